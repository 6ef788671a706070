"""Operator 6 against all pairs."""

import numpy as np

from corpusprep.llm import ngram_join as nj
from corpusprep.llm.common import read
from conftest import SMALL
from llm import brute


def check(docs, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    links = brute.jaccard_links([t for _, t in rows])
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = brute.reach(len(rows), links)
    least = {}
    for (k, _), c in zip(rows, root):
        least[c] = min([x for x in (k, least.get(c)) if x is not None], default=None)
    want = brute.key_of((k, least[c], m) for (k, _), c, m in zip(rows, root, n))
    got = nj.similar(docs, **options).collect()
    assert brute.key_of((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    return got


def test_documents(spark):
    check(read(spark, SMALL, "documents"))


def test_awkward_rows(spark):
    got = check(brute.awkward(spark))
    assert {r["doc_id"] for r in got if r["kept"]} == {1, 3, 4, 5, None, 6, 8, 11, 13, 20}
    assert nj.similar(brute.empty(spark)).count() == 0


def test_large_group_in_blocks(spark):
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 4)):
            w[j] = f"x{rng.integers(0, 3)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), block_nodes=16)


def test_one_of_each(spark):
    docs = brute.awkward(spark)
    out = nj.one_of_each(docs)
    assert out.columns == docs.columns
    ids = sorted(r["doc_id"] or 0 for r in out.collect())
    assert ids == [0, 0, 1, 3, 4, 5, 6, 8, 11, 13, 20]
    assert nj.one_of_each(brute.empty(spark)).count() == 0


def test_bands_reach_the_recall():
    for s in (0.5, 0.8, 0.95):
        for r in (3, 5):
            b = nj.bands_for(s, 0.9999, r)
            assert 1 - (1 - s ** r) ** b >= 0.9999 > 1 - (1 - s ** r) ** (b - 1)


def near_copies(n, words=110, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        w[int(rng.integers(words))] = f"x{i}"
        out.append((i, " ".join(w)))
    return out


def test_edges_of_a_large_group_grow_with_it(spark, monkeypatch):
    """Verified edges number at most one per node, and candidate edges a few,
    however large a group of near copies is."""
    seen = []
    plain = nj.components
    monkeypatch.setattr(nj, "components", lambda e: (seen.append(e.count()), plain(e))[1])
    for m in (1000, 4000, 16_000):
        seen.clear()
        got = nj.similar(spark.createDataFrame(near_copies(m), "doc_id long, text string"), block_nodes=512).select(
            "class_id", "n_links").distinct().collect()
        candidates, verified = seen
        assert candidates <= 24 * m and verified <= m + (m / 512) ** 2
        assert len(got) < 3000 and all(r["n_links"] > 0.5 * m for r in got) and {r["class_id"] for r in got} == {0}


def test_links_across_blocks_make_one_class(spark):
    """Chains whose neighbours stand in different blocks."""
    rows, w = [], [f"c{i}" for i in range(70)]
    for i in range(60):
        w = w[2:] + [f"n{i}a", f"n{i}b"]
        rows.append((i, " ".join(w)))
    check(spark.createDataFrame(rows + near_copies(40, seed=3), "doc_id long, text string"), block_nodes=4)
