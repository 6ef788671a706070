"""Operator 5 against all pairs: recall, nothing below the threshold, counts."""

import numpy as np

from corpusprep.llm import lattice as L
from corpusprep.llm.common import read
from conftest import SMALL
from llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, node string, cell long"


def groups(seed=0, dim=64, n=60, clusters=6, spread=0.08):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(clusters):
        centre = rng.standard_normal(dim)
        for _ in range(n // clusters * (3 if c == 0 else 1)):
            out.append((centre + spread * rng.standard_normal(dim) * rng.uniform(0.3, 1.2)).astype("float32"))
    out += list(rng.standard_normal((n, dim)).astype("float32"))
    return [(i, [float(x) for x in v], int(i % 7 == 0), "x", 1) for i, v in enumerate(out)]


def links_of(rows, cosine=0.98):
    out = []
    unit = {}
    for i, (_, v, lab, *_) in enumerate(rows):
        if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            unit[i] = x / np.linalg.norm(x)
    for i in unit:
        for j in unit:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                out.append((i, j))
    return out


def run(spark, rows, **options):
    return {r["vec_id"]: r for r in L.near_duplicates(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def check(spark, rows, **options):
    links = links_of(rows)
    got = run(spark, rows, **options)
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows)
    assert all(got[r[0]]["n_links"] <= n[i] for i, r in enumerate(rows))
    found = sum(g["n_links"] for g in got.values())
    assert found >= 0.97 * sum(n) and sum(n) > 100
    if found == sum(n):
        root = brute.reach(len(rows), links)
        assert all(got[r[0]]["component_id"] == rows[root[i]][0] for i, r in enumerate(rows))


def test_groups(spark):
    check(spark, groups())


def test_crowded_cells_in_blocks(spark):
    check(spark, groups(1, spread=0.03), block=4)


def test_awkward_rows(spark):
    v = groups()[0][1]
    rows = [(1, v, 0, "x", 1), (2, v, 0, "x", 1), (3, [2 * x for x in v], 0, "x", 1), (4, v, 1, "x", 1),
            (5, v, None, "x", 1), (6, None, 0, "x", 1), (7, [0.0] * 64, 0, "x", 1), (8, [None, *v[1:]], 0, "x", 1),
            (9, [float("nan"), *v[1:]], 0, "x", 1), (10, [float("inf"), *v[1:]], 0, "x", 1), (11, [], 0, "x", 1),
            (12, v[:8], 0, "x", 1), (13, [-x for x in v], 0, "x", 1)]
    got = run(spark, rows)
    assert {k: (g["n_links"], g["component_id"], g["kept"]) for k, g in got.items()} == {
        1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False),
        **{k: (0, k, True) for k in range(4, 14)}}
    assert not run(spark, [])
    twice = L.near_duplicates(spark.createDataFrame([rows[0], rows[0]], SCHEMA)).collect()
    assert [(r["n_links"], r["component_id"]) for r in twice] == [(1, 1)] * 2


def test_recall_on_the_given_vectors(spark):
    rows = [tuple(r) for r in read(spark, SMALL, "embeddings").select("vec_id", "embedding", "label").collect()]
    links = links_of(rows)
    got = {r["vec_id"]: r for r in L.near_duplicates(read(spark, SMALL, "embeddings")).collect()}
    assert sum(g["n_links"] for g in got.values()) >= 0.9 * 2 * len(links)


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)) * 2
    p = L.e8(x)
    v = L.shortest()
    assert len(np.unique(v, axis=0)) == 240 and np.allclose((v ** 2).sum(axis=1), 2)
    assert np.allclose(p * 2, np.round(p * 2)) and np.allclose(p.sum(axis=1) % 2, 0)
    mine = ((x - p) ** 2).sum(axis=1)
    assert (mine <= (((x - p)[:, None] - v[None]) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()


def test_labels_of_any_type(spark):
    """Text labels are compared as they are; results equal those of numbers."""
    docs = read(spark, SMALL, "embeddings")
    plain = sorted(tuple(r) for r in L.near_duplicates(docs).collect())
    for kind in ("concat('label ', label)", "cast(label as double)"):
        got = sorted(tuple(r) for r in L.near_duplicates(docs.selectExpr("vec_id", "embedding", f"{kind} as label")).collect())
        assert got == plain


def test_cells_keep_growing_with_the_vectors():
    scales = [L.scale_for(10 ** k) for k in range(3, 13)]
    assert all(a < b for a, b in zip(scales[2:], scales[3:]))
