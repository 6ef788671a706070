"""The pipeline's stages on small tables against plain versions."""

from collections import Counter

import corpus_pipeline as cp
from corpusprep.llm import quality
from corpusprep.llm.common import read, table
from conftest import SMALL
from llm import brute


def test_stages_in_order(spark):
    docs = read(spark, SMALL, "documents")
    columns = docs.columns
    stage = dict(cp.STAGES)
    good = table(stage["quality classifier"](spark, docs, SMALL), "t")
    want = quality.classify(docs, read(spark, SMALL, "labels")).filter("kept")
    assert good.columns == columns
    assert Counter(r[0] for r in good.select("doc_id").collect()) == Counter(r[0] for r in want.select("doc_id").collect())

    lines = table(stage["line dedup"](spark, good, SMALL), "t")
    assert lines.columns == columns and lines.count() == good.count()
    site, whole = {}, {}
    rows = good.collect()
    for r in rows:
        whole.setdefault(r["text"], set()).add(r["source"])
        for x in (r["text"] or "").split("\n"):
            site.setdefault(x.strip(" \t\r\x0b\x0c"), set()).add(r["source"])
    after = {r["doc_id"]: r["text"] for r in lines.collect()}
    for r in rows:
        ls = r["text"].split("\n")
        spread = [x for x in ls if x.strip(" \t\r\x0b\x0c") and len(site[x.strip(" \t\r\x0b\x0c")]) >= 5]
        want = "\n".join(x for x in ls if x not in spread) if len(whole[r["text"]]) < 5 else r["text"]
        assert after[r["doc_id"]] == want

    one = table(stage["n-gram Jaccard join"](spark, lines, SMALL), "t")
    rows = sorted((r["doc_id"], r["text"]) for r in lines.collect())
    root = brute.reach(len(rows), brute.jaccard_links([t for _, t in rows]))
    assert one.columns == columns
    assert sorted(r["doc_id"] for r in one.collect()) == [k for i, (k, _) in enumerate(rows) if root[i] == i]

    mixed = table(stage["mixing"](spark, one, SMALL), "t")
    assert mixed.columns == columns
    size = Counter()
    for r in one.collect():
        size[r["source"]] += len(brute.words(r["text"]))
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(brute.words(r["text"]))
    assert all(taken[s] <= 3 * size[s] for s in size) and sum(taken.values()) > 0.8 * sum(size.values())

    out = stage["BPE encoding and decoding"](spark, mixed, SMALL)
    assert out.count() == mixed.count()


def test_run_gives_the_last_stage(spark):
    out = cp.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and extra
    columns pass every stage; empty tables give empty results."""
    rows = brute.awkward(spark)
    labels = read(spark, SMALL, "labels")
    for name, docs, marks in (("awkward", rows, labels), ("empty", brute.empty(spark), labels), ("bare", brute.empty(spark), labels.limit(0))):
        sf = f"{tmp_path}/{name}"
        docs.write.parquet(f"{sf}/documents.parquet")
        marks.write.parquet(f"{sf}/labels.parquet")
        docs = read(spark, sf, "documents")
        for i, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, sf)
            if i < len(cp.STAGES) - 1:
                assert out.columns == docs.columns
                out = table(out, "t")
            assert out.count() <= 3 * rows.count() and (name == "awkward" or out.count() == 0)
            docs = out
    # without the column that only counts characters
    out = dict(cp.STAGES)["line dedup"](spark, rows.drop("n_chars"), "")
    assert out.columns == rows.drop("n_chars").columns
