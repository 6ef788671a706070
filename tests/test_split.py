"""Splits: exact sizes, disjoint and complete."""

import pytest
from pyspark.sql import functions as F

from corpusprep.operators import split
from corpusprep.sources import tables as tb
from conftest import SMALL


def test_split_exact_sizes(spark):
    t = tb.text_table(spark, SMALL)
    n = t.count()
    s = split.split_exact(t, "doc_id", 20, 42)
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"validation": 10, "test": 10, "train": n - 20}
    assert s.select("doc_id").distinct().count() == n


def test_split_exact_per_group_large_n_path(spark):
    # n above the window-group-limit threshold takes the range-rank path
    df = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("g"))
    s = split.split_exact(df, "k", 1200, 7, by="g")
    c = {(r["g"], r["split"]): r["count"] for r in s.groupBy("g", "split").count().collect()}
    assert c[("0", "validation")] == 600 and c[("0", "test")] == 600 and c[("0", "train")] == 300


def test_split_sequential_disjoint(spark):
    b = tb.books(spark, SMALL)
    s = split.split_sequential(b, "book_id", [("train", 50), ("validation", 10), ("test", 10)])
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 50, "validation": 10, "test": 10}
    assert s.select("book_id").distinct().count() == 70


def test_interleave_stops_at_first_exhausted(spark):
    t = tb.text_table(spark, SMALL)
    m = min(r["count"] for r in t.groupBy("dataset").count().collect())
    out = split.interleave(t, "dataset", ["doc_id"], ["en", "fr", "de", "es"])
    assert out.count() == 4 * m
    pos = sorted(r["position"] for r in out.collect())
    assert pos == list(range(4 * m))


def test_sample_rows_with_replacement(spark):
    from corpusprep.operators.order import global_rank
    r = global_rank(spark.range(10).withColumnRenamed("id", "k"), ["k"])
    s = split.sample_rows(r, 100, 3)
    assert s.count() == 100 and s.select("k").distinct().count() <= 10


def test_shards_are_a_share_of_the_rows(spark):
    import warnings

    from pyspark.sql import functions as F

    rows = [(i, ["a", "b", "c"][i % 3], f"s{i % 7}", "x" * 50) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, dataset string, shard string, text string")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = split.sample_by_shards(df, {"a": 2, "b": 9, "c": 0}, "doc_id", "shard")
    assert any("9 shards of b" in str(w.message) for w in seen)
    got = {r["dataset"]: r["count"] for r in out.groupBy("dataset").count().collect()}
    assert got == {"a": 100 * 2 // 7, "b": 100} and out.columns == df.columns
    order = {r["doc_id"]: r["h"] for r in df.select("doc_id", split.hash_order(42, "doc_id").alias("h")).collect()}
    a = sorted((i for i in order if i % 3 == 0), key=lambda i: (order[i], i))[:28]
    assert {r["doc_id"] for r in out.filter("dataset = 'a'").collect()} == set(a)
    # the text takes no shuffle: a broadcast of the edges, then a filter
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "SortMergeJoin" not in plan
    with pytest.raises(FileNotFoundError, match="nowhere"):
        split.sample_by_shards(df, {"nowhere": 1}, "doc_id", "shard")
    assert split.sample_by_shards(df, {}, "doc_id", "shard").count() == 0
    assert df.filter(F.lit(False)).count() == split.sample_by_fraction(df, {"a": 0.001}, "doc_id").count() == 0
