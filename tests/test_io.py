"""Sources, sinks and streaming ingest: behaviour the oracle cannot see
(resume after restart, strict reads, cache keys, per-run overwrite)."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from corpusprep.sources import io
from corpusprep.sources import tables as tb
from corpusprep.streaming import ingest


def test_stream_ingest_resumes_without_rereading(spark, tmp_path):
    books = tb.books(spark, SMALL)
    shards, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    books.filter(F.col("book_id") % 2 == 0).write.option("maxRecordsPerFile", 50).json(shards + "/a")
    ingest.stream_ingest(spark, shards + "/*", out, ck, max_files_per_trigger=1)
    first = spark.read.parquet(out).count()
    # restart with nothing new: no row written twice
    ingest.stream_ingest(spark, shards + "/*", out, ck, max_files_per_trigger=1)
    assert spark.read.parquet(out).count() == first
    # new shards arrive: only they are processed
    books.filter(F.col("book_id") % 2 == 1).write.option("maxRecordsPerFile", 50).json(shards + "/b")
    ingest.stream_ingest(spark, shards + "/*", out, ck, max_files_per_trigger=1)
    got = spark.read.parquet(out)
    assert got.count() == books.count()
    assert got.select("book_id").distinct().count() == books.count()


def test_failed_books_are_counted_not_written(spark, tmp_path):
    rows = [(1, "T", "A", "1901", ["p1", "p2"], 2), (2, "T", None, "1902", ["p", None], 1),
            (3, None, None, None, ["x"], 1)]
    df = spark.createDataFrame(rows, ingest.BOOK_SCHEMA)
    shards = str(tmp_path / "in")
    df.write.json(shards)
    ingest.stream_ingest(spark, shards, str(tmp_path / "out"), str(tmp_path / "ck"))
    out = {r["book_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: "T by A, published 1901\np1p2", 3: "None by None, published None\nx"}
    ingest.running_totals(spark, shards, str(tmp_path / "tot"), str(tmp_path / "ck2"))
    t = spark.read.parquet(str(tmp_path / "tot")).first()
    assert (t["ok"], t["failed"], t["tokens"]) == (2, 1, 3)


def test_read_splits_missing_and_strict(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([("en", "train", "a"), ("en", "test", "b"), ("fr", "train", "c")],
                               "dataset string, split string, text string")
    io.write_splits(df, root)
    with pytest.warns(UserWarning):
        got = io.read_splits(spark, root, ["en", "de"], ["train", "validation"])
    assert sorted(r["text"] for r in got.collect()) == ["a"]
    with pytest.raises(FileNotFoundError):
        io.read_splits(spark, root, ["de"], strict=True)
    with pytest.raises(FileNotFoundError):
        io.read_strict(spark, str(tmp_path / "nope"))
    # overwriting one dataset keeps the others
    io.write_splits(spark.createDataFrame([("en", "train", "z")], df.schema), root)
    assert sorted(r["text"] for r in io.read_splits(spark, root).collect()) == ["b", "c", "z"]


def test_token_blocks_cache_keyed_by_vocab(spark, tmp_path):
    v1 = spark.createDataFrame([(0, "[UNK]", 0, True), (4, "▁a", 3, False)], io.VOCAB_FILE_SCHEMA)
    v2 = spark.createDataFrame([(0, "[UNK]", 0, True), (4, "▁b", 3, False)], io.VOCAB_FILE_SCHEMA)
    blocks = spark.createDataFrame([(0, [4, 4])], "block_id long, tokens array<int>")
    p1, new1 = io.write_token_blocks(blocks, str(tmp_path), "docs", v1)
    p1b, new1b = io.write_token_blocks(blocks, str(tmp_path), "docs", v1)
    p2, new2 = io.write_token_blocks(blocks, str(tmp_path), "docs", v2)
    assert new1 and not new1b and p1 == p1b and new2 and p2 != p1
    big = spark.createDataFrame([(70000, "x", 1, False)], io.VOCAB_FILE_SCHEMA)
    with pytest.raises(ValueError):
        io.write_token_blocks(blocks, str(tmp_path), "docs", big)


def test_append_metrics_and_overwrite_one_run(spark, tmp_path):
    path = str(tmp_path / "m")
    a = spark.createDataFrame([("r1", "loss", 1, 2.0), ("r2", "loss", 1, 3.0)], "run string, tag string, step long, value double")
    io.append_metrics(a, path)
    io.append_metrics(a.filter("run = 'r1'"), path)
    assert spark.read.parquet(path).count() == 3
    io.append_metrics(spark.createDataFrame([("r1", "loss", 9, 1.0)], a.schema), path, overwrite=True)
    got = sorted((r["run"], r["step"]) for r in spark.read.parquet(path).collect())
    assert got == [("r1", 9), ("r2", 1)]
    assert io.run_name("x") == "x" and len(io.run_name()) == 15


def test_public_table_registry(spark):
    t = io.read_public_tables(spark, io.PUBLIC_TABLES, SMALL)
    assert set(r["dataset"] for r in t.select("dataset").distinct().collect()) >= {"wiki", "books", "instructions"}
    with pytest.raises(ValueError):
        io.read_public_table(spark, "nope", SMALL)


def test_text_scan_spread_keeps_pushdown(spark):
    df = tb.read_table(spark, SMALL, "documents").filter(F.col("lang") == "en").select("doc_id")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism or \
        spark.read.parquet(f"{SMALL}/documents.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_block_cache_tells_contexts_and_inputs_apart(spark, tmp_path):
    from corpusprep.operators import pack, vocab
    tok = spark.createDataFrame([(i, list(range(4, 40))) for i in range(5)], "doc_id long, input_ids array<int>")
    from corpusprep.profiles import BASE_SPECIALS
    v = vocab.train_word_vocab(spark.createDataFrame([("a b c",)], "text string"), 10, BASE_SPECIALS)
    paths = []
    for ctx, t in ((16, tok), (32, tok), (16, tok.filter("doc_id < 4")), (16, tok)):
        blocks = pack.pack_blocks(t, ctx, ["doc_id"])
        path, new = io.write_token_blocks(blocks, str(tmp_path), "docs", v)
        assert spark.read.parquet(path).count() == blocks.count()
        paths.append((path, new))
    assert len({p for p, _ in paths}) == 3 and [n for _, n in paths] == [True, True, True, False]
    a, new_a = io.write_token_blocks(pack.pack_blocks(tok, 16, ["doc_id"]), str(tmp_path), "docs", v, settings={"ctx": 16})
    b, new_b = io.write_token_blocks(pack.pack_blocks(tok, 32, ["doc_id"]), str(tmp_path), "docs", v, settings={"ctx": 32})
    assert a != b and new_a and new_b


def test_a_skewed_dataset_is_written_by_many_tasks(spark, tmp_path):
    import glob
    df = spark.range(0, 60_000).selectExpr("case when id % 100 = 0 then 'fr' else 'en' end as dataset", "'train' as split",
                                           "id as doc_id", "md5(cast(id as string)) as text")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        io.write_splits(df.repartition(8), str(tmp_path / "s"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(glob.glob(str(tmp_path / "s/dataset=en/split=train/*.parquet"))) >= 4
    assert spark.read.parquet(str(tmp_path / "s")).count() == 60_000


def test_numbered_files_hold_exactly_n_rows_in_order(spark, tmp_path):
    import json
    import os

    rows = [(i * 7 % 1009, f"text {i}\nsecond \"line\" é") for i in range(1009)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    root = f"{tmp_path}/out"
    names = io.write_numbered(df, root, ["doc_id"], 100)
    assert names == [f"books_{i:05d}.jsonl" for i in range(11)]
    assert sorted(n for n in os.listdir(root) if not n.startswith(".")) == names
    want = [t for _, t in sorted(rows)]
    got = []
    for i, n in enumerate(names):
        with open(f"{root}/{n}", encoding="utf-8") as f:
            lines = [json.loads(x) for x in f]
        assert len(lines) == (100 if i < 10 else 9) and all(set(x) == {"text"} for x in lines)
        got += [x["text"] for x in lines]
    assert got == want
    assert io.write_numbered(df.limit(0), f"{tmp_path}/none", ["doc_id"]) == []


def test_a_failed_write_leaves_no_numbered_file(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 444, F.raise_error("broken")).otherwise(
        F.col("id").cast("string")).alias("text"))
    root = f"{tmp_path}/out"
    with pytest.raises(Exception, match="broken"):
        io.write_numbered(df, root, ["doc_id"], 100)
    assert not os.path.exists(root) or not [n for n in os.listdir(root) if not n.startswith(".")]


def _book_shards(spark, root, n, per_file):
    rows = [(i, f"T{i}", "A", "1901", ["p", None] if i % 5 == 0 else [f"p{i}"], i) for i in range(n)]
    io.write_numbered(spark.createDataFrame(rows, ingest.BOOK_SCHEMA), root, ["book_id"], per_file,
                      text=["book_id", "title_src", "author_src", "date1_src", "text_by_page_src", "token_count"])
    assert io.stamp_in_name_order(spark, root) == -(-n // per_file)


def _quota_state(spark, out):
    totals = {r["split"]: (r["records"], r["ok"], r["failed"], r["tokens"]) for r in ingest.quota_totals(spark, out).collect()}
    rows = {}
    for r in ingest.quota_rows(spark, out).collect():
        rows.setdefault(r["split"], []).append(r["book_id"])
    return totals, {s: sorted(v) for s, v in rows.items()}


def _expected_quotas(quotas, n):
    totals, rows, at = {}, {}, 0
    for s, q in quotas.items():
        ids = range(at, min(at + q, n))
        ok = [i for i in ids if i % 5]
        totals[s] = (len(ids), len(ok), len(ids) - len(ok), sum(ok))
        if ok:
            rows[s] = ok
        at += q
    return totals, rows


@pytest.mark.parametrize("files", [1, 3, 100])
def test_stream_quota_stops_after_its_records(spark, tmp_path, files):
    shards, out = str(tmp_path / "in"), str(tmp_path / "out")
    _book_shards(spark, shards, 60, 7)
    quotas = {"train": 25, "none": 0, "validation": 3, "test": 4}     # two splits end inside one shard
    ingest.stream_quota(spark, shards, out, str(tmp_path / "ck"), quotas, max_files_per_trigger=files)
    assert _quota_state(spark, out) == _expected_quotas(quotas, 60)
    # a finished run reads nothing more, other quotas are refused
    assert ingest.stream_quota(spark, shards, out, str(tmp_path / "ck"), quotas, max_files_per_trigger=files) is None
    with pytest.raises(ValueError):
        ingest.stream_quota(spark, shards, out, str(tmp_path / "ck"), {**quotas, "test": 5})


def test_stream_quota_is_exact_after_interruptions(spark, tmp_path):
    from pyspark.errors import StreamingQueryException
    shards, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    _book_shards(spark, shards, 40, 6)
    quotas = {"train": 20, "validation": 9, "test": 100}              # the stream ends before the last is full
    calls = []

    def breaks(books, *keep):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("interrupted")
        return ingest.format_books(books, *keep)

    with pytest.raises(StreamingQueryException):
        ingest.stream_quota(spark, shards, out, ck, quotas, transform=breaks)
    assert ingest.quota_totals(spark, out).agg(F.sum("records")).first()[0] == 12
    ingest.stream_quota(spark, shards, out, ck, quotas)
    want = _expected_quotas(quotas, 40)
    assert _quota_state(spark, out) == want
    # stopped after the last batch was written, before it was committed: it runs again
    last = max(int(f) for f in os.listdir(f"{ck}/commits") if f.isdigit())
    for f in (f"{ck}/commits/{last}", f"{ck}/commits/.{last}.crc"):
        os.remove(f)
    ingest.stream_quota(spark, shards, out, ck, quotas)
    assert _quota_state(spark, out) == want
    # later shards go on where the stream ended
    io.write_numbered(spark.createDataFrame([(i, "T", "A", "1", [f"p{i}"] if i % 5 else ["p", None], i) for i in range(40, 50)],
                                            ingest.BOOK_SCHEMA), shards, ["book_id"], 10, "later",
                      text=["book_id", "title_src", "author_src", "date1_src", "text_by_page_src", "token_count"])
    ingest.stream_quota(spark, shards, out, ck, quotas)
    assert _quota_state(spark, out) == _expected_quotas(quotas, 50)


def test_stream_quota_over_repeated_records(spark, tmp_path):
    """Equal records at a split's end are told apart by where they were read."""
    shards, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(7, "T", "A", "1", ["p"], 1)] * 30, ingest.BOOK_SCHEMA).coalesce(1).write.json(shards)
    ingest.stream_quota(spark, shards, out, str(tmp_path / "ck"), {"train": 11, "test": 4})
    totals, rows = _quota_state(spark, out)
    assert totals == {"train": (11, 11, 0, 11), "test": (4, 4, 0, 4)}
    assert {s: len(v) for s, v in rows.items()} == {"train": 11, "test": 4}


def test_stream_backlog_takes_a_bounded_number_of_batches(spark, tmp_path):
    """However many files wait, a run's micro-batches are bounded (one a file before)."""
    shards, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    n = 3 * ingest.MAX_BATCHES
    rows = [(i, f"Doc {i}", "a", "1900", ["x", "y"], 2) for i in range(n)]
    (spark.createDataFrame(rows, ingest.BOOK_SCHEMA).coalesce(1).write.option("maxRecordsPerFile", 1).json(shards))
    assert n <= io.count_files(spark, shards) == io.count_files(spark, shards + "/*") <= n + 1      # the files and _SUCCESS
    q = ingest.running_totals(spark, shards, out, ck)
    assert q.lastProgress["batchId"] < ingest.MAX_BATCHES
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(n, 0, 2 * n)]


def test_metrics_of_many_runs_take_few_files(spark, tmp_path):
    """Folders and files do not grow with the runs; other runs of a bucket, null ones too, survive an overwrite."""
    path, schema = str(tmp_path / "m"), "run long, tag string, step long, value double"
    a = spark.createDataFrame([(None if i == 7 else i, "loss", s, float(s)) for i in range(300) for s in range(2)], schema)
    io.append_metrics(a, path)
    io.append_metrics(a.filter("run = 1"), path)
    assert len(io.list_dirs(spark, path)) <= io.RUN_BUCKETS
    io.append_metrics(spark.createDataFrame([(1, "loss", 9, 1.0), (None, "loss", 9, 1.0)], schema), path, overwrite=True)
    got = sorted((-1 if r["run"] is None else r["run"], r["step"]) for r in spark.read.schema(schema).parquet(path).collect())
    assert got == sorted([(-1, 9), (1, 9)] + [(i, s) for i in range(300) if i not in (1, 7) for s in range(2)])
