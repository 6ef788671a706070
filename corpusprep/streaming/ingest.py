"""Resumable ingest and running counters (S6, A9) with Structured Streaming.

The reference pulls a streamed dataset record by record, counts finished
files to resume after an interruption and keeps ok/failed/token counters
under a lock. Here the source is a folder of shard files read with
``readStream`` (``maxFilesPerTrigger`` bounds each micro-batch; a backlog that
would take more than ``MAX_BATCHES`` of them gets larger ones, so their fixed
costs do not grow with the number of files), the sink is
Parquet with a checkpoint location (exactly-once: a restarted query resumes
after the last committed batch and never re-reads a finished file), and the
counters are a streaming aggregate whose state lives in the same checkpoint.
``trigger(availableNow=True)`` drains what is there and stops; no port is
opened.

``stream_quota`` fills splits one after the other, each with a fixed number of
records of the stream, and then stops. Counting records per split in keyed
state would send a split's records to one task; here a micro-batch looks up the
keys at which splits end (order columns only), the records are labelled by
comparison where they were read, and the counters are observed while they are
written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.operators.order import keys_at, order_key
from corpusprep.sources import io

BOOK_SCHEMA = ("book_id long, title_src string, author_src string, date1_src string, "
               "text_by_page_src array<string>, token_count int")


# Micro-batches that one run may take for the files that are there.
MAX_BATCHES = 32


def read_stream(spark: SparkSession, in_dir: str, schema: str, fmt: str = "json",
                max_files_per_trigger: int = 1, max_batches: int | None = MAX_BATCHES) -> DataFrame:
    """The files under ``in_dir`` as a stream, ``max_files_per_trigger`` in a
    micro-batch, or as many more as it takes to be through with those present
    in ``max_batches`` (None: never more)."""
    files = int(max_files_per_trigger)
    if max_batches:
        files = max(files, -(-io.count_files(spark, in_dir) // int(max_batches)))
    return (spark.readStream.schema(schema).format(fmt)
            .option("maxFilesPerTrigger", files).load(in_dir))


def book_failed(pages: str = "text_by_page_src"):
    """A book with a missing page list or a null page cannot be formatted."""
    return F.col(pages).isNull() | F.exists(pages, lambda p: p.isNull())


def format_books(books: DataFrame, *keep: str) -> DataFrame:
    """P2 on the stream: (book_id, text, token_count) of the books that can be
    formatted, and the columns ``keep``."""
    ok = books.filter(~book_failed())
    return ok.select("book_id", tx.book_text("title_src", "author_src", "date1_src", "text_by_page_src")
                     .alias("text"), "token_count", *keep)


def stream_ingest(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                  schema: str = BOOK_SCHEMA, fmt: str = "json", max_files_per_trigger: int = 1,
                  transform=format_books):
    """Every shard under ``in_dir`` -> ``transform`` -> Parquet at ``out_dir``.
    Re-running with the same checkpoint processes only shards not yet
    committed. Returns the finished query (its progress holds per-batch row
    counts)."""
    src = read_stream(spark, in_dir, schema, fmt, max_files_per_trigger)
    q = (transform(src).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def running_totals(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                   schema: str = BOOK_SCHEMA, fmt: str = "json", max_files_per_trigger: int = 1):
    """Ok / failed / token counters over the stream. A global streaming
    aggregate (partial per task, one merged state row) in complete mode; each
    micro-batch overwrites ``out_dir`` with the current totals, so the table
    always holds the totals of everything committed so far."""
    src = read_stream(spark, in_dir, schema, fmt, max_files_per_trigger)
    failed = book_failed()
    agg = src.agg(F.count(F.when(~failed, 1)).alias("ok"),
                  F.count(F.when(failed, 1)).alias("failed"),
                  F.coalesce(F.sum(F.when(~failed, F.col("token_count"))), F.lit(0)).cast("long").alias("tokens"))

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(out_dir)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# Where a record stands in the stream: its file's time and path, then its own key.
STREAM_ORDER = ("_time", "_file")
LEDGER_SCHEMA = "split string, quota long, records long, ok long, failed long, tokens long"
COUNTERS = ("records", "ok", "failed", "tokens")


def _ledger(spark: SparkSession, out_dir: str, batch_id: int) -> list:
    """The counters after a micro-batch, a row per split in their order."""
    path = f"{out_dir}/ledger/batch={batch_id}"
    if not io.path_exists(spark, path):
        raise FileNotFoundError(f"{path}: the counters do not belong to this checkpoint")
    return sorted(spark.read.schema("i int, " + LEDGER_SCHEMA).json(path).collect(), key=lambda r: r["i"])


def stream_quota(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, quotas: dict[str, int],
                 order: Sequence[str] = ("book_id",), schema: str = BOOK_SCHEMA, fmt: str = "json",
                 max_files_per_trigger: int = 1, transform=format_books, failed=book_failed,
                 tokens: str = "token_count"):
    """S6 with A9: the next ``quotas[s]`` records of the stream for each split in
    turn, then the stream stops, however much input is left. A record that
    cannot be formatted counts as taken and as failed and is not written.

    Records come by file time, file path and ``order``; repeated ones by where
    they were read. Each micro-batch is written to a folder of its own under
    ``{out_dir}/data`` and its counters to ``{out_dir}/ledger``, from the
    counters of the batch before. A batch that was interrupted runs again under
    the same number and overwrites both, so the counts are exact after any
    restart. A finished run that is started again reads nothing. The quotas of a
    run are fixed: other ones under the same folder are an error. Returns the
    finished query."""
    goal = sum(quotas.values())
    reached = []
    src = (read_stream(spark, in_dir, schema, fmt, max_files_per_trigger)
           .select("*", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_file")))

    def take(batch: DataFrame, batch_id: int):
        session = batch.sparkSession
        if batch_id:
            before = {r["split"]: r.asDict() for r in _ledger(session, out_dir, batch_id - 1)}
            if {s: r["quota"] for s, r in before.items()} != quotas:
                raise ValueError(f"{out_dir} was begun with other quotas")
        else:
            before = {s: dict.fromkeys(COUNTERS, 0) for s in quotas}
        done = sum(r["records"] for r in before.values())
        after = {s: dict(before[s]) for s in quotas}
        if done < goal:
            keys = [*STREAM_ORDER, *order, "_row"]
            rows = batch.withColumn("_row", F.monotonically_increasing_id())
            ends, end = {}, 0
            for s, n in quotas.items():
                end += n
                ends[s] = end - done
            edges = keys_at(rows, sorted({e for e in ends.values() if e > 0}), keys)
            # the splits that are not full yet, up to the one this batch does not fill
            label, past = None, F.lit(None).cast("string")
            for s, e in ends.items():
                if quotas[s] == 0 or e <= 0:
                    continue
                if e not in edges:
                    past = F.lit(s)
                    break
                here = order_key(keys) <= edges[e]
                label = F.when(here, s) if label is None else label.when(here, s)
            rows = rows.withColumn("split", past if label is None else label.otherwise(past))
            bad, seen = failed(), Observation()
            counts = []
            for i, s in enumerate(quotas):
                mine = F.col("split") == s
                counts += [F.count(F.when(mine, 1)).alias(f"records{i}"), F.count(F.when(mine & ~bad, 1)).alias(f"ok{i}"),
                           F.count(F.when(mine & bad, 1)).alias(f"failed{i}"),
                           F.coalesce(F.sum(F.when(mine & ~bad, F.col(tokens))), F.lit(0)).cast("long").alias(f"tokens{i}")]
            kept = rows.observe(seen, *counts).filter(F.col("split").isNotNull())
            # one folder a split, in which the transform's columns stand
            (kept.transform(lambda d: transform(d, "split")).write.mode("overwrite").partitionBy("split")
             .parquet(f"{out_dir}/data/batch={batch_id}"))
            got = seen.get
            for i, s in enumerate(quotas):
                for c in COUNTERS:
                    after[s][c] += got[f"{c}{i}"]
        rows = [(i, s, quotas[s], *(after[s][c] for c in COUNTERS)) for i, s in enumerate(quotas)]
        (session.createDataFrame(rows, "i int, " + LEDGER_SCHEMA).coalesce(1).write.mode("overwrite")
         .json(f"{out_dir}/ledger/batch={batch_id}"))
        if sum(r["records"] for r in after.values()) >= goal:
            reached.append(batch_id)

    last = _last_batch(spark, out_dir)
    if last is not None:
        have = _ledger(spark, out_dir, last)
        if {r["split"]: r["quota"] for r in have} != quotas:
            raise ValueError(f"{out_dir} was begun with other quotas")
        if sum(r["records"] for r in have) >= goal:
            return None
    q = (src.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    while not q.awaitTermination(0.2):
        if reached:
            q.stop()
    return q


def _last_batch(spark: SparkSession, out_dir: str) -> int | None:
    done = [int(d.split("=", 1)[1]) for d in io.list_dirs(spark, f"{out_dir}/ledger") if d.startswith("batch=")]
    done = [b for b in done if io.path_exists(spark, f"{out_dir}/ledger/batch={b}/_SUCCESS")]
    return max(done, default=None)


def quota_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """The counters of a ``stream_quota`` folder (split, quota, records, ok,
    failed, tokens), after the last batch written."""
    last = _last_batch(spark, out_dir)
    if last is None:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).json(f"{out_dir}/ledger/batch={last}")


def quota_rows(spark: SparkSession, out_dir: str, schema: str = "book_id long, text string, token_count int") -> DataFrame:
    """What ``stream_quota`` wrote: the transform's columns and ``split``. Only
    batches with counters count."""
    last = _last_batch(spark, out_dir)
    if last is None:
        return spark.createDataFrame([], f"{schema}, split string")
    return (spark.read.schema(f"{schema}, batch int, split string").parquet(f"{out_dir}/data")
            .filter(F.col("batch") <= last).drop("batch"))
