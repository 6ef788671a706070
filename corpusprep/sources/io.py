"""Readers and writers.

Layout: one table per stage with partition columns ``dataset`` and ``split``
(``{root}/dataset=../split=../part-*.parquet``), so choosing datasets/splits is
partition pruning and writing is one ``partitionBy`` job. Paths are Hadoop
paths (shared storage on a cluster); existence checks go through the Hadoop
FileSystem of the session, never a machine-local folder.
"""

from __future__ import annotations

import hashlib
import time
import uuid
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.session import checkpoint_dir

SPLITS = ("train", "validation", "test")
TEXT_SCHEMA = "text string"
VOCAB_FILE_SCHEMA = "id int, piece string, freq long, is_special boolean"
MAX_UINT16 = 65535


# --------------------------------------------------------------------------
# paths
# --------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-directories of ``path`` (driver-side listing of one
    directory level: bounded by the number of datasets/splits, not rows)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def count_files(spark: SparkSession, path: str) -> int:
    """Number of files at ``path`` (a folder, file or pattern), counted by the
    file system; 0 when there are none."""
    fs, p = _fs(spark, path)
    found = fs.globStatus(p) or []
    return sum(1 if s.isFile() else fs.getContentSummary(s.getPath()).getFileCount() for s in found)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/corpusprep-io/{name}-{uuid.uuid4().hex[:12]}"


# --------------------------------------------------------------------------
# sources
# --------------------------------------------------------------------------

def read_splits(spark: SparkSession, root: str, names: str | Sequence[str] = "all",
                splits: Sequence[str] = SPLITS, strict: bool = False) -> DataFrame:
    """The table under ``root`` restricted to datasets ``names`` ('all' =
    every dataset directory) and ``splits``. A missing dataset or split warns
    and is skipped (``strict``: raises). The restriction is a filter on the
    partition columns, so only the chosen directories are listed and read."""
    if not path_exists(spark, root):
        if strict:
            raise FileNotFoundError(root)
        warnings.warn(f"{root} does not exist")
        return spark.createDataFrame([], "dataset string, split string")
    present = {d.split("=", 1)[1] for d in list_dirs(spark, root) if d.startswith("dataset=")}
    wanted = sorted(present) if names == "all" else list(names)
    keep = []
    for n in wanted:
        if n not in present:
            if strict:
                raise FileNotFoundError(f"{root}/dataset={n}")
            warnings.warn(f"dataset {n} not found under {root}, skipped")
            continue
        have = {d.split("=", 1)[1] for d in list_dirs(spark, f"{root}/dataset={n}") if d.startswith("split=")}
        for s in splits:
            if s not in have:
                if strict:
                    raise FileNotFoundError(f"{root}/dataset={n}/split={s}")
                warnings.warn(f"split {s} of {n} not found, skipped")
        keep.append(n)
    df = spark.read.option("basePath", root).parquet(root)
    return df.filter(F.col("dataset").isin(keep) & F.col("split").isin(list(splits)))


def read_strict(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A missing path is an error (vocabulary jobs, loaders)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    r = spark.read.format(fmt)
    if schema:
        r = r.schema(schema)
    return r.load(path)


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str = TEXT_SCHEMA) -> DataFrame:
    """S3: JSON-lines shards of one split with an explicit schema (no inference
    pass over the data); ``file_name`` keeps the shard for name order (O2)."""
    return (spark.read.schema(schema).json(paths if isinstance(paths, str) else list(paths))
            .withColumn("file_name", F.col("_metadata.file_name")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A corpus text file, one sample per line -> (text)."""
    return spark.read.text(path).withColumnRenamed("value", "text")


# Named public tables. Each entry adapts one input shape to (dataset, text)
# from the given tables (the hub download itself is not built).
def _registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpusprep.functions import text as tx
    from corpusprep.operators import segment
    from corpusprep.sources import tables as tb

    def documents(spark, sf):
        return tb.text_table(spark, sf).select("dataset", "text")

    def wiki(spark, sf):
        return segment.coalesce_articles(tb.placed_wiki_lines(spark, sf), tb.WIKI_ORDER).select(F.lit("wiki").alias("dataset"), "text")

    def books(spark, sf):
        b = tb.books(spark, sf)
        return b.select(F.lit("books").alias("dataset"),
                        tx.book_text("title_src", "author_src", "date1_src", "text_by_page_src").alias("text"))

    def instructions(spark, sf):
        p, c = tx.format_instruction("instruction", "input", "output")
        return tb.instructions(spark, sf).select(F.lit("instructions").alias("dataset"),
                                                 F.concat(p, c).alias("text"))

    return {"documents": documents, "wiki": wiki, "books": books, "instructions": instructions}


PUBLIC_TABLES = tuple(sorted(_registry()))


def read_public_table(spark: SparkSession, name: str, source: str) -> DataFrame:
    """One named table adapted to (dataset, text)."""
    reg = _registry()
    if name not in reg:
        raise ValueError(f"unknown table: {name}")
    return reg[name](spark, source)


def read_public_tables(spark: SparkSession, names: Sequence[str], source: str) -> DataFrame:
    """S5 for several names at once (``unionByName``)."""
    out = None
    for n in names:
        d = read_public_table(spark, n, source)
        out = d if out is None else out.unionByName(d)
    return out


# --------------------------------------------------------------------------
# sinks
# --------------------------------------------------------------------------

def write_splits(df: DataFrame, root: str, partitions: Sequence[str] = ("dataset", "split"),
                 mode: str = "overwrite") -> str:
    """K1: one directory per dataset/split. Overwrite replaces only the
    partitions present in ``df`` (dynamic partition overwrite), so writing one
    dataset leaves the others in place. Rows are rebalanced by the partition
    columns: small partitions are gathered into few files, and a large one is
    split by size over as many tasks as it needs."""
    spark = df.sparkSession
    prev = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        (df.hint("rebalance", *partitions).write.mode(mode).partitionBy(*partitions).parquet(root))
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev)
    return root


def write_jsonl(df: DataFrame, root: str, records_per_file: int = 100, text: str = "text") -> str:
    """K2: rolling JSON-lines files of at most ``records_per_file`` rows
    ({"text": ...} per line)."""
    (df.select(text).write.mode("overwrite").option("maxRecordsPerFile", int(records_per_file))
     .json(root))
    return root


def write_numbered(df: DataFrame, root: str, order: Sequence[str], records_per_file: int = 100, prefix: str = "books",
                   text: str | Sequence[str] = "text") -> list[str]:
    """K2: JSON-lines files ``{prefix}_{00000}.jsonl``, ``{prefix}_{00001}.jsonl``
    ... of exactly ``records_per_file`` rows in ``order`` (unique), the last one
    of what is left. ``text`` names the column or columns of a record. Returns
    the names; an empty table gives none.

    Two phases: a row's file follows from its distributed rank, each file is
    written whole by one task into a staging folder under Spark's own commit
    protocol, and only when that job has committed are the files moved to their
    names. A failed job leaves no file under ``root``, and the staging folder
    goes in either case."""
    from corpusprep.operators.order import global_rank
    spark = df.sparkSession
    record = [text] if isinstance(text, str) else list(text)
    staging = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex[:12]}"
    fs, base = _fs(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        ranked = global_rank(df.select(*dict.fromkeys([*order, *record])), list(order), "_pos")
        number = F.floor((F.col("_pos") - 1) / int(records_per_file)).cast("long")
        (ranked.withColumn("_file", number).repartition("_file").sortWithinPartitions("_file", "_pos")
         .select("_file", *record).write.partitionBy("_file").json(staging))
        names = []
        for s in fs.listStatus(path(staging)):      # one entry per file written
            if not s.isDirectory():
                continue
            i = int(s.getPath().getName().split("=")[1])
            part = [x.getPath() for x in fs.listStatus(s.getPath()) if x.getPath().getName().startswith("part-")]
            name = f"{prefix}_{i:05d}.jsonl"
            fs.delete(path(base, name), False)
            if len(part) != 1 or not fs.rename(part[0], path(base, name)):
                raise OSError(f"{name} cannot be put in place")
            names.append(name)
        return sorted(names)
    finally:
        fs.delete(path(staging), True)


def stamp_in_name_order(spark: SparkSession, root: str, step_ms: int = 1000) -> int:
    """Give the files under ``root`` modification times that rise with their
    names, which is the order in which a file stream takes them. Returns the
    number of files (one call a file; the content is not touched)."""
    fs, p = _fs(spark, root)
    files = sorted((s.getPath() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[:1] not in "._"),
                   key=lambda f: f.getName())
    start = int(time.time() * 1000) - step_ms * len(files)
    for i, f in enumerate(files):
        fs.setTimes(f, start + i * step_ms, -1)
    return len(files)


def write_corpus(df: DataFrame, path: str, line: str = "line") -> str:
    """K3: one cleaned line per sample, UTF-8 text files."""
    df.select(line).write.mode("overwrite").text(path)
    return path


def save_vocab(vocab: DataFrame, path: str) -> str:
    """K4: vocabulary (id, piece, freq, is_special) as Parquet."""
    vocab.select("id", "piece", "freq", "is_special").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """K4: a missing vocabulary is an error."""
    return read_strict(spark, path, VOCAB_FILE_SCHEMA)


def vocab_fingerprint(vocab: DataFrame) -> str:
    """Order-free content key of a vocabulary: count and sum of xxhash64 over
    (id, piece) - one distributed aggregate, nothing collected but two numbers."""
    r = vocab.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("id", "piece").cast("decimal(38,0)")).alias("s")).first()
    return f"{int(r['n'])}-{abs(int(r['s'] or 0)) % (1 << 64):016x}"


def blocks_fingerprint(blocks: DataFrame) -> str:
    """Order-free content key of a block table: rows and sum of their hashes."""
    r = blocks.agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.xxhash64(*blocks.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{int(r['n'])}-{abs(int(r['s'] or 0)) % (1 << 64):016x}"


def write_token_blocks(blocks: DataFrame, root: str, source_key: str, vocab: DataFrame,
                       check_uint16: bool = True, settings: dict | None = None) -> tuple[str, bool]:
    """K5: the packed block table written once and re-used. The cache key is the
    source key, the vocabulary's fingerprint and the ``settings`` that shape the
    blocks (context length, order, seed, version of the input, ...). Without
    settings the blocks' own content is the key: they are computed to tell, but
    a stale table is never returned. Ids must fit 16 bits when
    ``check_uint16`` (max id checked on the vocabulary, not on the tokens)."""
    if check_uint16:
        top = vocab.agg(F.max("id")).first()[0]
        if top is not None and int(top) > MAX_UINT16:
            raise ValueError(f"id {top} does not fit 16 bits")
    if settings is None:
        tag = blocks_fingerprint(blocks)
    else:
        tag = hashlib.md5(repr(sorted(settings.items())).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{source_key}-{vocab_fingerprint(vocab)}-{tag}"
    spark = blocks.sparkSession
    if path_exists(spark, f"{path}/_SUCCESS"):
        return path, False
    blocks.write.mode("overwrite").parquet(path)
    return path, True


def run_name(run: str | None = None) -> str:
    """K6: the run directory name; a timestamp when not given."""
    if run:
        return run
    import datetime
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%d-%H%M%S")


RUN_BUCKETS = 32


def append_metrics(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """K6: append (run, tag, step, value[, text]) rows; ``overwrite`` replaces
    only the runs present in ``df``.

    A log may have more runs than a folder each would bear, so rows lie in
    ``RUN_BUCKETS`` partitions by the hash of their run, and an append writes a
    few files however many runs there are. An overwrite writes the partitions of
    its runs anew, with what they hold of other runs."""
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64("run"), F.lit(RUN_BUCKETS)).cast("int")
    rows = df.withColumn("bucket", bucket)
    if overwrite and any(d.startswith("bucket=") for d in list_dirs(spark, path)):
        runs = df.select("run").distinct()
        old = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
        touched = [r["bucket"] for r in runs.select(bucket.alias("bucket")).distinct().collect()]   # RUN_BUCKETS at most
        others = old.filter(F.col("bucket").isin(touched)).join(runs.withColumnRenamed("run", "_run"),
                                                                F.col("run").eqNullSafe(F.col("_run")), "left_anti")
        rows = rows.unionByName(others)
    write_splits(rows, path, ["bucket"], "overwrite" if overwrite else "append")
    return path


def hparams_table(metrics: DataFrame, hparams: dict[str, float]) -> DataFrame:
    """X11: per run the run parameters and the final value of every metric tag
    (value at the last step), as maps. One row per run; each map is bounded
    by the number of tags."""
    last = (metrics.groupBy("run", "tag")
            .agg(F.max_by("value", "step").alias("value")))
    hp = F.create_map(*[x for k, v in sorted(hparams.items()) for x in (F.lit(k), F.lit(float(v)))]) \
        if hparams else F.create_map().cast("map<string,double>")
    return (last.groupBy("run")
            .agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("metrics"))
            .withColumn("hparams", hp))
