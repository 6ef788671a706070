"""Readers of the driver's tables and the input shapes derived from them.

The reference reads hub datasets; here each input shape of its scripts is
derived from the given tables by a Spark job (so the work grows with them):

* text            (dataset, doc_id, source, text)          <- documents
* wiki lines      (pos, text ending in newline)            <- documents
* books           (book_id, title/author/date, pages, n)   <- documents
* instructions    (id, instruction, input, output)         <- conversations
* messages        (message_id, parent_id, role, text, rank)<- conversations
* metrics         (run, tag, step, ts, value)              <- events
* candidates      (group_id, item_id, score)               <- embeddings
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusprep.operators.order import hash_int, rank_within
from corpusprep.session import ship_package

# Fixed values of the derivations (must equal the oracle SQL).
WIKI_LINE_STRIDE = 100000      # pos = doc_id * stride + line index: a name for a line, not its order
BOOK_AUTHOR_NULL_MOD = 7       # author NULL when doc_id % 7 = 0
BOOK_YEAR_BASE = 1900          # date = 1900 + doc_id % 100
MESSAGE_GROUP = 4              # conversations grouped by conv_id div 4
RANK_MOD = 5                   # rank = h(message_id) % 5, 4 -> NULL


# Tables whose rows carry text: per-row work on them (pre-tokenising, encoding,
# regex splits) is CPU-bound.
TEXT_TABLES = frozenset({"documents", "conversations", "pages"})


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Scan-parallelism floor: a text table read as fewer partitions than the
    cluster's default parallelism (a small file with one row group) is
    spread round-robin so CPU-bound per-row work uses every core. A large scan
    already has enough splits and is left alone; filters and column pruning
    still reach the scan below the repartition."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, doc_id, source, text): the pre-training text shape."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("dataset"), "doc_id", "source", "text")


# Order of the lines: documents of one doc_id (or none) stay apart by their
# text, exact copies by the row they came from.
WIKI_ORDER = ("doc_id", "doc", "copy", "line")


def placed_wiki_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat line stream: per document a title line, a blank line, then every
    text line, each ending in a newline; ordered by ``WIKI_ORDER``."""
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("doc"),
        F.monotonically_increasing_id().alias("copy"), "text")
    title = F.concat(F.lit(" = Doc "), F.col("doc_id").cast("string"), F.lit(" = \n"))
    body = F.transform(F.split("text", "\n"), lambda x: F.concat(x, F.lit("\n")))
    lines = F.concat(F.array(title, F.lit(" \n")), F.coalesce(body, F.array().cast("array<string>")))
    return (d.select("doc_id", "doc", "copy", F.posexplode(lines).alias("line", "text"))
            .withColumn("pos", F.col("doc_id") * WIKI_LINE_STRIDE + F.col("line")))


def wiki_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with their ``pos`` only, in no order."""
    return placed_wiki_lines(spark, sf_dir).select("pos", "text")


def word_count(text) -> F.Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("book_id"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title_src"),
        F.when(F.col("doc_id") % BOOK_AUTHOR_NULL_MOD == 0, F.lit(None).cast("string"))
         .otherwise(F.col("source")).alias("author_src"),
        (F.lit(BOOK_YEAR_BASE) + F.col("doc_id") % 100).cast("string").alias("date1_src"),
        F.split("text", "\n").alias("text_by_page_src"),
        word_count(F.col("text")).alias("token_count"))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instruction row per conversation that has an assistant turn."""
    c = read_table(spark, sf_dir, "conversations")

    def first(role):
        return F.min(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]

    g = c.groupBy("conv_id").agg(first("system").alias("sys"), first("user").alias("usr"),
                                 first("assistant").alias("output"))
    return (g.filter(F.col("output").isNotNull())
            .select(F.col("conv_id").alias("id"),
                    F.coalesce("sys", "usr").alias("instruction"),
                    F.when(F.col("sys").isNotNull(), F.col("usr")).alias("input"),
                    "output"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation forest: conversations of a group of four hang below the
    group's first conversation at depth 0, 1, 1, 2."""
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") != "system")
    t = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    c = c.withColumn("t", t)
    g = F.floor(F.col("conv_id") / MESSAGE_GROUP)
    o = F.col("conv_id") % MESSAGE_GROUP
    att = F.when(o == 0, 0).when(o == 3, 2).otherwise(1)
    c = c.withColumn("g", g).withColumn("o", o).withColumn("att", att)
    c = c.filter((F.col("o") == 0) | (F.col("t") >= F.col("att")))
    mid = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("t").cast("string"))
    parent = (F.when((F.col("o") == 0) & (F.col("t") == 0), F.lit(None).cast("string"))
              .when((F.col("o") > 0) & (F.col("t") == F.col("att")),
                    F.concat((F.col("g") * MESSAGE_GROUP).cast("string"), F.lit("-"),
                             (F.col("att") - 1).cast("string")))
              .otherwise(F.concat(F.col("conv_id").cast("string"), F.lit("-"),
                                  (F.col("t") - 1).cast("string"))))
    role = (F.when(F.col("role") == "user", F.lit("prompter"))
            .when(F.col("role") == "assistant", F.lit("assistant")).otherwise(F.col("role")))
    out = c.select(mid.alias("message_id"), parent.alias("parent_id"), role.alias("role"), "text")
    r = hash_int(F.col("message_id")) % RANK_MOD
    return out.withColumn("rank", F.when(r == RANK_MOD - 1, F.lit(None)).otherwise(r).cast("int"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar metric log: run = user, tag = event type, step = order in the run."""
    e = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("tag"), "ts", "value", "event_id")
    return rank_within(e, "run", ["ts", "event_id"], out="step").drop("event_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates: one group per embedding, one item per element."""
    e = read_table(spark, sf_dir, "embeddings")
    return (e.select(F.col("vec_id").alias("group_id"),
                     F.posexplode("embedding").alias("item_id", "score"))
            .select("group_id", F.col("item_id").cast("long"),
                    F.col("score").cast("double")))
