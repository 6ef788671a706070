"""Corpus pipeline over ``documents``: quality model, cross-site line removal,
near-duplicate removal, source mix, BPE. Each stage is written as Parquet and
reread as the next one's input.

Every stage takes nulls in any column, empty and very long texts, ties and
repeated rows, and extra columns of any name, which all but the last return. A
text without words (null, empty, blank) is kept by the first three stages (the
classifier has nothing against it, it has no line to remove, it is nobody's
copy) and left out by the mix, which takes words. Repeated rows are one
document to near-duplicate removal and rows of their own elsewhere. Without
usable labels the classifier rejects nothing. An empty table gives an empty
result of the same columns. ``n_chars``, where there is such a column, follows
the text when lines are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.llm import bpe_boundary, line_dedup, mixing, ngram_join, quality
from corpusprep.llm.common import read, table
from corpusprep.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (operator 1)."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go; all documents stay (operator 4)."""
    out = line_dedup.remove_spread_lines(docs)
    if "n_chars" not in docs.columns:
        return out.select(*docs.columns)
    n_chars = F.when(F.col("_ld_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumn("n_chars", F.coalesce(n_chars, "n_chars")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 6)."""
    return ngram_join.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (operator 2)."""
    return mixing.repeat(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded text (operator 10)."""
    return bpe_boundary.encode_decode(docs, vocabulary())


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage),
          ("n-gram Jaccard join", near_duplicate_stage), ("mixing", mix_stage),
          ("BPE encoding and decoding", bpe_stage)]

# The quality model and the library's BPE have no SQL form; the pipeline is
# tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, f"stage{i}")
    return docs
