"""Queries of the dealt operators: ``QUERIES[name] = fn(spark, sf_dir)`` and,
where SQL can express the result, ``ORACLE[name]``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.llm import bpe_boundary, bpe_segment_tree, cover_tree, lattice, license_scan, line_dedup, lm_automaton, merkle, mixing, ngram_join, quality, token_binary, topk_search
from corpusprep.llm.common import ascii_lower, read, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def vocabulary() -> str:
    """Path of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op1_quality")
def op1_quality(spark, sf):
    c = quality.classify(read(spark, sf, "documents"), read(spark, sf, "labels"))
    return c.select("doc_id", "lang", "perplexity", "limit", "kept")


@register("op2_mixing", mixing.oracle())
def op2_mixing(spark, sf):
    return mixing.mix(read(spark, sf, "documents"))


@register("op3_token_planes")
def op3_token_planes(spark, sf):
    path = scratch_path(spark, "tokens")
    token_binary.write(read(spark, sf, "documents"), path, vocabulary())
    return token_binary.read_documents(spark, path)


@register("op4_line_spread", line_dedup.oracle())
def op4_line_spread(spark, sf):
    out = line_dedup.remove_spread_lines(read(spark, sf, "documents"))
    return out.select("doc_id", "text", F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"))


@register("op5_lattice")
def op5_lattice(spark, sf):
    return lattice.near_duplicates(read(spark, sf, "embeddings"))


@register("op6_ngram_join")
def op6_ngram_join(spark, sf):
    return ngram_join.similar(read(spark, sf, "documents"))


@register("op7_lm_automaton")
def op7_lm_automaton(spark, sf):
    return lm_automaton.score(read(spark, sf, "documents"))


@register("op8_topk_search", topk_search.oracle())
def op8_topk_search(spark, sf):
    return topk_search.search(read(spark, sf, "documents"), F.col("doc_id") % 20 == 0)


@register("op9_license_scan")
def op9_license_scan(spark, sf):
    return license_scan.scan(read(spark, sf, "documents")).drop("places")


@register("op10_bpe_boundary")
def op10_bpe_boundary(spark, sf):
    return bpe_boundary.encode_decode(read(spark, sf, "documents"), vocabulary())


@register("op11_merkle", merkle.oracle())
def op11_merkle(spark, sf):
    docs = read(spark, sf, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    now = {"text": F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))}
    path = scratch_path(spark, "merkle")
    merkle.write(merkle.leaves(docs, "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], "lang", now), path)
    return merkle.verify(spark, path)


@register("op12_cover_tree", cover_tree.oracle())
def op12_cover_tree(spark, sf):
    v = read(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # floor() would turn NaN into a number: components that are not finite stay
    odd = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform("embedding", lambda x: F.when(odd(x), x.cast("double")).otherwise(
        F.floor(256 * x.cast("double")).cast("double")))
    v = v.select("vec_id", label.alias("label"), whole.alias("embedding"))
    return cover_tree.mine(v, F.col("vec_id") % 50 == 0)


@register("op13_bpe_segment_tree")
def op13_bpe_segment_tree(spark, sf):
    import public_tokenizers

    return bpe_segment_tree.encode_decode(read(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                          public_tokenizers.PATTERN)
