"""Registered queries (continued): subword vocabularies (BPE, unigram) at the
sizes of the usual recipes, and encoding with them. Training is checked against
the public trainer, brute force and its own properties in the tests; SQL checks
what it can say of a vocabulary (its specials, alphabet and byte pieces, and
their ids) and the round trip decode(encode(text)) = text."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.operators import bpe, tokenise, unigram, vocab
from corpusprep.plans import sqlparts as S
from corpusprep.plans.catalog import register
from corpusprep.profiles import BASE_SPECIALS
from corpusprep.sources import tables as tb

BPE_VOCAB = 32_000
UNIGRAM_VOCAB = 64_000
UNIGRAM_SEED = 1_000_000
# the unigram recipe: coverage, byte fallback, normalisation, script and digit split, sentence length in bytes
COVERAGE = 0.9995
MAX_BYTES = 16_384
RECIPE = {"coverage": COVERAGE, "byte_fallback": True, "normalise": "nfkc", "split_scripts": True, "max_bytes": MAX_BYTES}

_trained: dict = {}


def once(spark, sf, name, train):
    """A vocabulary is trained once per session and table folder; the queries
    over it share the result (tables bounded by the vocabulary size)."""
    key = (spark.sparkContext.applicationId, spark.sparkContext.startTime, sf, name)
    if key not in _trained:
        _trained[key] = train()
    return _trained[key]


def bpe_vocab(spark, sf):
    return once(spark, sf, "bpe", lambda: bpe.train_bpe(tb.text_table(spark, sf), BPE_VOCAB, BASE_SPECIALS))


def unigram_vocab(spark, sf):
    return once(spark, sf, "unigram", lambda: unigram.train_unigram(
        tb.text_table(spark, sf), UNIGRAM_VOCAB, BASE_SPECIALS, seed_size=UNIGRAM_SEED, **RECIPE))


_SPECIAL_SQL = " union all ".join(f"select {i} as id, {S.q(s)} as piece" for i, s in enumerate(BASE_SPECIALS))
_FIRST = len(BASE_SPECIALS)


@register("v1_train_bpe")
def v1_train_bpe(spark, sf):
    vocab, merges = bpe_vocab(spark, sf)
    # a token that two merges make goes by the first
    made = merges.groupBy("id").agg(F.min(F.struct("rank", "left_id", "right_id")).alias("m")).select("id", "m.*")
    return vocab.join(made, "id", "left").select("id", "piece", "is_special", "rank", "left_id", "right_id")


# ids are dense, specials come first, then the alphabet in code point order, then merges
@register("v1_bpe_alphabet",
          f"with p as (select distinct unnest(string_split({S.metaspace('text')}, '')) as piece from documents where text <> ''), "
          f"a as (select cast({_FIRST - 1} + row_number() over (order by unicode(piece)) as integer) as id, piece from p) "
          f"select id, piece, true as dense from a union all select id, piece, true from ({_SPECIAL_SQL})")
def v1_bpe_alphabet(spark, sf):
    vocab, merges = bpe_vocab(spark, sf)
    n = vocab.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"), F.countDistinct("id").alias("ids"),
                  F.countDistinct("piece").alias("pieces"))
    dense = n.select(((F.col("top") == F.col("n") - 1) & (F.col("ids") == F.col("n")) & (F.col("pieces") == F.col("n"))).alias("dense"))
    return (vocab.join(merges.select("id"), "id", "left_anti").join(F.broadcast(dense))     # one row
            .select("id", "piece", "dense"))


# metaspace decoding drops the first space, so only a text starting with a
# space cannot come back unchanged
@register("t1_encode_bpe", "select doc_id, not starts_with(text, ' ') as roundtrip_equal from documents")
def t1_encode_bpe(spark, sf):
    vocab, merges = bpe_vocab(spark, sf)
    t = tb.text_table(spark, sf).select("doc_id", "text")
    enc = bpe.encode_bpe(t, bpe.make_bpe_model(vocab, merges, BASE_SPECIALS), "text", "input_ids")
    dec = tokenise.decode(enc.select("doc_id", "input_ids"), vocab, key="doc_id")
    return t.join(dec, "doc_id").select("doc_id", (F.col("decoded") == F.col("text")).alias("roundtrip_equal"))


@register("v2_train_unigram")
def v2_train_unigram(spark, sf):
    return unigram_vocab(spark, sf).select("id", "piece", F.round("score", 6).alias("score"))


# specials, then the 256 byte pieces, then by score; the characters that have a
# piece are the covered ones
@register("v2_unigram_alphabet",
          f"with p as (select unnest(string_split({S.metaspace('text')}, '')) as piece from documents "
          f"where text <> '' and octet_length(encode(text)) <= {MAX_BYTES}), "
          "c as (select piece, count(*) as n from p group by piece), "
          "r as (select piece, sum(n) over (order by n desc, piece rows unbounded preceding) - n as before, sum(n) over () as total from c) "
          f"select 'character' as kind, piece, cast(null as integer) as id, true as sorted from r where before / total < {COVERAGE} "
          f"union all select 'special', piece, id, true from ({_SPECIAL_SQL}) "
          f"union all select 'byte', printf('<0x%02X>', i), cast(i + {_FIRST} as integer), true from range(256) t(i)")
def v2_unigram_alphabet(spark, sf):
    v = unigram_vocab(spark, sf)
    learned = F.col("id") >= _FIRST + 256
    # scores fall along the ids: pairs of neighbours by id, at most the vocabulary size
    after = v.filter(learned).select((F.col("id") - 1).alias("id"), F.col("score").alias("next"))
    rising = v.filter(learned).join(after, "id").agg(F.count(F.when(F.col("next") > F.col("score"), 1)).alias("n"))
    ordered = rising.select((F.col("n") == 0).alias("sorted"))
    kind = F.when(F.col("id") < _FIRST, "special").when(learned, "character").otherwise("byte")
    return (v.filter(~learned | (F.length("piece") == 1)).join(F.broadcast(ordered))    # one row
            .select(kind.alias("kind"), "piece", F.when(~learned, F.col("id")).alias("id"), "sorted"))


@register("v6_unigram_score_table")
def v6_unigram_score_table(spark, sf):
    return unigram.score_table(unigram_vocab(spark, sf)).select("id", "piece", F.round("score", 6).alias("score"))


@register("t1_encode_unigram", "select doc_id, not starts_with(text, ' ') as roundtrip_equal from documents")
def t1_encode_unigram(spark, sf):
    v = unigram_vocab(spark, sf)
    enc = unigram.make_unigram_encoder(v, BASE_SPECIALS)
    t = tb.text_table(spark, sf).select("doc_id", "text")
    e = unigram.encode_unigram(t, enc, "text", "input_ids")
    dec = tokenise.decode(e.select("doc_id", "input_ids"), v, key="doc_id")
    return t.join(dec, "doc_id").select("doc_id", (F.col("decoded") == F.col("text")).alias("roundtrip_equal"))


_META = S.metaspace("text")
_SCRIPT_PIECES = f"'{S.script_pattern('▁?', '▁')}|▁'"


def _spans_sql(name: str, pieces: str) -> str:
    return (f"{name}l as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as i from (select doc_id, {pieces} as p from documents)), "
            f"{name} as (select doc_id, sum(length(piece)) over w - length(piece) as s, sum(length(piece)) over w as e from {name}l "
            "window w as (partition by doc_id order by i rows unbounded preceding))")


# whole words against runs of one script: where they cut alike, and how often they differ
@register("v7_aligned_tokens",
          f"with {_spans_sql('a', S.pieces('text'))}, {_spans_sql('b', f'regexp_extract_all({_META}, {_SCRIPT_PIECES})')}, "
          "j as (select a.doc_id, count(*) as cuts, count(*) filter (a.s = b.s) as same from a join b on a.doc_id = b.doc_id and a.e = b.e group by a.doc_id) "
          "select doc_id, (select count(*) from a where a.doc_id = d.doc_id) as n_a, (select count(*) from b where b.doc_id = d.doc_id) as n_b, "
          "coalesce(same, 0) as n_same, coalesce(cuts - same, 0) as n_different from documents d left join j using (doc_id)")
def v7_aligned_tokens(spark, sf):
    t = tb.text_table(spark, sf)
    return vocab.compare_alignment(t, tx.metaspace_pieces(F.col("text")), tx.metaspace_script_pieces(F.col("text")))


@register("c4_normalize_text", "select doc_id, text from documents")
def c4_normalize_text(spark, sf):
    """NFKC leaves the given documents unchanged (checked); the literal
    fixtures with ligatures, full-width forms and case folding are in the tests."""
    d = tb.read_table(spark, sf, "documents")
    return d.select("doc_id", tx.normalize_text(F.col("text"), "nfkc").alias("text"))
