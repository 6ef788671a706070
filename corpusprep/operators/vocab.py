"""Vocabulary jobs: piece counts, character coverage, word/char vocabularies,
special-token ids, extension with new specials, score tables.

The only full-corpus pass is the piece count (partial + final hash aggregate);
everything after works on the count table, and the kept vocabulary is bounded
by ``vocab_size`` (a distributed top-k, never a global row number over pieces).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions import text as tx
from corpusprep.session import BROADCAST_ROW_LIMIT, reliable_checkpoint

VOCAB_SCHEMA = "id int, piece string, freq long, is_special boolean"


def piece_counts(df: DataFrame, pieces: Column) -> DataFrame:
    """(piece, freq) over every row of ``df``."""
    return (df.select(F.explode(pieces).alias("piece"))
            .groupBy("piece").agg(F.count(F.lit(1)).alias("freq")))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return piece_counts(df, tx.metaspace_pieces(F.col(text)))


def char_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return piece_counts(df, tx.chars(tx.metaspace(F.col(text))))


def char_coverage(counts: DataFrame, coverage: float = 0.9995) -> DataFrame:
    """Most frequent characters whose running share first reaches
    ``coverage`` (the crossing character is kept). The window runs over the
    alphabet (one row per distinct character), not over corpus rows."""
    total = F.sum("freq").over(Window.partitionBy())
    run = F.sum("freq").over(Window.orderBy(F.desc("freq"), "piece")
                             .rowsBetween(Window.unboundedPreceding, 0))
    c = counts.withColumn("share_before", (run - F.col("freq")) / total)
    return c.filter(F.col("share_before") < coverage).drop("share_before")


def top_pieces(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent pieces, ids 0.. by (freq desc, piece).
    TakeOrdered keeps ``n`` per task; the numbering window sees <= n rows."""
    top = counts.orderBy(F.desc("freq"), "piece").limit(int(n))
    w = Window.orderBy(F.desc("freq"), "piece")
    return top.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def assign_ids(pieces: DataFrame, specials: Sequence[str]) -> DataFrame:
    """V4: specials take ids 0..k-1, pieces follow in rank order. A piece equal
    to a special is not given a second id."""
    spark = pieces.sparkSession
    k = len(specials)
    sp = spark.createDataFrame([(i, s, 0, True) for i, s in enumerate(specials)], VOCAB_SCHEMA)
    body = (pieces.filter(~F.col("piece").isin(list(specials)) if specials else F.lit(True))
            .select((F.col("rank") + k).cast("int").alias("id"), "piece",
                    F.col("freq").cast("long"), F.lit(False).alias("is_special")))
    return sp.unionByName(body)


def train_word_vocab(df: DataFrame, vocab_size: int, specials: Sequence[str],
                     text: str = "text") -> DataFrame:
    """V3 word model: id = k + rank by (freq desc, piece), k specials first."""
    counts = word_counts(df, text).filter(~F.col("piece").isin(list(specials)))
    # bounded by vocab_size: materialised once in the shared checkpoint folder
    return reliable_checkpoint(assign_ids(top_pieces(counts, vocab_size - len(specials)), specials))


def train_char_vocab(df: DataFrame, specials: Sequence[str], coverage: float = 1.0,
                     text: str = "text") -> DataFrame:
    """V3 char model: characters of the metaspace text by (freq desc, char)."""
    counts = char_counts(df, text)
    if coverage < 1.0:
        counts = char_coverage(counts, coverage)
    w = Window.orderBy(F.desc("freq"), "piece")  # alphabet-sized
    ranked = counts.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))
    return reliable_checkpoint(assign_ids(ranked, specials))


def missing_pieces(vocab: DataFrame, specials: Sequence[str]) -> DataFrame:
    """Specials not yet in the vocabulary, in list order."""
    spark = vocab.sparkSession
    sp = spark.createDataFrame([(i, s) for i, s in enumerate(specials)], "ord int, piece string")
    return sp.join(vocab.select("piece"), "piece", "left_anti")


def extend_vocab(vocab: DataFrame, specials: Sequence[str]) -> DataFrame:
    """V5: specials not present get the next ids after max(id), in list order."""
    miss = missing_pieces(vocab, specials)
    top = vocab.agg(F.max("id")).first()[0]  # one number
    top = -1 if top is None else int(top)
    w = Window.orderBy("ord")  # at most len(specials) rows
    add = (miss
           .select((F.lit(top) + F.row_number().over(w)).cast("int").alias("id"), "piece",
                   F.lit(0).cast("long").alias("freq"), F.lit(True).alias("is_special")))
    return reliable_checkpoint(vocab.unionByName(add))


def score_table(vocab: DataFrame) -> DataFrame:
    """V6: (id, piece, score) with score = ln(freq / total) for learned pieces,
    0 for specials."""
    total = vocab.filter(~F.col("is_special")).agg(F.sum("freq")).first()[0] or 1  # one number
    return vocab.select("id", "piece",
                        F.when(F.col("is_special") | (F.col("freq") <= 0), F.lit(0.0))
                         .otherwise(F.log(F.col("freq") / F.lit(float(total)))).alias("score"))


def collect_vocab(vocab: DataFrame) -> tuple[list[str], list[int]]:
    """Driver copy of a vocabulary for broadcasting into tasks; its size is
    bounded by vocab_size and checked here."""
    rows = vocab.select("piece", "id").limit(BROADCAST_ROW_LIMIT + 1).collect()
    if len(rows) > BROADCAST_ROW_LIMIT:
        raise ValueError(f"vocabulary over {BROADCAST_ROW_LIMIT} rows is too large to broadcast")
    return [r["piece"] for r in rows], [int(r["id"]) for r in rows]


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint only when the table has at most ``limit`` rows (counted on
    a bounded prefix, so the check itself never scans more than limit+1 rows)."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def compare_encodings(df: DataFrame, vocab_a: DataFrame, vocab_b: DataFrame,
                      key: str = "doc_id", group: str = "dataset", text: str = "text") -> DataFrame:
    """V7: encode the same text with two vocabularies; per group the number of
    rows with identical ids and the share of differing positions."""
    from corpusprep.operators.tokenise import encode, make_lookup
    a = encode(df.select(group, key, text), make_lookup(vocab_a), text, "ids_a")
    b = encode(a, make_lookup(vocab_b), text, "ids_b")
    diff = F.size(F.filter(F.arrays_zip("ids_a", "ids_b"), lambda z: z["ids_a"] != z["ids_b"]))
    r = b.select(group, diff.alias("_d"), F.size("ids_a").alias("_n"))
    return r.groupBy(group).agg(F.count(F.lit(1)).alias("docs"),
                                F.count(F.when(F.col("_d") == 0, 1)).alias("equal_docs"),
                                F.round(F.sum("_d") / F.sum("_n"), 6).alias("mismatch_rate"))


def compare_alignment(df: DataFrame, a: Column, b: Column, key: str = "doc_id") -> DataFrame:
    """V7 by characters: two ways ``a`` and ``b`` (array<string>) to cut the same
    text. Per row ``key, n_a, n_b`` (tokens), ``n_same`` (tokens that both have
    at the same characters) and ``n_different`` (stretches between cuts that
    both make which they fill differently), so one token more or less is one
    difference and the rest of the text still counts as the same.

    Character ends of all rows of a batch are merged as one sorted array; a null
    or empty list has no tokens."""
    from corpusprep.operators.tokenise import small_batches
    schema = T.StructType([df.schema[key], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_same", "n_different")]])
    shift = 1 << 32

    def spans(col):
        """(row * 2**32 + start, row * 2**32 + end) of each token, tokens per row."""
        offs = np.asarray(col.offsets, dtype=np.int64)
        offs = offs - offs[0]
        n = np.diff(offs)
        size = pc.utf8_length(col.flatten()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        base = np.repeat(np.concatenate([[0], end])[offs[:-1]], n)
        row = np.repeat(np.arange(len(n)), n) * shift
        return row + end - base - size, row + end - base, n

    def run(batches):
        for batch in small_batches(batches, [1, 2]):
            rows = batch.num_rows
            (sa, ea, na), (sb, eb, nb) = spans(batch.column(1)), spans(batch.column(2))
            cuts = np.intersect1d(ea, eb)
            # the tokens of a row are in order, so equal ends are met once; both must start there too
            same = np.intersect1d(ea, eb, return_indices=True)[1:]
            same = cuts[sa[same[0]] == sb[same[1]]]
            per = [np.bincount(x // shift, minlength=rows) for x in (same, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(na), pa.array(nb), pa.array(per[0]), pa.array(per[1] - per[0])],
                                             schema.names)

    none = F.array().cast("array<string>")
    keep = lambda c: F.filter(F.coalesce(c, none), lambda x: x != "")
    return df.select(key, keep(a).alias("a"), keep(b).alias("b")).mapInArrow(run, schema)


CODE_POINTS = 0x110000


def byte_fallback(df: DataFrame, covered: DataFrame, pieces: str = "pieces") -> DataFrame:
    """In the array column ``pieces`` every piece that is not a ``piece`` of
    ``covered`` becomes its UTF-8 bytes as pieces '<0xNN>'. ``covered`` is an
    alphabet, so there are as many rows as code points at most (checked).

    One lookup per Arrow batch; each distinct missing piece is spelled once. A
    null array stays null, a null piece too; the other columns are kept."""
    known = [r["piece"] for r in covered.select("piece").limit(CODE_POINTS + 1).collect()]
    if len(known) > CODE_POINTS:
        raise ValueError("more covered pieces than there are characters")
    from corpusprep.operators.tokenise import small_batches
    alphabet = df.sparkSession.sparkContext.broadcast(known)
    at = df.columns.index(pieces)

    def run(batches):
        have = pa.array(alphabet.value, pa.string())
        for b in small_batches(batches, [at]):
            col = b.column(at)
            flat = col.flatten()
            d = flat.dictionary_encode()
            spelt = [[p] if p is None or k else [f"<0x{x:02X}>" for x in p.encode()]
                     for p, k in zip(d.dictionary.to_pylist(), pc.is_in(d.dictionary, have).to_pylist())]
            spelt.append([None])                                       # what a null piece points to
            size = np.array([len(x) for x in spelt], np.int64)
            start = np.cumsum(size) - size
            code = d.indices.fill_null(len(spelt) - 1).to_numpy(zero_copy_only=False)
            n = size[code]
            ends = np.cumsum(n)
            pick = np.repeat(start[code] - (ends - n), n) + np.arange(int(n.sum()))
            pool = pa.array([x for s in spelt for x in s], pa.string())
            lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            per = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lens)])]
            out = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pool.take(pa.array(pick)),
                                           mask=col.is_null() if col.null_count else None)
            yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(run, df.schema)
