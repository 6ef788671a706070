"""Operator 7: language-model scores by a weighted backoff automaton.

States are the n-grams (fewer than ``order`` words) of the training text. From
a state, an arc per word seen after it carries the smoothed probability and
leads to the longest state that ends there; a failure arc carries the weight
that smoothing leaves to the next shorter state. A text is scored in one
left-to-right traversal: take the word's arc, or the failure arc until there is
one, and add up the logarithms.

Smoothing: p(w|h) = (c(hw) + k p(w|h')) / (c(h) + k), h' one word shorter,
down to the additive unigram model; so a failure arc weighs k / (c(h) + k). The
strength k is the one of ``STRENGTHS`` that predicts the training text best,
each training token being taken out of the counts while it is predicted.

The automaton of a large corpus fits no single machine, so it comes to the
texts in parts: texts are packed into blocks; a block asks, once for each
distinct n-gram it holds, the shard that owns the n-gram; shards add up the
training counts of all blocks and answer; with the answers a block has every
state and arc its own texts can reach. A frequent n-gram is one entry per
block, however often it occurs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.llm import wordhash as wh
from corpusprep.llm.common import table
from corpusprep.llm.sharded_counts import ASK, answer, entry, pack, shard_cuts, unpack
from corpusprep.llm.token_binary import from_planes, to_planes

ORDER = 2
STRENGTHS = (16.0, 64.0, 256.0, 1024.0, 65536.0)
ALPHA = 0.1
BLOCK_BYTES = 6 << 20
SHARD_TOKENS = 3_000_000
END = 0x9E0D                # stands for the end of a text among the word hashes
BEGIN = 0xBE61


_BLOCK = [("block", T.LongType()), ("n_words", T.LongType()), ("words", T.ArrayType(T.BinaryType())),
          ("n", T.LongType()), ("idx", T.ArrayType(T.BinaryType())),
          ("held", T.ArrayType(T.BooleanType())), ("count", T.ArrayType(T.LongType()))]


def blocks(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """Texts packed into blocks: the block's distinct words (sorted hashes) and
    every token as an index into them; each text ends with END."""
    kt = docs.schema[key].dataType
    schema = T.StructType([T.StructField(n, t) for n, t in _BLOCK] + [T.StructField("keys", T.ArrayType(kt))])
    # the remainder of the key's crc32 decides; a null key counts as empty text
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        part, seq = TaskContext.get().partitionId(), 0
        tokens, count, keys, flags, size = [], [], [], [], 0

        def emit():
            nonlocal tokens, count, keys, flags, size, seq
            words, idx = np.unique(np.concatenate(tokens), return_inverse=True)
            deltas = np.diff(words, prepend=np.uint64(0))
            out = [(part << 32) + seq, len(words), pack(deltas), len(idx), to_planes(idx), flags, count, keys]
            tokens, count, keys, flags, size, seq = [], [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, arrow)], schema.names)

        for b in batches:
            raw, off = wh.buffer_of(b.column(2))
            for i, j in wh.pieces(off):
                s, e, first = wh.word_spans(raw, off[i:j + 1], wh.SPACE)
                n = np.diff(first)
                h = np.insert(wh.word_hashes(raw, s, e), first[1:], np.uint64(END))
                tokens.append(h)
                count += (n + 1).tolist()
                keys += b.column(0).slice(i, j - i).to_pylist()
                flags += b.column(1).slice(i, j - i).to_pylist()
                size += int(off[j] - off[i])
                if size >= block_bytes:
                    yield emit()
        if count:
            yield emit()

    src = docs.select(F.col(key).alias("k"), held.alias("h"), F.col(text).alias("t"))
    return src.mapInArrow(run, schema)


class Block:
    """The n-grams of one block. ``at[n]`` gives each token's n-gram as an index
    into the sorted distinct ``keys[n]``; ``hist[n]`` its history (the n-gram
    without the last word) as an index into ``keys[n - 1]``, -1 for a text's
    beginning, -2 where there is none; ``train[n]`` counts the training occurrences in the block."""

    def __init__(self, r: dict, order: int):
        words = np.cumsum(unpack(r["words"], r["n_words"]), dtype=np.uint64)
        idx = from_planes(r["idx"], r["n"]).astype(np.int64)
        self.count = np.array(r["count"], np.int64)
        first = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        self.first = first
        self.weight = np.repeat(~np.array(r["held"], bool), self.count)
        place = np.arange(len(idx)) - np.repeat(first, self.count)
        self.keys, self.at, self.hist, self.train = {1: words}, {1: idx}, {}, {}
        h = words[idx]
        for n in range(2, order + 1):
            before = np.concatenate([[np.uint64(0)], self.keys[n - 1][self.at[n - 1]][:-1]])
            before = np.where(place == 0, np.uint64(BEGIN), before)
            self.keys[n], self.at[n] = np.unique(wh.mix(before * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(n)),
                                                 return_inverse=True)
            prev = np.concatenate([[-1], self.at[n - 1][:-1]])
            # -2: so near its beginning the text has no context of this length
            self.hist[n] = np.where(place < n - 2, -2, np.where(place == 0, -1, prev))
        for n in range(1, order + 1):
            self.train[n] = np.bincount(self.at[n], self.weight, len(self.keys[n])).astype(np.uint64)


def ask(b: DataFrame, order: int, shards: int) -> DataFrame:
    """(level, shard, block, n, keys, counts): what each block asks of each shard."""
    schema = ASK

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                block = Block(r, order)
                for level, keys in block.keys.items():
                    cuts = [0, *shard_cuts(keys, shards).tolist(), len(keys)]
                    for s, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        if y > x:
                            out = [level, s, r["block"], y - x, *entry(keys[x:y], block.train[level][x:y])]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([v], f.type) for v, f in zip(out, arrow)], schema.names)

    return b.drop("keys").mapInArrow(run, schema)


def traverse(block: Block, totals: dict[int, np.ndarray], n_train: int, n_docs: int, vocab: int,
             order: int, k: float, out_one: bool = False) -> np.ndarray:
    """log10 weight of every token's path through the automaton. At a token the
    state is the longest known suffix of what was read; the path takes failure
    arcs from the longest context down to the longest one with an arc for the
    token. ``out_one`` takes the token itself out of the training counts."""
    own = block.weight.astype(np.float64) if out_one else 0.0
    c = totals[1][block.at[1]] - own
    p = (c + ALPHA) / (n_train - own + ALPHA * (vocab + 1))
    arc, fail = np.log10(p), np.zeros(len(p))
    for n in range(2, order + 1):
        h = block.hist[n]
        hist = np.where(h >= 0, totals[n - 1][h], n_docs) - own
        c = totals[n][block.at[n]] - own
        step = np.where(h == -2, 0.0, np.log10(k / (hist + k)))     # failure arc of the longer state
        p = np.where(h == -2, p, (c + k * p) / (hist + k))
        # an arc of the longer state replaces the path so far; else its failure arc is taken first
        seen = (c > 0) & (h != -2)
        arc, fail = np.where(seen, np.log10(p), arc), np.where(seen, 0.0, fail + step)
    return arc + fail


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER,
          strengths=STRENGTHS, block_bytes: int = BLOCK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per row of ``docs``: ``key, held_out, n_tokens, n_known, train_tokens,
    base_score, score`` (log10 probabilities of the whole text under the additive
    unigram model and under the automaton).

    Trains on the rows whose key has a crc32 (as text) that is no multiple of
    10. Words are separated by 0x20 and 0x09-0x0D, A-Z count as a-z; a null or
    empty text is one token, the end. A null key counts as empty text there and
    is held out. Repeated rows are scored each. An empty table gives an empty
    result. Counts cover the whole table."""
    b = table(blocks(docs, key, text, block_bytes), "lm-blocks")
    size = b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                 F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)).alias("d")).first()
    shards = max(1, math.ceil(size["n"] / shard_tokens))
    got = table(answer(ask(b, order, shards)), "lm-counts")
    one = got.filter("level = 1").agg(F.coalesce(F.sum("sum"), F.lit(0)).alias("n"),
                                      F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    n_train, vocab, n_docs = one["n"], one["v"], size["d"]
    per_block = got.groupBy("block").agg(F.collect_list(F.struct("level", "shard", "n", "totals")).alias("got"))
    kt = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kt), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("inner", T.ArrayType(T.DoubleType()))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                block = Block(r, order)
                totals = {}
                for level in block.keys:
                    part = sorted((g["shard"], g["n"], g["totals"]) for g in r["got"] if g["level"] == level)
                    totals[level] = np.concatenate([unpack(t, n) for _, n, t in part]).astype(np.float64)
                add = lambda v: np.add.reduceat(v, block.first)
                c = totals[1][block.at[1]]
                base = np.log10((c + ALPHA) / (n_train + ALPHA * (vocab + 1)))
                scores, inner = [], []
                for k in strengths:
                    scores.append(add(traverse(block, totals, n_train, n_docs, vocab, order, k)))
                    loo = traverse(block, totals, n_train, n_docs, vocab, order, k, out_one=True)
                    inner.append(add(np.where(block.weight, loo, 0.0)))
                cols = [r["keys"], r["held"], block.count.tolist(), add((c > 0).astype(np.int64)).tolist(),
                        add(base).tolist(), np.stack(scores, 1).tolist(), np.stack(inner, 1).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, arrow)], schema.names)

    scored = table(b.join(per_block, "block").mapInArrow(run, schema), "lm-scores")
    best = scored.agg(*[F.sum(F.col("inner")[i]).alias(f"s{i}") for i in range(len(strengths))]).first()
    pick = max(range(len(strengths)), key=lambda i: best[i] if best[i] is not None else 0.0)
    return scored.select(key, "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
                         "base_score", F.col("scores")[pick].alias("score"))
