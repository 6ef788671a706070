"""V2 unigram-LM vocabulary training (Kudo 2018, ACL) and Viterbi encoding.

Plan:
* word table ``(piece, freq)`` = the metaspace piece count (A6), the only
  pass over the corpus;
* seed pieces: the repeated substrings of the words that a distributed suffix
  sort finds (``suffixes.repeated_substrings``), the first ``seed_size`` by
  freq x length, plus every character of the alphabet;
* EM: the E-step is an Arrow pass over word partitions - forward-backward on
  the lattices of a whole batch at once (``lattice.Lattice``) - and emits
  expected piece counts already summed per task; the M-step adds them up and
  renormalises;
* pruning: after ``sub_iters`` EM rounds the pieces are ranked by the
  likelihood lost when each is removed (Viterbi usage x (its log-prob - the
  log-prob of its best segmentation without it)) and the best ``shrink``
  share is kept (characters always stay), until ``vocab_size`` is reached.
  Usage is a pass over the words, the second-best segmentations a pass over
  the pieces; both run in tasks.

The model is two arrays, broadcast to tasks: the trie of the pieces and their
scores, bounded by ``seed_size`` (at most ``BROADCAST_ROW_LIMIT``). The driver
holds these arrays and adds up one count per piece; nothing there walks words
or segments pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions import text as tx
from corpusprep.operators.lattice import PieceTrie, lattices
from corpusprep.operators.order import take_first
from corpusprep.operators.suffixes import repeated_substrings
from corpusprep.operators.tokenise import _map_pieces, map_pieces_by_unique, pre_tokenise
from corpusprep.operators.vocab import char_coverage, piece_counts, word_counts
from corpusprep.session import BROADCAST_ROW_LIMIT, reliable_checkpoint

UNIGRAM_VOCAB_SCHEMA = "id int, piece string, score double, is_special boolean"
UNK_PENALTY = 10.0   # an unknown character costs min(score) - 10
WORDS_PER_PARTITION = 400_000    # a task gives out a row per piece that its words meet, so few tasks give out less
HELD_CHARS = 1 << 21                # of words worked on together: some 200,000
PIECES_PER_PARTITION = 100_000


def _unknown(score: np.ndarray) -> float:
    return float(score[score > -np.inf].min()) - UNK_PENALTY


_COUNTS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("count", T.DoubleType())])


def _held(batches, chars: int = HELD_CHARS):
    """(words, weights) of several batches together: words of one length are
    worked on at once, so there should be many of them."""
    words, weights, size = [], [], 0
    for b in batches:
        words += b.column(0).to_pylist()
        weights.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
        size += pc.sum(pc.utf8_length(b.column(0))).as_py() or 0
        if size >= chars:
            yield words, np.concatenate(weights)
            words, weights, size = [], [], 0
    if words:
        yield words, np.concatenate(weights)


def _e_step(words: DataFrame, trie, score: np.ndarray, viterbi: bool = False) -> tuple[np.ndarray, float]:
    """(expected or Viterbi count of each piece, log-likelihood) over
    ``words(piece, freq)``, weighted by frequency and summed inside each task
    first. ``trie`` is a broadcast ``PieceTrie``."""
    unknown, n = _unknown(score), len(score)

    def run(batches):
        total, likelihood = np.zeros(n), 0.0
        for ws, fs in _held(batches):
            for part, lat in lattices(trie.value, ws, score, unknown):
                if viterbi:
                    word, _, piece = lat.segments()
                    known = piece >= 0
                    np.add.at(total, piece[known], fs[part[word[known]]])
                else:
                    likelihood += lat.add_expected(fs[part], total)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()),
                                          pa.array(np.append(total[some], likelihood))], _COUNTS.names)

    rows = words.select("piece", "freq").mapInArrow(run, _COUNTS).groupBy("id").agg(F.sum("count").alias("count")).toArrow()
    ids, count = rows["id"].to_numpy(), rows["count"].to_numpy()
    out = np.zeros(n)
    out[ids[ids >= 0]] = count[ids >= 0]
    return out, float(count[ids < 0].sum())


def _without(spark, trie, score: np.ndarray) -> np.ndarray:
    """Log-probability of each piece's best segmentation into other pieces
    (single characters: their own): a pass over the pieces."""
    unknown, n = _unknown(score), len(score)

    def run(batches):
        t = trie.value
        for b in batches:
            ids = b.column(0).to_numpy()
            for i in range(0, len(ids), 1 << 16):
                part = ids[i:i + (1 << 16)]
                top = np.zeros(len(part))
                pieces = ["".join(map(chr, t.codes[t.offs[p]:t.offs[p + 1]].tolist())) for p in part.tolist()]
                for at, lat in lattices(t, pieces, score, unknown, whole=False):
                    top[at] = lat.top()
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(top)], _COUNTS.names)

    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-n // 1000)), -(-n // PIECES_PER_PARTITION))
    rows = spark.range(0, n, 1, parts).mapInArrow(run, _COUNTS).toArrow()
    out = np.zeros(n)
    out[rows["id"].to_numpy()] = rows["count"].to_numpy()
    return out


def _normalise(counts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Log-probabilities of the pieces kept, -inf for the others."""
    c = np.maximum(np.where(keep, counts, 0.0), 1e-12)
    return np.where(keep, np.log(c / (counts[keep].sum() or 1.0)), -np.inf)


def training_words(df: DataFrame, text: str = "text", normalise: str | None = None, split_scripts: bool = False,
                   max_bytes: int | None = None, sentences: int | None = None, key: str | None = None,
                   seed: int = 42) -> DataFrame:
    """(piece, freq) of the training text, in the order of the usual recipe: drop
    over-long sentences, sample sentences (needs ``key``), normalise, cut into
    metaspace pieces and, with ``split_scripts``, each of them into runs of one
    script and single digits (the '▁' stays with what follows it)."""
    from corpusprep.operators import split
    if max_bytes:
        df = split.max_bytes(df, max_bytes, text)
    if sentences:
        df = split.take(df, sentences, key, seed)
    if normalise:
        df = df.withColumn(text, tx.normalize_text(F.col(text), normalise))
    if not split_scripts:
        return word_counts(df, text)
    return piece_counts(df, tx.metaspace_script_pieces(F.col(text)))


def covered(words: DataFrame, coverage: float) -> tuple[DataFrame, list[str]]:
    """Words cut at the characters outside the most frequent ``coverage`` share
    of the text, and these characters (both bounded by the alphabet)."""
    chars = (words.select(F.explode(tx.chars(F.col("piece"))).alias("piece"), "freq")
             .groupBy("piece").agg(F.sum("freq").alias("freq")))
    chars = reliable_checkpoint(chars)
    rare = [r["piece"] for r in chars.join(char_coverage(chars, coverage).select("piece"), "piece", "left_anti").collect()]
    if not rare:
        return words, []
    cut = F.split(F.translate(F.col("piece"), "".join(rare), "\0" * len(rare)), "\0")
    return (words.select(F.explode(cut).alias("piece"), "freq").filter(F.col("piece") != "")
            .groupBy("piece").agg(F.sum("freq").alias("freq"))), rare


def train_unigram(df: DataFrame, vocab_size: int, specials: Sequence[str], text: str = "text",
                  seed_size: int = 1_000_000, max_piece_len: int = 16, shrink: float = 0.75,
                  sub_iters: int = 2, history: list | None = None, coverage: float = 1.0,
                  byte_fallback: bool = False, **recipe) -> DataFrame:
    """V2: (id, piece, score, is_special); specials first, then (with
    ``byte_fallback``) the 256 byte pieces, then pieces by score desc. Characters
    outside ``coverage`` get no piece of their own. ``recipe``: the options of
    ``training_words``. ``history`` (optional list) receives (stage,
    log-likelihood) per EM round."""
    spark = df.sparkSession
    # E-steps are CPU-bound per word: spread the word table over every core
    # (an aggregate's output may have been coalesced into a few partitions)
    counts = reliable_checkpoint(training_words(df, text, **recipe))
    n_words = counts.count()
    if coverage < 1.0:
        counts, _ = covered(counts, coverage)
    parts = max(spark.sparkContext.defaultParallelism, -(-n_words // WORDS_PER_PARTITION))
    words = reliable_checkpoint(counts.repartition(parts))
    if seed_size > BROADCAST_ROW_LIMIT:
        raise ValueError("seed_size is beyond what a model may have to be broadcast")
    # one row per character: bounded by the code points there are
    chars = (words.select(F.explode(tx.chars(F.col("piece"))).alias("sub"), "freq")
             .groupBy("sub").agg(F.sum("freq").alias("freq")))
    seeds = (repeated_substrings(words, int(max_piece_len)).filter(F.length("sub") > 1)
             .withColumn("gain", -F.col("freq") * F.length("sub")))
    seeds = take_first(reliable_checkpoint(seeds), int(seed_size), ["gain", "sub"]).select("sub", "freq")
    rows = chars.unionByName(seeds).toArrow().sort_by("sub")
    pieces = rows["sub"].to_pylist()        # in code point order: ties go by index
    heads = [*specials, *(tx.BYTE_PIECES if byte_fallback else ())]
    target = vocab_size - len(heads)

    size = np.array([len(p) for p in pieces], np.int64)
    single, keep = size == 1, np.ones(len(pieces), bool)
    score = _normalise(rows["freq"].to_numpy().astype(np.float64), keep)
    trie = spark.sparkContext.broadcast(PieceTrie(pieces))
    while len(pieces):
        for _ in range(int(sub_iters)):
            counts, ll = _e_step(words, trie, score)
            if history is not None:
                history.append((int(keep.sum()), ll))
            # characters always stay; other pieces with no expected use go
            keep &= single | (counts > 0.5)
            score = _normalise(counts, keep)
        if keep.sum() <= target:
            break
        usage, _ = _e_step(words, trie, score, viterbi=True)
        many = np.flatnonzero(keep & ~single)
        loss = usage[many] * (score[many] - _without(spark, trie, score)[many])
        n_keep = max(target, int(keep.sum() * shrink)) - int(single.sum())
        keep[many[np.argsort(-loss, kind="stable")[max(n_keep, 0):]]] = False
        score = np.where(keep, score, -np.inf)
        if keep.sum() < len(pieces) / 2:    # leave out what is gone
            at = np.flatnonzero(keep)
            pieces, score, single, keep = [pieces[i] for i in at.tolist()], score[at], single[at], keep[at]
            trie.unpersist()
            trie = spark.sparkContext.broadcast(PieceTrie(pieces))
    trie.unpersist()
    # at most target pieces (characters first if over), by score desc, then piece
    at = np.flatnonzero(keep)
    at = at[np.argsort(-score[at], kind="stable")]
    if len(at) > target:
        at = np.concatenate([at[single[at]], at[~single[at]]])[:max(target, 0)]
        at = np.sort(at)[np.argsort(-score[np.sort(at)], kind="stable")]
    learned = [(pieces[i], float(score[i])) for i in at.tolist() if pieces[i] not in specials]
    rows = [(i, p, 0.0, i < len(specials)) for i, p in enumerate(heads)]
    rows += [(len(heads) + i, p, sc, False) for i, (p, sc) in enumerate(learned)]
    return spark.createDataFrame(rows, UNIGRAM_VOCAB_SCHEMA)


class UnigramEncoder:
    """Picklable Viterbi encoder: pieces -> ids (specials whole; unknown
    characters -> their byte pieces when the vocabulary has them, else unk
    id). The distinct words of a batch are segmented together; per-task cache
    of encoded words."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], specials: Sequence[str],
                 unk_id: int, max_len: int):
        self.scores, self.ids, self.specials, self.unk_id, self.max_len = scores, ids, list(specials), unk_id, max_len
        self.bytes = all(p in ids for p in tx.BYTE_PIECES)
        self._cache = None

    def __getstate__(self):
        return {"scores": self.scores, "ids": self.ids, "specials": self.specials,
                "unk_id": self.unk_id, "max_len": self.max_len}

    def __setstate__(self, st):
        self.__init__(st["scores"], st["ids"], st["specials"], st["unk_id"], st["max_len"])

    def _prepare(self):
        pieces = [p for p in self.scores if p]
        self._cache = {s: [self.ids[s]] for s in self.specials if s in self.ids}
        self._score = np.array([self.scores[p] for p in pieces])
        self._trie = PieceTrie(pieces)
        self._ids = np.array([self.ids[p] for p in pieces], np.int32)
        self._unknown = _unknown(self._score) if pieces else -UNK_PENALTY

    def _segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each word's best segmentation, all words at once."""
        out: list[list[int]] = [[] for _ in words]
        for part, lat in lattices(self._trie, words, self._score, self._unknown):
            word, start, piece = lat.segments()
            ids = np.where(piece >= 0, self._ids[piece] if len(self._ids) else 0, -1)
            odd = np.zeros(len(part), bool)
            odd[word[ids < 0]] = True
            ends, ids, at = np.cumsum(np.bincount(word, minlength=len(part))).tolist(), ids.tolist(), 0
            for i, end, some in zip(part.tolist(), ends, odd.tolist()):
                out[i] = ids[at:end]
                if some:
                    out[i] = [y for x, s in zip(out[i], start[at:end].tolist())
                              for y in ([x] if x >= 0 else self._unknown_ids(words[i][s]))]
                at = end
        return out

    def _unknown_ids(self, char: str) -> list[int]:
        return [self.ids[tx.BYTE_PIECES[x]] for x in char.encode()] if self.bytes else [self.unk_id]

    def encode_pieces(self, words: list[str]) -> list[list[int]]:
        if self._cache is None:
            self._prepare()
        cache = self._cache
        new = [w for w in dict.fromkeys(words) if w not in cache]
        got = dict(zip(new, self._segment(new)))
        if len(cache) + len(got) <= 1_000_000:
            cache.update(got)
        return [cache[w] if w in cache else got[w] for w in words]

    def encode_piece(self, w: str) -> list[int]:
        return self.encode_pieces([w])[0]

    def map_list_array(self, arr: pa.ListArray) -> pa.ListArray:
        return map_pieces_by_unique(arr, self.encode_pieces)


def make_unigram_encoder(vocab: DataFrame, specials: Sequence[str] = (), unk: str = "[UNK]") -> UnigramEncoder:
    rows = vocab.select("id", "piece", "score", "is_special").limit(BROADCAST_ROW_LIMIT + 1).collect()
    if len(rows) > BROADCAST_ROW_LIMIT:
        raise ValueError("vocabulary too large to broadcast")
    ids = {r["piece"]: int(r["id"]) for r in rows}
    in_bytes = set(tx.BYTE_PIECES) if set(tx.BYTE_PIECES) <= set(ids) else set()
    scores = {r["piece"]: float(r["score"]) for r in rows if not r["is_special"] and r["piece"] not in in_bytes}
    max_len = max((len(p) for p in scores), default=1)
    return UnigramEncoder(scores, ids, specials, ids.get(unk, 0), max_len)


def encode_unigram(df: DataFrame, enc: UnigramEncoder, text: str = "text", out: str = "ids") -> DataFrame:
    """T1 with a unigram model (Viterbi per metaspace piece)."""
    df = df.withColumn("_p0", pre_tokenise(F.col(text), "word", enc.specials))
    return _map_pieces(df, enc, {"_p0": out})


def score_table(vocab: DataFrame) -> DataFrame:
    """V6 for a unigram vocabulary: (id, piece, score), unknown id 0 scored 0."""
    return vocab.select("id", "piece", F.when(F.col("is_special"), F.lit(0.0)).otherwise(F.col("score")).alias("score"))
