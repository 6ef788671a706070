"""V1 BPE vocabulary training and T1 BPE encoding.

Training semantics (the public BPE trainer's): special tokens take the first
ids, then every character of the corpus in code-point order, then one token
per merge. A merge joins the adjacent pair with the highest count (ties: the
lowest (left id, right id) pair), everywhere, left to right, until the
vocabulary is full. Words are the metaspace pieces.

Plan:
* the word table ``(wid, symbols array<int>, freq)`` comes from the piece count
  (A6), the only pass over the corpus; words of one symbol drop out since
  they hold no pair;
* per round, pair counts are a distributed ``groupBy(a, b)``; the first ``top_k``
  pairs by (count desc, a, b) come to the driver, and some of the first of these
  are the round's pairs;
* every word is cut where a pair stands that is not one of them. What is left,
  runs of symbols whose pairs all are, is added up over the words, so the many
  words become few distinct runs; the round has as many pairs as make about
  ``pull_words`` runs, counted beforehand for several choices;
* the runs are fetched and the training goes on over them alone. That is the
  training over all words as long as the best pair comes before the first pair
  that is not the round's: counts of old pairs only fall, and a merged token
  stands before a cut at most as often as the pair there did. Where a merge makes
  a token that exists already, its pairs may grow at the cuts, unseen; by how
  much at most is known from the runs, and the round ends before that matters;
* the round's merges are applied to the word table in their order, in tasks,
  and the next round counts again;
* the table is written to the shared checkpoint folder every
  ``checkpoint_every`` rounds.

Encoding: an Arrow pass per partition; pieces are cut on the JVM (specials
first), each distinct piece is merged by rank once per task (cache) over a
linked list of symbols with a heap of pairs, so a piece of n characters takes
O(n log n), and the merge table (bounded by the vocabulary size, checked)
travels with the task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions import text as tx
from corpusprep.operators.tokenise import Lookup, _map_pieces, map_pieces_by_unique, pre_tokenise
from corpusprep.operators.vocab import VOCAB_SCHEMA, word_counts
from corpusprep.session import BROADCAST_ROW_LIMIT, reliable_checkpoint

MERGES_SCHEMA = "rank int, left_id int, right_id int, id int, count long"
ALPHABET_LIMIT = 1_000_000
WORDS_PER_PARTITION = 200_000
TOP_PAIRS = 200_000
PULL_WORDS = 150_000    # runs that a round fetches, about


def _pairs(words: DataFrame) -> DataFrame:
    """(a, b, n, d): adjacent symbol pairs weighted by word frequency, and how
    often they stand in the words as listed."""
    s = F.col("symbols")
    n = F.size(s) - 1
    z = F.arrays_zip(F.slice(s, 1, n).alias("a"), F.slice(s, 2, n).alias("b"))
    return (words.select(F.explode(z).alias("p"), "freq")
            .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
            .agg(F.sum("freq").alias("n"), F.count(F.lit(1)).alias("d")))


def _merge_symbols(sym: list[int], table: dict[tuple[int, int], int]) -> list[int]:
    """One left-to-right pass joining every pair found in ``table``."""
    out, i, m = [], 0, len(sym)
    while i < m:
        if i + 1 < m:
            nid = table.get((sym[i], sym[i + 1]))
            if nid is not None:
                out.append(nid)
                i += 2
                continue
        out.append(sym[i])
        i += 1
    return out


_PAIR_SHIFT = 1 << 32


def _merge_flat(flat: np.ndarray, offs: np.ndarray, keys: np.ndarray, nids: np.ndarray):
    """Vectorised left-to-right merge of one Arrow batch of words.

    ``flat`` holds every symbol, ``offs`` the row offsets. Hits are adjacent
    pairs inside a row whose key is in ``keys`` (sorted). Two different pairs of
    one call must never overlap, so the only overlapping hits are runs of one
    self-pair (a, a): inside such a run the left-to-right rule takes every other
    hit. Returns new (values, offsets)."""
    k = flat[:-1] * _PAIR_SHIFT + flat[1:]
    pos = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    hit = keys[pos] == k
    last = offs[1:] - 1                    # a pair starting at a row's last symbol crosses rows
    hit[last[(last >= 0) & (last < k.size)]] = False
    h = np.nonzero(hit)[0]
    if h.size == 0:
        return None
    idx = np.arange(h.size)
    start = np.ones(h.size, dtype=bool)
    start[1:] = h[1:] != h[:-1] + 1
    run0 = np.maximum.accumulate(np.where(start, idx, 0))
    h = h[(idx - run0) % 2 == 0]
    out = flat.copy()
    out[h] = nids[pos[h]]
    keep = np.ones(flat.size, dtype=bool)
    keep[h + 1] = False
    removed = np.concatenate([[0], np.cumsum(~keep)])
    return out[keep], offs - removed[offs]


def _ranks(flat: np.ndarray, offs: np.ndarray, keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Rank of the pair at each symbol and the next one; past all ranks where
    the pair has none or crosses rows. ``keys`` is sorted, ``rank`` in its order."""
    out = np.full(flat.size, len(keys), np.int64)
    if flat.size > 1 and len(keys):
        k = flat[:-1] * _PAIR_SHIFT + flat[1:]
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        out[:-1] = np.where(keys[at] == k, rank[at], len(keys))
    last = offs[1:] - 1
    out[last[last >= 0]] = len(keys)
    return out


def _runs(ranks: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(first symbol, number of symbols) of the runs whose pairs are among the
    first ``many``."""
    ok = np.concatenate([[False], ranks < many, [False]])
    edge = np.flatnonzero(ok[1:] != ok[:-1])
    start, end = edge[::2], edge[1::2]
    return start, end - start + 1


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    o = np.asarray(col.offsets, dtype=np.int64)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), o - o[0]


def _count_runs(words: DataFrame, keys: np.ndarray, rank: np.ndarray, levels: list[int]) -> dict[int, int]:
    """About how many distinct runs there are for the first n pairs, for each n of ``levels``."""
    si = words.columns.index("symbols")
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def run(batches):
        for b in batches:
            flat, offs = _flat(b.column(si))
            if not flat.size:
                continue
            ranks = _ranks(flat, offs, keys, rank)
            power, inverse = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(flat.size, x)])) for x in (base, back))
            x = flat.astype(np.uint64) + np.uint64(1)
            x = (x ^ (x << np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9)
            total = np.concatenate([[np.uint64(0)], np.add.accumulate(x * power[:-1])])
            for n in levels:
                start, size = _runs(ranks, n)
                h = np.unique((total[start + size] - total[start]) * inverse[start]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n), pa.int32()), pa.array(h)], ["n", "h"])

    rows = words.mapInArrow(run, "n int, h long").groupBy("n").agg(F.approx_count_distinct("h").alias("c")).collect()
    return {r["n"]: r["c"] for r in rows}


def _fetch_runs(words: DataFrame, keys: np.ndarray, rank: np.ndarray, many: int) -> DataFrame:
    """(symbols, freq) of the distinct runs of the first ``many`` pairs."""
    si, fi = words.columns.index("symbols"), words.columns.index("freq")

    def run(batches):
        for b in batches:
            flat, offs = _flat(b.column(si))
            start, size = _runs(_ranks(flat, offs, keys, rank), many)
            freq = b.column(fi).to_numpy(zero_copy_only=False)[np.searchsorted(offs, start, "right") - 1]
            ends = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[at], pa.int32())),
                                              pa.array(freq, pa.int64())], ["symbols", "freq"])

    return words.mapInArrow(run, "symbols array<int>, freq long").groupBy("symbols").agg(F.sum("freq").alias("freq"))


def _merge_in_order(ids: list[int], rank: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Every merge of ``rank`` (pair -> (rank, new id)) applied once, in their
    order, each left to right."""
    n = len(ids)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r[0], i) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        at, i = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or (r := rank.get((ids[i], ids[j]))) is None or r[0] != at:
            continue
        ids[i], live[j] = r[1], False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x in (before[i], i):
            y = after[x] if x >= 0 else n
            # a merge that is over does not come back
            if y < n and (r := rank.get((ids[x], ids[y]))) is not None and r[0] > at:
                heapq.heappush(heap, (r[0], x))
    return [x for x, ok in zip(ids, live) if ok]


FEW_MERGES = 16


def _apply_merges(words: DataFrame, made: list[tuple[int, int, int]]) -> DataFrame:
    """The word table after the merges ``made`` ((left, right, new) in their
    order): a few by passes over the whole batch, more by walking the words that
    hold one of their pairs."""
    schema, names = words.schema, words.columns
    si = names.index("symbols")
    table = {(a, b): (i, new) for i, (a, b, new) in enumerate(made)}
    keys = np.sort(np.array([a * _PAIR_SHIFT + b for a, b in table], np.int64))

    def run(batches):
        for b in batches:
            flat, offs = _flat(b.column(si))
            if len(made) <= FEW_MERGES:
                for x, y, new in made:
                    if flat.size > 1 and (res := _merge_flat(flat, offs, np.array([x * _PAIR_SHIFT + y]), np.array([new]))):
                        flat, offs = res
                arr = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([arr if i == si else c for i, c in enumerate(b.columns)], names=names)
                continue
            hit = _ranks(flat, offs, keys, np.zeros(len(keys), np.int64)) < len(keys)
            some = np.unique(np.searchsorted(offs, np.flatnonzero(hit), "right") - 1)
            if not len(some):
                yield b
                continue
            size = np.diff(offs)
            keep = np.ones(len(size), bool)
            keep[some] = False
            now = [_merge_in_order(flat[offs[i]:offs[i + 1]].tolist(), table) for i in some.tolist()]
            values = np.concatenate([flat[np.repeat(keep, size)], np.array([x for w in now for x in w], np.int64)])
            ends = np.concatenate([[0], np.cumsum(np.concatenate([size[keep], [len(w) for w in now]]))])
            order = pa.array(np.concatenate([np.flatnonzero(keep), some]))
            arr = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([arr if i == si else b.column(i).take(order) for i in range(len(names))], names=names)

    return words.mapInArrow(run, schema).filter(F.size("symbols") >= 2)


class _Merger:
    """Merging over runs of symbols: linked lists in arrays, the places of each
    pair, exact counts of the pairs in them and a heap of pairs."""

    def __init__(self, symbols: pa.ListArray, freq: np.ndarray, counts: dict[tuple[int, int], int]):
        self.sym, offs = _flat(symbols)
        n, size = len(self.sym), np.diff(offs)
        self.weight = np.repeat(freq.astype(np.int64), size)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.after[offs[1:][size > 0] - 1] = -1
        self.before[offs[:-1][size > 0]] = -1
        left = np.flatnonzero(self.after >= 0)
        key = self.sym[left] * _PAIR_SHIFT + self.sym[left + 1]
        order = np.argsort(key, kind="stable")
        pairs, first = np.unique(key[order], return_index=True)
        self.where = {k: [p] for k, p in zip(pairs.tolist(), np.split(left[order], first[1:]))} if len(pairs) else {}
        self.n = {a * _PAIR_SHIFT + b: c for (a, b), c in counts.items()}
        self.heap = [(-c, k) for k, c in self.n.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[int, tuple[int, int]] | None:
        while self.heap:
            c, k = self.heap[0]
            if c and self.n[k] == -c:
                return -c, divmod(k, _PAIR_SHIFT)
            heapq.heappop(self.heap)
        return None

    def merge(self, pair: tuple[int, int], new: int) -> tuple[int, int]:
        """Join ``pair`` everywhere; how often the token then is a run's first
        and its last symbol."""
        (a, b), sym, after, before = pair, self.sym, self.after, self.before
        k = a * _PAIR_SHIFT + b
        pos = np.unique(np.concatenate(self.where.pop(k, [np.zeros(0, np.int64)])))
        pos = pos[(sym[pos] == a) & (after[pos] >= 0)]
        pos = pos[sym[after[pos]] == b]
        if a == b:      # of a run of one symbol every other pair
            taken, gone = [], set()
            for p in pos.tolist():
                if p not in gone:
                    taken.append(p)
                    gone.add(int(after[p]))
            pos = np.array(taken, np.int64)
        q, w = after[pos], self.weight[pos]
        l, r = before[pos], after[q]

        def met(at):       # whether the places ``at`` are among ``pos``
            return pos[np.minimum(np.searchsorted(pos, at), len(pos) - 1)] == at

        right = (r >= 0) & ~met(r) if len(pos) else r >= 0
        keys = [sym[l[l >= 0]] * _PAIR_SHIFT + a, b * _PAIR_SHIFT + sym[r[right]]]
        change = [-w[l >= 0], -w[right]]
        sym[pos], sym[q] = new, -1
        after[pos] = r
        before[r[r >= 0]] = pos[r >= 0]
        l, r = before[pos], after[pos]
        at = np.concatenate([l[l >= 0], pos[right]])
        made = np.concatenate([sym[l[l >= 0]] * _PAIR_SHIFT + new, new * _PAIR_SHIFT + sym[r[right]]])
        keys = np.concatenate([*keys, made])
        change = np.concatenate([*change, w[l >= 0], w[right]])
        order = np.argsort(made, kind="stable")
        ks, first = np.unique(made[order], return_index=True)
        for x, p in zip(ks.tolist(), np.split(at[order], first[1:]) if len(ks) else ()):
            self.where.setdefault(x, []).append(p)
        ks, inverse = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(ks), np.int64)
        np.add.at(sums, inverse, change)
        for x, d in zip(ks.tolist(), sums.tolist()):
            if d and x != k:
                c = self.n[x] = self.n.get(x, 0) + d
                if c > 0:
                    heapq.heappush(self.heap, (-c, x))
        self.n[k] = 0
        return int(w[l < 0].sum()), int(w[r < 0].sum())

    def most(self, token: int, first: bool) -> int:
        """Highest count of a pair that has ``token`` in front (else behind)."""
        return max((c for k, c in self.n.items() if (k >> 32 if first else k & (_PAIR_SHIFT - 1)) == token), default=0)


def train_bpe(df: DataFrame, vocab_size: int, specials: Sequence[str], text: str = "text",
              top_k: int = TOP_PAIRS, checkpoint_every: int = 25,
              pull_words: int = PULL_WORDS) -> tuple[DataFrame, DataFrame]:
    """V1: returns (vocab (id, piece, freq, is_special), merges (rank, left_id,
    right_id, id, count)); both bounded by ``vocab_size``."""
    spark = df.sparkSession
    counts = word_counts(df, text)
    counts = reliable_checkpoint(counts)
    char_counts = (counts.select(F.explode(tx.chars(F.col("piece"))).alias("ch"), "freq")
                   .groupBy("ch").agg(F.sum("freq").alias("freq")))
    alpha = char_counts.limit(ALPHABET_LIMIT + 1).collect()  # alphabet-sized
    if len(alpha) > ALPHABET_LIMIT:
        raise ValueError("alphabet too large")
    alpha.sort(key=lambda r: ord(r["ch"]))
    pieces: list[str] = list(specials)
    freqs: list[int] = [0] * len(pieces)
    piece_id = {p: i for i, p in enumerate(pieces)}
    for r in alpha:
        if r["ch"] not in piece_id:
            piece_id[r["ch"]] = len(pieces)
            pieces.append(r["ch"])
            freqs.append(int(r["freq"]))
    chars_lookup = Lookup([p for p in pieces], list(range(len(pieces))), piece_id.get("[UNK]", 0))
    words = counts.select(tx.chars(F.col("piece")).alias("symbols"), "freq")
    words = _map_pieces(words, chars_lookup, {"symbols": "symbols"}).filter(F.size("symbols") >= 2)
    # the word table is far smaller than the corpus: size its partitions to it,
    # but keep every core busy
    n_words = counts.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n_words // WORDS_PER_PARTITION))
    words = reliable_checkpoint(words.repartition(parts).withColumn("wid", F.monotonically_increasing_id()))
    merges: list[tuple[int, int, int, int, int]] = []

    def take(a: int, b: int, n: int) -> tuple[int, bool]:
        """Give the merged token an id; whether it is new."""
        new = pieces[a] + pieces[b]
        nid = piece_id.setdefault(new, len(pieces))
        fresh = nid == len(pieces)
        if fresh:
            pieces.append(new)
            freqs.append(n)
        merges.append((len(merges), a, b, nid, n))
        return nid, fresh

    def trained(top: pa.Table, many: int, whole: bool, keys: np.ndarray, rank: np.ndarray) -> list[tuple[int, int, int]]:
        """Merge over the runs of the first ``many`` pairs; the merges made."""
        rows = _fetch_runs(words, keys, rank, many).toArrow()
        first = top.slice(0, many)
        pairs = list(zip(first["a"].to_pylist(), first["b"].to_pylist()))
        counts = first["n"].to_pylist()
        m = _Merger(rows["symbols"].combine_chunks(), rows["freq"].to_numpy(), dict(zip(pairs, counts)))
        # pairs that are not the round's come after its last one
        edge = (0, (0, 0)) if whole else (counts[-1], pairs[-1])
        made, done, limit = [], set(), 0
        unseen: dict[tuple[int, bool], int] = defaultdict(int)      # growth at cuts behind (in front of) a token, at most
        while len(pieces) < vocab_size and (best := m.best()) is not None:
            n, pair = best
            if made and (n <= limit or pair in done or (not whole and (-n, pair) > (-edge[0], edge[1]))):
                break
            nid, fresh = take(*pair, n)
            heads, tails = m.merge(pair, nid)
            made.append((*pair, nid))
            done.add(pair)
            if not fresh and not whole:
                for side, weight in ((True, tails), (False, heads)):
                    unseen[nid, side] += min(weight, edge[0])
                    if grown := unseen[nid, side]:
                        limit = max(limit, edge[0] + grown, m.most(nid, side) + grown)
        return made

    rounds, old = 0, None
    while len(pieces) < vocab_size:
        top = _pairs(words).orderBy(F.desc("n"), "a", "b").limit(int(top_k)).toArrow()
        if old is not None:
            old.unpersist()  # the new table is cached now
            old = None
        if not top.num_rows or top["n"][0].as_py() < 1:
            break
        keys = top["a"].to_numpy().astype(np.int64) * _PAIR_SHIFT + top["b"].to_numpy()
        rank = np.argsort(keys, kind="stable")
        keys = keys[rank]
        # as many pairs as make few enough runs; their places are no fewer than their runs
        sure = max(1, int(np.searchsorted(np.cumsum(top["d"].to_numpy()), pull_words, "right")))
        levels = sorted({max(sure, top.num_rows * 2 // 3 ** i) if i else top.num_rows for i in range(12)} - {sure})
        counts = _count_runs(words, keys, rank, levels) if levels else {}
        many = max([sure, *(n for n in levels if counts.get(n, 0) <= pull_words)])
        new = _apply_merges(words, trained(top, many, many == top.num_rows < top_k, keys, rank))
        old, words = words, new
        rounds += 1
        if rounds % checkpoint_every == 0:
            words = reliable_checkpoint(words)
            old.unpersist()
            old = None
        else:
            words = words.persist()  # filled by the next round's pair count
    words.unpersist()
    k = len(specials)
    vocab = spark.createDataFrame(
        [(i, p, int(freqs[i]), i < k) for i, p in enumerate(pieces)], VOCAB_SCHEMA)
    mdf = spark.createDataFrame(merges, MERGES_SCHEMA)
    return vocab, mdf


class BpeModel:
    """Picklable merge table for tasks: pair -> (rank, new id)."""

    def __init__(self, pieces: list[str], ids: list[int], merges: list[tuple[int, int, int, int]],
                 unk_id: int, specials: Sequence[str]):
        self.pieces, self.ids, self.merges, self.unk_id = pieces, ids, merges, unk_id
        self.specials = list(specials)
        self._ready = False

    def __getstate__(self):
        return {"pieces": self.pieces, "ids": self.ids, "merges": self.merges,
                "unk_id": self.unk_id, "specials": self.specials}

    def __setstate__(self, st):
        self.__init__(st["pieces"], st["ids"], st["merges"], st["unk_id"], st["specials"])

    def _prepare(self):
        if not self._ready:
            self._id = dict(zip(self.pieces, self.ids))
            self._rank = {(a, b): (r, i) for r, a, b, i in self.merges}
            self._cache: dict[str, list[int]] = {}
            self._ready = True

    def _merged(self, ids: list[int]) -> list[int]:
        """Merge by rank, of equal ranks the leftmost first: symbols are a linked
        list, their pairs a heap of (rank, position); an entry that no longer
        says what stands there is passed over."""
        n, rank = len(ids), self._rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            at, i = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or (r := rank.get((ids[i], ids[j]))) is None or r[0] != at:
                continue
            ids[i], live[j] = r[1], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if y < n and (r := rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r[0], x))
        return [x for x, ok in zip(ids, live) if ok]

    def encode_piece(self, piece: str) -> list[int]:
        self._prepare()
        hit = self._cache.get(piece)
        if hit is not None:
            return hit
        sid = self._id.get(piece)
        if piece in self.specials and sid is not None:
            out = [sid]
        else:
            out = self._merged([self._id.get(ch, self.unk_id) for ch in piece])
        if len(self._cache) < 1_000_000:
            self._cache[piece] = out
        return out

    def map_list_array(self, arr: pa.ListArray) -> pa.ListArray:
        return map_pieces_by_unique(arr, lambda pieces: [self.encode_piece(p) for p in pieces])


def make_bpe_model(vocab: DataFrame, merges: DataFrame, specials: Sequence[str] = (),
                   unk: str = "[UNK]") -> BpeModel:
    """Driver copy of the vocabulary and merge table, size-checked."""
    v = vocab.select("piece", "id").limit(BROADCAST_ROW_LIMIT + 1).collect()
    m = merges.select("rank", "left_id", "right_id", "id").limit(BROADCAST_ROW_LIMIT + 1).collect()
    if len(v) > BROADCAST_ROW_LIMIT or len(m) > BROADCAST_ROW_LIMIT:
        raise ValueError("BPE model too large to broadcast")
    pieces, ids = [r["piece"] for r in v], [int(r["id"]) for r in v]
    unk_id = dict(zip(pieces, ids)).get(unk, 0)
    return BpeModel(pieces, ids, [tuple(int(x) for x in r) for r in m], unk_id, specials)


def encode_bpe(df: DataFrame, model: BpeModel, text: str | dict[str, str] = "text",
               out: str = "ids") -> DataFrame:
    """T1 with a BPE model: add ``out`` = ids of ``text`` (several columns at
    once with a {text_col: out_col} mapping)."""
    mapping = text if isinstance(text, dict) else {text: out}
    tmp = {}
    for i, (src, dst) in enumerate(mapping.items()):
        df = df.withColumn(f"_p{i}", pre_tokenise(F.col(src), "word", model.specials))
        tmp[f"_p{i}"] = dst
    return _map_pieces(df, model, tmp)


def bpe_ids_schema() -> T.ArrayType:
    return T.ArrayType(T.IntegerType())
