"""Operator 13: byte-level BPE by a segment tree over byte positions, and decoding.

A text is cut into the matches of a pattern; each match is merged by itself.
Leaf i of its tree holds the rank of the pair (token that starts at byte i, next
live token) and i itself, packed so that the minimum over the leaves is the
leftmost pair of lowest rank; it stands at the root. A merge makes three point
updates, each one path to the root: the merged token's new pair, the pair of its
live left neighbour, and the absorbed token's leaf, which empties. A match of n
bytes thus costs O(n log n), also where it is one run without any boundary.

Short matches are merged together: a forest of equally wide trees, one row of an
array each, takes one merge of every tree per round. Each worker keeps the ids
of the short matches it has seen (bounded).
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusprep.llm.bpe_boundary import text_slices

WIDTHS = (4, 8, 16, 32, 64)     # bytes of a match that the forest takes
FOREST_BYTES = 1 << 17          # leaves of one forest
CACHE_ENTRIES = 400_000
CACHE_CHARS = 32
CHUNK_CHARS = 1 << 20           # a longer text is cut into matches bit by bit
CHUNK_WORDS = 1 << 16
ID_BYTES = 4
_NONE = np.iinfo(np.int64).max  # leaf without a mergeable pair


def class_stand_ins() -> dict[int, str]:
    """Characters that the splitter here and the tiktoken library, whose Unicode
    tables differ in age, put in different classes, each with a character that
    is in tiktoken's class here (letter, number, or neither)."""
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    one_byte = {bytes([b]): b for b in range(256)}
    out: dict[int, str] = {}
    for cls, inside in ((r"\p{L}", "\xe9"), (r"\p{N}", "\xb2")):
        probe = tiktoken.Encoding("probe", pat_str=cls, mergeable_ranks=one_byte, special_tokens={})
        theirs, ours = set(probe.decode(probe.encode_ordinary(every))), set(regex.findall(cls, every))
        for c in ours - theirs:
            out.setdefault(ord(c), "\ue000")
        for c in theirs - ours:
            out[ord(c)] = inside
    return out


class SegmentTree:
    """Leftmost minimum over ``values`` with logarithmic point updates. Leaf i
    is ``value * size + i``; None stands for no value."""

    def __init__(self, values: list[int | None]):
        self.size = 1 << max(0, len(values) - 1).bit_length()
        self.tree = [_NONE] * self.size + [
            _NONE if v is None else v * self.size + i for i, v in enumerate(values)]
        self.tree += [_NONE] * (2 * self.size - len(self.tree))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def lowest(self) -> tuple[int, int] | None:
        """(value, position) of the leftmost minimum."""
        top = self.tree[1]
        return None if top == _NONE else divmod(top, self.size)

    def update(self, i: int, value: int | None) -> None:
        t, at = self.tree, i + self.size
        t[at] = _NONE if value is None else value * self.size + i
        at >>= 1
        while at:
            low = min(t[2 * at], t[2 * at + 1])
            if t[at] == low:
                return
            t[at] = low
            at >>= 1


class SegmentEncoder:
    """Encoder and decoder of a file of ranks (base64 token and rank a line)
    under a splitting pattern. All 256 bytes must be tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.stand_ins = class_stand_ins()
        # a quick look whether a text has one: from the first of them on, exactly after that
        self.odd = frozenset(map(chr, self.stand_ins))
        self.high = re.compile(f"[{chr(min(self.stand_ins))}-\U0010ffff]") if self.stand_ins else None
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for b, r in self.ranks.items():
            self.pieces[r] = b
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to make a token of two tokens, for array look-ups
        self.base = len(self.pieces)
        made = sorted((self.ranks[t[:i]] * self.base + self.ranks[t[i:]], r) for t, r in self.ranks.items()
                      for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.pair_keys = np.array([k for k, _ in made] + [_NONE], np.int64)
        self.pair_ranks = np.array([r for _, r in made] + [-1], np.int64)
        self.byte_pairs = self.pair_rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        self.seen: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair of ids; -1 where it is no token."""
        key = left * self.base + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_one(self, raw: bytes) -> list[int]:
        """Ids of one match of any length by its own tree."""
        n, rank = len(raw), self.ranks.get
        if n < 2:
            return [self.ranks[raw]] if n else []
        end = list(range(1, n + 1))         # where the live token that starts here ends
        before = list(range(-1, n - 1))     # start of the live token to the left
        tree = SegmentTree([rank(raw[i:i + 2]) for i in range(n - 1)])
        while (top := tree.lowest()) is not None:
            i = top[1]
            j = end[i]
            stop = end[i] = end[j]
            if j < n - 1:
                tree.update(j, None)
            if stop < n:
                before[stop] = i
                tree.update(i, rank(raw[i:end[stop]]))
            else:
                tree.update(i, None)
            if i:
                p = before[i]
                tree.update(p, rank(raw[p:stop]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i:end[i]]])
            i = end[i]
        return out

    def merge_forest(self, raws: list[bytes], width: int) -> list[bytes]:
        """Ids (4 bytes each) of matches of 2 to ``width`` bytes, all merged at
        once: a row is one tree."""
        n = len(raws)
        size = np.array([len(r) for r in raws])
        flat = np.zeros((n, width), np.uint8)
        inside = np.arange(width) < size[:, None]
        flat[inside] = np.frombuffer(b"".join(raws), np.uint8)
        ids = self.byte_ids[flat].ravel()
        rank = self.byte_pairs[flat[:, :-1], flat[:, 1:]]
        tree = np.full((n, 2 * width), _NONE, np.int64)
        tree[:, width:2 * width - 1] = np.where((rank >= 0) & inside[:, 1:], rank * width + np.arange(width - 1), _NONE)
        half = width
        while half > 1:
            half >>= 1
            tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
        tree = tree.ravel()
        at = np.tile(np.arange(width), n)
        after, before = at + 1, at - 1
        live = inside.ravel().copy()
        row = np.arange(n)
        while True:
            top = tree[row * 2 * width + 1]
            row, top = row[top < _NONE], top[top < _NONE]
            if not len(row):
                break
            made, i = top // width, top % width
            at, of = row * width, row * 2 * width
            j = after[at + i]
            k = after[at + j]
            p = before[at + i]
            ids[at + i] = made
            live[at + j] = False
            after[at + i] = k
            right, left = np.flatnonzero(k < size[row]), np.flatnonzero(p >= 0)
            before[at[right] + k[right]] = i[right]
            leaf = np.full(len(row), _NONE, np.int64)
            tree[of + width + j] = _NONE
            r = self.pair_rank(made[right], ids[at[right] + k[right]])
            leaf[right] = np.where(r >= 0, r * width + i[right], _NONE)
            tree[of + width + i] = leaf
            r = self.pair_rank(ids[at[left] + p[left]], made[left])
            tree[of[left] + width + p[left]] = np.where(r >= 0, r * width + p[left], _NONE)
            p = np.where(p >= 0, p, i)
            paths = [width + x for x in (p, i, j)]
            for _ in range(width.bit_length() - 1):
                paths = [x >> 1 for x in paths]
                for x in paths:
                    tree[of + x] = np.minimum(tree[of + 2 * x], tree[of + 2 * x + 1])
        raw = ids[live].astype("<u4").tobytes()
        stop = (np.cumsum(live.reshape(n, width).sum(axis=1)) * ID_BYTES).tolist()
        return [raw[a:b] for a, b in zip([0, *stop], stop)]

    def matches(self, text: str):
        """The pattern's matches in order, as tiktoken's character classes have them."""
        if self.high is not None and not text.isascii() and self.high.search(text) and not self.odd.isdisjoint(text):
            same = text.translate(self.stand_ins)
            return (text[m.start():m.end()] for m in self.pattern.finditer(same))
        if len(text) > CHUNK_CHARS:
            return (m.group() for m in self.pattern.finditer(text))
        return self.pattern.findall(text)

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct matches. A match that is a token is that token."""
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[tuple[int, bytes]]] = {}
        for i, w in enumerate(words):
            raw = w.encode()
            r = self.ranks.get(raw)
            if r is not None:
                out[i] = r.to_bytes(ID_BYTES, "little")
            elif len(raw) > WIDTHS[-1]:
                out[i] = np.array(self.merge_one(raw), "<u4").tobytes()
            else:
                width = next(x for x in WIDTHS if len(raw) <= x)
                classes.setdefault(width, []).append((i, raw))
        for width, held in classes.items():
            step = FOREST_BYTES // width
            for a in range(0, len(held), step):
                part = held[a:a + step]
                for (i, _), ids in zip(part, self.merge_forest([raw for _, raw in part], width)):
                    out[i] = ids
        return out

    def ids_of(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of matches, one after the other."""
        here = set().union(*lists)
        new = list(here.difference(self.seen))
        if len(self.seen) + len(new) > CACHE_ENTRIES:   # keep what is in use now
            self.seen = {w: self.seen[w] for w in here if w in self.seen}
        known = self.seen
        known.update(zip(new, self.learn(new)))
        out = [b"".join(map(known.__getitem__, ws)) for ws in lists]
        for w in new:
            if len(w) > CACHE_CHARS:    # long ones hardly recur
                del known[w]
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if any(len(t) > CHUNK_CHARS for t in texts):
            return [self.encode_long(t) if len(t) > CHUNK_CHARS else self.encode_batch([t])[0] for t in texts]
        return self.ids_of([list(self.matches(t)) for t in texts])

    def encode_long(self, text: str) -> bytes:
        """As ``encode_batch``, holding only some of the matches at a time."""
        out, found = [], iter(self.matches(text))
        while words := list(islice(found, CHUNK_WORDS)):
            out += self.ids_of([words])
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' bytes one after the other (need not be valid UTF-8)."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], SegmentEncoder] = {}


def encoder(path: str, pattern: str) -> SegmentEncoder:
    """The worker's encoder of a file of ranks (read once per worker)."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = SegmentEncoder(path, pattern)
    return _encoders[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """Encode every whole text by the ranks in ``path``, each match of
    ``pattern`` by itself and no special tokens, then decode the ids.

    Returns per row of ``docs``: ``key`` (null stays null, repeated rows stay
    repeated), ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers), ``decoded_sha256`` (of the decoded bytes), and
    with ``with_ids`` also ``ids`` (binary). A null or empty text has no ids;
    characters that no match holds are left out, as the pattern says. Of pairs
    with equal rank the leftmost is merged first. Very long texts and very long
    matches are encoded whole. Other columns of ``docs`` are ignored, so none
    can clash; an empty table gives an empty result. No shuffle: one Arrow pass
    above the scan."""
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    names = [f.name for f in fields]

    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            for start, texts in text_slices(b.column(1)):
                ids = enc.encode_batch(texts)
                cols = [b.column(0).slice(start, len(texts)),
                        pa.array([len(x) // ID_BYTES for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids], pa.string())]
                if with_ids:
                    cols.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(key, text).mapInArrow(run, T.StructType(fields))
