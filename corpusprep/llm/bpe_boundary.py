"""Operator 10: byte-level BPE encoding by forced boundaries, and decoding.

A byte pair that stands inside no token of the vocabulary (added tokens
included) can never be joined by a merge, so a text may be cut there and the
fragments encoded by themselves; the ids of the text are the fragments' ids in
order. A blank is such a place wherever the table allows a cut between it and the
byte before, so the coarse fragments of a text are found by splitting at blanks
and joining again what the table does not cut. Two conditions keep the pre-tokeniser's view the same on both sides:

* the byte left of the cut is no white space (its pattern looks ahead after
  white space only), and
* the byte right of it starts a character that is not an apostrophe (a
  contraction is recognised at the start of a match only).

Natural text is cut about once a word, so a fragment recurs many times: each
worker keeps the ids of fragments it has seen (bounded), and only new
fragments go to the tokenizers library. Fragments of any length are right; a
text without any boundary is one fragment.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# White space of the pre-tokeniser's pattern: ASCII here; of the others the
# last byte, which a cut may not follow when the byte before it is one of LEAD.
_ASCII_SPACE = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32)
_LEAD = (0xC2, 0x80, 0x81, 0x9A)
_SPACE_PAIR = re.compile(r"\s ")
# Letters whose class no Unicode version has changed.
_OLD_LETTERS = "\u0250"
CACHE_ENTRIES = 1_500_000
CACHE_CHARS = 48
BATCH_BYTES = 1 << 21
ID_BYTES = 4


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary: the
    printable Latin-1 bytes stand for themselves, the others for the
    characters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BoundaryEncoder:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        # one thread a task: Spark's tasks fill the cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        sym = byte_symbols()
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_of = dict(added)
        for tok, i in spec["model"]["vocab"].items():
            if i not in added:
                self.bytes_of[i] = bytes(sym[c] for c in tok)
        size = max(self.bytes_of) + 1
        self.pieces = [self.bytes_of.get(i, b"") for i in range(size)]
        inside = np.zeros((256, 256), bool)
        for b in self.bytes_of.values():
            a = np.frombuffer(b, np.uint8)
            inside[a[:-1], a[1:]] = True
        cut = ~inside
        cut[list(_ASCII_SPACE), :] = False
        cut[:, 0x80:0xC0] = False
        cut[:, ord("'")] = False
        self.cut = cut.ravel()
        # bytes that the table does not cut from a blank behind them
        held = [x for x in range(256) if x not in _ASCII_SPACE and not self.cut[x << 8 | 32]]
        self.held = frozenset(held)
        self.held_blank = re.compile(b"[" + b"".join(re.escape(bytes([x])) for x in held) + b"] ") if held else None
        self.symbols = {b: c for c, b in sym.items()}     # for str.translate of Latin-1
        # ids of fragments seen so far; those that follow a blank without it
        self.heads: dict[str, bytes] = {}
        self.seen: dict[str, bytes] = {}

    def cuts(self, raw: bytes) -> np.ndarray:
        """Per byte, whether ``raw`` may be cut before it for certain."""
        a = np.frombuffer(raw, np.uint8)
        ok = np.zeros(len(a), bool)
        if len(a) > 1:
            ok[1:] = self.cut[(a[:-1].astype(np.uint16) << 8) | a[1:]]
        if len(a) > 2:  # after a character that may be wide white space: no cut
            ok[2:] &= ~((a[1:-1] >= 0x80) & np.isin(a[:-2], _LEAD))
        return ok

    def fragments(self, texts: list[str]) -> list[list[str]]:
        """The fragments of each text, found over all texts at once."""
        raws = [t.encode() for t in texts]
        raw = b"".join(raws)
        first = np.cumsum([0, *map(len, raws)])
        ok = self.cuts(raw)
        ok[first[:-1][first[:-1] < len(raw)]] = True
        at = np.flatnonzero(ok)
        per = np.searchsorted(at, first).tolist()
        at = [*at.tolist(), len(raw)]
        cut = [raw[i:j].decode() for i, j in zip(at, at[1:])]
        return [cut[i:j] for i, j in zip(per, per[1:])]

    def words(self, text: str) -> tuple[list[str], list[str]]:
        """Coarse fragments: the text cut before each blank that the table cuts from
        the byte before; by all byte pairs if a blank follows white space. Returns
        (fragments as they are, fragments without their leading blank), in order."""
        if _SPACE_PAIR.search(text):
            return self.fragments([text])[0], []
        tail = text.split(" ")
        if self.held_blank is not None and self.held_blank.search(text.encode()):
            runs, open_run = [], [tail[0]]
            for prev, w in zip(tail, tail[1:]):
                if prev and prev[-1].encode()[-1] in self.held:
                    open_run.append(w)
                else:
                    runs.append(" ".join(open_run))
                    open_run = [w]
            tail = [*runs, " ".join(open_run)]
        head = tail.pop(0)
        return ([head] if head else []), tail

    def _ids(self, fragments: list[str]) -> list[bytes]:
        """Ids of fragments: by the library's BPE model where a fragment is one
        pre-token for certain (a word of letters), else by its whole encoder."""
        out: list[bytes] = [b""] * len(fragments)
        rest = []
        tokenize, symbols = self.lib.model.tokenize, self.symbols
        for i, f in enumerate(fragments):
            if self._plain(f[f[:1] == " ":]):
                out[i] = array("I", [t.id for t in tokenize(f.encode().decode("latin-1").translate(symbols))]).tobytes()
            else:
                rest.append(i)
        for i, e in zip(rest, self.lib.encode_batch_fast([fragments[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    def _plain(self, word: str) -> bool:
        """Whether the word is letters of one pre-token for certain."""
        return word.isalpha() and (word.isascii() or max(word) < _OLD_LETTERS)

    def _ends(self, word: str) -> bool:
        """Whether the word's last character may be cut off for certain."""
        b = word[-3:].encode()
        return bool(self.cut[b[-2] << 8 | b[-1]]) and not (b[-2] >= 0x80 and len(b) > 2 and b[-3] in _LEAD)

    def _learn(self, new: set[str], known: dict[str, bytes], blank: str) -> None:
        """Put the ids of new coarse fragments into ``known``. Words of letters go
        to the model, a word with one ASCII mark behind it is the word and the
        mark, all others are cut by their byte pairs."""
        heads = self.heads
        stems, marked, odd = set(), [], []
        for f in new:
            if self._plain(f):
                stems.add(f)
            elif len(f) > 1 and f[-1] < "\x80" and self._plain(f[:-1]) and self._ends(f):
                marked.append(f)
                if f[:-1] not in known:
                    stems.add(f[:-1])
                if f[-1] not in heads:
                    heads[f[-1]] = self._ids([f[-1]])[0]
            else:
                odd.append(f)
        order = list(stems)
        known.update(zip(order, self._ids([blank + f for f in order])))
        for f in marked:
            known[f] = known[f[:-1]] + heads[f[-1]]
        if not odd:
            return
        fine = self.fragments([blank + f for f in odd])
        memo: dict[str, bytes] = {}
        todo = []
        for fs in fine:
            for x in fs:
                if x not in memo:
                    got = heads.get(x)
                    memo[x] = got or b""
                    if got is None:
                        todo.append(x)
        memo.update(zip(todo, self._ids(todo)))
        for f, fs in zip(odd, fine):
            known[f] = b"".join([memo[x] for x in fs])
            for x in fs[1:]:
                if len(x) <= CACHE_CHARS:
                    heads[x] = memo[x]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        held: list[tuple[list[str], list[str]]] = []
        size = 0
        for t in texts:
            held.append(self.words(t) if t else ([], []))
            size += len(t)
            if size >= BATCH_BYTES:
                out += self._flush(held)
                held, size = [], 0
        return out + self._flush(held)

    def _flush(self, held: list[tuple[list[str], list[str]]]) -> list[bytes]:
        first = set().union(*[h for h, _ in held])
        later = set().union(*[t for _, t in held])
        if len(self.seen) + len(self.heads) > CACHE_ENTRIES:    # keep what is in use now
            self.heads = {f: self.heads[f] for f in first if f in self.heads}
            self.seen = {f: self.seen[f] for f in later if f in self.seen}
        heads, seen = self.heads, self.seen
        long = []
        for known, blank, here in ((heads, "", first), (seen, " ", later)):
            new = here.difference(known)
            if new:
                self._learn(new, known, blank)
                long += [(known, f) for f in new if len(f) > CACHE_CHARS]
        out = [b"".join([*map(heads.__getitem__, h), *map(seen.__getitem__, t)]) for h, t in held]
        for known, f in long:       # long fragments hardly recur
            del known[f]
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: the tokens' bytes, with every invalid
        sequence replaced by U+FFFD (special tokens are kept)."""
        p = self.pieces
        raw = b"".join(map(p.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_encoders: dict[str, BoundaryEncoder] = {}


def encoder(path: str) -> BoundaryEncoder:
    """The worker's encoder of a vocabulary file (read once per worker)."""
    if path not in _encoders:
        _encoders[path] = BoundaryEncoder(path)
    return _encoders[path]


def text_slices(col: pa.Array, limit: int = BATCH_BYTES):
    """Slices (start, texts) of a string column of about ``limit`` characters."""
    held, size, start = [], 0, 0
    for i in range(len(col)):
        t = col[i].as_py() or ""
        held.append(t)
        size += len(t)
        if size >= limit:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """Encode every text, then decode its ids.

    Returns per row of ``docs``: ``key`` (null stays null, repeated rows stay
    repeated), ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers), ``decoded_sha256`` (of the decoded text in
    UTF-8), and with ``with_ids`` also ``ids`` (binary). A null or empty text
    has no ids. Other columns of ``docs`` are ignored, so none can clash. No
    shuffle: one Arrow pass above the scan."""
    kt = docs.schema[key].dataType
    fields = [T.StructField(key, kt), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    names = [f.name for f in fields]

    def run(batches):
        enc = encoder(path)
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
