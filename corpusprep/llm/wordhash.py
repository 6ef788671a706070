"""Words of a batch of texts as 64-bit hashes, by array operations.

A batch of strings is one byte buffer with offsets. Word borders come from a
256-entry separator table; the hash of a word is a polynomial over its bytes,
taken from differences of one running sum, so no word is touched by itself.
Work is done in pieces of a few MB: memory follows the piece, not the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
PIECE_BYTES = 1 << 21
_powers: dict[str, np.ndarray] = {}


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte table that is True inside the given inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a:b + 1] = True
    return t


#: White space 0x09-0x0D and 0x20: what stands between words.
SPACE = separators((0x09, 0x0D), (0x20, 0x20))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "b" not in _powers or len(_powers["b"]) < n:
        size = max(n, PIECE_BYTES + 1)
        for k, v in (("b", _BASE), ("i", _INV)):
            p = np.full(size, v, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers["b"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def word_spans(raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray):
    """(start, end, first): byte range of every word, and per text the index of
    its first word (one entry more than texts)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = ~sep[raw[lo:hi]]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(inside) + 1, bool)      # a text starts here
    edge[offsets - lo] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s = np.flatnonzero(start) + lo
    e = np.flatnonzero(end) + lo + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    out = np.empty(len(s), U64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + PIECE_BYTES, "right")))
        lo, hi = int(s[i]), int(e[j - 1])
        b, inv = _pow(hi - lo + 1)
        piece = raw[lo:hi]
        v = (LOWER[piece] if lower else piece).astype(U64) + U64(1)
        run = np.zeros(hi - lo + 1, U64)
        np.cumsum(v * b[:hi - lo], out=run[1:])
        a, z = s[i:j] - lo, e[i:j] - lo
        out[i:j] = mix((run[z] - run[a]) * inv[a] + (z - a).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def hash_word(word: str) -> int:
    """The same hash for one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]), lower=False)[0])


def windows(words: np.ndarray, first: np.ndarray, k: int):
    """Hashes of every ``k`` consecutive words inside one text (a text of fewer
    words, but one at least, has one window of all its words), and per text
    the index of its first window."""
    n = np.diff(first)
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(n)), per)
    pos = first[:-1][text] + np.arange(at[-1]) - at[:-1][text]
    last = first[1:][text]
    h = np.zeros(len(pos), U64)
    for i in range(k):
        p = pos + i
        ok = p < last
        w = np.where(ok, words[np.minimum(p, max(len(words) - 1, 0))], U64(0)) if len(words) else h
        h = mix(h * U64(0x2545F4914F6CDD1D) + w + U64(i + 1))
    return h, at


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """Ranges of texts that hold about ``limit`` bytes (one text at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j
