"""Segmentation lattices of many words at once (numpy inside tasks).

``PieceTrie`` is one open hash table of keys (parent, character): a node's
number is its key's slot plus one, so all pieces are walked for all positions of
a batch with one lookup per depth.

``Block`` holds words of one length, position by position: its edges of k
characters are one array, so a step of the forward, backward and best sums is a
product of whole rows, nothing is sorted and nothing is taken to logarithms.
``Lattice`` takes words of any length as a list of edges (start, end, piece) and
sums logarithms; it is for long words and for those whose probability is too
small for a double. ``lattices`` deals words out to both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CODE_BITS = 21
CHUNK_CHARS = 1 << 17
NEG_INF = -1e30
LOAD = 4                # a trie's table has at least so many slots a node
BLOCK_CHARS = 1 << 16   # characters of a block's words together
BLOCK_LENGTH = 48       # longer words are few of a length: no blocks of them
LEAST_LOG = -500.0      # a word whose characters alone are at least this likely stays far from underflow


def code_points(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings, offsets)."""
    size = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(size)])


class PieceTrie:
    """Trie over ``pieces`` (distinct, not empty); piece i is the i-th of them."""

    def __init__(self, pieces: Sequence[str]):
        flat, offs = code_points(pieces)
        size = np.diff(offs)
        self.max_len = int(size.max(initial=0))
        levels, node = [], np.zeros(len(size), np.int64)
        for d in range(self.max_len):       # by rank first: how many nodes there are says how large the table is
            live = np.flatnonzero(size > d)
            level, at = np.unique(node[live] << CODE_BITS | flat[offs[live] + d], return_inverse=True)
            levels.append((level, at, live))
            node[live] = at + 1
        bits = max(4, (LOAD * sum(len(x) for x, _, _ in levels)).bit_length())
        self.shift, self.table = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64)
        above = np.zeros(1, np.int64)
        for d, (level, at, live) in enumerate(levels):
            parent = above[(level >> CODE_BITS) - (d > 0)]
            above = self._insert(parent << CODE_BITS | level & ((1 << CODE_BITS) - 1))
            node[live] = above[at]
        self.piece_of = np.full(len(self.table) + 1, -1, np.int32)
        self.piece_of[node] = np.arange(len(size))
        self.codes, self.offs = flat.astype(np.int32), offs

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _insert(self, key: np.ndarray) -> np.ndarray:
        """Nodes of keys that are new and distinct."""
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.table[at[todo]] < 0]
            self.table[at[free]] = key[free]        # of several the last stays
            todo = todo[self.table[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & (len(self.table) - 1)
        return at + 1

    def child(self, key: np.ndarray) -> np.ndarray:
        """Node of each key ``parent << CODE_BITS | character``, 0 if there is none."""
        at = self._slot(key)
        got, node = self.table[at], at + 1
        other = np.flatnonzero(got != key)
        node[other] = 0
        other = other[got[other] >= 0]
        while len(other):
            at[other] = slot = (at[other] + 1) & (len(self.table) - 1)
            got = self.table[slot]
            same = got == key[other]
            node[other[same]] = slot[same] + 1
            other = other[~same & (got >= 0)]
        return node

    def walk(self, flat: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, places, pieces) of the pieces that stand in words of one
        length; ``flat`` has all first characters of ``width`` words, then all
        second ones and so on."""
        live, state = np.arange(len(flat)), np.zeros(len(flat), np.int64)
        for k in range(self.max_len):
            to = np.searchsorted(live, len(flat) - k * width)
            live, state = live[:to], state[:to]
            if not len(live):
                break
            state = self.child(state << CODE_BITS | flat[live + k * width])
            ok = state > 0
            live, state = live[ok], state[ok]
            piece = self.piece_of[state]
            hit = piece >= 0
            yield k, live[hit], piece[hit]

    def find(self, flat: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces that stand at any position;
        ``left`` is how many characters of its word each position has."""
        state = np.zeros(len(flat), np.int64)
        live = np.arange(len(flat))
        start, size, piece = [], [], []
        for k in range(self.max_len):
            live = live[left[live] > k]
            if not len(live):
                break
            key = state[live] << CODE_BITS | flat[live + k]
            at = self.child(key)
            ok = at > 0
            live, at = live[ok], at[ok]
            state[live] = at
            p = self.piece_of[at]
            hit = p >= 0
            start.append(live[hit])
            size.append(np.full(int(hit.sum()), k + 1))
            piece.append(p[hit])
        if not start:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(start), np.concatenate(size), np.concatenate(piece).astype(np.int64)


class Lattice:
    """All segmentations of a batch of words. A word of m characters has m + 1
    nodes; a character that is no piece is an edge of its own (piece -1)."""

    def __init__(self, trie: PieceTrie, flat: np.ndarray, offs: np.ndarray, score: np.ndarray, unknown: float,
                 whole: bool = True):
        """``score`` per piece; pieces of score -inf do not count. ``whole=False``
        leaves out edges that are a whole word of several characters."""
        size = np.diff(offs)
        word = np.repeat(np.arange(len(size)), size)
        local = np.arange(len(flat)) - offs[word]
        start, length, piece = trie.find(flat, size[word] - local)
        ok = score[piece] > -np.inf
        if not whole:
            ok &= (length == 1) | (length < size[word[start]])
        start, length, piece = start[ok], length[ok], piece[ok]
        single = np.zeros(len(flat), bool)
        single[start[length == 1]] = True
        bare = np.flatnonzero(~single)
        start = np.concatenate([start, bare])
        length = np.concatenate([length, np.ones(len(bare), np.int64)])
        self.piece = np.concatenate([piece, np.full(len(bare), -1)])
        self.score = np.concatenate([score[piece], np.full(len(bare), unknown)])
        self.word, self.tail = word[start], local[start] + length      # where the edge ends in its word
        self.head = local[start]
        self.a = start + self.word                                      # node numbers
        self.b = self.a + length
        self.first = offs[:-1] + np.arange(len(size))
        self.last = self.first + size
        self.start, self.length = start, length
        self.n_nodes = len(flat) + len(size)

    def _steps(self, by: np.ndarray, node: np.ndarray, longest_first: bool = True):
        """Edges in order of ``by``, those of a node together: (edge order, per
        step its slice, the starts of its groups)."""
        order = np.lexsort((self.a if longest_first else -self.b, node, by))
        edge = np.searchsorted(by[order], np.arange(int(by.max(initial=0)) + 2))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if i < j:
                e = order[i:j]
                n = node[e]
                yield e, np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))

    def forward(self) -> np.ndarray:
        alpha = np.full(self.n_nodes, NEG_INF)
        alpha[self.first] = 0.0
        for e, g in self._steps(self.tail, self.b):
            alpha[self.b[e[g]]] = np.logaddexp.reduceat(alpha[self.a[e]] + self.score[e], g)
        return alpha

    def backward(self) -> np.ndarray:
        beta = np.full(self.n_nodes, NEG_INF)
        beta[self.last] = 0.0
        far = int(self.head.max(initial=0))
        for e, g in self._steps(far - self.head, self.a, False):
            beta[self.a[e[g]]] = np.logaddexp.reduceat(beta[self.b[e]] + self.score[e], g)
        return beta

    def expected(self, weight: np.ndarray, n_pieces: int) -> tuple[np.ndarray, float]:
        """(expected count of each piece, log-likelihood), words weighted."""
        total = np.zeros(n_pieces)
        return total, self.add_expected(weight, total)

    def add_expected(self, weight: np.ndarray, total: np.ndarray) -> float:
        """Add the expected count of each piece to ``total``; the log-likelihood."""
        alpha, beta = self.forward(), self.backward()
        z = alpha[self.last]
        known = self.piece >= 0
        p = np.exp(alpha[self.a] + self.score + beta[self.b] - z[self.word]) * weight[self.word]
        np.add.at(total, self.piece[known], p[known])
        return float((z * weight).sum())

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """(score of each word's best segmentation, edge into each node on it);
        of equal ones the longer last piece."""
        top = np.full(self.n_nodes, NEG_INF)
        top[self.first] = 0.0
        back = np.full(self.n_nodes, -1)
        for e, g in self._steps(self.tail, self.b):
            v = top[self.a[e]] + self.score[e]
            m = np.maximum.reduceat(v, g)
            size = np.diff(np.append(g, len(e)))
            at = np.minimum.reduceat(np.where(v == np.repeat(m, size), np.arange(len(e)), len(e)), g)
            node = self.b[e[g]]
            top[node], back[node] = m, e[at]
        return top[self.last], back

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, edge) of the edges on the best segmentations, word by word in order."""
        _, back = self.best()
        at, word, out = self.last.copy(), np.arange(len(self.last)), []
        while True:
            go = at > self.first[word]
            at, word = at[go], word[go]
            if not len(at):
                break
            e = back[at]
            out.append((word, e))
            at = self.a[e]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, e = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
        order = np.lexsort((self.head[e], w))
        return w[order], e[order]

    def top(self) -> np.ndarray:
        """Score of each word's best segmentation."""
        return self.best()[0]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, first character, piece) on the best segmentations, word by word in order."""
        word, e = self.paths()
        return word, self.head[e], self.piece[e]


class Block:
    """``Lattice`` of words of one length; ``codes`` has a row per position, a
    column per word."""

    def __init__(self, trie: PieceTrie, codes: np.ndarray, score: np.ndarray, unknown: float, whole: bool = True):
        self.size, self.width = codes.shape
        self.trie, self.codes, self.score, self.unknown = trie, codes, score, unknown
        self.edges = []     # by length: (characters - 1, places, pieces)
        bare = np.ones(codes.size, bool)
        for k, at, piece in trie.walk(codes.ravel(), self.width):
            if not whole and 0 < k == self.size - 1:
                continue
            ok = score[piece] > -np.inf
            at, piece = at[ok], piece[ok]
            if k == 0:
                bare[at] = False
            if len(at):
                self.edges.append((k, at, piece))
        self.bare = np.flatnonzero(bare)

    def _rows(self, value: np.ndarray, unknown, none) -> list[tuple[int, np.ndarray]]:
        """(characters - 1, a value for each place) of the lengths there are."""
        out, known = [], {k: (at, piece) for k, at, piece in self.edges}
        for k in sorted({0, *known}):
            row = np.full((self.size - k) * self.width, none, np.asarray(value).dtype)
            if k in known:
                row[known[k][0]] = value[known[k][1]]
            if k == 0:
                row[self.bare] = unknown
            out.append((k, row.reshape(self.size - k, self.width)))
        return out

    def add_expected(self, weight: np.ndarray, total: np.ndarray) -> float:
        """Add the expected count of each piece to ``total``; the log-likelihood."""
        single = np.zeros(self.codes.size)
        for k, at, piece in self.edges[:1]:
            if k == 0:
                single[at] = self.score[piece]
        single[self.bare] = self.unknown
        low = np.flatnonzero(single.reshape(self.codes.shape).sum(0) < LEAST_LOG)
        likelihood = 0.0
        if len(low):
            flat, offs = self.codes[:, low].T.ravel(), np.arange(len(low) + 1) * self.size
            likelihood = Lattice(self.trie, flat, offs, self.score, self.unknown).add_expected(weight[low], total)
            if len(low) == self.width:
                return likelihood
            weight = weight.copy()
            weight[low] = 0.0
        rows = self._rows(np.exp(self.score), np.exp(self.unknown), 0.0)
        alpha, beta = np.zeros((self.size + 1, self.width)), np.zeros((self.size + 1, self.width))
        alpha[0], beta[self.size] = 1.0, 1.0
        part = np.empty(self.width)
        for t in range(1, self.size + 1):
            for k, row in rows:
                if k < t:
                    alpha[t] += np.multiply(alpha[t - 1 - k], row[t - 1 - k], out=part)
        for t in range(self.size - 1, -1, -1):
            for k, row in rows:
                if t + k < self.size:
                    beta[t] += np.multiply(beta[t + k + 1], row[t], out=part)
        z = alpha[self.size]
        z[low] = 1.0
        beta *= weight / z
        rows = dict(rows)
        for k, at, piece in self.edges:
            p = rows[k]
            p *= alpha[:self.size - k]
            p *= beta[k + 1:]
            np.add.at(total, piece, p.ravel()[at])
        return likelihood + float((np.log(z) * weight).sum())

    def _best(self) -> tuple[np.ndarray, np.ndarray]:
        """(score of each node's best way, characters - 1 of its last edge)."""
        rows = self._rows(self.score, self.unknown, -np.inf)[::-1]      # of equal ones the longer last piece
        top, back = np.full((self.size + 1, self.width), -np.inf), np.zeros((self.size + 1, self.width), np.int8)
        top[0] = 0.0
        for t in range(1, self.size + 1):
            for k, row in rows:
                if k < t:
                    v = top[t - 1 - k] + row[t - 1 - k]
                    np.copyto(back[t], k, where=v > top[t])
                    np.maximum(top[t], v, out=top[t])
        return top, back

    def top(self) -> np.ndarray:
        """Score of each word's best segmentation."""
        return self._best()[0][self.size]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, first character, piece) on the best segmentations, word by word in order."""
        _, back = self._best()
        ids = dict(self._rows(np.arange(len(self.score)), -1, -1))
        found = np.full(self.codes.shape, -2, np.int64)
        word, at = np.arange(self.width), np.full(self.width, self.size)
        while len(word):
            k = back[at, word]
            at = at - 1 - k
            for n in np.unique(k).tolist():
                of = k == n
                found[at[of], word[of]] = ids[n][at[of], word[of]]
            word, at = word[at > 0], at[at > 0]
        word, start = np.nonzero(found.T > -2)
        return word, start, found[start, word]


def lattices(trie: PieceTrie, words: Sequence[str], score: np.ndarray, unknown: float,
             whole: bool = True) -> Iterator[tuple[np.ndarray, Block | Lattice]]:
    """(indices, lattice) of all words that are not empty."""
    flat, offs = code_points(words)
    size = np.diff(offs)
    order = np.argsort(size, kind="stable")
    ends = np.searchsorted(size[order], np.arange(BLOCK_LENGTH + 2))
    for n in range(1, BLOCK_LENGTH + 1):
        step = BLOCK_CHARS // n
        for i in range(int(ends[n]), int(ends[n + 1]), step):
            part = order[i:min(i + step, int(ends[n + 1]))]
            yield part, Block(trie, flat[offs[part] + np.arange(n)[:, None]], score, unknown, whole)
    long = order[ends[BLOCK_LENGTH + 1]:]
    for held in chunks([words[i] for i in long.tolist()]):
        part = long[held]
        flat, offs = code_points([words[i] for i in part.tolist()])
        yield part, Lattice(trie, flat, offs, score, unknown, whole)


def chunks(words: Sequence[str]):
    """Indices of ``words`` in chunks of a bounded number of characters, words
    of similar length together (the steps of a chunk are its longest word)."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    held, size = [], 0
    for i in order:
        held.append(i)
        size += len(words[i])
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held
