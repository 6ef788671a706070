"""Repeated substrings by suffix sorting against counting them all; lattices
against segmentation word by word."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from conftest import SMALL
from corpusprep.operators import vocab
from corpusprep.operators.lattice import BLOCK_LENGTH, NEG_INF, Block, Lattice, PieceTrie, chunks, code_points, lattices
from corpusprep.operators.suffixes import intervals, repeated_substrings
from corpusprep.sources import tables as tb


def counted(words, max_len, min_freq=2):
    """Every substring, what follows it, and how often it stands."""
    freq, after = defaultdict(int), defaultdict(set)
    for w, f in words:
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + max_len) + 1):
                freq[w[i:j]] += f
                after[w[i:j]].add(w[j:j + 1])
    return {s: f for s, f in freq.items() if f >= min_freq and len(after[s]) > 1}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_substrings_equal_counting_all(spark, parts):
    rnd = random.Random(parts)
    words = [("".join(rnd.choice("abcé▁中") for _ in range(rnd.randint(1, 30))), rnd.randint(1, 5)) for _ in range(400)]
    words += [("a" * 40, 3), ("ab" * 25, 1), ("same", 1), ("same", 2), ("x", 9), ("😀😀y", 2), ("😀😀z", 1)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for max_len in (1, 4, 16):
            df = spark.createDataFrame(words, "piece string, freq long").repartition(4)
            got = {r["sub"]: r["freq"] for r in repeated_substrings(df, max_len).collect()}
            assert got == counted(words, max_len)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_substrings_of_documents(spark):
    words = vocab.word_counts(tb.text_table(spark, SMALL).filter("doc_id < 20"))
    rows = [(r["piece"], r["freq"]) for r in words.collect()]
    assert {r["sub"]: r["freq"] for r in repeated_substrings(words).collect()} == counted(rows, 16)


def test_empty_and_awkward_words(spark):
    none = spark.createDataFrame([], "piece string, freq long")
    assert repeated_substrings(none).count() == 0
    odd = spark.createDataFrame([(None, 5), ("", 5), ("a\0b", 2), ("ac", 1), ("a" * 20_000, 1)], "piece string, freq long")
    got = {r["sub"]: r["freq"] for r in repeated_substrings(odd, 4).collect()}
    assert got["a"] == 20_000 + 3 and got["aaaa"] == 19_997 and not any("\0" in s for s in got)


def test_walk_holds_one_suffix():
    """Intervals come out as they close, from a plain iterator."""
    rows = iter(sorted([("ab\0", 1), ("abc\0", 2), ("b\0", 1), ("bc\0", 2), ("c\0", 2)]))
    got = {(s, f) for s, f, lo, hi in intervals(rows, 4) if lo != hi}
    assert got == {("ab", 3), ("b", 3)}


def plain_lattice(word, score, unknown, max_len):
    """log Z, expected counts, best segmentation, one word at a time."""
    n = len(word)
    edges = [(i, j, word[i:j], score[word[i:j]]) for j in range(1, n + 1) for i in range(max(0, j - max_len), j) if word[i:j] in score]
    have = {i for i, j, *_ in edges if j == i + 1}
    edges += [(i, i + 1, None, unknown) for i in range(n) if i not in have]
    a, b = [NEG_INF] * (n + 1), [NEG_INF] * (n + 1)
    a[0] = b[n] = 0.0
    best, back = [NEG_INF] * (n + 1), [None] * (n + 1)
    best[0] = 0.0
    for j in range(1, n + 1):
        for i, jj, p, s in sorted((e for e in edges if e[1] == j), key=lambda e: e[0]):
            a[j] = np.logaddexp(a[j], a[i] + s)
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, p if p is not None else word[i:j])
    for i in range(n - 1, -1, -1):
        for ii, j, p, s in (e for e in edges if e[0] == i):
            b[i] = np.logaddexp(b[i], b[j] + s)
    count = defaultdict(float)
    for i, j, p, s in edges:
        if p is not None:
            count[p] += math.exp(a[i] + s + b[j] - a[n])
    out, j = [], n
    while j:
        j, p = back[j]
        out.append(p)
    return a[n], count, best[n], out[::-1]


def test_lattices_equal_word_by_word():
    rnd = random.Random(2)
    pieces = sorted({"".join(rnd.choice("abcd中") for _ in range(rnd.randint(1, 5))) for _ in range(150)} - {"d"})
    score = np.array([-rnd.uniform(1, 12) for _ in pieces])
    score[5] = -np.inf                                  # gone, but still in the trie
    alive = {p: s for p, s in zip(pieces, score.tolist()) if s > -np.inf}
    words = ["".join(rnd.choice("abcd中😀") for _ in range(rnd.randint(1, 40))) for _ in range(300)] + ["a" * 700, "d", "a"]
    weight = np.array([rnd.randint(1, 4) for _ in words], float)
    trie, total, z, best, paths = PieceTrie(pieces), np.zeros(len(pieces)), 0.0, {}, {}
    for part in chunks(words):
        flat, offs = code_points([words[i] for i in part])
        lat = Lattice(trie, flat, offs, score, -25.0)
        got, ll = lat.expected(weight[part], len(pieces))
        total, z = total + got, z + ll
        top, _ = lat.best()
        word, e = lat.paths()
        for w, x in zip(word.tolist(), e.tolist()):
            at = int(lat.start[x])
            paths.setdefault(part[w], []).append("".join(map(chr, flat[at:at + int(lat.length[x])])))
        best.update(zip(part, top.tolist()))
    want, wz = defaultdict(float), 0.0
    for i, w in enumerate(words):
        ll, count, b, seg = plain_lattice(w, alive, -25.0, 5)
        wz += ll * weight[i]
        for p, c in count.items():
            want[p] += c * weight[i]
        assert abs(best[i] - b) < 1e-8 * abs(b) and paths[i] == seg
    assert abs(z - wz) < 1e-8 * abs(wz)
    assert np.allclose(total, [want[p] for p in pieces])


def test_whole_word_can_be_left_out():
    trie = PieceTrie(["a", "ab", "abc", "b", "c", "bc"])
    flat, offs = code_points(["abc", "a"])
    top, _ = Lattice(trie, flat, offs, np.array([-3.0, -4, -1, -3, -3, -5]), -20.0, whole=False).best()
    assert top.tolist() == [-7.0, -3.0]     # ab + c; one character stays itself


def test_blocks_of_one_length_equal_word_by_word():
    """Words are dealt into blocks of one length (no edge lists, no sorting);
    long and very unlikely words still come out right."""
    rnd = random.Random(3)
    pieces = sorted({"".join(rnd.choice("abcd中") for _ in range(rnd.randint(1, 5))) for _ in range(150)} - {"d"})
    score = np.array([-float(rnd.randint(1, 12)) for _ in pieces])      # whole numbers: many equal ways
    score[5] = -np.inf
    alive = {p: s for p, s in zip(pieces, score.tolist()) if s > -np.inf}
    words = ["".join(rnd.choice("abcd中😀") for _ in range(rnd.randint(1, BLOCK_LENGTH))) for _ in range(400)]
    words += ["", "a" * 700, "d", "a", "a", "😀" * 40, "😀" * 39 + "a"]   # the last two: below the least double
    weight = np.array([rnd.randint(1, 4) for _ in words], float)
    trie, total, z, top, paths, kinds = PieceTrie(pieces), np.zeros(len(pieces)), 0.0, {}, {}, {}
    for part, lat in lattices(trie, words, score, -25.0):
        kinds.update((int(i), type(lat)) for i in part)
        z += lat.add_expected(weight[part], total)
        top.update(zip(part.tolist(), lat.top().tolist()))
        for w, at, p in zip(*(x.tolist() for x in lat.segments())):
            word = words[int(part[w])]
            paths.setdefault(int(part[w]), []).append(pieces[p] if p >= 0 else word[at])
    assert sorted(kinds) == [i for i, w in enumerate(words) if w]
    assert all((kinds[i] is Block) == (len(w) <= BLOCK_LENGTH) for i, w in enumerate(words) if w)
    want, wz = defaultdict(float), 0.0
    for i, w in enumerate(words):
        if w:
            ll, count, b, seg = plain_lattice(w, alive, -25.0, 5)
            wz += ll * weight[i]
            for p, c in count.items():
                want[p] += c * weight[i]
            assert abs(top[i] - b) < 1e-8 * abs(b) and paths[i] == seg
    assert abs(z - wz) < 1e-8 * abs(wz)
    assert np.allclose(total, [want[p] for p in pieces])


def test_trie_finds_every_piece_and_no_other():
    rnd = random.Random(4)
    pieces = sorted({"".join(chr(rnd.choice([97, 98, 0x4E2D, 0x10FFFF])) for _ in range(rnd.randint(1, 6))) for _ in range(3000)})
    trie = PieceTrie(pieces)
    for n in (1, 2, 5, 8):
        words = ["".join(chr(rnd.choice([97, 98, 99, 0x4E2D, 0x10FFFF])) for _ in range(n)) for _ in range(200)]
        flat, offs = code_points(words)
        got = {(int(a) % 200, int(a) // 200, pieces[p]) for k, at, piece in trie.walk(flat.reshape(200, n).T.ravel(), 200)
               for a, p in zip(at, piece)}
        have = set(pieces)
        assert got == {(w, i, x[i:j]) for w, x in enumerate(words) for i in range(n) for j in range(i + 1, n + 1) if x[i:j] in have}
    flat, offs = code_points(["abc"])
    assert len(PieceTrie([]).find(flat, np.array([3, 2, 1]))[0]) == 0


def test_blocks_leave_out_whole_words():
    words = ["abc", "bca", "a", "c"]
    trie = PieceTrie(["a", "ab", "abc", "b", "c", "bc"])
    top = np.zeros(4)
    for part, lat in lattices(trie, words, np.array([-3.0, -4, -1, -3, -3, -5]), -20.0, whole=False):
        top[part] = lat.top()
    assert top.tolist() == [-7.0, -8.0, -3.0, -3.0]
