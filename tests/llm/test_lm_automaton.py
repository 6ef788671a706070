"""Operator 7 against counts in dictionaries."""

import math
import zlib
from collections import Counter

import pytest

from corpusprep.llm import lm_automaton as lm
from corpusprep.llm.common import read
from conftest import SMALL
from llm import brute


def plain(rows, order, strengths):
    toks = [(k, [*brute.words(brute.lower(t)), "</s>"]) for k, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in toks]
    c, n = Counter(), 0
    for (_, t), h in zip(toks, held):
        if not h:
            n += len(t)
            c["^",] += 1
            for j in range(len(t)):
                for g in range(1, order + 1):
                    if j - g + 1 >= -1:
                        c[tuple((["^"] if j - g + 1 < 0 else []) + t[max(0, j - g + 1):j + 1])] += 1
    v = sum(len(g) == 1 and g != ("^",) for g in c)

    def p(h, w, k, own):
        if not h:
            return (c[w,] - own + 0.1) / (n - own + 0.1 * (v + 1))
        return (c[(*h, w)] - own + k * p(h[1:], w, k, own)) / (c[h] - own + k)

    def score(t, k, own=0):
        return sum(math.log10(p(tuple((["^"] + t)[max(0, j + 2 - order):j + 1]) if order > 1 else (), t[j], k, own))
                   for j in range(len(t)))

    k = max(strengths, key=lambda k: sum(score(t, k, 1) for (_, t), h in zip(toks, held) if not h))
    return [(key, h, len(t), sum(c[w,] > 0 for w in t), n, sum(math.log10(p((), w, 1, 0)) for w in t), score(t, k))
            for (key, t), h in zip(toks, held)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_documents(spark, order):
    docs = read(spark, SMALL, "documents").limit(40)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), order=order, block_bytes=1 << 14,
                   shard_tokens=2000).collect()
    assert brute.key_of(got) == brute.key_of(plain(rows, order, lm.STRENGTHS))


def test_awkward_rows(spark):
    docs = brute.awkward(spark).filter("doc_id is null or doc_id not in (6, 7)")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = lm.score(docs).collect()
    assert brute.key_of(got) == brute.key_of(plain(rows, 2, lm.STRENGTHS))
    assert lm.score(brute.empty(spark)).count() == 0


def test_held_out_text_is_predicted_better_than_by_the_base(spark):
    r = lm.score(read(spark, SMALL, "documents")).filter("held_out").selectExpr("sum(base_score) b", "sum(score) s").first()
    assert r["s"] > r["b"]


def test_probabilities_of_a_state_sum_to_one(spark):
    # every one-word text after the same training text: known words and one unknown
    train = [(i, "a b a c") for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = train + list(zip(held, ["a", "b", "c", "unseen"]))
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the texts "w end" differ in p(w | begin) and p(end | w)
    assert all(got[h] < 0 for h in held) and got[held[0]] > got[held[3]]
