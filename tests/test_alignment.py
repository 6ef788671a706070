"""Aligned comparison of two ways to cut the same text, by brute force."""

import random

from pyspark.sql import functions as F

from corpusprep.operators import vocab


def plain(a, b):
    def spans(tokens):
        out, at = [], 0
        for t in tokens or []:
            if t:
                out.append((at, at + len(t)))
                at += len(t)
        return out
    a, b = spans(a), spans(b)
    cuts = {e for _, e in a} & {e for _, e in b}
    same = set(a) & set(b)
    return len(a), len(b), len(same), len(cuts) - len(same)


def test_alignment_equals_brute_force(spark):
    rnd = random.Random(1)

    def cut(text):
        out = []
        while text:
            n = rnd.randint(1, 4)
            out.append(text[:n])
            text = text[n:]
        return out

    rows = []
    for i in range(300):
        text = "".join(rnd.choice("abé▁中😀") for _ in range(rnd.randint(0, 60)))
        rows.append((i, cut(text), cut(text)))
    rows += [(900, ["abc", "d", "ef"], ["ab", "c", "d", "ef"]), (901, None, None), (902, [], []), (903, ["", "ab"], ["a", "", "b"]), (None, ["x"], ["x"]),
             (904, ["w"] * 3000, ["w"] * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, a array<string>, b array<string>").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in vocab.compare_alignment(df, F.col("a"), F.col("b")).collect()}
    assert got == {i: plain(a, b) for i, a, b, *_ in rows}
    assert got[900] == (3, 4, 2, 1)     # one split differs once, what follows is the same
    assert vocab.compare_alignment(df.limit(0), F.col("a"), F.col("b")).count() == 0
