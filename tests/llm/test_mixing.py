"""Operator 2 against the rule worked out on the driver."""

from collections import defaultdict

import duckdb

from corpusprep.llm import mixing
from llm import brute


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {s: 0.0 for s in names if not sizes[s]}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= cap * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: float(cap * sizes[s]) for s in over}


def test_awkward_rows(spark):
    rows = mixing.mix(brute.awkward(spark)).collect()
    docs = brute.awkward(spark).collect()
    assert len(rows) == len(docs)
    sizes = defaultdict(int)
    for r in docs:
        sizes[r["source"]] += len(brute.words(r["text"]))
    want = plain_targets(dict(sizes))
    assert sorted({(r["source_size"], round(r["target"], 6)) for r in rows}) == sorted(
        {(sizes[s], round(t, 6)) for s, t in want.items()})
    by = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source_size"], r["target"]] += r["taken"]
    for (_, target), taken in by.items():
        assert abs(taken - target) <= 1 * 2
    again = mixing.mix(brute.awkward(spark).repartition(5)).collect()
    assert brute.key_of(again) == brute.key_of(rows)
    assert mixing.mix(brute.empty(spark)).count() == 0


def test_oracle_sql_on_many_sources(spark):
    con = duckdb.connect()
    rows = [(i, " ".join(["w"] * (i * 7919 % 50)), f"s{i * i % 11}" if i % 13 else None) for i in range(800)]
    con.execute("create table t (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    want = con.execute(mixing.oracle("t")).fetchall()
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert brute.key_of(got) == brute.key_of(want)


def test_repeat_gives_whole_documents(spark):
    docs = brute.awkward(spark)
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    have = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert set(got) <= have and max(got.count(x) for x in set(got)) <= 6    # the repeated row twice three times
    assert mixing.repeat(brute.empty(spark)).count() == 0


def taken_by_source(docs, out):
    size, got, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs.collect():
        n = len(brute.words(r["text"]))
        size[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    for r in out.collect():
        got[r["source"]] += len(brute.words(r["text"]))
    want = plain_targets(dict(size))
    return {s: (got[s], want[s], most[s]) for s in size}


def test_repeat_keeps_to_targets_with_null_and_repeated_keys(spark):
    rows = [(None, " ".join([f"w{i}"] * (1 + i % 3)), "a") for i in range(90)]
    rows += [(7, f"same key {i}", "a") for i in range(60)] + [(8, "same row twice", "a")] * 40
    rows += [(100 + i, " ".join(["x"] * (i % 9)), "b") for i in range(300)] + [(None, "one more", None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.repeat(docs)
    for got, want, most in taken_by_source(docs, first).values():
        assert abs(got - want) <= most
    again = mixing.repeat(docs.repartition(7))
    assert brute.key_of(again.collect()) == brute.key_of(first.collect())       # reruns agree
    times = brute.key_of(first.collect())
    have = brute.key_of(docs.collect())
    assert all(n <= 3 * have[r] for r, n in times.items())


def test_repeat_of_awkward_rows_keeps_to_targets(spark):
    docs = brute.awkward(spark)
    for got, want, most in taken_by_source(docs, mixing.repeat(docs)).values():
        assert abs(got - want) <= most
