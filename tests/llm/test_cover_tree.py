"""Operator 12 against brute force, and the cover tree's own rules."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusprep.llm import cover_tree as ct
from corpusprep.llm import queries as q
from corpusprep.llm.common import read
from conftest import SMALL
from llm import brute

SCHEMA = "vec_id long, label string, embedding array<double>, uid string, anchor string, cell string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def plain(rows, is_anchor, k=5, n=3, low=50, high=95):
    """The result by comparing all rows, in Python's integers."""
    rows = [(i, int(a), str(b), [int(x) for x in v]) for i, (a, b, v) in enumerate(rows)
            if a is not None and b is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows = [r for r in rows if sum(x * x for x in r[3]) < ct.MOST]
    out = []
    for u, a, lab, v in rows:
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, other, l2) for other, b, l2, w in rows]
        same = sorted((s, b) for s, b, other, l2 in scored if l2 == lab and other != u)[:k]
        for s, b in same:
            fit = sorted((t, c) for t, c, _, l2 in scored if l2 != lab and low * -s <= 100 * -t <= high * -s)[:n]
            out += [(a, b, r + 1, c, -s, -t) for r, (t, c) in enumerate(fit)]
    return out


def test_query_equals_sql(spark):
    got = q.QUERIES["op12_cover_tree"](spark, SMALL).collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    assert Counter(map(tuple, got)) == Counter(con.execute(ct.oracle()).fetchall()) and got


def test_query_equals_brute_force_with_awkward_vectors(spark, tmp_path):
    e = read(spark, SMALL, "embeddings").limit(260)
    nan, inf = float("nan"), float("inf")
    one = e.first()["embedding"]
    extra = spark.createDataFrame(
        [(100, one, 3), (100, one, 3), (9000, None, 3), (9001, [None] * 64, 3), (9002, [nan] + one[1:], 3), (9003, [inf] + one[1:], 3),
         (9004, one, None), (9005, [0.0] * 64, 3), (9006, [], 4), (9007, one[:3], 4), (9050, one, 7), (None, one, 3), (9100, one + [2.0], 6)], e.schema)
    e.unionByName(extra).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = []
    for r in e.unionByName(extra).collect():
        lab = r["label"] if r["label"] is None or r["vec_id"] is None or r["vec_id"] % 7 else (r["label"] + 1) % 10
        v = r["embedding"]
        rows.append((r["vec_id"], lab, None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * x)) for x in v]))
    got = q.QUERIES["op12_cover_tree"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows, lambda a: a % 50 == 0))


@pytest.mark.parametrize("options", [{}, {"shard_rows": 16, "range_anchors": 3, "cells": 5}, {"shard_rows": 64, "cells": 1, "positives": 2, "negatives": 7}])
def test_equals_brute_force(spark, options):
    rng = np.random.default_rng(4)
    middle = rng.integers(-40, 40, (12, 6))
    rows = []
    for i in range(400):
        v = (middle[i % 12] + rng.integers(-6, 7, 6)).tolist()
        rows.append((i, ["a", "b", "c", "a"][int(rng.integers(4))], v))
    rows += [(500 + i, "a" if i % 3 else "b", [10, 10, 10, 0, 0, 0]) for i in range(150)]       # one very common vector
    rows += [(3, "a", [1, 2, 3, 4, 5, 6]), (3, "a", [1, 2, 3, 4, 5, 6]), (700, "rare", [5, 5, 5, 5, 5, 5]), (701, "c", [0] * 6), (702, "c", [])]
    docs = frame(spark, [(a, b, [float(x) for x in v]) for a, b, v in rows])
    got = ct.mine(docs, F.col("vec_id") % 10 == 0, **options).collect()
    k = {"positives": "k", "negatives": "n"}
    want = plain(rows, lambda a: a % 10 == 0, **{k[o]: x for o, x in options.items() if o in k})
    assert Counter(map(tuple, got)) == Counter(want)


def test_products_beyond_double_precision_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.integers(-1 << 29, 1 << 29, 8)]) for i in range(60)]
    rows += [(100 + i, "ab"[i % 2], [float((1 << 29) - i % 5)] * 8) for i in range(60)] + [(900, "a", [4e9] * 8)]
    got = ct.mine(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows, lambda a: a % 5 == 0)) and got


def test_empty_tables(spark):
    assert ct.mine(frame(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    some = frame(spark, [(i, "a", [1.0, float(i)]) for i in range(20)])
    assert ct.mine(some, F.lit(False)).count() == 0
    assert ct.mine(some, F.col("vec_id") % 5 == 0).count() == 0      # one label only
    assert ct.mine(frame(spark, [(None, None, None)]), F.lit(True)).count() == 0


def nodes(node):
    yield node
    for c in node.children:
        yield from nodes(c)


def test_tree_covers_separates_and_holds_each_point_once():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-50, 50, (300, 5)), np.tile([7, 7, 7, 7, 7], (60, 1)), rng.integers(0, 3, (100, 5))]).astype(float)
    t = ct.CoverTree(x, leaf=4)
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for n in nodes(t.root):
        assert t.distance(n.centre, t.order[n.start:n.stop]).max() <= n.radius + 1e-9
        if n.children:
            assert [c.start for c in n.children] == [n.start, *[c.stop for c in n.children][:-1]] and n.children[-1].stop == n.stop
            # centres of one level are further apart than any of its children reaches
            made = [c for c in n.children if c.stop - c.start > 1 and c.radius < n.radius]
            for a in made:
                for b in made:
                    assert a is b or t.distance(a.centre, np.array([b.centre]))[0] > max(a.radius, b.radius) - 1e-9
    # every point of the sphere's norm, and bounds hold for all pairs
    assert np.allclose((t.points ** 2).sum(axis=1), t.norm ** 2)
    q2 = rng.integers(-60, 60, (40, 5)).astype(float)
    score = q2 @ x.T
    for n in nodes(t.root):
        lo, hi = ct.bounds(q2 @ x[[n.centre]].T, np.sqrt((q2 ** 2).sum(axis=1)), np.array([n.radius]), t.norm)
        mine = score[:, t.order[n.start:n.stop]]
        assert (mine.min(axis=1) >= lo[:, 0]).all() and (mine.max(axis=1) <= hi[:, 0]).all()


def test_descent_skips_what_cannot_enter():
    rng = np.random.default_rng(7)
    middle = rng.standard_normal((40, 16)) * 100
    x = np.round(np.repeat(middle, 100, axis=0) + rng.standard_normal((4000, 16)) * 4)
    t = ct.CoverTree(x)
    q2 = x[::100]
    m = len(q2)
    everything = np.full((m, 1), ct.MOST)
    (row, _, score), = t.search(q2, -everything, everything, 5, lambda r, p: np.ones((len(r), len(p)), bool), np.arange(len(x)))
    assert t.verified < 0.25 * m * len(x)
    by = np.lexsort((-score, row))
    assert (score[by].reshape(m, 5) == np.sort(q2 @ x.T, axis=1)[:, :-6:-1]).all()
    # windows below the best: whole clusters are skipped from both sides
    t.verified = 0
    high = np.floor(score[by].reshape(m, 5)[:, :1] * 0.95)
    (row, _, score), = t.search(q2, np.ceil(high * 0.5), high, 3, lambda r, p: np.ones((len(r), len(p)), bool), np.arange(len(x)))
    assert t.verified < 0.5 * m * len(x) and (score <= high[row, 0]).all()
