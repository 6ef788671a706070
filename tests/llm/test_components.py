"""Connected components against union-find."""

import random

import pytest

from corpusprep.llm.components import components
from llm import brute


def check(spark, n, links):
    root = brute.reach(n, links)
    some = {x for e in links if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(got) == len(some) and {r["node"]: r["label"] for r in got} == {i: root[i] for i in some}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = 300
    check(spark, n, [(rnd.randrange(n), rnd.randrange(n)) for _ in range([100, 200, 900][seed])])


def test_paths_stars_and_repeats(spark):
    order = list(range(400))
    random.Random(5).shuffle(order)
    path = list(zip(order, order[1:]))
    straight = [(500 + i, 501 + i) for i in range(300)]
    star = [(999, 1000 + i) for i in range(100)] + [(1200, 1100 + i) for i in range(100)]
    check(spark, 1300, path + straight + star + path[:50] + [(1250, 1250)])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0
