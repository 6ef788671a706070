"""Sampling reductions on literal candidate groups."""

from pyspark.sql import functions as F

from corpusprep.operators import evaluate as ev


def test_top_k_keeps_ties(spark):
    c = spark.createDataFrame([(1, 0, 5.0), (1, 1, 4.0), (1, 2, 4.0), (1, 3, 3.0)],
                              "group_id long, item_id long, score double")
    assert sorted(r["item_id"] for r in ev.top_k_per_group(c, 2).collect()) == [0, 1, 2]


def test_nucleus_keeps_crossing_item(spark):
    p = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.3), (1, 2, 0.2)], "group_id long, item_id long, prob double")
    # mass before item 1 is 0.5, not above 0.5: item 1 is the crossing item, kept
    kept = {r["item_id"]: r["prob"] for r in ev.nucleus_per_group(p, 0.5).collect()}
    assert set(kept) == {0, 1} and abs(sum(kept.values()) - 1) < 1e-12
    kept = {r["item_id"]: r["prob"] for r in ev.nucleus_per_group(p, 0.4).collect()}
    assert set(kept) == {0}


def test_softmax_and_draw(spark):
    c = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 0.0)], "group_id long, item_id long, score double")
    p = ev.softmax_per_group(c)
    sums = {r["group_id"]: r["s"] for r in p.groupBy("group_id").sum("prob").withColumnRenamed("sum(prob)", "s").collect()}
    assert all(abs(v - 1) < 1e-12 for v in sums.values())
    d = ev.draw_per_group(p, 1).collect()
    assert len(d) == 2


def test_a_pair_that_stands_everywhere_asks_once_per_block(spark):
    import math

    from corpusprep.operators import evaluate as ev
    hot = spark.range(400).selectExpr("id as pair_id", "0L as which", "array_repeat(5, 50) as input_ids",
                                      "concat(array(-100), array_repeat(6, 48), array(9)) as labels")
    bigram = spark.createDataFrame([(5, 6, 7), (5, 8, 3)], "prev int, token int, n long")
    got = ev.score_tokens(hot, bigram, 10, 0.5, "m", blocks=4)
    assert got.count() == 400 * 50
    by = {r["label"]: (r["n"], r["lo"], r["hi"]) for r in got.groupBy("label").agg(
        F.count("*").alias("n"), F.min("logp").alias("lo"), F.max("logp").alias("hi")).collect()}
    assert by[-100] == (400, 0.0, 0.0)
    for label, n, c in ((6, 19200, 7), (9, 400, 0)):
        want = math.log((c + 0.5) / (10 + 5))
        assert by[label][0] == n and abs(by[label][1] - want) < 1e-12 and abs(by[label][2] - want) < 1e-12


def test_models_scored_together_equal_each_alone(spark):
    """Several add-k models share one lookup of the counts; masked and unknown positions included."""
    from corpusprep.operators import evaluate
    seq = spark.createDataFrame([("p", 0, [1, 2, 1, 9], [-100, 1, 2, 3]), ("p", 1, [2, 2], [1, -100]), ("q", 0, [1], [2])],
                                "pair_id string, which int, input_ids array<int>, labels array<int>")
    bigram = spark.createDataFrame([(1, 2, 3), (2, 1, 1), (1, 1, 2)], "prev int, token int, n long")
    both = evaluate.score_tokens(seq, bigram, 10, {"a": 1.0, "b": 0.1})
    alone = evaluate.score_tokens(seq, bigram, 10, 1.0, "a").unionByName(evaluate.score_tokens(seq, bigram, 10, 0.1, "b"))
    assert both.columns == alone.columns
    rows = sorted(tuple(r) for r in both.collect())
    assert rows == sorted(tuple(r) for r in alone.collect()) and len(rows) == 14
    assert str(both._jdf.queryExecution().optimizedPlan()).count("Union") == 0
