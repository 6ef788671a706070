"""Plan shapes that the scale design depends on (checked on the executed
physical plan, so a regression to a one-task window or a shuffled corpus is
caught even when results stay right)."""

from pyspark.sql import functions as F

from conftest import SMALL
from corpusprep.operators import order, pack, split, tokenise, vocab
from corpusprep.profiles import BASE_SPECIALS
from corpusprep.sources import tables as tb


def _plan(df) -> str:
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_rank_and_prefix_sum_never_use_one_partition(spark):
    d = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    for out in (order.global_rank(d, ["id"], "r"), order.prefix_sum(d, ["id"], "v", "c")):
        p = _plan(out)
        assert "SinglePartition" not in p and "Window" not in p


def test_encode_adds_no_exchange(spark):
    t = spark.createDataFrame([(i, f"word{i % 13} other{i % 5}") for i in range(200)], "doc_id long, text string")
    v = vocab.train_word_vocab(t, 50, BASE_SPECIALS)
    enc = tokenise.encode(t, v, "text", "ids")
    p = _plan(enc)
    assert "Exchange" not in p and "MapInArrow" in p


def test_exact_split_labels_by_broadcast(spark):
    t = tb.text_table(spark, SMALL)
    s = split.split_exact(t, "doc_id", 20, 42, by="dataset")
    p = _plan(s)
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_pack_blocks_has_no_single_partition_step(spark):
    tok = spark.createDataFrame([(i, list(range(i % 50 + 1))) for i in range(300)], "doc_id long, input_ids array<int>")
    b = pack.pack_blocks(tok, 16, ["doc_id"])
    p = _plan(b)
    assert "SinglePartition" not in p
    assert sum(len(r["tokens"]) for r in b.collect()) == sum(i % 50 + 1 for i in range(300))
