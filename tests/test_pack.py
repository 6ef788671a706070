"""Packing: blocks equal slices of the flat stream (1 vs 8 partitions),
windows equal slices, length fitting edge cases."""

from pyspark.sql import functions as F

from corpusprep.operators import pack
from corpusprep.profiles import IGNORE_INDEX


def _docs(spark):
    rows = [(i, list(range(i * 100, i * 100 + (i * 37) % 23))) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, input_ids array<int>"), rows


def test_blocks_are_stream_slices(spark):
    df, rows = _docs(spark)
    flat = [t for _, ids in sorted(rows) for t in ids]
    for parts in (1, 8):
        blocks = pack.pack_blocks(df, 16, ["doc_id"], num_partitions=parts).collect()
        got = {r["block_id"]: r["tokens"] for r in blocks}
        assert sum(len(v) for v in got.values()) == len(flat)
        for b, toks in got.items():
            assert toks == flat[b * 16:(b + 1) * 16]


def test_next_token_pairs_and_windows(spark):
    df, rows = _docs(spark)
    flat = [t for _, ids in sorted(rows) for t in ids]
    blocks = pack.pack_blocks(df, 16, ["doc_id"])
    for r in pack.next_token_pairs(blocks).collect():
        b = r["block_id"]
        assert r["x"] == flat[b * 16:b * 16 + len(r["x"])]
        assert r["y"] == flat[b * 16 + 1:b * 16 + 1 + len(r["y"])]
    for r in pack.sample_windows(blocks, 20, 8, 16, 5).collect():
        s = r["start"]
        assert 0 <= s < len(flat) - 9
        assert r["x"] == flat[s:s + 8] and r["y"] == flat[s + 1:s + 9]


def test_fit_length(spark):
    rows = [([1, 2], [IGNORE_INDEX, 2]), ([1, 2, 3, 4], [9, 8, 7, 6]), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6])]
    df = spark.createDataFrame(rows, "i array<int>, l array<int>")
    x, y = pack.fit_length("i", "l", 4, 1)
    out = df.select(x.alias("x"), y.alias("y")).collect()
    assert out[0]["x"] == [1, 2, 1, 1] and out[0]["y"] == [IGNORE_INDEX, 2, IGNORE_INDEX, IGNORE_INDEX]
    assert out[1]["x"] == [1, 2, 3, 4]
    assert out[2]["x"] == [3, 4, 5, 6] and out[2]["y"] == [3, 4, 5, 6]


def test_prompt_views(spark):
    rows = [([5, 6, 7, 8], [IGNORE_INDEX, IGNORE_INDEX, 7, 8]),
            ([5, 6], [IGNORE_INDEX, IGNORE_INDEX]),   # all masked
            ([5, 6], [6, 7])]                          # first label at index 0
    df = spark.createDataFrame(rows, "input_ids array<int>, labels array<int>")
    p, t = pack.prompt_and_target()
    out = df.select(p.alias("p"), t.alias("t")).collect()
    assert out[0]["p"] == [5, 6, 7] and out[0]["t"] == [8]
    assert out[1]["p"] == [5, 6] and out[1]["t"] == []
    assert out[2]["p"] == [5] and out[2]["t"] == [7]
    nested = spark.createDataFrame([([[5, 6, 7, 8], [5, 6, 9]], [[IGNORE_INDEX, IGNORE_INDEX, 7, 8], [IGNORE_INDEX, 9, 1]])],
                                   "input_ids array<array<int>>, labels array<array<int>>")
    p2, c2 = pack.prompt_and_completion()
    r = nested.select(p2.alias("p"), c2.alias("c")).first()
    assert r["p"] == [5, 6] and r["c"] == [7, 8]
