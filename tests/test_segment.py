"""Lines keep to their documents, and turns to their conversations, whatever their number."""

import __spark_entry__ as E
from corpusprep.operators import segment
from corpusprep.sources import tables as tb

QUERIES = E.queries()


def test_long_and_repeated_documents(spark, tmp_path):
    n = tb.WIKI_LINE_STRIDE + 5
    rows = [(1, "\n".join(f"a{i}" for i in range(n))), (2, "b0\nb1"), (3, "c"), (3, "c"), (3, "d"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["a4_coalesce_articles"](spark, str(tmp_path)).collect()
    assert [r["article_id"] for r in sorted(got)] == list(range(1, 7))
    want = sorted(f"= Doc {k} =" + ("" if t is None else f" \n{t}") for k, t in rows)
    assert sorted(r["text"] for r in got) == want
    ids = QUERIES["w1_article_id"](spark, str(tmp_path)).groupBy("article_id").count().collect()
    assert sorted(r["count"] for r in ids) == [2, 3, 3, 3, 4, n + 2]


def test_positions_that_repeat_keep_their_lines(spark):
    lines = spark.createDataFrame([(None, "x\n"), (None, "y\n"), (1, " = T = \n"), (2, "z\n"), (2, "z\n")], "pos long, text string")
    assert segment.article_ids(lines).count() == 5


def test_interleave_of_long_and_repeated_conversations(spark, tmp_path):
    turns = [(0, 0), (0, 1), (0, 1500), (1, 0), (1, 0), (1, 400)]
    spark.createDataFrame([(i,) for i in range(9)], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(turns, "conv_id long, turn int").write.parquet(str(tmp_path / "conversations.parquet"))
    out = QUERIES["u2_interleave"](spark, str(tmp_path)).filter("dataset = 'conversations'").orderBy("position").collect()
    assert [r["k"] for r in out] == [c * 1000 + t for c, t in turns]
