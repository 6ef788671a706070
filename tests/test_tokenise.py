"""Encoding: Arrow lookup path equals the join path; decode inverts encode
when every word is known; SFT/preference masks and shifts."""

from pyspark.sql import functions as F

from corpusprep.operators import tokenise, vocab
from corpusprep.profiles import BASE_SPECIALS, CHAT_SPECIALS, IGNORE_INDEX
from corpusprep.sources import tables as tb
from conftest import SMALL


def test_arrow_lookup_equals_join(spark):
    t = tb.text_table(spark, SMALL)
    v = vocab.train_word_vocab(t, 500, BASE_SPECIALS)
    arrow = tokenise.encode(t.select("doc_id", "text"), v, "text", "ids")
    a = arrow.select("doc_id", F.posexplode("ids").alias("pos", "id")).select(
        "doc_id", F.col("pos").cast("long"), F.col("id").cast("long"))
    j = tokenise.encode_long(t, v, "doc_id")
    assert sorted(a.collect()) == sorted(j.collect())


def test_decode_roundtrip_full_vocab(spark):
    rows = [(1, "the cat  sat\non the mat"), (2, "a"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    v = vocab.train_word_vocab(df, 1000, BASE_SPECIALS)
    tok = tokenise.tokenize_pretrain(df, v)
    dec = {r["doc_id"]: r["decoded"] for r in tokenise.decode(tok, v, key="doc_id").collect()}
    assert dec[1] == "the cat  sat\non the mat" and dec[2] == "a" and dec[3] == ""


def test_unknown_maps_to_unk(spark):
    df = spark.createDataFrame([(1, "aa bb")], "doc_id long, text string")
    v = vocab.train_word_vocab(spark.createDataFrame([(1, "aa")], "doc_id long, text string"), 10, BASE_SPECIALS)
    ids = tokenise.tokenize_pretrain(df, v).first()["input_ids"]
    assert ids == [2, 4, 0, 3]


def test_sft_mask_and_shift(spark):
    v = vocab.extend_vocab(vocab.train_word_vocab(
        spark.createDataFrame([(1, "p q r")], "doc_id long, text string"), 10, BASE_SPECIALS), CHAT_SPECIALS)
    df = spark.createDataFrame([(1, "<SYSTEM>p</SYSTEM><MODEL>", "q r</MODEL>")], "id long, prompt string, completion string")
    r = tokenise.tokenize_sft(df, v, BASE_SPECIALS + CHAT_SPECIALS).first()
    lk = tokenise.make_lookup(v)
    d = dict(zip(lk.pieces, lk.ids))
    full = [d["<SYSTEM>"], d["▁p"], d["</SYSTEM>"], d["<MODEL>"], d["▁q"], d["▁r"], d["</MODEL>"]]
    labels = [IGNORE_INDEX] * 4 + full[4:]
    assert r["input_ids"] == full[:-1] and r["labels"] == labels[1:]
    assert len(r["input_ids"]) == len(r["labels"])


def test_preference_nested(spark):
    v = vocab.extend_vocab(vocab.train_word_vocab(
        spark.createDataFrame([(1, "x y z")], "doc_id long, text string"), 10, BASE_SPECIALS), CHAT_SPECIALS)
    df = spark.createDataFrame([("p", "<USER>x</USER><MODEL>", "y</MODEL>", "z</MODEL>")],
                               "row_id string, prompts string, accepted string, rejected string")
    r = tokenise.tokenize_preference(df, v, BASE_SPECIALS + CHAT_SPECIALS).first()
    assert r["rewards"] == [1.0, -1.0]
    assert len(r["input_ids"]) == 2 and r["input_ids"][0][:3] == r["input_ids"][1][:3]
    assert r["labels"][0][:3] == [IGNORE_INDEX] * 3


def test_extend_vocab_ids(spark):
    v = vocab.train_word_vocab(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), 10, BASE_SPECIALS)
    e = {r["piece"]: r["id"] for r in vocab.extend_vocab(v, CHAT_SPECIALS + ["[PAD]"]).collect()}
    assert [e[s] for s in CHAT_SPECIALS] == list(range(6, 12)) and e["[PAD]"] == 1


def test_decode_is_one_arrow_pass_and_equals_the_join(spark):
    t = spark.createDataFrame([(1, "a b  c", 7), (2, " lead", 8), (3, "", 9), (4, None, 1)], "doc_id long, text string, x int")
    v = vocab.train_word_vocab(t.filter("text is not null"), 50, BASE_SPECIALS)
    tok = tokenise.tokenize_pretrain(t, v)
    for skip in (True, False):
        got = tokenise.decode(tok, v, key="doc_id", keep=["x"], skip_special=skip, pieces="pieces")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "MapInArrow" in plan
        want = {r["doc_id"]: r["decoded"] for r in tokenise.decode_joined(tok, v, key="doc_id", skip_special=skip).collect()}
        rows = {r["doc_id"]: r for r in got.collect()}
        assert {k: r["decoded"] for k, r in rows.items()} == want
        assert rows[1]["x"] == 7 and rows[1]["pieces"] == ["[SOS]", "▁a", "▁b", "▁", "▁c", "[EOS]"]
        assert rows[3]["pieces"] == ["[SOS]", "[EOS]"]


def test_byte_fallback_spells_what_is_not_covered(spark):
    from corpusprep.operators import vocab
    rows = [(1, ["a", "é", None, "漢", "a", "é"]), (2, []), (3, None), (4, ["b"] * 5000 + ["ß"]), (5, ["漢"])]
    df = spark.createDataFrame(rows, "k int, pieces array<string>").coalesce(1)
    known = spark.createDataFrame([("a",), ("b",)], "piece string")
    got = {r["k"]: r["pieces"] for r in vocab.byte_fallback(df, known).collect()}

    def spell(p):
        return [p] if p in ("a", "b", None) else [f"<0x{x:02X}>" for x in p.encode()]

    assert got == {k: None if v is None else [x for p in v for x in spell(p)] for k, v in rows}
    assert vocab.byte_fallback(df.limit(0), known).count() == 0
    none = vocab.byte_fallback(df.filter("k = 1"), known.limit(0)).first()["pieces"]
    assert none[0] == "<0x61>" and len(none) == 1 + 2 + 1 + 3 + 1 + 2


def test_passes_work_on_bounded_parts_of_a_batch(spark, monkeypatch):
    """A batch is cut by the entries of its lists, nulls and long rows included, and the results stay the same."""
    import pyarrow as pa

    from corpusprep.operators import tokenise
    lists = [["a"] * n for n in (3, 0, 5, 1)] + [None] + [["b"] * 20, ["a", "c"]]
    b = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string())), pa.array(range(len(lists)))], ["p", "k"])
    parts = list(tokenise.small_batches(iter([b]), [0], 8))
    assert [x for p in parts for x in p.to_pylist()] == b.to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or ()) for x in p.column(0).to_pylist()) <= 8 for p in parts) and len(parts) > 2
    empty = b.slice(0, 0)
    assert [p.num_rows for p in tokenise.small_batches(iter([empty]), [0], 8)] == [0]
    lk = tokenise.Lookup(["a", "b"], [5, 6], 0)
    assert [x for p in parts for x in lk.map_list_array(p.column(0)).to_pylist()] == lk.map_list_array(b.column(0)).to_pylist()
