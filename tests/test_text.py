"""Column functions on literal edge cases (tabs, NBSP, blank, titles, chunks)."""

from pyspark.sql import functions as F

from corpusprep.functions import text as tx


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


def test_clean_whitespace_matches_python_split(spark):
    cases = ["  a \t b\n\nc  ", "a b", "", "   ", "x\x1cy", " lead"]
    for c in cases:
        assert one(spark, tx.clean_whitespace, c) == " ".join(c.split()), repr(c)


def test_strip_and_blank(spark):
    for c in [" \n a b \t", " x ", "", " \n "]:
        assert one(spark, tx.strip, c) == c.strip(), repr(c)
        assert one(spark, tx.is_blank, c) == (c.strip() == ""), repr(c)


def test_metaspace_pieces(spark):
    assert one(spark, tx.metaspace_pieces, "a b\nc") == ["▁a", "▁b\nc"]
    assert one(spark, tx.metaspace_pieces, "a  b") == ["▁a", "▁", "▁b"]
    assert one(spark, tx.metaspace_pieces, " a") == ["▁a"]
    assert one(spark, tx.metaspace_pieces, "") == []


def test_specials_cut_first(spark):
    f = lambda c: tx.pieces_with_specials(c, ["<USER>", "</USER>", "<MODEL>"])
    assert one(spark, f, "<USER>hi there</USER><MODEL>") == ["<USER>", "▁hi", "▁there", "</USER>", "<MODEL>"]
    assert one(spark, f, "a<USER></USER>") == ["▁a", "<USER>", "</USER>"]


def test_title_pattern(spark):
    assert one(spark, tx.is_title, " = Doc 1 = \n") is True
    assert one(spark, tx.is_title, " = A = \n") is False          # one-character title
    assert one(spark, tx.is_title, " = = Sub = = \n") is False    # sub-heading
    assert one(spark, tx.is_title, "text = x = \n") is False


def test_chunk_words(spark):
    f = lambda c: tx.chunk_words(c, 2)
    assert one(spark, f, "a b c d e") == ["a b", "c d", "e"]
    assert one(spark, f, "   ") == []
    assert one(spark, lambda c: tx.chunk_words(c, 0), "a  b") == ["a  b"]


def test_book_text_none_fields(spark):
    df = spark.createDataFrame([("T", None, "1901", ["p1\n", None, "p2"])],
                               "t string, a string, d string, p array<string>")
    out = df.select(tx.book_text("t", "a", "d", "p").alias("o")).first()["o"]
    assert out == "T by None, published 1901\np1\np2"


def test_format_instruction_empty_input(spark):
    df = spark.createDataFrame([("i", "", "o"), ("i", None, "o"), ("i", "x", "o")], "i string, x string, o string")
    p, c = tx.format_instruction("i", "x", "o")
    rows = df.select(p.alias("p"), c.alias("c")).collect()
    assert rows[0]["p"] == "<SYSTEM>i</SYSTEM><MODEL>" and rows[1]["p"] == rows[0]["p"]
    assert rows[2]["p"] == "<SYSTEM>i</SYSTEM><USER>x</USER><MODEL>"
    assert rows[0]["c"] == "o</MODEL>"


def test_titles_with_unicode_white_space_and_line_ends(spark):
    import re
    lines = [" = A B = \n", " = A\u0085B = \n", " = A\rB = \n", " = Doc = \n", "\x1c= Doc =\x1d\n",
             " = Doc = \n\n", " = D = \n", " = Do = \n", " = Doc =", " =  x y = \n", "= Doc = \n"]
    for t in lines:
        assert one(spark, tx.is_title, t) == bool(re.match(tx.TITLE_PATTERN, t)), repr(t)


def test_control_characters_stay_in_pieces(spark):
    f = lambda c: tx.pieces_with_specials(c, ["<USER>", "</USER>"])
    assert one(spark, f, "a\u0001b") == ["▁a\u0001b"]
    assert one(spark, f, "x\u0001<USER>\n y\u0001</USER>") == ["▁x\u0001", "<USER>", "▁\n", "▁y\u0001", "</USER>"]
    assert one(spark, f, "") == [] and one(spark, f, "<USER>") == ["<USER>"]


def test_format_example_modes(spark):
    import pytest

    from corpusprep.operators import formats
    df = spark.createDataFrame([(1, [("prompter", "q"), ("assistant", "a"), ("prompter", "q2")], "yes", "no")],
                               "id long, context array<struct<role:string,text:string>>, accepted string, rejected string")
    r = formats.format_example(df, "openassistant", ["id"]).first()
    assert tuple(r) == (1, "<USER>q</USER><MODEL>a</MODEL><USER>q2</USER><MODEL>", "yes</MODEL>", "no</MODEL>")
    i = spark.createDataFrame([("s", "u", "o")], "instruction string, input string, output string")
    assert formats.format_example(i, "alpaca").collect() == formats.format_example(i, "post_training_sft").collect()
    with pytest.raises(ValueError, match="no example format"):
        formats.format_example(i, "other")


def test_profiles():
    import pytest

    from corpusprep.profiles import BASE_SPECIALS, CHAT_SPECIALS, get_profile
    p = get_profile("sentence_piece_v2")
    assert p.specials == BASE_SPECIALS + CHAT_SPECIALS and p.stop == "</MODEL>" and p.pad == "[PAD]"
    assert p.check_mode("pre_training") == "pre_training"
    with pytest.raises(ValueError):
        p.check_mode("post_training_sft")


def test_scripts_are_kept_apart(spark):
    text = "abcдеж γδ漢字かなカー한글 שלוםمرحبا नमस्ते९२ ไทย x9ዐ!?é"
    got = spark.createDataFrame([(text,)], "t string").select(tx.split_by_script("t").alias("p")).first()["p"]
    assert got == ["abc", "деж", "γδ", "漢字かなカー", "한글", "שלום", "مرحبا", "नमस्ते", "९", "२", "ไทย", "x", "9", "ዐ", "!?", "é"]
    meta = spark.createDataFrame([("abде 12",), ("",), (None,)], "t string").select(tx.metaspace_script_pieces("t").alias("p")).collect()
    assert [r["p"] for r in meta] == [["▁ab", "де", "▁1", "2"], [], None]
