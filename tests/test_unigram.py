"""Unigram vocabulary (EM) and Viterbi encoding: properties; NFKC rules."""

from pyspark.sql import functions as F

from conftest import SMALL
from corpusprep.functions import text as tx
from corpusprep.operators import tokenise, unigram
from corpusprep.profiles import BASE_SPECIALS
from corpusprep.sources import tables as tb


def test_unigram_em_and_roundtrip(spark):
    t = tb.text_table(spark, SMALL).filter(F.col("doc_id") < 60).select("doc_id", "text")
    hist = []
    v = unigram.train_unigram(t, 150, BASE_SPECIALS, seed_size=2000, history=hist)
    rows = v.collect()
    assert len(rows) == 150 and sorted(r["id"] for r in rows) == list(range(150))
    assert [r["piece"] for r in sorted(rows, key=lambda r: r["id"])[:4]] == BASE_SPECIALS
    # within a pair of EM rounds at a fixed piece set the likelihood does not fall
    for (n1, l1), (n2, l2) in zip(hist, hist[1:]):
        if n1 == n2:
            assert l2 >= l1 - 1e-6 * abs(l1)
    enc = unigram.make_unigram_encoder(v, BASE_SPECIALS)
    e = unigram.encode_unigram(t, enc, "text", "input_ids")
    d = tokenise.decode(e.select("doc_id", "input_ids"), v, key="doc_id")
    bad = t.join(d, "doc_id").filter(F.col("decoded") != F.col("text")).count()
    assert bad == 0


def test_unigram_unknown_and_specials(spark):
    t = spark.createDataFrame([("aa ab ab",)], "text string")
    v = unigram.train_unigram(t, 10, BASE_SPECIALS + ["<USER>"], seed_size=50)
    enc = unigram.make_unigram_encoder(v, BASE_SPECIALS + ["<USER>"])
    ids = {r["piece"]: r["id"] for r in v.collect()}
    out = unigram.encode_unigram(spark.createDataFrame([("<USER>az",)], "text string"), enc).first()["ids"]
    assert out[0] == ids["<USER>"] and ids["[UNK]"] in out


def test_normalisation_rules(spark):
    df = spark.createDataFrame([("ﬁne Ｆｕｌｌ Straße",), (None,)], "text string")
    got = df.select(tx.normalize_text("text", "nfkc").alias("a"), tx.normalize_text("text", "nfkc_cf").alias("b"),
                    tx.normalize_text("text", "identity").alias("c")).collect()
    assert (got[0]["a"], got[0]["b"], got[0]["c"]) == ("fine Full Straße", "fine full strasse", "ﬁne Ｆｕｌｌ Straße")
    assert got[1]["a"] is None


def test_recipe_options_change_the_vocabulary(spark):
    rows = [(i, f"abc{i % 7}def Привет мир ab-cd x{i} ﬁne") for i in range(40)] + [(99, "rare ☃ sign " + "z" * 500)]
    t = spark.createDataFrame(rows, "doc_id long, text string")

    def pieces(**o):
        return {r["piece"] for r in unigram.train_unigram(t, 420, BASE_SPECIALS, **o).collect()}

    plain = pieces()
    assert "☃" in plain and "ﬁ" in plain and not plain & set(tx.BYTE_PIECES)
    full = pieces(coverage=0.995, byte_fallback=True, normalise="nfkc", split_scripts=True, max_bytes=400)
    assert "☃" not in full and "ﬁ" not in full and set(tx.BYTE_PIECES) <= full
    # no piece mixes scripts, or digits with letters
    assert not any(any(c.isdigit() for c in p) and any(c.isalpha() for c in p) for p in full - set(tx.BYTE_PIECES) - set(BASE_SPECIALS))
    few = unigram.training_words(t, sentences=3, key="doc_id").agg(F.sum("freq")).first()[0]
    assert 0 < few < unigram.training_words(t).agg(F.sum("freq")).first()[0]


def test_byte_fallback_leaves_no_unknown_and_comes_back(spark):
    t = spark.createDataFrame([(i, "ab abc bc ca") for i in range(5)], "doc_id long, text string")
    v = unigram.train_unigram(t, 300, BASE_SPECIALS, byte_fallback=True)
    ids = {r["piece"]: r["id"] for r in v.collect()}
    assert [ids[p] for p in tx.BYTE_PIECES] == list(range(4, 260))
    enc = unigram.make_unigram_encoder(v, BASE_SPECIALS)
    q = spark.createDataFrame([(1, "ab ☃é ca"), (2, "<0x41>")], "doc_id long, text string")
    e = unigram.encode_unigram(q, enc, "text", "input_ids")
    assert all(ids["[UNK]"] not in r["input_ids"] for r in e.collect())
    d = {r["doc_id"]: r["decoded"] for r in tokenise.decode(e, v, key="doc_id").collect()}
    assert d[1] == "ab ☃é ca" and d[2] == "<0x41>"
    # a literal that looks like a byte piece stays, however it was cut
    w = unigram.train_unigram(q, 290, BASE_SPECIALS, byte_fallback=True)
    e = unigram.encode_unigram(q, unigram.make_unigram_encoder(w, BASE_SPECIALS), "text", "input_ids")
    assert {r["decoded"] for r in tokenise.decode(e, w, key="doc_id").collect()} == {"ab ☃é ca", "<0x41>"}
