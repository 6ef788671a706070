"""Operator 1 against the model in dictionaries, and what it keeps."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusprep.llm import quality
from corpusprep.llm.common import read
from corpusprep.llm.mixing import seeded
from conftest import SMALL
from llm import brute


def split(t):
    return [w for w in brute.words(t)]


class Plain:
    """Interpolated modified Kneser-Ney trigrams in dictionaries."""

    def __init__(self, texts):
        c3 = Counter()
        for t in texts:
            w = ["<s>", "<s>", *split(t), "</s>"]
            c3.update(zip(w, w[1:], w[2:]))
        c2 = Counter((b, w) for _, b, w in c3)
        c1 = Counter((w,) for _, w in c2)
        self.c = {3: c3, 2: c2, 1: c1}
        self.d = {n: self.discounts(c) for n, c in self.c.items()}
        self.tot, self.left = {}, {}
        for n, c in self.c.items():
            tot, left = Counter(), defaultdict(float)
            for g, x in c.items():
                tot[g[:-1]] += x
                left[g[:-1]] += self.cut(n, x)
            self.tot[n], self.left[n] = tot, left

    @staticmethod
    def discounts(c):
        n = [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0.5] * 3
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    def cut(self, n, x):
        return self.d[n][min(x, 3) - 1]

    def p(self, g):
        n = len(g)
        low = 1 / (len(self.c[1]) + 1) if n == 1 else self.p(g[1:])
        t = self.tot[n].get(g[:-1], 0)
        if not t:
            return low
        x = self.c[n].get(g, 0)
        return max(x - (self.cut(n, x) if x else 0), 0) / t + self.left[n][g[:-1]] / t * low

    def perplexity(self, t):
        w = ["<s>", "<s>", *split(t), "</s>"]
        lp = [math.log(self.p(g)) for g in zip(w, w[1:], w[2:])]
        return math.exp(-sum(lp) / len(lp))


def test_perplexity_equals_the_plain_model(spark):
    docs = read(spark, SMALL, "documents")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    train, rest = texts[:60], [*texts[60:90], None, "", " \n", "never seen words"]
    model = quality.train(spark.createDataFrame([(t,) for t in train], "text string"))
    plain = Plain(train)
    got = quality.perplexities(spark.createDataFrame([(t,) for t in rest], "text string"), model)
    import hashlib
    by = {bytes(r["node"]): r["perplexity"] for r in got.collect()}
    for t in rest:
        want = plain.perplexity(t)
        assert abs(by[hashlib.md5((t or "").encode()).digest()] - want) < 1e-6 * want


def test_the_plain_model_is_a_distribution():
    m = Plain(["a b a c a b", "b a b", "a"])
    words = ["a", "b", "c", "</s>", "unknown"]
    for h in (("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("x", "y"), ("b", "a")):
        assert abs(sum(m.p((*h, w)) for w in words) - 1) < 1e-9


def test_clean_documents_stay_and_junk_goes(spark):
    c = quality.classify(read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels"))
    lab = read(spark, "/root/testdata/sf0.01", "labels")
    r = {(x["quality"], x["kept"]): x["count"] for x in c.join(lab, "doc_id").groupBy("quality", "kept").count().collect()}
    assert r.get((1, False), 0) <= 0.01 * r[1, True]
    assert r[0, False] > 0.6 * (r[0, False] + r.get((0, True), 0))


def test_limits_are_no_wider_than_unseen_trusted_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    size = (F.length("text") / quality.WORD_CHARS + 1).cast("long")
    rows = (quality.classify(docs, labels).join(docs.select("doc_id", size.alias("size")), "doc_id")
            .join(labels.select("doc_id", "quality", "toxic"), "doc_id")
            .withColumn("h", seeded(quality.SEED, F.col("doc_id"))).collect())
    wide = lambda r: math.exp(quality.SHORT / math.sqrt(r["size"]))
    unseen = defaultdict(list)
    for r in rows:
        if r["quality"] == 1 and not r["toxic"] and r["h"] % 2 == 0:
            unseen[r["lang"]].append(r["perplexity"] / wide(r))
    assert unseen
    for r in rows:
        assert r["limit"] / wide(r) <= max(unseen[r["lang"]]) * 1.0001
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert junk.count(False) > 0.93 * len(junk)


def test_awkward_rows(spark):
    docs = brute.awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, None, None), (None, 1, 0), (9, 0, 1), (11, 1, 0), (12, 1, 0), (12, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    c = quality.classify(docs, labels)
    assert c.count() == docs.count()
    none = labels.filter("false")
    assert quality.classify(docs, none).filter("not kept").count() == 0
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and brute.key_of(kept.collect()) == brute.key_of(docs.collect())
    assert quality.keep_good(brute.empty(spark), labels).count() == 0


def test_shuffled_model_joins_give_the_same(spark, monkeypatch):
    """Model tables beyond the broadcast limit are joined by their keys."""
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    plain = quality.classify(docs, labels).collect()
    monkeypatch.setattr(quality, "MODEL_ROWS", 0)
    out = quality.classify(docs, labels)
    assert brute.key_of((r["doc_id"], r["perplexity"], r["limit"], r["kept"]) for r in out.collect()) == brute.key_of(
        (r["doc_id"], r["perplexity"], r["limit"], r["kept"]) for r in plain)


def test_long_trusted_texts_do_not_end_the_sample(spark, monkeypatch):
    """The sample's bound holds, and a text that does not fit is passed over."""
    rows = [(i, " ".join([f"w{j}" for j in range(40)]), "en") for i in range(200)] + [(1000 + i, "longer " * 5000, "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    seen = []
    plain = quality.train
    monkeypatch.setattr(quality, "train", lambda sample, text: (seen.extend(sample.collect()), plain(sample, text))[1])
    quality.classify(docs, labels, max_docs=20, max_words=20_000).collect()
    assert seen and all(r["t"].startswith("w0") for r in seen)


def test_limit_and_kept_follow_from_perplexities(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    size = (F.length("text") / quality.WORD_CHARS + 1).cast("long")
    rows = (quality.classify(docs, labels).join(docs.select("doc_id", size.alias("size")), "doc_id")
            .join(labels.select("doc_id", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic")), "doc_id", "left")
            .withColumn("h", seeded(quality.SEED, F.col("doc_id"))).collect())
    wide = lambda r: math.exp(quality.SHORT / math.sqrt(r["size"]))
    by = defaultdict(list)
    for r in rows:
        if r["quality"] == 1 and not r["toxic"] and r["h"] % 2 == 0:
            by[r["lang"]].append(r["perplexity"] / wide(r))
    for lang, v in by.items():
        v.sort()
        limits = {round(r["limit"] / wide(r), 6) for r in rows if r["lang"] == lang}
        assert len(limits) == 1
        at = limits.pop()       # the quantile: so many of the unseen are at or below it
        share = sum(x <= at * (1 + 1e-9) for x in v) / len(v)
        assert share >= quality.QUANTILE - 1e-9 and sum(x < at * (1 - 1e-9) for x in v) / len(v) <= quality.QUANTILE
    assert all(r["kept"] == (r["limit"] is None or r["perplexity"] <= r["limit"]) for r in rows)
