"""Operator 1: quality classifier by an n-gram language model of trusted text.

An interpolated modified Kneser-Ney model of word trigrams is trained on
trusted documents; joins of every document's n-grams with the count tables,
sharded by n-gram key, give its perplexity; a document whose perplexity is
above its language's limit, a quantile over trusted documents that the model
has not seen, is rejected. Perplexities are compared after division by their
length's allowance, in the quantile as in the test. An upper limit cannot see
junk that the model finds likely, such as one common word repeated.

The training text is a bounded sample of the trusted documents
(``max_docs`` and ``max_words`` per language). Everything else, the scores and
the quantiles, covers all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.common import small, table, text_key
from corpusprep.llm.mixing import seeded

MAX_DOCS = 400          # training documents per language
MAX_WORDS = 100_000     # and their words
LONGEST = 0.1           # of MAX_WORDS: no training document is longer
QUANTILE = 0.99
# The perplexity of a short text rests on few words: its limit is wider by
# exp(SHORT / sqrt(n)), n its length in words of WORD_CHARS characters.
SHORT = 2.0
WORD_CHARS = 6
SEED = 11
MODEL_ROWS = 1_000_000  # model tables of more rows are joined by a shuffle
BEGIN, END = 1, 2       # ids of the padding; words are 64-bit hashes


def gram_rows(docs: DataFrame, keep: list, text: Column) -> DataFrame:
    """One row per token (words, then one end): its two predecessors and itself."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    ids = F.concat(F.array(F.lit(BEGIN).cast("long"), F.lit(BEGIN).cast("long")),
                   F.transform(words, lambda x: F.xxhash64(x)), F.array(F.lit(END).cast("long")))
    d = docs.select(*keep, ids.alias("ids"))
    d = d.select("*", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("i"))
    at = [F.get("ids", F.col("i") - k) for k in (2, 1, 0)]
    return d.select(*[c for c in d.columns if c not in ("ids", "i")],
                    at[0].alias("a"), at[1].alias("b"), at[2].alias("w"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the
    counts of counts (four numbers); plain halves where there are too few."""
    c = counts.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [c[f"n{k}"] for k in (1, 2, 3, 4)]
    if not all(n):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def discount(d: list[float]) -> Column:
    return F.when(F.col("c") == 1, F.lit(d[0])).when(F.col("c") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def allowance(size: Column, short: float) -> Column:
    """How much wider the limit of a text of ``size`` words is."""
    return F.exp(F.lit(short) / F.sqrt(size))


def train(sample: DataFrame, text: str = "text") -> dict:
    """Model tables of a bounded sample: ``m3(k, lp)``, ``m2(k, lp, g)``,
    ``m1(k, lp, g)`` (natural logarithms; ``g`` is the weight left to the lower
    order when the row's n-gram is the history), their row counts, and ``unk``."""
    c3 = table(gram_rows(sample, [], F.col(text)).groupBy("a", "b", "w").agg(F.count(F.lit(1)).alias("c")), "kn3")
    c2 = table(c3.groupBy("b", "w").agg(F.count(F.lit(1)).alias("c")), "kn2")
    c1 = table(c2.groupBy("w").agg(F.count(F.lit(1)).alias("c")), "kn1")
    d3, d2, d1 = discounts(c3), discounts(c2), discounts(c1)

    def left(c, by, d):     # total and left-over weight of every history
        return c.groupBy(*by).agg(F.sum("c").alias("tot"), (F.sum(discount(d)) / F.sum("c")).alias("g"))

    one = c1.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t"), F.sum(discount(d1)).alias("d"),
                 F.count(F.lit(1)).alias("v")).first()
    t1, v = float(one["t"] or 0), one["v"]
    g1 = (one["d"] / t1) if t1 else 1.0
    p1 = c1.select("w", (F.greatest(F.col("c") - discount(d1), F.lit(0.0)) / F.lit(t1 or 1.0) + F.lit(g1 / (v + 1))).alias("p1"))
    h2, h3 = left(c2, ["b"], d2), left(c3, ["a", "b"], d3)
    p2 = (c2.join(h2, "b").join(p1, "w")
          .select("b", "w", (F.greatest(F.col("c") - discount(d2), F.lit(0.0)) / F.col("tot")
                             + F.col("g") * F.col("p1")).alias("p2")))
    p3 = (c3.join(h3, ["a", "b"]).join(p2, ["b", "w"])
          .select("a", "b", "w", (F.greatest(F.col("c") - discount(d3), F.lit(0.0)) / F.col("tot")
                                  + F.col("g") * F.col("p2")).alias("p3")))
    m1 = table(p1.join(h2.select(F.col("b").alias("w"), "g"), "w", "full").select(
        F.col("w").alias("k"), F.log("p1").alias("lp"), F.log("g").alias("g")), "m1")
    m2 = table(p2.join(h3.select(F.col("a").alias("b"), F.col("b").alias("w"), "g"), ["b", "w"], "full").select(
        F.xxhash64("b", "w").alias("k"), F.log("p2").alias("lp"), F.log("g").alias("g")), "m2")
    m3 = table(p3.select(F.xxhash64("a", "b", "w").alias("k"), F.log("p3").alias("lp")), "m3")
    import math
    return {"m1": m1, "m2": m2, "m3": m3, "n": {m: t.count() for m, t in (("m1", m1), ("m2", m2), ("m3", m3))},
            "unk": math.log(g1 / (v + 1))}


def perplexities(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """(node, n_tokens, perplexity) per distinct text. The n-grams meet the
    model in joins on their keys and are summed per text before any shuffle."""
    rows = gram_rows(docs, [text_key(F.col(text)).alias("node")], F.col(text))

    def m(name, tag, col):
        t = model[name].filter(F.col(col).isNotNull())
        return small(t.select(F.col("k").alias("k" + tag), F.col(col).alias(col + tag)), model["n"][name], MODEL_ROWS)

    j = (rows.withColumn("k3", F.xxhash64("a", "b", "w")).withColumn("k2", F.xxhash64("b", "w"))
         .withColumn("kh", F.xxhash64("a", "b"))
         .join(m("m3", "3", "lp"), "k3", "left").join(m("m2", "2", "lp"), "k2", "left")
         .join(m("m2", "h", "g"), "kh", "left")
         .join(m("m1", "1", "lp").withColumnRenamed("k1", "w"), "w", "left")
         .join(m("m1", "b", "g").withColumnRenamed("kb", "b"), "b", "left"))
    lp = F.coalesce("lp3", F.coalesce("gh", F.lit(0.0)) + F.coalesce(
        "lp2", F.coalesce("gb", F.lit(0.0)) + F.coalesce("lp1", F.lit(model["unk"]))))
    # copies of a text add up to the same mean
    return (j.groupBy("node").agg(F.avg(lp).alias("lp")).select("node", F.exp(-F.col("lp")).alias("perplexity")))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, quantile: float = QUANTILE,
             short: float = SHORT, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: ``key, lang, node`` (key of the text), ``perplexity``,
    ``limit`` and ``kept``.

    Trusted are the rows whose key has a label ``quality = 1`` (and none that
    says otherwise, nor a toxic one). By a seeded hash of the key half of them
    may train (of those of at most a tenth of ``max_words`` the first
    ``max_docs`` per language, up to ``max_words``), the other half sets the limits. A language (null is one) without trusted
    documents has no limit and keeps all. Null and empty texts have one token,
    the end. Without any trusted document everything is kept."""
    good = (labels.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
            .filter((F.col("q") == 1) & (F.col("t") == 0)).select(F.col(key).alias("doc")))
    narrow = table(docs.select(F.col(key).alias("doc"), F.coalesce(F.col(lang), F.lit("")).alias("l"),
                               F.col(lang).alias("lang"), text_key(F.col(text)).alias("node"),
                               (F.length(F.coalesce(F.col(text), F.lit(""))) / WORD_CHARS + 1).cast("long").alias("size")), "narrow")
    trusted = table(narrow.join(good, "doc").withColumn("h", seeded(seed, F.col("doc"))), "trusted")
    w = Window.partitionBy("l").orderBy("h", "doc", "node")
    fit = (F.col("h") % 2 == 1) & (F.col("size") <= LONGEST * max_words)
    top = trusted.filter(fit).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max_docs)
    top = top.withColumn("sum", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    picked = table(top.filter(F.col("sum") <= max_words).select("node").distinct(), "picked")
    texts = (docs.select(text_key(F.col(text)).alias("node"), F.col(text).alias("t"))
             .join(small(picked, picked.count()), "node").dropDuplicates(["node"]))
    model = train(texts, "t")
    scores = table(perplexities(docs, model, text), "perplexity")
    held = trusted.filter(F.col("h") % 2 == 0).join(picked, "node", "left_anti")
    limits = (held.join(scores, "node").groupBy("l")
              .agg(F.percentile_approx(F.col("perplexity") / allowance(F.col("size"), short), quantile, 10_000).alias("limit")))
    limits = table(limits, "limits")
    out = narrow.join(scores, "node").join(small(limits, limits.count()), "l", "left")
    out = out.withColumn("limit", F.col("limit") * allowance(F.col("size"), short))
    return out.select(F.col("doc").alias(key), F.col("lang").alias(lang), "node", "perplexity", "limit",
                      (F.col("limit").isNull() | (F.col("perplexity") <= F.col("limit"))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
              **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns."""
    c = classify(docs, labels, key, text, lang, **options).filter(~F.col("kept"))
    bad = c.select(F.col("node").alias("_q_node"), F.coalesce(F.col(lang), F.lit("")).alias("_q_lang")).distinct()
    d = docs.withColumn("_q_own", text_key(F.col(text)))
    return d.join(bad, (F.col("_q_own") == F.col("_q_node")) & (F.coalesce(F.col(lang), F.lit("")) == F.col("_q_lang")),
                  "left_anti").select(*docs.columns)
