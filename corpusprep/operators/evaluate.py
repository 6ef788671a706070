"""Evaluation over score tables.

The reference samples from logits and scores sequences with its network; here
the same reductions run over long tables:

* candidates  (group_id, item_id, score)  - one group per sampling step
* token log-probs (pair_id, which, model, pos, label, logp)

Per-group windows below run over one candidate distribution (bounded by the
vocabulary size), never over corpus rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.operators.order import HASH_SPAN, hash_order
from corpusprep.profiles import IGNORE_INDEX



def top_k_per_group(c: DataFrame, k: int, temperature: float = 1.0) -> DataFrame:
    """Keep items whose score/T is >= the k-th largest (ties kept);
    k <= 0 keeps all. rank() with a filter gets Spark's per-group limit."""
    c = c.withColumn("score", F.col("score") / F.lit(float(temperature)))
    if k <= 0:
        return c
    w = Window.partitionBy("group_id").orderBy(F.desc("score"))
    return c.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= k).drop("_r")


def softmax_per_group(c: DataFrame, value: str = "score", out: str = "prob") -> DataFrame:
    """exp(x - max) / sum(exp(x - max)) within each group."""
    w = Window.partitionBy("group_id")
    e = F.exp(F.col(value) - F.max(value).over(w))
    return c.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def nucleus_per_group(p: DataFrame, top_p: float) -> DataFrame:
    """In descending probability order keep items while the cumulative
    sum *before* them is <= top_p (the crossing item is kept), renormalise.
    top_p <= 0 keeps all."""
    if top_p <= 0:
        return p
    w = Window.partitionBy("group_id").orderBy(*[F.desc("prob"), F.asc("item_id")]) \
        .rowsBetween(Window.unboundedPreceding, 0)
    kept = p.withColumn("_before", F.sum("prob").over(w) - F.col("prob")) \
            .filter(F.col("_before") <= F.lit(float(top_p))).drop("_before")
    return kept.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy("group_id")))


def draw_per_group(p: DataFrame, seed: int) -> DataFrame:
    """One weighted draw per group by inverse CDF with u = h(seed:group)/2^60:
    the first item (descending prob, then item) whose cumulative prob exceeds u
    (the last item when rounding leaves none); logp = ln(prob)."""
    w = Window.partitionBy("group_id").orderBy(F.desc("prob"), F.asc("item_id")) \
        .rowsBetween(Window.unboundedPreceding, 0)
    u = hash_order(seed, F.col("group_id")) / F.lit(float(HASH_SPAN))
    c = p.withColumn("_cum", F.sum("prob").over(w)).withColumn("_u", u)
    first = F.min(F.struct((-F.col("prob")).alias("np"), F.col("item_id").alias("item_id")))
    hit = c.filter(F.col("_cum") > F.col("_u")).groupBy("group_id").agg(first.alias("_s"))
    last = c.groupBy("group_id").agg(
        F.max(F.struct((-F.col("prob")).alias("np"), F.col("item_id").alias("item_id"))).alias("_l"))
    pick = last.join(hit, "group_id", "left").select(
        "group_id", F.coalesce(F.col("_s.item_id"), F.col("_l.item_id")).alias("item_id"))
    return pick.join(p, ["group_id", "item_id"]).select(
        "group_id", "item_id", "prob", F.log("prob").alias("logp"))


def masked_cross_entropy(t: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean negative log-probability over positions whose label != -100,
    and its perplexity."""
    live = F.col("label") != IGNORE_INDEX
    g = t.groupBy(*by).agg(F.sum(F.when(live, -F.col("logp"))).alias("_s"),
                           F.count(F.when(live, 1)).alias("tokens"))
    ce = F.col("_s") / F.col("tokens")
    return g.select(*by, "tokens", F.round(ce, 6).alias("cross_entropy"),
                    F.round(F.exp(ce), 6).alias("perplexity"))


def fit_bigram(ids: DataFrame, col: str = "input_ids") -> DataFrame:
    """Bigram counts (prev, token, n) and prev totals from id sequences - the
    table model that stands in for the network in E2."""
    pairs = ids.select(F.explode(F.arrays_zip(F.slice(col, 1, F.greatest(F.size(col) - 1, F.lit(0))),
                                              F.slice(col, 2, F.greatest(F.size(col) - 1, F.lit(0)))))
                       .alias("z"))
    return pairs.select(F.col("z.0").alias("prev"), F.col("z.1").alias("token")) \
        .groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n"))


def score_tokens(seq: DataFrame, bigram: DataFrame, vocab_size: int, k: float | dict[str, float],
                 model: str | None = None, keys: tuple[str, ...] = ("pair_id", "which"), blocks: int | None = None) -> DataFrame:
    """Per position log P(label | input) under add-k smoothing,
    (n(prev, label) + k) / (n(prev) + k * V); masked positions get logp 0.
    seq has keys, input_ids and labels (same length). ``k`` is the ``model``'s,
    or a {model: k} mapping: the counts are looked up once for all of them.

    Sequences are dealt into ``blocks`` by their keys. Only a block's distinct
    pairs ask the model, and the answers meet the positions on (block, pair), so
    a pair that stands everywhere is a row per block to the model, and its
    positions are spread over the blocks."""
    models = k if isinstance(k, dict) else {model: k}
    n = int(blocks or seq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    z = (seq.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("_block"),
                    F.posexplode(F.arrays_zip("input_ids", "labels")).alias("pos", "z"))
         .select(*keys, "_block", "pos", F.col("z.input_ids").alias("prev"), F.col("z.labels").alias("label")))
    masked = F.col("label") == IGNORE_INDEX
    asks = z.filter(~masked).select("_block", "prev", "label").distinct()
    tot = bigram.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    lp = [F.log((F.coalesce("n", F.lit(0)) + F.lit(k)) /
                (F.coalesce("n_prev", F.lit(0)) + F.lit(k * vocab_size))).alias(f"_lp{i}")
          for i, k in enumerate(models.values())]
    answers = (asks.join(bigram.withColumnRenamed("token", "label"), ["prev", "label"], "left")
               .join(tot, "prev", "left")
               .select(F.col("_block").alias("_b"), F.col("prev").alias("_p"), F.col("label").alias("_l"), *lp))
    j = z.join(answers, (F.col("_block") == F.col("_b")) & F.col("prev").eqNullSafe(F.col("_p"))
               & F.col("label").eqNullSafe(F.col("_l")), "left")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.when(masked, F.lit(0.0)).otherwise(F.col(f"_lp{i}")).alias("logp"))
                               for i, m in enumerate(models)]))
    return (j.select(*keys, each.alias("_m"), F.col("pos").cast("long"), F.col("label").cast("long"))
            .select(*keys, "_m.model", "pos", "label", "_m.logp"))


def preference_loss(scores: DataFrame, beta: float, mode: str = "position",
                    policy: str = "policy", reference: str = "reference") -> DataFrame:
    """margin = beta * ((ref_w - theta_w) - (ref_l - theta_l)) on negative
    log-likelihoods; loss = -log sigmoid(margin) = log1p(exp(-margin)).
    mode 'position' (as the reference: per position, masked ones included);
    mode 'sequence' (sums per sequence first). Output per pair_id."""
    nll = F.sum(F.when(F.col("model") == policy, -F.col("logp")).otherwise(0.0))
    ref = F.sum(F.when(F.col("model") == reference, -F.col("logp")).otherwise(0.0))
    if mode == "position":
        per = scores.groupBy("pair_id", "pos").agg(
            F.sum(F.when((F.col("model") == reference) & (F.col("which") == 0), -F.col("logp"))
                  .when((F.col("model") == policy) & (F.col("which") == 0), F.col("logp"))
                  .when((F.col("model") == reference) & (F.col("which") == 1), F.col("logp"))
                  .when((F.col("model") == policy) & (F.col("which") == 1), -F.col("logp"))
                  .otherwise(0.0)).alias("_d"))
        m = per.withColumn("margin", F.lit(float(beta)) * F.col("_d"))
        loss = F.log1p(F.exp(-F.col("margin")))
        return m.groupBy("pair_id").agg(F.round(F.avg(loss), 6).alias("loss"),
                                        F.round(F.avg("margin"), 6).alias("reward"))
    if mode == "sequence":
        s = scores.groupBy("pair_id", "which").agg(nll.alias("th"), ref.alias("rf"))
        w, l_ = s.filter(F.col("which") == 0), s.filter(F.col("which") == 1)
        j = w.alias("w").join(l_.alias("l"), "pair_id")
        margin = F.lit(float(beta)) * ((F.col("w.rf") - F.col("w.th")) - (F.col("l.rf") - F.col("l.th")))
        return j.select("pair_id", F.round(F.log1p(F.exp(-margin)), 6).alias("loss"),
                        F.round(margin, 6).alias("reward"))
    raise ValueError(f"unknown mode: {mode}")

