"""Packing token sequences into training blocks and batches
(W3, L1-L5, X5-X8, A11 helpers).

The flat token stream of the reference (all documents concatenated in order)
is never materialised as one array or exploded per token: each document's
offset comes from the distributed prefix sum, every document emits one slice
per block it overlaps, and a block (bounded by ``ctx`` tokens) is assembled by
an ordered group-by on block_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.operators.order import hash_order, prefix_sum
from corpusprep.profiles import IGNORE_INDEX
from corpusprep.session import reliable_checkpoint


def doc_offsets(tok: DataFrame, order: Sequence[str], ids: str = "input_ids",
                num_partitions: int | None = None) -> DataFrame:
    """Exclusive running token count along ``order`` (unique keys) -> column
    ``offset``. The token rows are written once (the encoder does not run again
    for the rank); only keys and lengths are ranked, and joined back."""
    tok = reliable_checkpoint(tok)
    t = tok.withColumn("_n", F.size(ids).cast("long"))
    return prefix_sum(t, list(order), "_n", out="offset", inclusive=False,
                      num_partitions=num_partitions).drop("_n")


def pack_blocks(tok: DataFrame, ctx: int, order: Sequence[str], ids: str = "input_ids",
                num_partitions: int | None = None) -> DataFrame:
    """L1: (block_id, tokens) with block b = stream[b*ctx : (b+1)*ctx]; the
    last block may be short."""
    c = int(ctx)
    off = doc_offsets(tok.select(*order, ids), order, ids, num_partitions)
    n = F.size(ids)
    first_b = F.floor(F.col("offset") / c)
    last_b = F.floor((F.col("offset") + n - 1) / c)
    per = (off.filter(n > 0)
           .select("offset", ids, F.explode(F.sequence(first_b, last_b)).alias("block_id")))
    lo = F.greatest(F.col("block_id") * c, F.col("offset"))
    hi = F.least((F.col("block_id") + 1) * c, F.col("offset") + n)
    piece = F.slice(ids, (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int"))
    pieces = per.select("block_id", F.struct(lo.alias("start"), piece.alias("p")).alias("s"))
    return pieces.groupBy("block_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["p"])).alias("tokens"))


def next_token_pairs(blocks: DataFrame) -> DataFrame:
    """L2: per block x = tokens, y = tokens shifted by one; y's last item is the
    first token of the next block (none for the last block, which then has
    one pair fewer)."""
    nxt = blocks.select((F.col("block_id") - 1).alias("block_id"),
                        F.element_at("tokens", 1).alias("_next"))
    j = blocks.join(nxt, "block_id", "left")
    y = F.when(F.col("_next").isNotNull(),
               F.concat(F.slice("tokens", 2, F.size("tokens")), F.array("_next"))) \
        .otherwise(F.slice("tokens", 2, F.size("tokens")))
    x = F.slice("tokens", 1, F.size(y))
    return j.select("block_id", x.alias("x"), y.alias("y"))


def sample_windows(blocks: DataFrame, n: int, ctx: int, block_size: int, seed: int,
                   total: int | None = None) -> DataFrame:
    """L3: ``n`` windows of ctx+1 tokens starting uniformly in [0, L-ctx-1)
    (the last legal start excluded, as in the reference); x = w[:ctx],
    y = w[1:]. A window touches at most two blocks when ctx <= block_size:
    equi-join on the exploded block ids, then an ordered group-by per draw."""
    spark = blocks.sparkSession
    L = total if total is not None else blocks.agg(F.sum(F.size("tokens"))).first()[0]
    span = L - ctx - 1
    if span <= 0:
        raise ValueError("stream shorter than the context")
    B = int(block_size)
    draws = spark.range(n).select(F.col("id").alias("draw"),
                                  F.pmod(hash_order(seed, F.col("id")), F.lit(span)).alias("start"))
    need = draws.select("draw", "start", F.explode(F.sequence(
        F.floor(F.col("start") / B), F.floor((F.col("start") + ctx) / B))).alias("block_id"))
    j = need.join(blocks, "block_id")
    lo = F.greatest(F.col("start"), F.col("block_id") * B)
    hi = F.least(F.col("start") + ctx + 1, F.col("block_id") * B + F.size("tokens"))
    part = F.slice("tokens", (lo - F.col("block_id") * B + 1).cast("int"), (hi - lo).cast("int"))
    g = j.select("draw", "start", F.struct(lo.alias("lo"), part.alias("p")).alias("s")).groupBy("draw", "start").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["p"])).alias("w"))
    return g.select("draw", "start", F.slice("w", 1, ctx).alias("x"), F.slice("w", 2, ctx).alias("y"))


def fit_length(ids, labels, ctx: int, pad_id: int) -> tuple[Column, Column]:
    """Longer -> keep the last ctx; shorter -> right-pad ids with pad_id
    and labels with -100."""
    i, lab = (F.col(ids) if isinstance(ids, str) else ids), (F.col(labels) if isinstance(labels, str) else labels)
    n = F.size(i)
    cut_i = F.when(n > ctx, F.slice(i, -ctx, ctx)).otherwise(i)
    cut_l = F.when(n > ctx, F.slice(lab, -ctx, ctx)).otherwise(lab)
    pad = F.greatest(F.lit(ctx) - n, F.lit(0))
    return (F.concat(cut_i, F.array_repeat(F.lit(pad_id), pad)),
            F.concat(cut_l, F.array_repeat(F.lit(IGNORE_INDEX), pad)))


def first_label_index(labels) -> Column:
    """1-based index of the first label != -100 (0 when none)."""
    lab = F.col(labels) if isinstance(labels, str) else labels
    return F.array_position(F.transform(lab, lambda x: x != IGNORE_INDEX), True)


def prompt_and_target(ids: str = "input_ids", labels: str = "labels") -> tuple[Column, Column]:
    """X7 (SFT test view): cut = first unmasked index + 1 (whole row when none);
    prompt = ids[:cut], target = labels[cut:]."""
    k = first_label_index(labels)
    cut = F.when(k > 0, k).otherwise(F.size(labels))
    return (F.slice(ids, 1, cut.cast("int")),
            F.slice(labels, (cut + 1).cast("int"), F.greatest(F.size(labels) - cut, F.lit(0)).cast("int")))


def prompt_and_completion(ids: str = "input_ids", labels: str = "labels") -> tuple[Column, Column]:
    """X8 (preference test view, accepted sequence only): prompt = ids before
    the first unmasked index; completion = unmasked labels."""
    acc_ids, acc_lab = F.element_at(ids, 1), F.element_at(labels, 1)
    k = first_label_index(acc_lab)
    cut = F.when(k > 0, k - 1).otherwise(F.size(acc_ids))
    return (F.slice(acc_ids, 1, cut.cast("int")), F.filter(acc_lab, lambda x: x != IGNORE_INDEX))


def explode_pairs(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Nested [accepted, rejected] rows -> one row per sequence with
    ``accepted`` = reward > 0."""
    z = df.select(key, F.posexplode(F.arrays_zip("input_ids", "labels", "rewards")).alias("sub", "z"))
    return z.select(key, "sub", F.col("z.input_ids").alias("input_ids"), F.col("z.labels").alias("labels"),
                    (F.col("z.rewards") > 0).alias("accepted"))


def sft_batches(ranked: DataFrame, n_batches: int, batch: int, ctx: int, pad_id: int, seed: int,
                rank_col: str = "rank", total: int | None = None) -> DataFrame:
    """L4: n_batches*batch draws with replacement (R9) -> fit_length ->
    (batch_id, slot, input_ids, labels)."""
    from corpusprep.operators.split import sample_rows
    s = sample_rows(ranked, n_batches * batch, seed, rank_col, total)
    x, y = fit_length("input_ids", "labels", ctx, pad_id)
    return s.select((F.col("draw") / batch).cast("long").alias("batch_id"),
                    (F.col("draw") % batch).alias("slot"), x.alias("input_ids"), y.alias("labels"))


def preference_batches(ranked: DataFrame, n_batches: int, batch: int, ctx: int, pad_id: int, seed: int,
                       rank_col: str = "rank", total: int | None = None) -> DataFrame:
    """As L4, each draw yields its accepted and its rejected sequence."""
    from corpusprep.operators.split import sample_rows
    s = sample_rows(ranked, n_batches * batch, seed, rank_col, total)
    e = explode_pairs(s.withColumnRenamed("draw", "_draw"), "_draw")
    x, y = fit_length("input_ids", "labels", ctx, pad_id)
    return e.select((F.col("_draw") / batch).cast("long").alias("batch_id"),
                    (F.col("_draw") % batch).alias("slot"), "accepted", x.alias("input_ids"), y.alias("labels"))
