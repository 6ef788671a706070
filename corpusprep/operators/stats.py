"""Token statistics, counts and evaluation aggregates.

All are hash aggregates with partial (map-side) aggregation; nothing collects
rows of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "ALL"


def _ntok(col: str):
    return F.coalesce(F.size(col), F.lit(0)).cast("long")


def token_stats(df: DataFrame, ids: str = "input_ids",
                by: tuple[str, ...] = ("dataset", "split")) -> DataFrame:
    """A1: per dataset/split total tokens, examples and average (0 when empty).
    A row's tokens are the length of its ``ids``: of nested preference ids that
    is the number of sequences, 2 a row."""
    g = df.groupBy(*by).agg(F.sum(_ntok(ids)).alias("total_tokens"),
                            F.count(F.lit(1)).alias("examples"))
    return g.withColumn("avg_tokens", F.round(F.when(F.col("examples") > 0,
                        F.col("total_tokens") / F.col("examples")).otherwise(0.0), 6))


def token_stats_total(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """A2: the A1 rows plus one grand total (dataset = split = 'ALL'); the total
    average is total/total, not a mean of means."""
    g = (df.rollup("dataset", "split")
         .agg(F.sum(_ntok(ids)).alias("total_tokens"), F.count(F.lit(1)).alias("examples"),
              F.grouping_id().alias("_gid")))
    g = g.filter(F.col("_gid").isin(0, 3))
    return (g.select(F.when(F.col("_gid") == 3, F.lit(ALL)).otherwise(F.col("dataset")).alias("dataset"),
                     F.when(F.col("_gid") == 3, F.lit(ALL)).otherwise(F.col("split")).alias("split"),
                     "total_tokens", "examples")
            .withColumn("avg_tokens", F.round(F.when(F.col("examples") > 0,
                        F.col("total_tokens") / F.col("examples")).otherwise(0.0), 6)))


def count_tokens(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """A3: tokens per split (splits with 0 tokens not reported) plus 'ALL'."""
    g = (df.rollup("split").agg(F.sum(_ntok(ids)).alias("tokens"), F.grouping_id().alias("_gid"))
         .filter(F.col("tokens") > 0))
    return g.select(F.when(F.col("_gid") == 1, F.lit(ALL)).otherwise(F.col("split")).alias("split"), "tokens")


def dataset_sizes(df: DataFrame, by: tuple[str, ...] = ("dataset", "split")) -> DataFrame:
    """A10: row counts."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def batches_per_epoch_tokens(df: DataFrame, batch: int, ctx: int, ids: str = "input_ids",
                             by: tuple[str, ...] = ("split",)) -> DataFrame:
    """A11 pre-training: tokens // (batch * ctx)."""
    return (df.groupBy(*by).agg(F.sum(_ntok(ids)).alias("tokens"))
            .withColumn("batches", F.floor(F.col("tokens") / F.lit(batch * ctx)).cast("long")))


def batches_per_epoch_rows(df: DataFrame, batch: int, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """A11 SFT/preference: rows // batch."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("batches", F.floor(F.col("rows") / F.lit(batch)).cast("long")))


def mean_metric(df: DataFrame, value: str, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """Mean of per-batch values."""
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean_value"),
                               F.count(F.lit(1)).alias("batches"))


def throughput(metrics: DataFrame) -> DataFrame:
    """Steps per second between consecutive steps of a run:
    1/(t_i - t_(i-1)), 0 when the gap is <= 0 or there is no previous step.
    The previous step is found by an equi-join on the unique (run, step) key,
    so a run with most of the rows still spreads over all tasks."""
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    prev = metrics.select("run", (F.col("step") + 1).alias("step"), secs.alias("_prev"))
    gap = secs - F.col("_prev")
    return (metrics.join(prev, ["run", "step"], "left")
            .withColumn("rate", F.round(F.when(gap > 0, 1.0 / gap).otherwise(0.0), 6))
            .drop("_prev"))


def dict_to_long(df: DataFrame, main_tag: str, value_cols: list[str],
                 keys: tuple[str, ...] = ("run", "step")) -> DataFrame:
    """A dict of scalars per step -> one row per sub-tag "main/sub"."""
    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in value_cols)
    return df.selectExpr(*keys, f"stack({len(value_cols)}, {stack}) as (sub, value)").select(
        *keys, F.concat(F.lit(main_tag + "/"), F.col("sub")).alias("tag"), "value")
