"""Deterministic splits, caps and samples.

Random draws of the reference become hash orders (see ``order``); counts are
exact. No operator numbers all rows through one task: small holdouts come from
a distributed top-k, large ranks from the range-partitioned ``global_rank``.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.operators.order import hash_order, keys_at, order_key, rank_within, take_first
from corpusprep.operators.vocab import bounded_broadcast
from corpusprep.session import BROADCAST_ROW_LIMIT, broadcast_if, reliable_checkpoint

SPLITS = ("train", "validation", "test")


def split_exact(df: DataFrame, key: str, n_holdout: int, seed: int = 42,
                by: str | None = None) -> DataFrame:
    """R2: shuffle, take exactly ``n_holdout`` rows out (per ``by`` group when
    given), first floor(n/2) of them validation, the rest test, all others
    train.

    Plan: the holdout of each group is its n smallest (hash, key) tuples. For
    n up to Spark's window-group-limit threshold the ranking window gets a
    partial per-group limit before its shuffle (a hot group ships at most n
    rows per task); larger n use the range-partitioned rank. Only two
    threshold tuples per group come back, and every row is labelled by
    comparing its (hash, key) with them (broadcast of #groups rows, checked)."""
    n_valid = n_holdout // 2
    spark = df.sparkSession
    hk = F.struct(hash_order(seed, key).alias("h"), F.col(key).alias("k"))
    g = by or "_g"
    src = df if by else df.withColumn("_g", F.lit(0))
    keyed = src.select(g, hk.alias("_hk"))
    limit = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n_holdout <= limit:
        w = Window.partitionBy(g).orderBy("_hk")
        ranked = keyed.withColumn("_rn", F.row_number().over(w))
    else:
        ranked = rank_within(keyed, g, ["_hk"], out="_rn")
    ranked = ranked.filter(F.col("_rn") <= n_holdout)
    th = reliable_checkpoint(ranked.groupBy(g).agg(
        F.max(F.when(F.col("_rn") <= n_valid, F.col("_hk"))).alias("_tv"),
        F.max("_hk").alias("_tt")))
    side = F.broadcast(th) if th.count() <= BROADCAST_ROW_LIMIT else th
    label = (F.when(F.col("_tv").isNotNull() & (hk <= F.col("_tv")), F.lit("validation"))
             .when(F.col("_tt").isNotNull() & (hk <= F.col("_tt")), F.lit("test"))
             .otherwise(F.lit("train")))
    out = src.join(side, g, "left").withColumn("split", label).drop("_tv", "_tt")
    return out if by else out.drop("_g")


def split_sequential(df: DataFrame, key: str, sizes: Sequence[tuple[str, int]],
                     seed: int = 42) -> DataFrame:
    """Consume one shuffled stream: first sizes[0] rows to split 0, the
    next sizes[1] to split 1, ...; rows past the end get no split (dropped).
    Disjoint by construction. Only the keys are ranked; rows are labelled by
    comparing their key with the last key of each split."""
    keyed = df.withColumn("_h", hash_order(seed, key))
    ends, at = [], 0
    for name, n in sizes:
        at += n
        ends.append((name, at))
    edges = keys_at(keyed, [e for _, e in ends], ["_h", key])
    here = order_key(["_h", key])
    cond = None
    for name, e in ends:     # past the end of the stream: everything that is left
        c = here <= edges[e] if e in edges else F.lit(True) if e > 0 else F.lit(False)
        cond = F.when(c, F.lit(name)) if cond is None else cond.when(c, F.lit(name))
    return keyed.withColumn("split", cond).filter(F.col("split").isNotNull()).drop("_h")


def take(df: DataFrame, n: int | None, key: str, seed: int = 42) -> DataFrame:
    """Shuffle then keep the first ``n`` (0/None: no limit)."""
    if not n:
        return df
    return take_first(df.withColumn("_h", hash_order(seed, key)), n, ["_h", key]).drop("_h")


def max_bytes(df: DataFrame, n: int = 16384, text: str = "text") -> DataFrame:
    """Drop lines longer than ``n`` UTF-8 bytes."""
    return df.filter(F.octet_length(text) <= n)


def first_of_groups(df: DataFrame, quotas: dict[str, int], key: str, group: str = "dataset", seed: int = 42) -> DataFrame:
    """Per group exactly its quota of rows, first in hash order (groups without
    one are left out; keys must be unique).

    Only (group, hash, key) is ranked; the key at each group's quota comes back
    (a row per group), and the rest is a filter over the table: its other
    columns take no shuffle, however many groups end somewhere."""
    quotas = {g: int(n) for g, n in quotas.items() if n > 0}
    if not quotas:
        return df.limit(0)
    spark = df.sparkSession
    q = spark.createDataFrame(list(quotas.items()), f"{group} string, _quota long")
    keys = df.filter(F.col(group).isin(list(quotas))).select(group, hash_order(seed, key).alias("_h"), F.col(key).alias("_k"))
    # the last row that counts: at the quota, or the group's last one
    ranked = rank_within(keys, group, ["_h", "_k"], out="_rn").join(bounded_broadcast(q), group)
    edge = (ranked.filter(F.col("_rn") <= F.col("_quota")).groupBy(group)
            .agg(F.max(F.struct("_h", "_k")).alias("_edge")))
    return (df.join(bounded_broadcast(reliable_checkpoint(edge)), group)
            .filter(F.struct(hash_order(seed, key).alias("_h"), F.col(key).alias("_k")) <= F.col("_edge")).select(*df.columns))


def sample_by_fraction(df: DataFrame, fractions: dict[str, float], key: str,
                       group: str = "dataset", seed: int = 42) -> DataFrame:
    """Per group keep exactly floor(count * fraction) rows (fraction capped
    at 1; groups without a fraction or with 0 are skipped) in hash order."""
    fr = {g: min(float(f), 1.0) for g, f in fractions.items() if f and f > 0}
    counts = df.filter(F.col(group).isin(list(fr))).groupBy(group).count().collect() if fr else []
    return first_of_groups(df, {r[group]: int(r["count"] * fr[r[group]]) for r in counts}, key, group, seed)


def sample_by_shards(df: DataFrame, requested: dict[str, int], key: str, shard: str,
                     group: str = "dataset", seed: int = 42) -> DataFrame:
    """``requested`` shards of each dataset, as so large a share of its rows:
    of ``a`` available shards (distinct values of ``shard``) and ``c`` rows,
    exactly floor(c * requested / a) in hash order, all of them if as many or
    more are asked for than there are (with a warning). 0 skips a dataset; one
    that does not exist is an error."""
    want = {g: int(n) for g, n in requested.items() if n}
    have = {r[group]: r for r in (df.filter(F.col(group).isin(list(want))).groupBy(group)      # a row per dataset
                                  .agg(F.countDistinct(shard).alias("a"), F.count(F.lit(1)).alias("c")).collect())}
    missing = sorted(set(want) - set(have))
    if missing:
        raise FileNotFoundError(f"no such dataset: {', '.join(missing)}")
    for g, n in want.items():
        if n > have[g]["a"]:
            warnings.warn(f"{n} shards of {g} requested, {have[g]['a']} available: all are used", stacklevel=2)
    return first_of_groups(df, {g: have[g]["c"] * min(n, have[g]["a"]) // have[g]["a"] for g, n in want.items()}, key, group, seed)


def interleave(df: DataFrame, group: str, order: Sequence[str], group_order: Sequence[str],
               stop: str = "first_exhausted", unique: bool = True) -> DataFrame:
    """Round-robin over groups in ``group_order``; stops when the first
    group runs out. Output has ``rn`` (round) and ``gi`` (group index) and a
    global ``position``. ``unique=False``: rows of a group may repeat in ``order``."""
    spark = df.sparkSession
    gi = spark.createDataFrame([(g, i) for i, g in enumerate(group_order)], f"{group} string, gi int")
    ranked = rank_within(df.join(broadcast_if(gi, len(group_order)), group), group, list(order), out="rn", unique=unique)
    counts = ranked.groupBy(group).count().collect()
    m = min(r["count"] for r in counts) if len(counts) == len(group_order) else 0
    if stop == "first_exhausted":
        ranked = ranked.filter(F.col("rn") <= m)
    n = len(group_order)
    return ranked.withColumn("position", (F.col("rn") - 1) * n + F.col("gi"))


def sample_rows(df: DataFrame, n: int, seed: int, rank_col: str = "rank",
                total: int | None = None) -> DataFrame:
    """``n`` draws with replacement: draw i picks row pmod(h(seed:i), N)+1
    of a ranked table (equi-join on the rank; repeats kept)."""
    spark = df.sparkSession
    N = total if total is not None else df.count()
    if N == 0:
        return df.limit(0)
    draws = spark.range(n).select(F.col("id").alias("draw"),
                                  (F.pmod(hash_order(seed, F.col("id")), F.lit(N)) + 1).alias(rank_col))
    return draws.join(df, rank_col)


def prepare_corpus(docs: DataFrame, chunk: int, max_samples: int | None, max_lines: int | None,
                   seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """R4/X1/C1/C2 in the reference's order: chunk every ``chunk`` words ->
    shuffle -> keep ``max_samples`` chunks -> clean whitespace -> drop blank
    -> keep ``max_lines`` lines (counting non-blank lines only)."""
    from corpusprep.functions import text as tx
    ch = docs.select(key, F.posexplode(tx.chunk_words(F.col(text), chunk)).alias("chunk", "_t")) \
        .withColumn("chunk", F.col("chunk").cast("long"))
    ckey = F.concat_ws("-", F.col(key).cast("string"), F.col("chunk").cast("string"))
    ch = ch.withColumn("_h", hash_order(seed, ckey))
    order = ["_h", key, "chunk"]
    if max_samples:
        ch = take_first(ch, max_samples, order)
    lines = ch.withColumn("line", tx.clean_whitespace(F.col("_t"))).filter(F.col("line") != "")
    if max_lines:
        lines = take_first(lines, max_lines, order)
    return lines.select(key, "chunk", "line")


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Append tables (duplicates kept), by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
