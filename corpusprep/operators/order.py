"""Deterministic order on a distributed engine.

The reference relies on list order and on seeded random shuffles. Spark has no
physical order, so every operator here takes explicit order columns, and random
shuffles become a *hash order* ``md5(seed || ':' || key)`` tie-broken by the key.

``global_rank`` and ``prefix_sum`` never use an un-partitioned window (which
would move every row into one task). They range-partition on the order,
sort inside partitions, materialise that in the shared checkpoint folder (so
partition borders stay fixed between passes and survive executor loss), add
per-partition bases computed from P small totals, and finish inside each
partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.session import broadcast_if, reliable_checkpoint

HASH_DIGITS = 15
HASH_SPAN = 16 ** HASH_DIGITS

_IDX_BITS = 33  # monotonically_increasing_id: partition index << 33 | row index
_IDX_MASK = (1 << _IDX_BITS) - 1


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def hash_int(x: Column) -> Column:
    """First 15 hex digits of md5(x) as a bigint: 60 bits, so a draw reaches
    every row of any table (same value as DuckDB's
    ``cast('0x'||substr(md5(x),1,15) as bigint)``)."""
    return F.conv(F.substring(F.md5(x.cast("string")), 1, HASH_DIGITS), 16, 10).cast("bigint")


def hash_order(seed: int | str, key: Column | str) -> Column:
    """Seeded shuffle key of ``key``: h(seed || ':' || key)."""
    k = F.col(key) if isinstance(key, str) else key
    return hash_int(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def shuffle(df: DataFrame, key: str, seed: int, out: str = "shuffle_key") -> DataFrame:
    """Seeded shuffle as a distributed sort by (hash, key)."""
    return df.withColumn(out, hash_order(seed, key)).orderBy(out, key)


# Rows that a top-k may gather in its last task; more are cut by a threshold key.
TOP_ROWS = 100_000


def take_first(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """The first ``n`` rows in ``order`` (unique keys; 0/None: all). A
    small ``n`` is a top-k; a large one filters by the key at position ``n``, so
    no task gathers ``n`` rows."""
    if n is None or n <= 0:
        return df
    if n <= TOP_ROWS:
        return df.orderBy(*_cols(order)).limit(int(n))
    edge = keys_at(df, [n], order)
    return df.filter(order_key(order) <= edge[int(n)]) if edge else df


def _keyed(df: DataFrame, order: Sequence, extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """(payload, keys, names): order expressions become columns; ``keys`` holds
    them and ``extra`` only, so a rank never moves the other columns."""
    names = []
    for i, c in enumerate(order):
        if isinstance(c, str):
            names.append(c)
        else:
            df = df.withColumn(f"_key{i}", c)
            names.append(f"_key{i}")
    return df, df.select(*dict.fromkeys([*extra, *names])), names


# Keys and ranks of so many rows are sent to where the other columns are, which
# then take no shuffle (keys of fixed width: some 10 MB).
ATTACH_ROWS = 200_000


def _attach(df: DataFrame, ranked: DataFrame, names: Sequence[str], out: str, columns: Sequence[str],
            unique: bool, rows: int) -> DataFrame:
    """Put ``out`` beside the other columns: nothing to do when the keys are all
    there is, else a join on the (unique) keys, null-safe; a broadcast one for up
    to ``ATTACH_ROWS`` rows."""
    if not unique or set(df.columns) <= set(ranked.columns):
        return ranked.select(*columns, out)
    r = ranked.select(*[F.col(n).alias(f"_r_{n}") for n in names], out)
    cond = None
    for n in names:
        c = F.col(n).eqNullSafe(F.col(f"_r_{n}"))
        cond = c if cond is None else cond & c
    if all(isinstance(df.schema[n].dataType, T.NumericType | T.DatetimeType | T.BooleanType) for n in names):
        r = broadcast_if(r, rows, ATTACH_ROWS)
    return df.join(r, cond).select(*columns, out)


def _ranged(df: DataFrame, order: Sequence, num_partitions: int | None) -> DataFrame:
    """Range-partition and sort on ``order`` and stamp the physical position;
    materialised so the borders are fixed for the follow-up passes."""
    spark = df.sparkSession
    n = int(num_partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    oc = _cols(order)
    r = (df.repartitionByRange(n, *oc).sortWithinPartitions(*oc)
         .withColumn("_mid", F.monotonically_increasing_id()))
    r = reliable_checkpoint(r)
    return r.withColumn("_pid", F.shiftrightunsigned("_mid", _IDX_BITS).cast("int"))


def ranged(df: DataFrame, order: Sequence, num_partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned, sorted and materialised, with ``_pid`` (the
    physical partition) and ``_mid`` (the position)."""
    return _ranged(df, order, num_partitions)


def _partition_bases(r: DataFrame, value: Column | None) -> tuple[dict[int, tuple[int, int]], int]:
    """Rows and sum of ``value`` before each partition (bounded by the partition
    count, not by the data), and the number of all rows."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if value is not None:
        aggs.append(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("s"))
    out, acc_n, acc_s = {}, 0, 0
    for row in sorted(r.groupBy("_pid").agg(*aggs).collect(), key=lambda x: x["_pid"]):
        out[row["_pid"]] = (acc_n, acc_s)
        acc_n += row["n"]
        acc_s += row["s"] if value is not None else 0
    return out, acc_n


def global_rank(df: DataFrame, order: Sequence, out: str = "rank",
                num_partitions: int | None = None, unique: bool = True) -> DataFrame:
    """1-based dense position of each row in ``order``.

    Only the order columns are range-partitioned, sorted and materialised; the
    in-partition index comes from ``monotonically_increasing_id`` taken after
    the sort, and the other columns are joined on the keys, which must be unique
    (``unique=False``: rows may repeat, and all columns take the range shuffle)."""
    columns = df.columns
    df, keys, names = _keyed(df, order)
    r = _ranged(keys if unique else df, [F.col(n) for n in names], num_partitions)
    before, rows = _partition_bases(r, None)
    bases = r.sparkSession.createDataFrame([(p, n) for p, (n, _) in before.items()], "_pid int, _base_n long")
    ranked = r.join(broadcast_if(bases, len(before)), "_pid").withColumn(
        out, F.col("_base_n") + F.col("_mid").bitwiseAND(_IDX_MASK) + 1)
    return _attach(df, ranked, names, out, columns, unique, rows)


def prefix_sum(df: DataFrame, order: Sequence, value: str, out: str = "cum",
               inclusive: bool = True, num_partitions: int | None = None, unique: bool = True) -> DataFrame:
    """Running sum of ``value`` along ``order`` (two-phase, distributed; order
    keys must be unique, or ``unique=False``: all columns take the range shuffle).

    Only the order columns and ``value`` are range-partitioned. Phase 1:
    per-partition totals (P numbers). Phase 2: an Arrow pass inside each
    partition adds the running sum to the partition's base; the other columns
    are joined on the keys."""
    columns = df.columns
    df, keys, names = _keyed(df, order, [value])
    r = _ranged(keys if unique else df, [F.col(n) for n in names], num_partitions)
    before, rows = _partition_bases(r, F.col(value))
    bases = {p: s for p, (_, s) in before.items()}
    schema = T.StructType(list(r.schema.fields) + [T.StructField(out, T.LongType(), False)])
    vi = r.columns.index(value)
    pi = r.columns.index("_pid")

    def scan(batches):
        carry = None
        for b in batches:
            if carry is None and b.num_rows:
                carry = int(bases.get(b.column(pi)[0].as_py(), 0))
            v = b.column(vi).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cs = np.cumsum(v) + (carry or 0)
            if b.num_rows:
                carry = int(cs[-1])
            col = cs if inclusive else cs - v
            yield pa.RecordBatch.from_arrays(
                list(b.columns) + [pa.array(col, pa.int64())],
                schema=b.schema.append(pa.field(out, pa.int64(), nullable=False)))

    return _attach(df, r.mapInArrow(scan, schema), names, out, columns, unique, rows)


def rank_within(df: DataFrame, group: str, order: Sequence, out: str = "rank",
                num_partitions: int | None = None, unique: bool = True) -> DataFrame:
    """Position inside ``group``, without a per-group window and without a join
    on ``group``: a group with any share of the rows spreads over as many tasks
    as its range needs.

    The rows are ranked by (group, order). Where a group starts follows from a
    few numbers per partition (first and last group, where the last one
    starts); an Arrow pass subtracts it. ``unique`` as in ``prefix_sum``."""
    columns = df.columns
    df, keys, names = _keyed(df, order, [group])
    r = _ranged(keys if unique else df, [F.col(group), *[F.col(n) for n in names]], num_partitions)
    ends = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(group), "_mid").alias("first"),
                                 F.max_by(F.struct(group), "_mid").alias("last"))
    ends = reliable_checkpoint(ends)
    start = (r.join(broadcast_if(ends.select("_pid", F.col(f"last.{group}").alias("_last")), ends.count()), "_pid")
             .filter(F.col(group).eqNullSafe(F.col("_last"))).groupBy("_pid").agg(F.min("_mid").alias("m")).collect())
    start = {x["_pid"]: x["m"] & _IDX_MASK for x in start}
    info, seen, open_group, open_at = {}, 0, None, 0
    for x in sorted(ends.collect(), key=lambda x: x["_pid"]):
        p, first, last = x["_pid"], x["first"], x["last"]
        at = open_at if seen and first == open_group else seen     # rows before the first group's first row
        info[p] = (seen, at)
        open_at = at if first == last else seen + start[p]
        open_group, seen = last, seen + x["n"]
    schema = T.StructType(list(r.schema.fields) + [T.StructField(out, T.LongType(), False)])
    gi, pi = r.columns.index(group), r.columns.index("_pid")

    def scan(batches):
        done, begin, last = None, 0, None
        for b in batches:
            n = b.num_rows
            col = b.column(gi)
            rank = np.zeros(n, np.int64)
            if n:
                if done is None:
                    done, begin = info[b.column(pi)[0].as_py()]
                    last = col.slice(0, 1)
                # a new group where the value differs from the row before (null is a value)
                ids = pa.chunked_array([last, col]).combine_chunks().dictionary_encode().indices.fill_null(-1)
                new = np.flatnonzero(np.diff(ids.to_numpy(zero_copy_only=False)))
                pos = done + np.arange(n)
                begins = np.full(n, begin)
                if len(new):
                    begins = np.where(np.arange(n) >= new[0], pos[new][np.searchsorted(new, np.arange(n), "right") - 1], begin)
                rank = pos - begins + 1
                done, begin, last = done + n, int(begins[-1]), col.slice(n - 1, 1)
            yield pa.RecordBatch.from_arrays(
                list(b.columns) + [pa.array(rank, pa.int64())],
                schema=b.schema.append(pa.field(out, pa.int64(), nullable=False)))

    ranked = r.mapInArrow(scan, schema)
    return _attach(df, ranked, list(dict.fromkeys([group, *names])), out, columns, unique, seen)


def keys_at(df: DataFrame, positions: Sequence[int], order: Sequence, num_partitions: int | None = None):
    """The order keys at some 1-based positions, as {position: struct literal}
    (positions past the end are absent). Only the order columns are ranked, and
    only these few rows come back."""
    _, keys, names = _keyed(df, order)
    hits = (global_rank(keys, names, "_pos", num_partitions)
            .filter(F.col("_pos").isin([int(p) for p in positions])).collect())
    kinds = {f.name: f.dataType for f in keys.schema.fields}
    return {h["_pos"]: F.struct(*[F.lit(h[n]).cast(kinds[n]).alias(n) for n in names]) for h in hits}


def order_key(order: Sequence) -> Column:
    """The order columns as one comparable struct (null first, as in ascending order)."""
    return F.struct(*[(F.col(c).alias(c) if isinstance(c, str) else c.alias(f"_key{i}")) for i, c in enumerate(order)])


def skip(df: DataFrame, n: int, order: Sequence, num_partitions: int | None = None) -> DataFrame:
    """Drop the first ``n`` rows in ``order`` (unique keys): the key at
    position ``n`` is found first, the rest is a filter over the table, which is
    neither shuffled nor sorted."""
    if not n:
        return df
    edge = keys_at(df, [n], order, num_partitions)
    return df.filter(order_key(order) > edge[int(n)]) if edge else df.limit(0)


def order_by_file(df: DataFrame, order: Sequence = (), out: str = "position") -> DataFrame:
    """O2: position of each row when shard files are read in the order of their
    full path (and rows within a file by ``order``)."""
    f = df.withColumn("_file", F.col("_metadata.file_path"))
    return global_rank(f, ["_file", *order], out, unique=bool(order)).drop("_file")
