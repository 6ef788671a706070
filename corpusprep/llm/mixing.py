"""Operator 2: mix sources to target weights by capped water-filling.

Every source gets its weight's share of the total, clamped at a maximum number
of epochs; the excess is dealt out again by weight among the sources that are
not clamped, until none is above its cap. A source then takes whole repetitions
of all its documents, and for the remaining fraction the first documents of a
seeded order, the last one of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.llm.common import small, table, text_key
from corpusprep.operators.order import global_rank

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
# The boundary document of a source is found by descending through the seeded
# order 4,096 ways at a time, so no source's order is ever put into one task.
LEVEL_BITS = 12
LEVELS = 2
HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Number of words (white space: 0x20 and 0x09-0x0D); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, key: Column) -> Column:
    """60-bit position of a key in the seeded order."""
    k = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(k), 1, 15), 16, 10).cast("bigint")


def water_level(caps: DataFrame, total: int) -> float:
    """The level at which ``sum(least(cap, level * weight))`` is ``total`` (or
    infinity when all sources are clamped). Each round is one aggregate over
    the sources; the set of clamped sources only grows."""
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        r = caps.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("used"),
                     F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
                     F.count(F.when(full, 1)).alias("n")).first()
        if r["n"] == clamped:
            return level
        if not r["open"]:
            return float("inf")
        clamped, level = r["n"], float(total - r["used"]) / float(r["open"])


def targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
            share: float = 1.0) -> tuple[DataFrame, int]:
    """Per source (code point order, null last, weights repeating): ``sid,
    source, source_size, target``, and the number of sources."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = global_rank(src, [F.col("source").isNull(), "source"], "sid")
    w = F.array(*[F.lit(int(x)) for x in weights])
    caps = table(src.withColumn("weight", F.get(w, ((F.col("sid") - 1) % len(weights)).cast("int")))
                 .withColumn("cap", F.col("source_size") * F.lit(max_epochs)), "sources")
    t = caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    level = water_level(caps, int(t["t"] * share))
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return caps.withColumn("target", target).select("sid", "source", "source_size", "target"), t["n"]


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        split_last: bool = True) -> DataFrame:
    """Per document: ``key, size, source_size, target, taken`` (words that the
    mix takes, repeats counted).

    With ``split_last`` the last document of a source's fraction is taken in
    part, so a source's taken words are its target, rounded; without, it is
    taken whole or not at all, whichever is nearer. Sources and keys may be
    null; null and empty texts have size 0 and are taken 0 words; repeated
    rows are documents of their own; an empty table gives an empty result.
    Only ``key``, size, source and the order are shuffled, never the text."""
    sized = table(docs.select(F.col(key).alias("doc"), F.col(source).alias("source"),
                              word_count(F.col(text)).alias("size"),
                              seeded(seed, F.col(key)).alias("h")), "sized")
    out = taken(sized, weights, max_epochs, split_last)
    return out.select(F.col("doc").alias(key), "size", "source_size", "target", "taken")


def taken(sized: DataFrame, weights, max_epochs: int, split_last: bool) -> DataFrame:
    """``sized(doc, source, size, h)``, a row per document, with the words that
    the mix takes of each in the order (h, doc, size); ``doc`` may be any row
    identity."""
    src, n = targets(sized, weights, max_epochs)
    src = src.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    src = src.withColumn("budget", F.floor(
        F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    d = sized.join(small(src.withColumnRenamed("source", "s"), n), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    # descend to the bucket of the order in which a source's budget ends
    edge = None     # sid, prefix (of the bucket), base (words before it)
    for lv in range(1, LEVELS + 1):
        shift = HASH_BITS - LEVEL_BITS * lv
        inner = d.withColumn("bucket", F.shiftright("h", shift))
        if edge is not None:
            up = small(edge.select("sid", "prefix", F.col("base").alias("b0")), n)
            inner = inner.join(up, "sid").filter(F.shiftright("bucket", LEVEL_BITS) == F.col("prefix"))
        else:
            inner = inner.withColumn("b0", F.lit(0).cast("long"))
        sums = inner.groupBy("sid", "bucket", "budget", "b0").agg(F.sum("size").alias("s"))
        order = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("end", F.col("b0") + F.sum("s").over(order))
        # first bucket that reaches the budget; a budget of 0 ends before all
        edge = table(run.filter(F.col("end") >= F.col("budget")).groupBy("sid")
                     .agg(F.min_by(F.struct("bucket", (F.col("end") - F.col("s")).alias("base")), "bucket").alias("e"))
                     .select("sid", F.col("e.bucket").alias("prefix"), F.col("e.base").alias("base")), f"edge{lv}")
    shift = HASH_BITS - LEVEL_BITS * LEVELS
    d = d.join(small(edge, n), "sid", "left").withColumn("b", F.shiftright("h", shift))
    before = F.col("b") < F.col("prefix")
    at = F.col("b") == F.col("prefix")
    last = d.filter(at)
    order = Window.partitionBy("sid").orderBy("h", "doc", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("left", F.col("budget") - (F.col("base") + F.sum("size").over(order) - F.col("size")))
    part = (F.least(F.greatest("left", F.lit(0)), "size") if split_last
            else F.when((F.col("left") > 0) & (2 * F.col("left") >= F.col("size")), F.col("size")).otherwise(0))
    rest = d.filter(F.coalesce(~at, F.lit(True))).withColumn(
        "part", F.when(before, F.col("size")).otherwise(F.lit(0)))
    cols = ["doc", "size", "source_size", "target", "whole", "part"]
    out = rest.select(cols).unionByName(last.withColumn("part", part).select(cols))
    return out.select("doc", "size", "source_size", "target",
                      (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def repeat(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as many times as it is taken (whole
    documents only; documents without words are left out, the mix takes
    nothing of them). All columns of ``docs`` are kept.

    Each row is a document of its own, also where its key is null or repeated:
    the table is written with a row number that decisions are joined back on.
    The seeded order goes by key and text, so rows that share a key are dealt
    over it; only rows alike in both may change places, and reruns agree. An
    empty table gives an empty result."""
    row = "_mix_row"
    d = table(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    order = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), F.hex(text_key(F.col(text))))
    sized = table(d.select(F.col(row).alias("doc"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                           seeded(seed, order).alias("h")), "sized")
    reps = (taken(sized, weights, max_epochs, split_last=False).filter(F.col("taken") > 0)
            .select(F.col("doc").alias(row), (F.col("taken") / F.col("size")).cast("int").alias("_mix_reps")))
    return (d.join(reps, row).withColumn("_mix_i", F.explode(F.sequence(F.lit(1), F.col("_mix_reps"))))
            .select(*docs.columns))


_S = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def oracle(table_name: str = "documents", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL of ``mix(..., split_last=True)``."""
    cases = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return f"""
with d as (select doc_id, source, cast({_S} as bigint) as size,
    cast('0x' || substr(md5('{seed}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as h
  from {table_name}),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by encode(source) nulls last) - 1) % {len(weights)} {cases} end as weight,
    source_size * {max_epochs} as cap from s),
o as (select *, row_number() over r as k, cast(sum(cap) over r as bigint) as used,
    cast(sum(weight) over () - sum(weight) over r as bigint) as open,
    cast(sum(source_size) over () as bigint) as total
  from w window r as (order by cast(cap as double) / weight, source rows between unbounded preceding and current row)),
l as (select 0 as k, cast(max(total) as double) / sum(weight) as level from o
  union all select k, cast(total - used as double) / open from o where open > 0),
f as (select min(level) as level from l where (select count(*) from w where cap <= l.level * weight) = l.k),
t as (select source, source_size, least(cast(cap as double), (select level from f) * weight) as target from w),
b as (select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) as whole from t),
g as (select *, cast(floor(target - whole * source_size + 0.5) as bigint) as budget from b),
r as (select d.doc_id, d.size, g.source_size, g.target, g.whole, g.budget,
    cast(sum(d.size) over (partition by g.source order by d.h, d.doc_id, d.size
      rows between unbounded preceding and current row) as bigint) - d.size as before
  from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  cast(whole * size + least(greatest(budget - before, 0), size) as bigint) as taken from r"""
