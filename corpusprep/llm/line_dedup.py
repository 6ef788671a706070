"""Operator 4: remove lines that stand on many sites (DataFrame operations only).

A line's spread is the number of distinct sites (sources) that carry it.
HyperLogLog sketches of the sites, one per line hash, merge by aggregation, so
a line that stands in a third of all rows is one small sketch per task before
the shuffle. Only lines whose estimate is near the threshold get an exact
distinct count; the sketch decides the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import table, text_key

MIN_SITES = 5
LG_K = 12
# Estimates between threshold / BAND and threshold * BAND are counted exactly:
# far beyond the sketch's error (1.04 / sqrt(2**LG_K), under 2 %).
BAND = 2.0
# Exact copies of a text are dealt to this many join keys.
SALTS = 64


def normal(line: Column) -> Column:
    """What two lines are compared by: outer white space does not count."""
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def line_hash(line: Column) -> Column:
    """128-bit key of a normalised line in hex; blank lines have none."""
    n = normal(line)
    return F.when(n != "", F.md5(n))


def spread_lines(docs: DataFrame, text: str = "text", site: str = "source",
                 min_sites: int = MIN_SITES) -> DataFrame:
    """(line): hashes of the lines on ``min_sites`` distinct sites or more. A
    null site is a site of its own."""
    # distinct strings are found by hashing, distinct byte arrays by comparing all
    hashes = F.array_distinct(F.transform(F.split(F.col(text), "\n"), line_hash))
    lines = (docs.select(F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("site"),
                         F.explode(hashes).alias("line")).filter(F.col("line").isNotNull())
             .withColumn("line", F.unhex("line")))
    est = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    est = table(est.filter(F.col("sites") >= min_sites / BAND), "line-sites")
    sure = est.filter(F.col("sites") > min_sites * BAND).select("line")
    near = est.filter(F.col("sites") <= min_sites * BAND).select("line")
    exact = (lines.groupBy("line", "site").agg(F.count(F.lit(1)).alias("n"))
             .join(near, "line", "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
             .filter(F.col("sites") >= min_sites).select("line"))
    return table(sure.unionByName(exact), "spread-lines")


def copied_texts(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(text_key): texts that stand whole on ``min_sites`` distinct sites or
    more. Their copies alone make their lines spread."""
    site = F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n"))
    return (docs.filter(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("text_key"), site.alias("site"))
            .groupBy("text_key", "site").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("text_key").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select("text_key"))


def remove_spread_lines(docs: DataFrame, text: str = "text", site: str = "source",
                        min_sites: int = MIN_SITES, prefix: str = "_ld_") -> DataFrame:
    """All rows and columns of ``docs`` with the spread lines taken out of
    ``text``, plus ``<prefix>lines`` (lines of the text) and ``<prefix>removed``.

    Spread lines go from every document, however much of it they are; only a
    text that itself stands whole on ``min_sites`` sites stays as it is: it is a
    copied document, which document-level dedup handles. A null text stays null
    with 0 lines; an empty text has one line; blank lines are never spread;
    repeated rows are treated alike; an empty table gives an empty result. Work
    is linear in a text's lines. The text is shuffled once, for the join with
    the lines to remove, on the text's key and a salt of the row, so copies of
    one text spread."""
    spread = spread_lines(docs, text, site, min_sites)
    key, salt, pos, cut = (prefix + n for n in ("key", "salt", "pos", "cut"))
    lines = F.split(F.col(text), "\n")
    plain = [f.name for f in docs.schema.fields if f.name != text and not f.dataType.simpleString().startswith(("map", "variant"))]
    keyed = docs.withColumn(key, text_key(F.col(text))).withColumn(salt, F.pmod(F.xxhash64(F.lit(4), *plain), F.lit(SALTS)).cast("int"))
    hit = (keyed.filter(F.col(text).isNotNull())
           .select(key, salt, F.posexplode(F.transform(lines, line_hash)).alias(pos, "line"))
           .filter(F.col("line").isNotNull()).withColumn("line", F.unhex("line"))
           .join(spread, "line", "left_semi")
           .groupBy(key, salt).agg(F.sort_array(F.collect_set(pos)).alias("at"))
           .join(copied_texts(docs, text, site, min_sites).withColumnRenamed("text_key", key), key, "left_anti"))
    # one flag a line up to the last to go: gaps between positions filled with false
    gap = lambda x, i: x - F.coalesce(F.get("at", i - 1), F.lit(-1)) - 1
    flags = F.flatten(F.transform("at", lambda x, i: F.concat(F.array_repeat(F.lit(False), gap(x, i)), F.array(F.lit(True)))))
    hit = hit.select(key, salt, flags.alias(cut), F.size("at").alias("n"))
    full = keyed.join(hit, [key, salt], "left")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col(cut), i), F.lit(False))), "\n")
    out = [F.when(F.col(cut).isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c)
           for c in docs.columns]
    return full.select(*out, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(prefix + "lines"),
                       F.coalesce(F.col("n"), F.lit(0)).cast("long").alias(prefix + "removed"))


def oracle(table_name: str = "documents", min_sites: int = MIN_SITES,
           columns: str = "doc_id, text, n_lines, n_removed") -> str:
    """DuckDB SQL of ``remove_spread_lines`` with the columns of op4."""
    norm = r"trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
    return f"""
with d as (select *, row_number() over () as rid, string_split(text, chr(10)) as ls from {table_name}),
c as (select text from d where text is not null group by text having count(distinct coalesce('s' || source, 'n')) >= {min_sites}),
e as (select rid, coalesce('s' || source, 'n') as site, unnest(ls) as x, unnest(range(len(ls))) as pos from d),
n as (select rid, site, pos, x, {norm} as v from e),
b as (select v from n where v <> '' group by v having count(distinct site) >= {min_sites}),
m as (select rid, pos, x, v in (select v from b) as cut from n),
g as (select rid, count(*) filter (cut) as removed, coalesce(string_agg(x, chr(10) order by pos) filter (not cut), '') as rest
  from m group by rid),
r as (select d.* exclude (text, rid, ls), case when g.removed > 0 and c.text is null then g.rest else d.text end as text,
    cast(coalesce(len(ls), 0) as bigint) as n_lines,
    cast(case when c.text is null then coalesce(g.removed, 0) else 0 end as bigint) as n_removed
  from d left join g using (rid) left join c on c.text = d.text)
select {columns} from r"""
