"""Article segmentation of an ordered line stream.

article_id = running count of title lines along ``pos``, one column or several
(distributed prefix sum: range partition + per-partition totals + in-partition
scan; positions may repeat, so the lines take the range shuffle). Lines before
the first title form article 0; blank lines are dropped; each article is the
ordered concatenation of its lines, stripped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.operators.order import prefix_sum


def _order(pos: str | Sequence[str]) -> list[str]:
    return [pos] if isinstance(pos, str) else list(pos)


def article_ids(lines: DataFrame, pos: str | Sequence[str] = "pos", text: str = "text",
                num_partitions: int | None = None) -> DataFrame:
    flagged = lines.withColumn("_t", tx.is_title(F.col(text)).cast("long"))
    return prefix_sum(flagged, _order(pos), "_t", out="article_id",
                      num_partitions=num_partitions, unique=False).drop("_t")


def coalesce_articles(lines: DataFrame, pos: str | Sequence[str] = "pos", text: str = "text",
                      num_partitions: int | None = None) -> DataFrame:
    """A4: one row per article (article_id, text). The group is the article
    itself (its lines form the output row)."""
    a = article_ids(lines, pos, text, num_partitions).filter(~tx.is_blank(F.col(text)))
    g = a.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct(*_order(pos), text))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda s: s[text]), "")
    return g.select("article_id", tx.strip(body).alias("text"))
