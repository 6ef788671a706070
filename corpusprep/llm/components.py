"""Connected components by hooking, pointer jumping and contraction of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import drop_path, scratch_path


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(u, v)``: the smallest node that
    can be reached.

    In a round each node hooks onto its smallest smaller neighbour, pointer
    jumping takes it to the root of the tree that this makes, and the edges are
    replaced by those between the roots: equal ones once, loops dropped. So the
    edges of a round are joined twice and shrink from round to round (a group
    whose edges all lead to few nodes is a few edges after the first), and
    rounds and jumps grow with the logarithm of a component's size. Every table
    of a round stands in the shared folder. Hub nodes meet partial aggregation
    and joins against unique keys only."""
    spark = edges.sparkSession

    def put(df):
        path = scratch_path(spark, "cc")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def tidy(df):
        """Each pair of different nodes once, the larger one first."""
        return (df.filter(F.col("u") != F.col("v"))
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    live, path = put(tidy(edges.select("u", "v")))
    rounds = []
    while live.limit(1).count():
        up, up_path = put(live.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")))
        while True:
            over = up.select(F.col("node").alias("label"), F.col("label").alias("over"))
            new, new_path = put(up.join(over, "label", "left").select(
                "node", F.coalesce("over", "label").alias("label"), F.col("over").isNotNull().alias("moved")))
            moved = new.filter("moved").limit(1).count()
            drop_path(spark, up_path)
            up, up_path = new.select("node", "label"), new_path
            if not moved:
                break
        rounds.append(up)
        left = up.select(F.col("node").alias("u"), F.col("label").alias("ru"))
        right = up.select(F.col("node").alias("v"), F.col("label").alias("rv"))
        new, new_path = put(tidy(live.join(left, "u").join(right, "v", "left").select(
            F.col("ru").alias("u"), F.coalesce("rv", "v").alias("v"))))
        drop_path(spark, path)
        live, path = new, new_path
    if not rounds:
        node = live.select(F.col("u").alias("node"))
        return node.withColumn("label", F.col("node"))
    # roots of one round are nodes of the next
    all_of = rounds[0]
    for up in rounds[1:]:
        last = up.select(F.col("node").alias("label"), F.col("label").alias("last"))
        all_of = (all_of.join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
                  .unionByName(up))
    all_of, _ = put(all_of)
    roots = all_of.select(F.col("label").alias("node")).distinct().withColumn("label", F.col("node"))
    return all_of.unionByName(roots)
