"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospark.session import cut_lineage


def _least(edges: DataFrame, both: bool) -> DataFrame:
    """(u, m): the smallest of u and its neighbours; `both` counts neighbours on either side, else smaller ones."""
    rows = edges.select("u", "v")
    if both:
        rows = rows.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return rows.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours of the smallest one."""
    least = _least(edges, both=True)
    # An edge (u, v) has v < u, so u is the larger neighbour of v.
    return edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of these."""
    least = _least(edges, both=False)
    rows = edges.join(least, "u")
    return rows.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for all nodes of `edges` (columns a, b), the smallest node that can be reached.

    Nodes are longs. Null ends and loops are left out. Each round is a table in the shared folder; their number grows
    with the logarithm of the longest path, and an empty edge table needs one.
    """
    rows = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND u <> v")
    now, before = cut_lineage(rows.distinct()), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        now = cut_lineage(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
