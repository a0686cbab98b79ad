"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v: nodes re-link to the smallest neighbour (large: only larger ones do)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of a link: the smallest node that it reaches, itself included.

    ``edges`` has columns u and v of one orderable type. Loops, repeated and reversed links are allowed; rows with nulls
    are ignored. No links in, no rows out. Each round is a written table; the driver sees counts only. Rounds grow with
    the logarithm of the longest chain.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "links")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).alias("mark")
    before, seen = None, now.agg(mark).first()
    while seen != before:
        now = written(_star(_star(now, large=True), large=False), "links")
        before, seen = seen, now.agg(mark).first()
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
