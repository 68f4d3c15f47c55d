"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, component), written: every node that has a link to another node, with the smallest node it can reach.
    `edges` has columns a and b (long). Loops, repeats and nulls add nothing; no links give an empty table. Each step
    is written out, so nothing depends on a lost executor, and no node's links are gathered. RuntimeError if `most`
    steps do not finish."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = written(e, "links"), None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        moved = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = moved.select("u", F.col("m").alias("v")).unionByName(moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = written(small.distinct(), "links", e)
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row[0] == 0 or tuple(row) == before:
            break
        before = tuple(row)
    else:
        raise RuntimeError(f"components are not settled after {most} steps")
    both = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return written(both.distinct(), "components", e)
