"""Connected components of an edge table, by alternating star steps.

Every step is a grouped minimum plus a join, its result is written to the
shared folder (so a lost executor costs a re-read), and nothing but one row of
counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import stage


def _stars(pairs: DataFrame, upward: bool) -> DataFrame:
    """Link the neighbours of every node u to the smallest of them and u:
    the larger neighbours (``upward``) or the smaller ones and u itself.

    ``pairs`` has (u, v); a hot node is a grouped minimum with map-side
    combine, then a join that adaptive execution may split."""
    if upward:
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    other = pairs.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return other.unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): one row per node that has a link to
    another; the component is its smallest node.

    Null ends and loops are no links.  Repeated and mirrored links count once.
    Without links the result is empty.  Rounds go on until one changes nothing (the
    stars of all components; about the logarithm of the longest path's length).
    """
    e = (edges.filter("a is not null and b is not null and a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = stage(e, "links")
    state = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = e.agg(*state).first()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _stars(both, upward=True).distinct()
        e = stage(_stars(e, upward=False).distinct(), "links")
        now = e.agg(*state).first()
        if now == seen:
            break
        seen = now
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
