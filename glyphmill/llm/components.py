"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is joins and aggregates; links stay in tables of the shared checkpoint folder and never meet in the driver. A node
with a third of all links is no group of its own: its minimum is a partial aggregate, and the join that follows has a single
row per node on one side, so skewed nodes can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b) after one star operation: neighbours are tied to the smallest neighbour of a node."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node reachable."""
    now = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        now = saved(_star(_star(now, True), False), "links")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
