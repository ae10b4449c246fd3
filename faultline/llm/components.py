"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import stored


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star round: neighbours of a node meet at the least of them. Minima are aggregates, so a hub never sits in one task."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        e = e.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    e = e.join(low, "u")
    if both:
        out = e.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = e.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its least node.

    Empty edges give an empty table. Self-loops and null ends are dropped. Each round is stored,
    so lineage stays short; only one count a round reaches the driver.
    """
    now = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        now = stored(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == last:
            break
        last = tuple(seen)
    found = now.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return found.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
