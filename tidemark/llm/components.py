"""Connected components of a links table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over links (a, b) with a > b; returns such links again."""
    if not large:  # what the large round gives is read twice
        edges = staged(edges, "links")
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        ends = ends.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = staged(ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    # both sides are read from files and shuffled alike, so that a node of many links can be split
    met = ends.join(least, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.filter(F.col("a") > F.col("b"))
    return out if large else staged(out.distinct(), "links")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for each node of a link: component is the smallest node reachable.

    links needs two long columns; loops, repeated and null links do no harm.
    Ends when a round changes nothing, in about log^2 rounds of the number of nodes.
    """
    pairs = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).filter("x <> y")
    edges = staged(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        edges = _stars(_stars(edges, True), False)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    ends = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)
