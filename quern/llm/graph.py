"""Connected components of an edge table, distributed and without driver-side links.

Alternating large-star and small-star steps: each node hooks its larger, then
its smaller neighbours onto its smallest known neighbour.  Each step is one
aggregation and one join whose skewed keys Spark splits; the number of rounds is
logarithmic in the longest chain.  Each round is written to the shared folder.
It ends when the edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges(a, b)``; the component is its smallest node."""
    now = C.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: larger neighbours of u hook onto the smallest of u and its neighbours
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, hook onto the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = C.written(small, "edges")
        C.forget(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node hooks onto one node that hooks onto none; each star is then a component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return not ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 OR (ups = 1 AND low = 0)").limit(1).count()
