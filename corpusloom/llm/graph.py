"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b bigint): root is the least vertex that v reaches.

    Each step is a few shuffles of the edges, the minima pre-aggregated; a vertex with very many neighbours is
    never collected into one row. Loops and repeated edges are fine; an empty table gives an empty result.
    """
    big = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    e = cut(edges.where("a <> b").select(*big).distinct())
    before = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("w")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = cut(small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        before = now
