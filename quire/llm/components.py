"""Connected components by alternating stars, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import joined, materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges (a, b, longs) the smallest node that it reaches.

    Each node's neighbours go to the smallest of them, first the larger ones, then the smaller; only minima are
    gathered by node, so a node with many neighbours is never in one place. Rounds end when nothing changes.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = joined(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = joined(large, low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = materialize(small.select("e.a", "e.b").where("a <> b").distinct())
        release(edges)
        edges, before, state = new, state, _state(new)
        if state == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
