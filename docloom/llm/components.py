"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import store


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node but the smallest of each component.

    edges: a, b (bigint). Each step is a grouped minimum and a join on it; links stay in tables and never
    reach the driver. Loops and repeated edges are harmless; no edges give no rows.
    """
    def oriented(x: DataFrame) -> DataFrame:
        return x.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    current = store(oriented(edges), "edges")
    state = _state(current)
    while state[0]:
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = oriented(large)
        low = current.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = current.join(low, current["a"] == low["u"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        current = store(oriented(small), "edges")
        now = _state(current)
        if now == state:
            break
        state = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
