"""Chunk lineage and the index: each operation gives the next version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(prior: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, chunk_id, action (delete, carry or insert), version: one full outer join of (doc_id, chunk_id[, version]) tables.

    Only documents of `new` are touched; their version is one over the highest live one. A document whose new row
    has a null chunk_id has no chunks left.
    """
    touched = new.select("doc_id").distinct()
    live = prior.join(touched, "doc_id", "left_semi")
    top = live.groupBy("doc_id").agg(F.max("version").alias("top"))
    old = live.select("doc_id", "chunk_id").distinct().withColumn("old", F.lit(True))
    now = new.where("chunk_id IS NOT NULL").select("doc_id", "chunk_id").distinct().withColumn("new", F.lit(True))
    both = old.join(now, ["doc_id", "chunk_id"], "full_outer").join(top, "doc_id", "left")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").otherwise("carry")
    return both.select("doc_id", "chunk_id", action.alias("action"), (F.coalesce("top", F.lit(0)) + 1).cast("bigint").alias("version"))


def apply(prior: DataFrame, changes: DataFrame) -> DataFrame:
    kept = prior.join(changes.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "chunk_id", "version")
    return kept.unionByName(changes.where("action <> 'delete'").select("doc_id", "chunk_id", "version"))


def stale(changes: DataFrame) -> DataFrame:
    """doc_id, chunk_ids: the chunks that each document no longer has, in order; documents without any have no row."""
    return changes.where("action = 'delete'").groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def tombstone(prior: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry without the documents, and the chunk ids to purge."""
    return prior.join(doc_ids, "doc_id", "left_anti"), prior.join(doc_ids, "doc_id", "left_semi").select("doc_id", "chunk_id")


def upsert(index: DataFrame, points: DataFrame, key: str = "point_id") -> DataFrame:
    return index.join(points.select(key), key, "left_anti").unionByName(points)


def purge(index: DataFrame, stale: DataFrame, key: str = "chunk_id") -> DataFrame:
    return index.join(stale.select(key), key, "left_anti")


def dim_guard(points: DataFrame, dim: int = 384, vector: str = "vector") -> DataFrame:
    """Adds dropped (a reason, or null): vectors of another length do not enter the index."""
    n = F.size(vector)
    return points.withColumn("dropped", F.when(n != dim, F.format_string(f"dense vector has %d dimensions, {dim} expected", n)))
