"""Retrieval, citation, quality and cost metrics with a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strict_sum


def case_metrics(cases: DataFrame, hits: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """case_id, retrieval_hit, reciprocal_rank, source_precision, citation_hit. cases: case_id, expected; hits: case_id, rank, source_uri."""
    match = F.col("source_uri").contains(F.col("expected"))
    seen = cases.join(hits, "case_id", "left").groupBy("case_id", "expected").agg(
        F.min(F.when(match, F.col("rank"))).alias("first"), F.avg(match.cast("double")).alias("share")
    )
    out = seen.select(
        "case_id", "expected", F.col("first").isNotNull().cast("double").alias("retrieval_hit"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce("share", F.lit(0.0)).alias("source_precision"),
    )
    if citations is None:
        return out.withColumn("citation_hit", F.lit(0.0)).drop("expected")
    cited = out.join(citations.withColumnRenamed("source_uri", "cited"), "case_id", "left")
    keys = ["case_id", "retrieval_hit", "reciprocal_rank", "source_precision"]
    return cited.groupBy(*keys).agg(F.coalesce(F.max(F.col("cited").contains(F.col("expected")).cast("double")), F.lit(0.0)).alias("citation_hit"))


def totals(cases: DataFrame, quality: list[str], tokens: list[str], cost: str) -> DataFrame:
    """Means skip nulls; token counts add up; the cost is null if any case's is."""
    return cases.agg(*[F.avg(c).alias(c) for c in quality], *[F.sum(c).alias(c) for c in tokens], strict_sum(F.col(cost)).alias(cost), F.count(F.lit(1)).alias("case_count"))


class GateMissed(SystemExit):
    """A metric below its gate."""


def passes(value: Column, least: Column) -> Column:
    """Whether a metric reaches its gate; one without a value does not."""
    return F.coalesce(value >= least, F.lit(False))


def gate(value: float, least: float, name: str = "retrieval_hit") -> None:
    if value < least:
        raise GateMissed(f"{name} {value:.4f} is below {least:.4f}")


def normalization_report(df: DataFrame, before: str, after: str, target: float = 0.15) -> DataFrame:
    sums = df.agg(F.coalesce(F.sum(before), F.lit(0)).alias("before_tokens"), F.coalesce(F.sum(after), F.lit(0)).alias("after_tokens"))
    gone = F.col("before_tokens") - F.col("after_tokens")
    share = F.when(F.col("before_tokens") > 0, F.round(gone / F.col("before_tokens"), 9)).otherwise(F.lit(0.0))
    return sums.select("before_tokens", "after_tokens", gone.alias("removed_tokens"), share.alias("reduction_fraction"), F.lit(target).alias("target_fraction"), (share >= target).alias("target_met"))
