"""A corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

Stages: documents of low quality go; one document of each near-duplicate group stays (the smallest doc_id); documents
that hold a benchmark item go; sources, languages and topics are mixed to target weights; what is left is put into shards,
whole rows with their shard and slot. Stages take null and empty texts, null ids, repeated rows, texts of any length, clashing
names and empty tables as their operators say; rows that repeat both id and text go or stay together in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.decontaminate import decontaminate
from docloom.llm.jaccard import keep_one
from docloom.llm.mixing import mix
from docloom.llm.quality import score_quality
from docloom.llm.sharding import shard_documents
from docloom.session import fresh, new_path, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    good = fresh("good", docs.columns)
    # once=False: the texts would lie on disk a third time, beside the input and this stage's result, until the stage is read
    return score_quality(docs, table(spark, sf_dir, "labels"), once=False).where(good).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = fresh("kept", docs.columns)
    return mix(docs, fraction=0.5).where(kept).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs, 40, keep=True)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("mixing_to_target_weights", mixing),
    ("sharding", sharding),
]
#: The stages need hashes and a fitted model that SQL does not have; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's own tables are deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
