"""Topics of (key, value) records: in Kafka, or as a folder of segments where there is none."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "key string, value string"


class Topic(Protocol):
    def write(self, records: DataFrame, number: int) -> None:
        """Appends records as batch `number`."""

    def stream(self) -> DataFrame:
        """All records from the start and as they come: key, value and, where there is an order, at."""


class FolderTopic:
    """Segments of JSON lines under a folder; a batch written again replaces itself, and one that is not whole is not seen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, records: DataFrame, number: int) -> None:
        rows = records.select("key", "value", F.lit(number).cast("bigint").alias("at"))
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.path}/at-{number:012d}")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(f"{RECORD}, at bigint").option("recursiveFileLookup", "true").json(self.path)


class KafkaTopic:
    """A Kafka topic; needs Spark's Kafka package on the class path. A batch written again appears twice, with the same keys."""

    def __init__(self, spark: SparkSession, servers: str, name: str):
        self.spark, self.servers, self.name = spark, servers, name

    def write(self, records: DataFrame, number: int) -> None:
        records.write.format("kafka").option("kafka.bootstrap.servers", self.servers).option("topic", self.name).save()

    def stream(self) -> DataFrame:
        options = {"kafka.bootstrap.servers": self.servers, "subscribe": self.name, "startingOffsets": "earliest"}
        raw = self.spark.readStream.format("kafka").options(**options).load()
        return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), F.struct("timestamp", "partition", "offset").alias("at"))
