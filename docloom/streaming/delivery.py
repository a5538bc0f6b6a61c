"""What was sent and what was not: counts of a batch's records as its sink took them, kept as a table."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from docloom.sources.tables import Keyed, Tables

COUNTS = "batch string, sent bigint, undelivered bigint, reason string"
METRICS = "delivery"


class Deliveries:
    """Counts by batch under a folder. Sent are records whose write went through as a whole, undelivered those of a write that failed: a sink that
    writes part of a batch before it fails is given the batch again by its caller, so its records count as undelivered until then."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.tables = Tables(spark, path, {"counts": Keyed(COUNTS, "batch")})
        self._turn = threading.Lock()

    def note(self, batch: str | int, sent: int, undelivered: int, reason: str | None) -> None:
        row = self.spark.createDataFrame([(str(batch), sent, undelivered, reason)], COUNTS)
        with self._turn:
            self.tables.commit(f"{batch}", {"counts": (row, None)})

    def send(self, records: DataFrame, batch: str | int, write: Callable[[DataFrame], None]) -> int:
        """Writes a batch's records by `write` and returns how many were sent, as they were counted on their way; a failure is noted and raised.

        Records are counted by the write itself. Only where it fails are they counted again, for what was not delivered."""
        seen = Observation()
        try:
            write(records.observe(seen, F.count(F.lit(1)).alias("n")))
        except Exception as error:
            self.note(batch, 0, records.count(), str(error).split("\n")[0])
            raise
        sent = int(seen.get["n"])
        self.note(batch, sent, 0, None)
        return sent

    def read(self) -> DataFrame:
        """batch, sent, undelivered, reason: the last try of each batch."""
        return self.tables.reader("counts").read()

    def report(self) -> dict:
        """Totals, and whether all that there was to send was sent."""
        row = self.read().agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"), F.coalesce(F.sum("undelivered"), F.lit(0)).alias("undelivered"), F.count("reason").alias("failed")).first()
        return {**row.asDict(), "all_sent": row["undelivered"] == 0 and row["failed"] == 0}


class StreamCounts(StreamingQueryListener):
    """Counts of streams' batches, as their sinks report them: rows observed under METRICS are sent when a batch ends, and a query that ends with an error leaves its reason.

    Progress is told by Spark after a batch is in; `counts` has (query, batch, rows), `failures` (query, reason)."""

    def __init__(self) -> None:
        self.counts: list[tuple[str, int, int]] = []
        self.failures: list[tuple[str, str]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get(METRICS)
        if found is not None:
            self.counts.append((event.progress.name or str(event.progress.id), event.progress.batchId, found["n"]))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.failures.append((str(event.id), event.exception.split("\n")[0]))


def counted(stream: DataFrame) -> DataFrame:
    """A stream whose batches' rows are observed for StreamCounts."""
    return stream.observe(METRICS, F.count(F.lit(1)).alias("n"))
