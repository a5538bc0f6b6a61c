"""Streams with state: batches of a key by size or age, and the newest row of a key by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.sources.tables import Keyed, Tables
from docloom.streaming.batching import SECONDS, SIZE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """Stateful streams of this session keep their state in RocksDB, on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: A key's open batch, and the items that the watermark has not passed, as pairs of item and time in 64-bit numbers.
OPEN = "batch long, n long, since long, first long, last long, waiting binary"


class Batcher:
    """A key's items in batches: one is full with `size` items, and over when `millis` have passed since its first.

    By event time items wait until the watermark has passed them, so they are met in their order whatever order they came in. By processing time they are met as they
    come, and an age is told by the time of the trigger. Either way a batch that nothing more is added to goes out by a timeout. The state is one value,
    which goes to the worker and back with the key's rows.
    """

    def __init__(self, key: str, size: int, millis: int, by_event: bool):
        self.key, self.size, self.millis, self.by_event = key, size, millis, by_event

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() if self.by_event else state.getCurrentProcessingTimeMs()
        *held, waiting = state.get if state.exists else (0, 0, 0, 0, 0, b"")
        # a key that has timed out is given no rows
        found = [] if state.hasTimedOut else [p[["item", "at"]].to_numpy(np.int64) for p in parts]
        pairs = np.concatenate([np.frombuffer(bytes(waiting), np.int64).reshape(-1, 2), *found])
        if self.by_event:
            due = pairs[:, 1] < now
            items, later = pairs[due], pairs[~due]
            items = items[np.lexsort((items[:, 0], items[:, 1]))].tolist()
        else:
            items, later = [(i, now) for i in sorted(pairs[:, 0].tolist())], pairs[:0]
        out, held = self._go_on(items, now, *map(int, held))
        state.update((*held, later.tobytes()))
        n, since = held[1:3]
        ends = ([since + self.millis] if n else []) + ([int(later[:, 1].min()) + 1] if len(later) else [])
        if ends and self.by_event:
            state.setTimeoutTimestamp(max(min(ends) - 1, now))  # it goes off when the watermark has passed it
        elif ends:
            state.setTimeoutDuration(max(min(ends) - now, 1))
        yield pd.DataFrame([(key[0], *row) for row in out], columns=[self.key, "batch", "n", "first_item", "last_item"])

    def _go_on(self, items: list, now: int, batch: int, n: int, since: int, first: int, last: int) -> tuple[list[tuple], tuple]:
        """Adds the items whose time has come, and lets go of batches that are full or over by now."""
        out = []
        for item, at in items:
            if n and at - since >= self.millis:
                out.append((batch, n, first, last))
                batch, n = batch + 1, 0
            if not n:
                since, first = at, item
            n, last = n + 1, item
            if n >= self.size:
                out.append((batch, n, first, last))
                batch, n = batch + 1, 0
        if n and now - since >= self.millis:
            out.append((batch, n, first, last))
            batch, n = batch + 1, 0
        return out, (batch, n, since, first, last)


def batched(stream: DataFrame, key: str, item: str, at: str | None = None, size: int = SIZE, seconds: float = SECONDS, delay: str = "0 seconds") -> DataFrame:
    """key, batch, n, first_item, last_item: a stream's items (bigint) of each key in batches of `size`, or fewer where `seconds` have passed since the first.

    With `at` (a timestamp) time is that of the events, of which those later than `delay` behind the newest are dropped; without, it is the clock's. State is a
    few numbers a key and, by event time, the items that the watermark has not passed. Rows without a key are in no batch. The session must use_state.
    """
    kept = stream.where(F.col(key).isNotNull())
    if at is None:
        rows = kept.select(key, F.col(item).cast("bigint").alias("item"), F.lit(0).cast("bigint").alias("at"))
    else:
        timed = kept.select(key, F.col(item).cast("bigint").alias("item"), F.col(at).cast("timestamp").alias("time")).withWatermark("time", delay)
        rows = timed.withColumn("at", F.unix_millis("time"))
    kind = stream.schema[key].dataType.simpleString()
    made = Batcher(key, size, int(seconds * 1000), at is not None)
    timeout = GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(made, f"`{key}` {kind}, batch long, n long, first_item long, last_item long", OPEN, "append", timeout)


class Newest:
    """The newest row of each key by event time, in a table: records may come in any order, again and late.

    A record is taken if its (time, id) is greater than what the table holds for its key, so the same records give the same table in any order and
    number. Records of one id are dropped where they come again within the watermark. What comes later than the table's row is counted a batch.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, id_: str, at: str, schema: str):
        self.spark, self.key, self.id, self.at = spark, key, id_, at
        self.tables = Tables(spark, path, {"rows": Keyed(schema, key), "late": Keyed("batch string, taken bigint, late bigint", "batch")})

    def take(self, records: DataFrame, batch: str | int) -> None:
        """Brings a batch of records in, in one commit with how many were taken and how many were late."""
        order = F.struct(self.at, self.id)
        names = self.tables.columns("rows")
        best = records.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*names), order).alias("r"), F.count(F.lit(1)).alias("n_")).select("r.*", "n_")
        best = best.persist()
        held = self.tables.view(batch).read("rows", best.select(self.key)).select(F.col(self.key).alias("k_"), order.alias("held_"))
        judged = best.join(held, F.col(self.key) == F.col("k_"), "left").withColumn("new_", F.col("held_").isNull() | (order > F.col("held_")))
        counts = judged.agg(F.coalesce(F.sum(F.when(F.col("new_"), 1).otherwise(0)), F.lit(0)).alias("taken"), F.coalesce(F.sum("n_"), F.lit(0)).alias("all"))
        told = counts.select(F.lit(str(batch)).alias("batch"), F.col("taken").cast("bigint").alias("taken"), (F.col("all") - F.col("taken")).cast("bigint").alias("late"))
        self.tables.commit(batch, {"rows": (judged.where("new_").select(*names), None), "late": (told, None)})
        best.unpersist()

    def stream(self, records: DataFrame, checkpoint: str, delay: str = "1 hour", **trigger) -> StreamingQuery:
        once = records.withColumn(self.at, F.col(self.at).cast("timestamp")).withWatermark(self.at, delay).dropDuplicatesWithinWatermark([self.id])
        run = once.writeStream.foreachBatch(lambda batch, number: self.take(batch, number))
        return run.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
