"""Micro-batches by size or age, in batch form and as a stream, and streaming ingestion."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import backoff_ceiling
from docloom.sources.files import route, validate

SIZE, SECONDS, RETRIES = 16, 2.0, 5


class MicroBatcher:
    """Holds items until there are `size` of them or the first is `seconds` old; an empty one is never ready."""

    def __init__(self, size: int = SIZE, seconds: float = SECONDS, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.items: list = []
        self.since = 0.0

    def add(self, item) -> None:
        if not self.items:
            self.since = self.clock()
        self.items.append(item)

    def ready(self) -> bool:
        return bool(self.items) and (len(self.items) >= self.size or self.clock() - self.since >= self.seconds)

    def flush(self) -> list:
        out, self.items = self.items, []
        return out


def microbatches(events: DataFrame, key: str = "user_id", item: str = "event_id", at: str = "ts", size: int = SIZE, seconds: float = SECONDS) -> DataFrame:
    """key, batch, n, first_item, last_item: each key's events in order of time, batched as a MicroBatcher driven by their times would. Rows without a key are in no batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, current, count = [0.0], None, 0
        held, out = MicroBatcher(size, seconds, lambda: now[0]), []

        def close() -> None:
            nonlocal count
            batch = held.flush()
            out.append((current, count, len(batch), batch[0], batch[-1]))
            count += 1

        for part in parts:
            for k, i, t in zip(part[key], part[item], part[at] / 1e6):
                if k != current:
                    if held.items:
                        close()
                    current, count = k, 0
                now[0] = t
                held.add(i)
                if held.ready():
                    close()
            yield pd.DataFrame(out, columns=["key", "batch", "n", "first_item", "last_item"])
            out.clear()
        if held.items:
            close()
        yield pd.DataFrame(out, columns=["key", "batch", "n", "first_item", "last_item"])

    # a key's events come one after the other from a sort that spills, so a key of any size passes in bounded memory
    micros = events.where(F.col(key).isNotNull()).select(key, item, F.unix_micros(F.col(at).cast("timestamp")).alias(at))
    sorted_rows = micros.repartition(key).sortWithinPartitions(key, at, item)
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, item)}
    out = sorted_rows.mapInPandas(run, f"key {kinds[key]}, batch bigint, n bigint, first_item {kinds[item]}, last_item {kinds[item]}")
    return out.withColumnRenamed("key", key)


def backoff(retry: int, base: float = 1.0, cap: float = 60.0, rng: Callable[[float, float], float] = random.uniform) -> float:
    return rng(0.0, min(cap, base * 2**retry))


def due(now: Column, attempts: Column, *key: str, base: float = 1.0, cap: float = 60.0) -> Column:
    """When a row that has failed so many times (1 or more) is to be tried again, in epoch seconds: full jitter up to the ceiling of its retry, by a hash of
    key and attempt, so that the same failure is given the same time wherever and however often it is worked out."""
    share = F.shiftrightunsigned(F.xxhash64(*key, attempts), 11).cast("double") / float(2**53)
    return now + share * backoff_ceiling((attempts - 1).cast("double"), base, cap)


def scheduled(failed: DataFrame, key: str, now: float, retries: int = RETRIES) -> tuple[DataFrame, DataFrame]:
    """Rows that failed just now (attempts: how many times before) as those to be tried again, with attempts and due, and those that have had all their tries."""
    counted = failed.withColumn("attempts", F.col("attempts") + 1)
    again = counted.where(F.col("attempts") <= retries)
    return again.withColumn("due", due(F.lit(now), F.col("attempts"), key)), counted.where(F.col("attempts") > retries)


def ingest(files: DataFrame, good: str, bad: str, checkpoint: str):
    """Streams files to two Parquet tables, documents and rejected ones. Each batch writes under its own number, so one run again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        checked = validate(batch).persist()
        for part, path in zip(route(checked), (good, bad)):
            part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        checked.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
