"""Streams with state against plain Python: batches by size and age, restarts, quiet keys, and the newest row of a key in any order."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.streaming.stateful import Newest, batched, use_state

EVENTS = "k string, item bigint, at timestamp"


@pytest.fixture(autouse=True)
def state(spark):
    use_state(spark)


def timed(spark, rows):
    return spark.createDataFrame(rows, "k string, item bigint, s double").select("k", "item", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")).alias("at"))


def plain_batches(rows, size, seconds, until):
    out = set()
    for key in {r[0] for r in rows if r[0] is not None}:
        groups = []
        for _, item, at in sorted((r for r in rows if r[0] == key and r[2] < until), key=lambda r: (r[2], r[1])):
            if not groups or len(groups[-1]) >= size or at - groups[-1][0][1] >= seconds:
                groups.append([])
            groups[-1].append((item, at))
        done = [len(g) >= size or i + 1 < len(groups) or until - g[0][1] >= seconds for i, g in enumerate(groups)]
        out |= {(key, i, len(g), g[0][0], g[-1][0]) for i, (g, d) in enumerate(zip(groups, done)) if d}
    return out


def test_batches_by_event_time(spark, tmp_path):
    """Events out of order within the delay, a stream stopped and started from its checkpoint, null keys: as if all had come in order."""
    rng = random.Random(1)
    rows = sorted(((rng.choice(["a", "b", "c", None]), i, 1000 + rng.randrange(4000) / 4) for i in range(240)), key=lambda r: r[2] + rng.random() * 50)
    rows.append(("last", 999, 2100.0))
    for part in range(3):
        timed(spark, rows[part * 80 : part * 80 + 80 + part // 2]).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        run = batched(stream, "k", "item", "at", 5, 60.0, "60 seconds").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
        assert run.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == plain_batches(rows, 5, 60.0, 2100.0 - 60) and {r[2] for r in got} >= {2, 5}


def test_a_quiet_key_is_let_go_by_a_timer(spark, tmp_path):
    """By the clock: a full batch goes out at once, the rest after its seconds without any further event."""
    timed(spark, [("a", i, 0.0) for i in range(7)] + [("b", 50, 0.0)]).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = batched(stream, "k", "item", size=4, seconds=2.0).writeStream.format("memory").queryName("quiet").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
    seen, began = [], time.time()
    while len(seen) < 3 and time.time() - began < 90:
        time.sleep(0.3)
        seen = sorted(map(tuple, spark.table("quiet").collect()))
    run.stop()
    assert seen == [("a", 0, 4, 0, 3), ("a", 1, 3, 4, 6), ("b", 0, 1, 50, 50)]


def test_newest_in_any_order(spark, tmp_path):
    """Shuffled, repeated and late records end in the table that records in order give; what was late is counted."""
    rng = random.Random(2)
    rows = [(rng.choice("abcdef"), i, 1e9 + rng.randrange(50)) for i in range(120)]
    want = {k: max((r[2], r[1]) for r in rows if r[0] == k) for k in "abcdef"}
    for order in range(2):
        shuffled = rows if order == 0 else rng.sample(rows, len(rows))
        held = Newest(spark, f"{tmp_path}/t{order}", "k", "item", "at", EVENTS)
        for part in range(3):
            some = shuffled[part * 40 : part * 40 + 40]
            timed(spark, some + some[:5] + (shuffled[:3] if part else [])).write.parquet(f"{tmp_path}/in{order}/{part}")
            stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in{order}")
            assert held.stream(stream, f"{tmp_path}/c{order}", "1 day").awaitTermination(120)
        got = {r.k: (r.s, r.item) for r in held.tables.reader("rows").read().withColumn("s", F.unix_micros("at") / 1e6).collect()}
        assert got == want
        told = held.tables.reader("late").read().agg(F.sum("taken"), F.sum("late")).first()
        assert sum(told) == 120 and told[0] >= 6




def test_a_batch_taken_again_changes_nothing(spark, tmp_path):
    held = Newest(spark, f"{tmp_path}/t", "k", "item", "at", EVENTS)
    held.take(timed(spark, [("a", 1, 5.0), (None, 2, 9.0)]), 0)
    for _ in range(2):
        held.take(timed(spark, [("a", 3, 4.0), ("b", 4, 1.0), ("a", 5, 6.0)]), 1)
    assert {(r.k, r.item) for r in held.tables.reader("rows").read().collect()} == {("a", 5), ("b", 4)}
    assert {tuple(r) for r in held.tables.reader("late").read().collect()} == {("0", 1, 0), ("1", 2, 1)}
