"""Files that settle, and counts of what was delivered."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from docloom.sources.settled import SettledReader, listing, settled, watch_settled
from docloom.sources.topics import FolderTopic
from docloom.streaming.delivery import Deliveries, StreamCounts, counted


def test_settled_by_times_and_listings():
    now = {"a": (1, int(5e9)), "b": (1, int(9.5e9)), "c": (2, int(5e9))}
    assert set(settled(now, None, 10.0, 1.0)) == {"a", "c"}
    assert set(settled(now, {"a": (1, int(5e9)), "c": (1, int(5e9))}, 10.0, 1.0)) == {"a"}  # c has grown though its time is old


def test_offsets_of_a_reader(tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr("docloom.sources.settled.listing", lambda folder: calls.append(1) or listing(folder))
    (tmp_path / "x").mkdir()
    for name in ("a.md", "x/b.md", ".hidden", "_c"):
        (tmp_path / name).write_text("one")
    reader = SettledReader(str(tmp_path), 0.05)
    assert reader.latestOffset() == {} and len(calls) == 1
    time.sleep(0.1)
    first = reader.latestOffset()
    assert {os.path.basename(p) for p in first} == {"a.md", "b.md"} and len(calls) == 2
    taken = [f[0] for part in reader.partitions({}, first) for f in part.files]
    assert len(taken) == 2 and [f for part in reader.partitions(first, first) for f in part.files] == []
    # one file grows after it was seen, one is gone: neither is read; the first is when it has settled again
    (tmp_path / "a.md").write_text("one two")
    os.remove(tmp_path / "x/b.md")
    assert [b for part in reader.partitions({}, first) for b in reader.read(part)] == []
    time.sleep(0.1)
    reader.latestOffset()
    later = SettledReader(str(tmp_path), 0.05).latestOffset()  # a reader started again
    rows = [b.to_pylist()[0] for part in reader.partitions(first, later) for b in reader.read(part)]
    assert [(r["content"], r["length"]) for r in rows] == [(b"one two", 7)]


def test_a_growing_file_is_taken_once_and_whole(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "whole.md").write_text("whole")

    def grow():
        for n in range(12):
            with open(box / "grows.md", "a") as file:
                file.write(f"line {n}\n")
            if n == 4:
                (box / "brief.md").write_text("x")
            if n == 5:
                os.remove(box / "brief.md")
            time.sleep(0.25)

    writer = threading.Thread(target=grow)
    writer.start()
    stream = watch_settled(spark, str(box), 1.5).select("path", F.col("content").cast("string").alias("text"))
    run = stream.writeStream.format("memory").queryName("settled_files").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    began, rows = time.time(), []
    while len(rows) < 2 and time.time() - began < 90:
        time.sleep(0.3)
        rows = spark.table("settled_files").collect()
    writer.join()
    time.sleep(2)
    rows = spark.table("settled_files").collect()
    run.stop()
    assert {(os.path.basename(r.path), r.text) for r in rows} == {("whole.md", "whole"), ("grows.md", "".join(f"line {n}\n" for n in range(12)))} and len(rows) == 2
    # started again from its checkpoint, nothing is taken twice
    again = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True)
    assert again.start(f"{tmp_path}/out").awaitTermination(60) and again.start(f"{tmp_path}/out").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_deliveries(spark, tmp_path):
    sent = Deliveries(spark, f"{tmp_path}/d")
    topic = FolderTopic(spark, f"{tmp_path}/topic")
    records = lambda n: spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))
    assert sent.send(records(7), 0, lambda df: topic.write(df, 0)) == 7
    with pytest.raises(Exception, match="full"):
        sent.send(records(5), 1, lambda df: df.select(F.raise_error(F.lit("disk full"))).write.format("noop").mode("overwrite").save())
    assert {(r.batch, r.sent, r.undelivered) for r in sent.read().collect()} == {("0", 7, 0), ("1", 0, 5)} and not sent.report()["all_sent"]
    sent.send(records(5), 1, lambda df: topic.write(df, 1))
    assert sent.report() == {"sent": 12, "undelivered": 0, "failed": 0, "all_sent": True}
    assert sent.send(records(0), 2, lambda df: topic.write(df, 2)) == 0


def test_counts_of_streams(spark, tmp_path):
    seen = StreamCounts()
    spark.streams.addListener(seen)
    try:
        for part in range(2):
            spark.range(5 + part).write.parquet(f"{tmp_path}/in/{part}")
            stream = counted(spark.readStream.schema("id bigint").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
            stream.writeStream.format("parquet").queryName("sent").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(60)
        failing = counted(spark.readStream.schema("id bigint").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
        run = failing.select(F.raise_error(F.lit("sink down"))).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="sink down"):
            run.awaitTermination(60)
        began = time.time()
        while (len(seen.counts) < 2 or not seen.failures) and time.time() - began < 20:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    assert [c[2] for c in seen.counts if c[0] == "sent"] == [5, 6] and len(seen.failures) == 1
