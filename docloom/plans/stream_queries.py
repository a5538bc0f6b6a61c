"""Queries of the operators with state: streams over segments of the tables' rows, run segment by segment from their checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import new_path, store, table
from docloom.sources.tables import Keyed, Tables
from docloom.streaming.stateful import Newest, batched, use_state

DAY = 86_400


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their time and its milliseconds, and which third of the time they lie in."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis("ts"))
    ends = events.agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    third = F.least(F.lit(2), F.floor(3 * (F.col("ms") - F.col("low")) / (F.col("high") - F.col("low") + 1))).cast("int")
    return events.crossJoin(F.broadcast(ends)).withColumn("third", third).drop("low", "high")  # one row of ends


def stream_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events in batches of four or of a day, whichever comes first, by the stream's own watermark. The stream is stopped and started again after each third of the time."""
    use_state(spark)
    events = store(_timed(spark, sf).select("user_id", "event_id", "ts", "third"), "timed")
    box, out, state = (new_path(spark, n) for n in ("events-in", "batches", "batch-state"))
    for third in range(3):
        events.where(F.col("third") == third).drop("third").write.parquet(f"{box}/at-{third}")
        stream = spark.readStream.schema("user_id bigint, event_id bigint, ts timestamp").option("recursiveFileLookup", "true").parquet(box)
        made = batched(stream, "user_id", "event_id", "ts", 4, DAY)
        made.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("user_id bigint, batch bigint, n bigint, first_item bigint, last_item bigint").parquet(out)


def _newest(spark: SparkSession, sf: str) -> Newest:
    """Events by their id's remainder, so that the times of three segments interleave; a tenth of each comes again in the next."""
    use_state(spark)
    held = Newest(spark, new_path(spark, "newest"), "user_id", "event_id", "ts", "user_id bigint, event_id bigint, event_type string, ts timestamp")
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    box, state = new_path(spark, "records-in"), new_path(spark, "record-state")
    for n in range(3):
        again = events.where((F.col("event_id") % 3 == n - 1) & (F.col("event_id") % 10 == 0))
        events.where(F.col("event_id") % 3 == n).unionByName(again).write.parquet(f"{box}/at-{n}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(box)
        held.stream(stream, state, "3650 days").awaitTermination()
    return held


def newest_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last event, whatever order, repeats and delays the records came in."""
    rows = _newest(spark, sf).tables.reader("rows").read()
    return rows.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("micros"))


def late_events(spark: SparkSession, sf: str) -> DataFrame:
    """How many records of each segment were newer than what was held, and how many were not; repeats are in neither."""
    told = _newest(spark, sf).tables.reader("late").read().where("taken + late > 0")  # a row a batch
    order = Window.orderBy(F.col("batch").cast("bigint"))
    return told.select((F.row_number().over(order) - 1).cast("bigint").alias("segment"), "taken", "late")


def synced_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and their customers' last statuses in two tables that change in one commit: two loads, changes, deletes and merges. A reader that
    was there before the last commit is joined to see that it still has its state."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    kinds = {"orders": Keyed("o_orderkey bigint, o_custkey bigint, o_orderstatus string", "o_orderkey", "o_custkey"), "customers": Keyed("o_custkey bigint, n bigint", "o_custkey")}
    both = Tables(spark, new_path(spark, "synced"), kinds, fan=2)
    count = lambda rows: rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    for n in range(2):
        some = orders.where(F.col("o_custkey") % 2 == n)
        both.commit(n, {"orders": (some, None), "customers": (count(some), None)})
    before = both.view()
    gone = orders.where("o_custkey % 3 = 0 AND o_orderkey % 2 = 0")
    left = count(orders.where("o_custkey % 3 = 0 AND o_orderkey % 2 <> 0"))
    empty = orders.where("o_custkey % 3 = 0").select("o_custkey").distinct()
    both.commit(2, {"orders": (orders.where("o_custkey % 3 = 1").withColumn("o_orderstatus", F.lit("X")), gone), "customers": (left, empty)})
    both.compact()
    now = both.view()
    state = lambda view, name: view.read("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias(f"{name}_orders"), F.max("o_orderstatus").alias(f"{name}_status")).join(view.read("customers").withColumnRenamed("n", f"{name}_n"), "o_custkey", "full")
    return state(before, "old").join(state(now, "new"), "o_custkey", "left")


QUERIES = {f.__name__: f for f in (stream_batches, newest_events, late_events, synced_tables)}

_RECORDS = """
e AS (SELECT *, event_id % 3 AS segment FROM events),
best AS (SELECT user_id, segment, max(struct_pack(ts := ts, id := event_id)) AS top, count(*) AS n FROM e GROUP BY ALL),
judged AS (SELECT *, max(top) OVER (PARTITION BY user_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM best)
"""
ORACLE_SQL = {
    "stream_batches": """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events)),
w AS (
  SELECT user_id, event_id, t, i, 0 AS batch, 1 AS n, t AS since FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.t, e.i, w.batch + over::INTEGER, CASE WHEN over THEN 1 ELSE w.n + 1 END, CASE WHEN over THEN e.t ELSE w.since END
  FROM (SELECT w.*, e.t AS next_t, w.n >= 4 OR e.t - w.since >= 86400000 AS over FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1) w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, batch::BIGINT AS batch, count(*) AS n, arg_min(event_id, i) AS first_item, arg_max(event_id, i) AS last_item FROM w GROUP BY user_id, batch
HAVING count(*) >= 4 OR (SELECT max(epoch_ms(ts)) FROM events) - min(since) >= 86400000""",
    "newest_events": "SELECT user_id, arg_max(event_id, struct_pack(ts := ts, id := event_id)) AS event_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS event_type, epoch_us(max(ts)) AS micros FROM events GROUP BY user_id",
    "late_events": f"WITH {_RECORDS} SELECT segment, count(*) FILTER (held IS NULL OR top > held) AS taken, (sum(n) - count(*) FILTER (held IS NULL OR top > held))::BIGINT AS late FROM judged GROUP BY segment",
    "synced_tables": """
WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS s FROM orders GROUP BY 1),
k AS (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_custkey % 3 = 1 THEN 'X' ELSE o_orderstatus END) AS s FROM orders WHERE NOT (o_custkey % 3 = 0 AND o_orderkey % 2 = 0) GROUP BY 1)
SELECT o.o_custkey, o.n AS old_orders, o.s AS old_status, o.n AS old_n, k.n AS new_orders, k.s AS new_status, k.n AS new_n FROM o LEFT JOIN k USING (o_custkey)""",
}
