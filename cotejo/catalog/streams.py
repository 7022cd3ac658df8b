"""Streaming queries, drained over the whole event table (X1-X4). An end marker closes the last windows, so drained results
equal the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cotejo.plans import derive, derive_accounts as acc
from cotejo.session import checkpoint_root
from cotejo.sources import sinks
from cotejo.streaming import jobs

c = F.col


def _stream(spark, sf):
    schema = derive.table(spark, sf, "events").schema
    return jobs.read_events(spark, sf, "events.parquet", schema)


def x1_streaming_counters(spark, sf):
    events = _stream(spark, sf).select(
        "user_id", c("event_type").alias("resource"), (c("event_id") % 3 + 1).cast("int").alias("quantity"),
        c("ts").cast("timestamp").alias("created_at"))
    events, end = jobs.with_end(events, "created_at")
    counters = jobs.drain(jobs.windowed_counters(events, "1 day"), "counters", ends=(end,))
    return counters.select("user_id", "resource", c("period_start").cast("timestamp_ntz").alias("period_start"), "count_current")


def x2_arrival_join(spark, sf):
    e = c("event_id")
    base = _stream(spark, sf)
    at = c("ts").cast("timestamp")
    a = base.filter(e % 4 != 1).select(e.alias("form_id"), c("user_id").alias("pos"), F.sha2(e.cast("string"), 256).alias("a_id"), at.alias("arrived_a"))
    late = at + F.when(e % 10 == 0, F.expr("INTERVAL 90 SECONDS")).otherwise(F.expr("INTERVAL 20 SECONDS"))
    b = base.filter(e % 4 != 2).select(e.alias("form_id"), c("user_id").alias("pos"), F.sha2(e.cast("string"), 256).alias("b_id"), late.alias("arrived_b"))
    (a, end_a), (b, end_b) = jobs.with_end(a, "arrived_a"), jobs.with_end(b, "arrived_b")
    joined = jobs.drain(jobs.arrival_join(a, b), "arrivals", ends=(end_a, end_b))
    return joined.filter(c("form_id").isNotNull()).select("form_id", "pos", c("a_id").isNotNull().alias("in_a"), c("b_id").isNotNull().alias("in_b"))


def x3_first_readings(spark, sf):
    readings = _stream(spark, sf).select(
        (c("user_id") % 20).alias("form_id"), (c("event_id") % 100).cast("string").alias("id_number"),
        c("ts").cast("timestamp").alias("arrived"))
    unique = jobs.drain(jobs.first_readings(readings, "60 days"), "first")
    return unique.select("form_id", "id_number")


def x4_last_used(spark, sf):
    """An event of type ``error`` is a refused request, which is no use of a key."""
    path = f"{checkpoint_root(spark)}/cotejo-last-used-{uuid.uuid4().hex}"
    requests = _stream(spark, sf).filter(c("event_type") != "error").select(c("user_id").alias("key_id"), "ts")
    jobs.keep_last_used(requests, path)
    return sinks.apply_key_changes(acc.keys(spark, sf), jobs.read_last_used(spark, path)).select("key_id", "last_used_at")


QUERIES = {
    "x1_streaming_counters": (x1_streaming_counters, """
SELECT user_id, event_type AS resource, date_trunc('day', ts) AS period_start, sum(event_id % 3 + 1) AS count_current
FROM events GROUP BY ALL"""),
    "x2_arrival_join": (x2_arrival_join, """
SELECT event_id AS form_id, user_id AS pos, true AS in_a, event_id % 4 <> 2 AND event_id % 10 <> 0 AS in_b
FROM events WHERE event_id % 4 <> 1
UNION ALL
SELECT event_id, user_id, false, true FROM events WHERE event_id % 4 = 1 OR (event_id % 4 <> 2 AND event_id % 10 = 0)"""),
    "x3_first_readings": (x3_first_readings, """
SELECT DISTINCT user_id % 20 AS form_id, CAST(event_id % 100 AS VARCHAR) AS id_number FROM events"""),
    "x4_last_used": (x4_last_used, """
SELECT c_custkey AS key_id, last_used_at FROM customer LEFT JOIN (
  SELECT user_id, max(ts) AS last_used_at FROM events WHERE event_type <> 'error' GROUP BY user_id) u
ON user_id = c_custkey"""),
}
