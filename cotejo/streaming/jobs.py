"""Streaming transformations and a drain helper.

Every job is a plain DataFrame transformation over a stream; sinks and checkpoints go to the shared folder, so a lost
executor or driver resumes from the last committed batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cotejo.session import checkpoint_root


def read_events(spark: SparkSession, root: str, pattern: str, schema) -> DataFrame:
    """Files of ``root`` matching ``pattern`` as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(root)


def windowed_counters(events: DataFrame, length: str = "1 hour", delay: str = "2 hours", time: str = "created_at") -> DataFrame:
    """Quantity per user, resource and tumbling window; events later than ``delay`` are dropped by the watermark."""
    return (
        events.withWatermark(time, delay)
        .groupBy("user_id", "resource", F.window(time, length).alias("w"))
        .agg(F.sum("quantity").alias("count_current"), F.max(time).alias("last_incremented_at"))
        .select("user_id", "resource", F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"),
                "count_current", "last_incremented_at")
    )


def arrival_join(a: DataFrame, b: DataFrame, wait_seconds: int = 60, delay: str = "2 minutes") -> DataFrame:
    """Readings of two recognisers for the same form row when they arrive within ``wait_seconds`` of each other; a reading
    whose partner stays away comes out alone once the watermark has passed."""
    left = a.withWatermark("arrived_a", delay)
    right = b.withWatermark("arrived_b", delay).withColumnsRenamed({"form_id": "form_b", "pos": "pos_b"})
    wait = F.expr(f"INTERVAL {wait_seconds} SECONDS")
    near = (
        (F.col("form_id") == F.col("form_b")) & (F.col("pos") == F.col("pos_b"))
        & (F.col("arrived_b") >= F.col("arrived_a") - wait) & (F.col("arrived_b") <= F.col("arrived_a") + wait)
    )
    joined = left.join(right, near, "full_outer")
    return joined.select(
        F.coalesce("form_id", "form_b").alias("form_id"), F.coalesce("pos", "pos_b").alias("pos"), "a_id", "b_id",
        "arrived_a", "arrived_b",
    )


def first_readings(readings: DataFrame, delay: str = "10 minutes", time: str = "arrived") -> DataFrame:
    """The first arrival per (form, identifier) within the watermark."""
    return readings.withWatermark(time, delay).dropDuplicatesWithinWatermark(["form_id", "id_number"])


def last_used(requests: DataFrame) -> DataFrame:
    """Last-use time per key."""
    return requests.groupBy("key_id").agg(F.max("ts").alias("last_used_at"))


def keep_last_used(requests: DataFrame, path: str) -> None:
    """Drain ``requests`` (key_id, ts) into snapshots of the last use per key. Every batch merges itself into the snapshot of
    the batch before and writes a new one, so the stream keeps no state of its own; only two snapshots stay. A batch that
    is run again after a failure overwrites its own snapshot."""
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = last_used(batch)
        if batch_id > 0:
            now = now.unionByName(spark.read.schema(now.schema).parquet(f"{path}/snapshot={batch_id - 1}"))
        now.groupBy("key_id").agg(F.max("last_used_at").alias("last_used_at")).write.mode("overwrite").parquet(
            f"{path}/snapshot={batch_id}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    query = (
        requests.writeStream.foreachBatch(save)
        .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_last_used(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of :func:`keep_last_used`."""
    kept = spark.read.parquet(path)
    newest = kept.agg(F.max("snapshot")).scalar()
    return kept.filter(F.col("snapshot") == newest).select("key_id", "last_used_at")


#: Event time of end markers, later than any event.
END = "2999-01-01 00:00:00"


def with_end(stream: DataFrame, time: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a second source that is empty until the returned function is called, which puts one row at ``END``
    there, all its other columns NULL. It moves the watermark past every event, so the last windows close; its own window
    never does, but a join may give the marker out, with its NULL keys."""
    spark, schema = stream.sparkSession, stream.schema
    path = f"{checkpoint_root(spark)}/cotejo-end-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)

    def release() -> None:
        row = [F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in schema]
        spark.range(1).select(*row).write.mode("append").parquet(path)

    return stream.unionByName(spark.readStream.schema(schema).parquet(path)), release


def drain(stream: DataFrame, name: str, mode: str = "append", ends: tuple[Callable[[], None], ...] = (),
          settings: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over everything available now into Parquet files and return them as a table. With ``ends`` (from
    :func:`with_end`) the end markers follow once all events are in. ``settings`` hold while the stream runs."""
    spark = stream.sparkSession
    path = f"{checkpoint_root(spark)}/cotejo-stream-{name}-{uuid.uuid4().hex}"

    def run() -> None:
        query = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", path)
            .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    before = {key: spark.conf.get(key, None) for key in settings or {}}
    for key, value in (settings or {}).items():
        spark.conf.set(key, value)
    try:
        run()
        if ends:
            for end in ends:
                end()
            run()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(path)
