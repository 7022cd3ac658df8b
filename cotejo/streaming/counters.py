"""Usage counters that grow batch by batch, with late corrections and replays.

A batch adds its own counters under its number. A number that comes again replaces what it added before, or adds nothing if
it has been folded into the base, so a replay never counts twice. Corrections are ordinary events of any time, with negative
quantities if need be: nothing closes a period. Reading sums the newest base and the batches after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cotejo.operators.metering import usage_counters

KEYS = ["user_id", "resource", "period_type", "period_start", "period_end"]


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished tables ``path/<number>``, ascending."""
    where, fs = _folder(spark, path)
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where) if s.isDirectory()]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def _summed(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*KEYS).agg(F.sum("count_current").alias("count_current"),
                                  F.max("last_incremented_at").alias("last_incremented_at"))


class CounterStore:
    """Counters below ``path``: ``base/<n>`` holds all batches up to n, ``batch/<n>`` what batch n adds. One writer."""

    def __init__(self, spark: SparkSession, path: str, fold_after: int = 20):
        self.spark, self.path, self.fold_after = spark, path, fold_after
        empty = spark.createDataFrame([], "user_id bigint, resource string, quantity bigint, created_at timestamp_ntz")
        self.empty = usage_counters(empty)

    def _tables(self) -> tuple[list[int], list[int]]:
        bases = _numbers(self.spark, f"{self.path}/base")
        return bases[-1:], [n for n in _numbers(self.spark, f"{self.path}/batch") if not bases or n > bases[-1]]

    def _read(self, bases: list[int], batches: list[int]) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.path}/{kind}/{n}")
                for kind, numbers in (("base", bases), ("batch", batches)) for n in numbers]

    def merge(self, events: DataFrame, number: int) -> None:
        """Count batch ``number`` of events (user_id, resource, quantity, created_at)."""
        bases, batches = self._tables()
        if bases and number <= bases[0]:
            return
        usage_counters(events).write.mode("overwrite").parquet(f"{self.path}/batch/{number}")
        if len({*batches, number}) >= self.fold_after:
            self.fold()

    def fold(self) -> None:
        """Put all batches into a new base. What it replaces goes only after the new base is complete."""
        bases, batches = self._tables()
        if not batches:
            return
        _summed(self._read(bases, batches)).write.mode("overwrite").parquet(f"{self.path}/base/{batches[-1]}")
        for kind, numbers in (("batch", batches), ("base", bases)):
            for n in numbers:
                where, fs = _folder(self.spark, f"{self.path}/{kind}/{n}")
                fs.delete(where, True)

    def read(self) -> DataFrame:
        """All counters, columns as those of ``usage_counters``."""
        parts = self._read(*self._tables())
        return _summed(parts) if parts else self.empty


def keep_counters(events: DataFrame, store: CounterStore, checkpoint: str) -> None:
    """Drain a stream of events into ``store``; Spark's batch numbers make replays after a failure harmless."""
    query = (events.writeStream.foreachBatch(store.merge).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
