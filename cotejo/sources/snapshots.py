"""Snapshots in buckets by key, where a change rewrites only the buckets it touches.

A table lies in ``buckets`` folders by a hash of its key. Changes read the touched buckets, and Spark's dynamic partition
overwrite swaps them in; files of all others stay as they are. There is one writer at a time, and readers should keep to a
snapshot they have started on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cotejo.plans.staging import staged
from cotejo.sources import sinks

BUCKETS = 64


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def create(self, rows: DataFrame) -> BucketedTable:
        """Write a first snapshot; rows of one bucket are brought together, so each bucket has few files."""
        placed = rows.select("*", self._bucket())
        placed.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(self.path)
        self.schema = rows.schema
        return self

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of some buckets only if asked; others are not even listed for reading."""
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)
        return rows.drop("bucket") if buckets is None else rows.filter(F.col("bucket").isin(buckets)).drop("bucket")

    def change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace each bucket that holds a key of ``changes`` by what ``apply(rows, changes)`` makes of its rows, and return
        the numbers of these buckets. ``apply`` keeps a row's key; new keys have to be in ``changes``."""
        # At most ``buckets`` numbers.
        touched = sorted(r.bucket for r in changes.select(self._bucket()).distinct().collect())
        if not touched:
            return []
        # Staged, so that a failed swap can be repeated from whole data.
        fresh = staged(apply(self.read(touched), changes).select(*self.schema.names, self._bucket()), "buckets")
        left = {r.bucket for r in fresh.select("bucket").distinct().collect()}
        (fresh.repartition(max(1, len(left)), "bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path))
        for number in set(touched) - left:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={number}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return touched

    def apply_key_changes(self, changes: DataFrame) -> list[int]:
        """As :func:`sinks.apply_key_changes`."""
        return self.change(changes, lambda rows, new: sinks.apply_key_changes(rows, new, self.key))

    def delete(self, ids: DataFrame) -> list[int]:
        return self.change(ids, lambda rows, gone: sinks.delete_by_id(rows, gone, self.key))

    def upsert_users(self, incoming: DataFrame) -> tuple[list[int], DataFrame]:
        """As :func:`sinks.upsert_users`; returns the touched buckets and the refused rows. Who owns an e-mail is looked up in
        two columns of the whole table, everything else in the touched buckets."""
        accepted, refused = sinks.split_upserts(self.read().select("user_id", "email"), incoming)
        accepted, refused = staged(accepted, "accepted"), staged(refused, "refused")
        return self.change(accepted, sinks.merge_users), refused
