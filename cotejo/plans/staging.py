"""Intermediate tables that cut lineage: written once to the shared checkpoint folder, read back with column pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cotejo.session import checkpoint_root

_WRITTEN: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return it as a scan. Unlike a cache it survives lost
    executors, and every reader prunes the columns it does not need."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cotejo-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Paths of the intermediate tables this process wrote and has not deleted."""
    return list(_WRITTEN)


def discard_staged(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete intermediate tables, by default all that this process wrote, once their results have been stored."""
    gone = 0
    for name in written() if paths is None else paths:
        if name in _WRITTEN:
            _WRITTEN.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        gone += bool(fs.delete(path, True))
    return gone
