"""Bounded samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Labelled documents a classifier is fitted on, at most.
TRAIN_ROWS = 20_000


def held_out(key: str = "doc_id"):
    """Rows that no classifier learns from; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, label`` (0 or 1) of at most ``rows`` labelled documents that are not held out, chosen by a digest of
    the id. Ids labelled more than once count once, with the larger label; of several texts of one id the one of smallest
    digest counts, so rows are bounded as ids are. Null ids, labels and texts don't count."""
    chosen = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
              .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows))
    # The sample is bounded by ``rows``, so its size is known.
    found = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
