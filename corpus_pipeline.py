"""The corpus pipeline: toxicity, near-duplicates, repeated passages, source mix, tokens. Each stage reads what the one
before it kept, as a Parquet table, and returns the columns of ``documents``; the last returns token ids."""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cotejo.llm import bpe, mixing, near, suffix, toxicity
from cotejo.plans.staging import discard_staged, written
from cotejo.session import checkpoint_root

#: Bytes from which on a passage counts as repeated here; passages of 50 words are a little longer.
PASSAGE = 240


_LEFT: list[str] = []


def stage(function):
    """When a stage starts, the one before has been written, so the intermediate tables that it left can go."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_staged(spark, _LEFT)
        before = set(written())
        out = function(spark, docs, sf_dir)
        _LEFT[:] = [path for path in written() if path not in before]
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject. It learns from the table ``labels``."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return near.without_near_duplicates(docs)


@stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier in the corpus; ``n_chars`` follows. No row goes, even if its text does."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = suffix.dedup_passages(docs, PASSAGE, keep_first=True, keep_text=True, columns=others)
    done = done.withColumnRenamed("kept", "text")
    if "n_chars" in others:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document appears as often as the mix takes it."""
    return mixing.mixed_documents(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("repeated_passages", drop_repeated_passages),
          ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder before the next one starts, and the
    one before it goes then. The last one's stays for the reader."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}", None
    for number, (name, function) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(before)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        before = path
    discard_staged(spark, _LEFT)
    return docs


#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None
