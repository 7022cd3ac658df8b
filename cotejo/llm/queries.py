"""Registered queries of the operators in this subpackage: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cotejo.llm import (bpe, mixing, near, neighbours, packing, passages, phrases, quality, search, simhash, suffix, toxicity,
                        warc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.train(docs, labels))


def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.rate(docs, toxicity.train(docs, labels))


def op3_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op4_sentences(spark, sf_dir):
    return passages.dedup_sentences(table(spark, sf_dir, "documents"), every_run=True)


def op5_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_simhash(spark, sf_dir):
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


def op7_suffix(spark, sf_dir):
    return suffix.dedup_passages(table(spark, sf_dir, "documents"), length=400, keep_first=False)


def op8_near(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op9_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).drop("source")


def op11_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op12_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": (op1_quality, None),
    "op2_toxicity": (op2_toxicity, None),
    "op3_bpe": (op3_bpe, None),
    "op4_sentences": (op4_sentences, None),
    "op5_warc": (op5_warc, warc.ORACLE_SQL),
    "op6_simhash": (op6_simhash, None),
    "op7_suffix": (op7_suffix, None),
    "op8_near": (op8_near, near.ORACLE_SQL),
    "op9_neighbours": (op9_neighbours, None),
    "op10_mixing": (op10_mixing, mixing.ORACLE_SQL),
    "op11_packing": (op11_packing, None),
    "op12_search": (op12_search, search.ORACLE_SQL),
    "op13_phrases": (op13_phrases, phrases.ORACLE_SQL),
}
