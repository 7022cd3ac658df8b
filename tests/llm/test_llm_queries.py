"""The registered queries at the smallest scale, and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cotejo.llm import queries
from tests import oracle

SF = f"{oracle.DATA}/sf0.001"
WITH_SQL = sorted(n for n, (_, sql) in queries.QUERIES.items() if sql)
COLUMNS = {
    "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string",
                 "refers_to": "bigint"},
    "op6_simhash": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
                    "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op7_suffix": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_near": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op11_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
                     "sequence_id": "bigint", "offset": "bigint"},
    "op12_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13_phrases": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint",
                     "n": "bigint", "score": "bigint"},
}


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_its_sql(spark, name):
    run, sql = queries.QUERIES[name]
    assert oracle.compare(run(spark, SF), sql, oracle.connect(SF)) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_the_agreed_columns(spark, name):
    kinds = dict(queries.QUERIES[name][0](spark, SF).dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]


def test_pipeline_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{number}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "bpe":
            assert after.columns == columns and after.dtypes == docs.dtypes
        if name in ("toxicity", "near_duplicates"):
            assert 0 < after.count() <= before and after.select("doc_id").distinct().count() == after.count()
        if name == "repeated_passages":
            assert after.count() == docs.count() and after.filter(F.length("text") != F.col("n_chars")).isEmpty()
        docs = after
    assert docs.filter("NOT round_trip").isEmpty() and docs.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, keys int, txt string"
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "a", 0, 2, "y"), (3, "some words here", "en", "a", 15, 3, "z"),
            (3, "some words here", "en", "a", 15, 3, "z"), (None, "lone null id", "en", None, 12, None, None)]
    docs = spark.createDataFrame(rows, kinds)
    out = stage(spark, docs, SF)
    assert out.count() >= 1
    if name != "bpe":
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_null_and_repeated_ids_do_not_shield_near_copies(spark):
    def text(name, edit=""):
        return " ".join(f"{name}{i}" for i in range(100)) + edit
    rows = [(1, text("a"), "x"), (None, text("a", " more"), "x"), (None, text("b"), "x"),
            (None, text("c"), "x"), (None, text("c", " more"), "x"), (None, text("c"), "y"),
            (5, text("d"), "x"), (5, text("a", " other"), "x"), (6, text("e"), "x"), (6, text("e", " more"), "x"),
            (7, text("f"), "x"), (7, text("f"), "y"), (None, "", "x"), (None, None, "x"), (8, " ", "x"), (8, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").strip()[:1]) for r in out.collect()), key=str)
    assert got == sorted([(1, "a"), (None, "b"), (None, "c"), (5, "d"), (6, "e"), (7, "f"), (None, ""), (None, ""), (8, ""),
                          (8, "")], key=str)
