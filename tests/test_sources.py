"""Response scans from JSON, record output, table changes, long digit streams."""

import json
import datetime as dt
import random

from pyspark.sql import functions as F

from cotejo.operators import layout
from cotejo.plans.staging import discard_staged, staged
from cotejo.sources import responses, sinks, tables


def word(text, conf, symbol_confs):
    return {"confidence": conf, "vertices": [{"x": 1, "y": 2}, {"x": 5, "y": 2}, {"x": 5, "y": 9}, {"x": 1, "y": 9}],
            "symbols": [{"text": t, "confidence": s} for t, s in zip(text, symbol_confs)]}


def test_json_responses(spark, tmp_path):
    page = {"blocks": [{"vertices": [{"x": 0, "y": 0}, {"x": 4, "y": 8}],
                        "paragraphs": [{"words": [word("12", 0.8, [0.7, None]), word("a", None, [None])]}]}]}
    (tmp_path / "a.json").write_text(json.dumps({"form_id": 1, "full_text": "12 a", "pages": [page]}) + "\n" + json.dumps({"form_id": 2}))
    a = responses.read_responses(spark, str(tmp_path / "a.json"), responses.RESPONSE_A)
    assert [tuple(r) for r in responses.scan_symbols(a).orderBy("ord").collect()] == [
        (1, 0, "1", 0.7), (1, 1, "2", 0.8), (1, 2, "a", 0.95)]
    box = responses.word_boxes_a(a).orderBy("box_id").first()
    assert (box["text"], box["x"], box["y"], box["w"], box["h"]) == ("12", 1.0, 2.0, 4.0, 7.0)
    block = responses.block_boxes_a(a).first()
    assert (block["text"], block["x"], block["y"]) == ("12 a", 2.0, 4.0)

    line = {"text": "12 x", "words": [{"text": "12", "polygon": [0, 0, 4, 0, 4, 3, 0, 3]}, {"text": "x", "confidence": 0.5}]}
    (tmp_path / "b.json").write_text(json.dumps({"form_id": 1, "blocks": [{"lines": [line]}]}))
    b = responses.read_responses(spark, str(tmp_path / "b.json"), responses.RESPONSE_B)
    assert [(r["text"], r["confidence"]) for r in responses.scan_words(b).orderBy("ord").collect()] == [("12", 0.95), ("x", 0.5)]
    assert [r["text"] for r in responses.word_boxes_b(b).collect()] == ["12"]
    assert [(r["x"], r["y"], r["confidence"]) for r in responses.line_boxes_b(b).collect()] == [(0.0, 0.0, 0.95)]


def test_every_table_round_trips(spark, tmp_path):
    assert len(tables.SCHEMAS) == 24
    empty = spark.range(1).select(F.lit("7").alias("id"))
    for name in tables.SCHEMAS:
        tables.write_table(empty, str(tmp_path), name)
        back = tables.read_table(spark, str(tmp_path), name)
        assert back.columns == [c for c, _ in tables.columns_of(name)] and back.count() == 1


def test_validation_records_as_json(spark, tmp_path):
    m = F.array(F.struct(F.lit("first_name").alias("field_name"), F.lit(True).alias("match"), F.lit(1.0).alias("similarity"), F.lit("Ana").alias("compared")))
    df = spark.range(1).select(F.lit("OK").alias("status"), F.lit("AUTO_SAVE").alias("action"), F.lit(1.0).alias("confidence"),
                               F.lit("").alias("details"), F.lit("Ana").alias("written_names"), F.lit("ANA").alias("digital_names"), m.alias("matches"))
    sinks.write_records(sinks.to_validation_records(df), str(tmp_path / "out"), "json")
    got = spark.read.json(str(tmp_path / "out")).first()
    assert (got["status"], got["action"], got["matches"]["first_name"]["compared"]) == ("ok", "auto_save", "Ana")
    text = spark.range(1).select(F.lit("t").alias("text"), F.lit(0.5).alias("confidence"), F.lit(1).alias("x"), F.lit(2).alias("y"))
    assert sinks.to_text_records(text).first()["position"]["y"] == 2


def test_keys_with_an_unknown_or_no_scope_are_refused(spark):
    keys = spark.createDataFrame([(1, ["a:b"]), (2, ["a:b", "x:y"]), (3, ["old:b"]), (4, [])], "key_id int, scopes array<string>")
    catalog = spark.createDataFrame([(1, "a:b", True), (2, "old:b", False)], "id int, code string, is_active boolean")
    rows, links = sinks.insert_keys(keys, catalog)
    assert [r["key_id"] for r in rows.collect()] == [1] and [tuple(r) for r in links.collect()] == [(1, 1)]


def test_stream_lookup_finds_identifiers_of_any_length(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("012") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    symbols = [(t, round(rng.random(), 3)) for t in texts]
    stream = "".join(texts)
    confs = [c for t, c in symbols for _ in t]
    ids = [stream[i:i + k] for i, k in ((0, 3), (40, 11), (len(stream) - 5, 5), (500, 9), (511, 10), (3, 1), (70, 2), (90, 12), (60, 80))]
    ids = list(dict.fromkeys(ids + ["9999", "2222222222"]))
    streams = spark.createDataFrame([(1, symbols)], "form_id bigint, symbols array<struct<text:string,confidence:double>>")
    df = spark.createDataFrame([(1, i) for i in ids] + [(2, "123")], "form_id bigint, id_number string")
    def run():
        return {(r["form_id"], r["id_number"]): (r["found"], r["digit_conf"]) for r in layout.map_digit_confidences(df, streams).collect()}
    short = run()
    monkeypatch.setattr(layout, "BLOCK", 64)
    assert run() == short
    for i in ids:
        at = stream.find(i)
        assert short[1, i][0] == (at >= 0)
        if at >= 0:
            assert short[1, i][1] == confs[at:at + len(i)]
    assert short[2, "123"] == (False, [0.85] * 3)


def test_staged_tables_can_be_discarded(spark):
    assert staged(spark.range(3), "t").count() == 3
    assert discard_staged(spark) >= 1


def test_key_changes_write_nulls_when_told_and_fold_repeats(spark):
    kinds = "key_id bigint, is_active boolean, last_used_at timestamp_ntz, revoked_at timestamp_ntz"
    day = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    keys = spark.createDataFrame([(1, True, day[0], None), (2, True, day[0], day[0]), (3, True, None, None)], kinds)
    changes = spark.createDataFrame(
        [(1, None, day[1], None, False), (1, False, day[3], None, False), (2, None, None, None, True)],
        kinds + ", set_revoked_at boolean")
    got = {r["key_id"]: tuple(r)[1:] for r in sinks.apply_key_changes(keys, changes).collect()}
    assert got == {1: (False, day[3], None), 2: (True, day[0], None), 3: (True, None, None)}


def test_upserts_name_what_they_refuse(spark):
    kinds = "user_id bigint, email string, is_active boolean, created_at timestamp_ntz"
    users = spark.createDataFrame([(1, "a@b.com", True, None), (2, "c@d.com", True, None)], kinds)
    incoming = spark.createDataFrame(
        [(1, "broken", False, None), (2, "A@B.com", False, None), (2, "x@y.com", False, None), (3, "n@n.com", True, None),
         (4, "n@n.com", True, None)], kinds)
    accepted, refused = sinks.split_upserts(users, incoming)
    assert {(r["user_id"], r["reason"]) for r in refused.collect()} == {
        (1, "malformed"), (2, "taken"), (2, "repeated"), (4, "taken")}
    assert [r["user_id"] for r in accepted.collect()] == [3]
    after = sinks.upsert_users(users, incoming).collect()
    assert sorted((r["user_id"], r["email"]) for r in after) == [(1, "a@b.com"), (2, "c@d.com"), (3, "n@n.com")]
