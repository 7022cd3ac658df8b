"""Response files, bucketed snapshots, counters by batch, streams with state, metadata and table rules."""

import datetime as dt
import gzip
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotejo.operators import constraints, metadata, metering, quality
from cotejo.operators.reconcile import dedupe_best
from cotejo.plans import derive
from cotejo.sources import documents, responses, sinks
from cotejo.sources.snapshots import BucketedTable
from cotejo.streaming import best, jobs
from cotejo.streaming.counters import CounterStore
from tests import oracle


# --- response files -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("most", [1, 7, 64, 10_000])
def test_every_line_is_read_once_whatever_the_ranges(tmp_path, most):
    rng = random.Random(most)
    lines = [("x" * rng.choice((0, 1, 6, 7, 8, 200)) + "é") * rng.choice((0, 1)) for _ in range(60)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.txt").write_bytes(b"one\r\n\r\ntwo\r\n")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"no")
    path = str(tmp_path)
    got = [r for p in documents.ranges(documents.files_of(path), most) for b in documents.read_range(path, p)
           for r in b.to_pylist()]
    assert [r["line"] for r in got if r["file"] == "a.txt"] == [x for x in lines if x]
    assert [(r["start"], r["line"]) for r in got if r["file"] == "b.txt"] == [(0, "one"), (7, "two")]
    raw = (tmp_path / "a.txt").read_bytes()
    assert all(raw[r["start"]:].startswith(r["line"].encode()) for r in got if r["file"] == "a.txt")


def test_a_line_longer_than_the_read_buffer(tmp_path):
    long = "y" * 200_000
    (tmp_path / "a").write_text(f"{long}\nshort\n")
    parts = documents.ranges(documents.files_of(str(tmp_path)), 50_000)
    assert [r["line"] for p in parts for b in documents.read_range(str(tmp_path), p) for r in b.to_pylist()] == [long, "short"]


def test_malformed_documents_are_kept_apart(spark, tmp_path):
    whole = json.dumps({"form_id": 1, "blocks": [{"lines": [{"text": "12 x", "words": [{"text": "12", "confidence": 0.5}]}]}]})
    bad = [whole[:-3], "text", "[1, 2]", "17", '{"form_id": "no number"}']
    (tmp_path / "a.json").write_text("\n".join([whole, *bad, "", '{"form_id": 2}']))
    got = documents.read_documents(spark, str(tmp_path), responses.RESPONSE_B, suffix=".json", rangeBytes=16).collect()
    assert sorted(r["malformed"] for r in got if r["malformed"] is not None) == sorted(bad)
    assert sorted(r["form_id"] for r in got if r["malformed"] is None) == [1, 2]
    (tmp_path / "empty").mkdir()
    assert documents.read_documents(spark, str(tmp_path / "empty"), responses.RESPONSE_B).count() == 0


def test_responses_hold_the_words_of_their_rows(spark):
    """A's documents are built by array operations, none of them for each symbol in an expression."""
    sf = f"{oracle.DATA}/sf0.001"
    docs = derive.responses_a(spark, sf)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
    words = {}
    for w in derive.page_words(spark, sf).orderBy("form_id", "box_id").collect():
        words.setdefault(w.form_id, []).append(w)
    got = {r.form_id: r.pages for r in docs.collect()}
    assert got.keys() == words.keys() and {len(p) for p in got.values()} == {1}
    for form, [page] in got.items():
        pairs = [(block, q) for block in page.blocks for q in block.paragraphs]
        assert len(pairs) == len(words[form]) and all(len(q.words) == 1 for _, q in pairs)
        assert len(page.blocks) == len({w.pos for w in words[form]})
        for w, (block, q) in zip(words[form], pairs):
            box = [(w.x, w.y), (w.x + w.w, w.y), (w.x + w.w, w.y + w.h), (w.x, w.y + w.h)]
            top = w.pos * 36.0
            outline = [(100.0, top), (700.0, top), (700.0, top + 20), (100.0, top + 20)]
            assert [tuple(v) for v in block.vertices] == ([] if w.seed % 23 == 0 else outline)
            assert [tuple(v) for v in q.vertices] == box
            assert [tuple(v) for v in q.words[0].vertices] == (box[:3] if w.seed % 19 == 0 else box)
            assert q.words[0].confidence == (None if w.seed % 17 == 0 and w.k == 0 else w.confidence)
            assert [tuple(s) for s in q.words[0].symbols] == [
                (c, None if (w.seed + i) % 5 == 0 else (60 + (w.seed + i) % 40) / 100) for i, c in enumerate(w.text)]


def test_symbols_of_any_letters():
    texts = ["añb", "", None, "😀1", "x" * 90]
    got = derive._symbols(pa.array(texts), np.arange(5)).to_pylist()
    assert [s if s is None else "".join(v["text"] for v in s) for s in got] == texts
    assert [v["confidence"] for v in got[3]] == [0.63, 0.64] and got[0][0]["confidence"] is None


def test_files_are_packed_at_the_chosen_level(spark, tmp_path):
    lines = [f'{{"form_id": {i}, "text": "{i * 7919 % 104729} words of {i % 13}"}}' for i in range(3000)]
    documents.write_lines(spark.createDataFrame([(v,) for v in lines], "line string").coalesce(1), str(tmp_path / "out"))
    [(name, size)] = documents.files_of(str(tmp_path / "out"))
    raw = gzip.decompress((tmp_path / "out" / name).read_bytes())
    assert raw.decode().splitlines() == lines and size > len(gzip.compress(raw, 6))


def test_documents_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text('{"form_id": 1}\n{"form_id": 2}\n')
    read = documents.read_documents(spark, str(tmp_path / "in"), responses.RESPONSE_B, stream=True).select("form_id")

    def run():
        query = (read.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
        query.awaitTermination()
        return sorted(r.form_id for r in spark.read.schema("form_id bigint").parquet(str(tmp_path / "out")).collect())

    assert run() == [1, 2]
    (tmp_path / "in" / "2").write_text('{"form_id": 3}')
    assert run() == [1, 2, 3]


# --- bucketed snapshots -------------------------------------------------------------------------------------------------
KEYS = "key_id bigint, is_active boolean, last_used_at timestamp_ntz, revoked_at timestamp_ntz, name string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names
            if f.endswith(".parquet")}


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    keys = spark.createDataFrame([(i, True, None, None, f"k{i}") for i in range(200)] + [(None, True, None, None, "none")], KEYS)
    table = BucketedTable(spark, str(tmp_path / "t"), "key_id", buckets=16).create(keys)
    before = files(tmp_path / "t")
    now = dt.datetime(2024, 3, 1)
    changes = spark.createDataFrame([(3, now), (3, now - dt.timedelta(days=1)), (7, now), (999, now)],
                                    "key_id bigint, last_used_at timestamp_ntz")
    touched = table.apply_key_changes(changes)
    after = files(tmp_path / "t")
    same = {f for f in before if f"bucket={touched[0]}/" not in f and all(f"bucket={b}/" not in f for b in touched)}
    assert len(touched) <= 3 and same and all(after.get(f) == before[f] for f in same)
    want = sinks.apply_key_changes(keys, changes)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
    assert table.apply_key_changes(changes.limit(0)) == [] and files(tmp_path / "t") == after


def test_deleting_all_rows_of_a_bucket_empties_it(spark, tmp_path):
    keys = spark.createDataFrame([(i, True, None, None, "k") for i in range(40)], KEYS)
    table = BucketedTable(spark, str(tmp_path / "t"), "key_id", buckets=8).create(keys)
    one = table.read([2]).select("key_id")
    gone = {r.key_id for r in one.collect()}
    assert gone and table.delete(spark.createDataFrame([(k,) for k in gone], "key_id bigint")) == [2]
    assert {r.key_id for r in table.read().collect()} == set(range(40)) - gone
    table.delete(table.read().select("key_id").filter("key_id > 0"))
    assert {r.key_id for r in table.read().collect()} == {0} - gone


def test_bucketed_upserts_equal_the_whole_snapshot(spark, tmp_path):
    schema = "user_id bigint, email string, is_active boolean, created_at timestamp_ntz"
    users = spark.createDataFrame([(i, f"u{i}@a.com", True, None) for i in range(30)], schema)
    incoming = spark.createDataFrame(
        [(3, "u3@a.com", False, None), (4, "new@a.com", None, None), (50, "u5@a.com", True, None), (60, "x@a.com", True, None),
         (61, "x@a.com", True, None), (62, "bad", True, None), (None, "n@a.com", True, None)], schema)
    table = BucketedTable(spark, str(tmp_path / "t"), "user_id", buckets=8).create(users)
    touched, refused = table.upsert_users(incoming)
    want = sinks.upsert_users(users, incoming)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
    assert {r.reason for r in refused.collect()} == {"malformed", "taken"} and len(touched) <= 4


# --- counters by batch --------------------------------------------------------------------------------------------------
EVENTS = "user_id bigint, resource string, quantity bigint, created_at timestamp_ntz"


@pytest.mark.parametrize("fold_after", [1, 2, 100])
def test_replays_and_late_corrections_give_the_batch_result(spark, tmp_path, fold_after):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    batches = [[(rng.randrange(4), "scan", rng.randrange(1, 5), start + dt.timedelta(hours=rng.randrange(24 * 40)))
                for _ in range(30)] for _ in range(5)]
    batches[4].append((1, "scan", -3, start))
    frames = [spark.createDataFrame(b, EVENTS) for b in batches]
    store = CounterStore(spark, str(tmp_path / "c"), fold_after)
    assert store.read().count() == 0
    for number in (0, 1, 1, 0, 2, 3, 2, 4, 4, 0):
        store.merge(frames[number], number)
    store.fold()
    store.fold()
    store.merge(frames[3], 3)
    want = metering.usage_counters(spark.createDataFrame([r for b in batches for r in b], EVENTS))
    columns = sorted(want.columns)
    assert sorted(map(str, store.read().select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_an_unfinished_table_does_not_count(spark, tmp_path):
    store = CounterStore(spark, str(tmp_path / "c"), 100)
    store.merge(spark.createDataFrame([(1, "scan", 2, dt.datetime(2024, 1, 1))], EVENTS), 0)
    os.makedirs(tmp_path / "c" / "base" / "7")
    os.makedirs(tmp_path / "c" / "batch" / "1")
    assert store.read().filter("period_type = 'daily'").first()["count_current"] == 2


# --- the surest reading, kept in a stream -----------------------------------------------------------------------------------
def test_best_readings_over_micro_batches_equal_the_batch_rule(spark, tmp_path):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(3), str(rng.randrange(6)), i, rng.choice((None, 0.2, 0.5, 0.9)), f"r{i}",
             start + dt.timedelta(minutes=rng.randrange(600))) for i in range(90)]
    schema = "form_id bigint, id_number string, ord bigint, confidence double, tag string, arrived timestamp"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream, end = jobs.with_end(stream, "arrived")
    got = jobs.drain(best.best_readings(stream, "1 day"), "best", ends=(end,), settings=best.STATE_STORE)
    want = dedupe_best(spark.createDataFrame(rows, schema).drop("arrived"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_reading_after_the_watermark_starts_anew(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    schema = "form_id bigint, id_number string, ord bigint, confidence double, arrived timestamp"
    batches = [[(1, "a", 5, 0.3, day)], [(1, "a", 4, 0.9, day + dt.timedelta(minutes=5))],
               [(2, "b", 1, 0.1, day + dt.timedelta(hours=3))], [(1, "a", 9, 0.2, day + dt.timedelta(hours=4))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream, end = jobs.with_end(read.select("form_id", "id_number", "ord", "confidence", "arrived"), "arrived")
    got = jobs.drain(best.best_readings(stream, "10 minutes"), "best", ends=(end,), settings=best.STATE_STORE)
    rows = sorted((r.form_id, r.id_number, r.ord, r.confidence) for r in got.collect())
    assert rows == [(1, "a", 4, 0.9), (1, "a", 9, 0.2), (2, "b", 1, 0.1)]


# --- metadata and table rules -----------------------------------------------------------------------------------------------
def test_metadata_of_any_shape(spark):
    rows = [(1, '{"k": 1, "note": "a", "both": 1, "deep": {"x": [1]}}'), (2, '{"k": 2.5, "both": "b", "a\'b": true, "c\'\\"d": 7}'), (3, None),
            (4, "no json"), (5, "[1, 2]"), (6, "{}")]
    df = spark.createDataFrame(rows, "event_id bigint, props string")
    got = {r["m_event"]: r for r in metadata.variant_columns(df.withColumnRenamed("event_id", "m_event"), "props", "m_").collect()}
    assert float(got[1]["m_k"]) == 1 and float(got[2]["m_k"]) == 2.5 and got[1]["m_note"] == "a"
    assert (got[1]["m_both"], got[2]["m_both"]) == ("1", "b") and got[2]["m_a'b"] is True and got[2]["m_c'\"d"] == 7
    assert json.loads(got[1]["m_deep"]) == {"x": [1]}
    assert all(got[k]["m_k"] is None for k in (3, 4, 5, 6))
    assert metadata.variant_columns(df, "props", keys=("note",)).columns == ["event_id", "note"]
    assert metadata.variant_columns(df.filter("event_id > 2"), "props").columns == ["event_id"]


def test_table_rules(spark):
    tables = {
        "users": spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u2", None), (None, None)], "id string, email string"),
        "api_keys": spark.createDataFrame([("k1", "u1", "h"), ("k2", "u9", "i"), ("k3", "u9", "j"), ("k4", None, "j")],
                                          "id string, user_id string, key_hash string"),
        "api_key_scopes": spark.createDataFrame([("k1", 1), ("k1", 1), ("k8", 2)], "api_key_id string, scope_id smallint"),
    }
    got = sorted((r.table_name, r.rule, r["columns"], r.value, r.n) for r in constraints.violations(tables).collect())
    assert got == [
        ("api_key_scopes", "repeated", "api_key_id, scope_id", "k1, 1", 2), ("api_key_scopes", "unknown", "api_key_id", "k8", 1),
        ("api_keys", "repeated", "key_hash", "j", 2), ("api_keys", "unknown", "user_id", "u9", 2),
        ("users", "missing", "id", "NULL", 1), ("users", "repeated", "email", "a", 2), ("users", "repeated", "id", "u2", 2)]
    assert constraints.violations({k: v.limit(0) for k, v in tables.items()}).count() == 0
    with pytest.raises(ValueError):
        constraints.violations({"users": spark.range(1).select(F.col("id").alias("x"))})


# --- image metrics over tiles -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("height, width, size", [(3, 3, 1), (11, 7, 4), (9, 9, 3), (17, 5, 128)])
def test_tiles_of_any_size_give_the_metrics_of_the_image(spark, height, width, size):
    rng = np.random.default_rng(height)
    image = rng.integers(0, 256, (height, width))
    pixels = spark.createDataFrame([(1, "s", y, x, int(image[y, x])) for y in range(height) for x in range(width)],
                                   "image_id bigint, stage string, y bigint, x bigint, v bigint")
    got = quality.pixel_metrics(pixels, size, 300).first()
    p = np.pad(image, 2, "reflect").astype(float)
    at = lambda dy, dx: p[2 + dy:height + 2 + dy, 2 + dx:width + 2 + dx]
    laplacian = at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4 * image
    taps = (1, 4, 6, 4, 1)
    blur = sum(a * b * at(i - 2, j - 2) for i, a in enumerate(taps) for j, b in enumerate(taps))
    sobel = [sum((2 - abs(e)) * d * (at(d, e) if k else at(e, d)) for d in (-1, 1) for e in (-1, 0, 1)) for k in (0, 1)]
    assert got.sharpness == pytest.approx(laplacian.var()) and got.contrast == pytest.approx(image.std())
    assert got.brightness == pytest.approx(image.mean())
    assert got.noise_level == pytest.approx(np.abs(image - np.floor((blur + 128) / 256)).mean())
    assert got.edge_density == pytest.approx((abs(sobel[0]) + abs(sobel[1]) >= 300).mean())
    assert quality.pixel_metrics(pixels.limit(0)).count() == 0
