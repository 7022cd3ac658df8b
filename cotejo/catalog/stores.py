"""Stored inputs and outputs: response files, bucketed snapshots, counters by batch, metadata, table rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cotejo.catalog import accounts, layout
from cotejo.catalog.accounts import AS_OF, moment
from cotejo.operators import constraints, metadata
from cotejo.plans import derive, derive_accounts as acc
from cotejo.plans.derive_accounts import with_accounts
from cotejo.session import checkpoint_root
from cotejo.sources import documents, responses, sinks
from cotejo.sources.snapshots import BucketedTable
from cotejo.streaming import best, jobs
from cotejo.streaming.counters import CounterStore, keep_counters

c = F.col


def _path(spark, name):
    return f"{checkpoint_root(spark)}/cotejo-{name}-{uuid.uuid4().hex}"


def _documents_a(spark, sf, path):
    """Recogniser A's responses as JSON lines; some forms come a second time, cut off or as plain text."""
    lines = derive.responses_a(spark, sf).select("form_id", F.to_json(F.struct("*")).alias("line"))
    cut = F.when(c("form_id") % 50 == 0, F.expr("left(line, length(line) div 2)"))
    text = F.when(c("form_id") % 70 == 0, F.concat(F.lit("form "), "form_id"))
    again = F.array_compact(F.array("line", cut, text))
    documents.write_lines(lines.select(F.explode(again).alias("line")), path)


def s1_response_files(spark, sf):
    path = _path(spark, "responses-a")
    _documents_a(spark, sf, path)
    whole = documents.read_documents(spark, path, responses.RESPONSE_A).filter(c("malformed").isNull())
    return responses.scan_symbols(whole)


def s1_malformed_documents(spark, sf):
    path = _path(spark, "responses-a")
    _documents_a(spark, sf, path)
    found = documents.read_documents(spark, path, responses.RESPONSE_A, rangeBytes=1 << 20)
    kind = F.when(c("malformed").isNull(), "whole").when(c("malformed").startswith("{"), "cut off").otherwise("no document")
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def s2_response_stream(spark, sf):
    """The same source as a stream."""
    path = _path(spark, "responses-b")
    documents.write_documents(derive.responses_b(spark, sf), path)
    read = documents.read_documents(spark, path, responses.RESPONSE_B, stream=True)
    return jobs.drain(responses.scan_words(read), "responses")


def s7_violations(spark, sf):
    ks, us = acc.keys(spark, sf), acc.users(spark, sf)
    plans = acc.subscriptions(spark, sf)
    return constraints.violations({
        "users": us.select(c("user_id").alias("id"), "email"),
        "api_keys": ks.select(c("key_id").alias("id"), "user_id", "key_hash"),
        "api_permission_scopes": acc.scopes(spark, sf).select("id", "code"),
        "api_key_scopes": acc.key_scopes(spark, sf).select(c("key_id").alias("api_key_id"), "scope_id"),
        "usage_events": acc.usage_events(spark, sf).select(
            F.when(c("event_id") % 500 != 0, c("event_id")).alias("id"), "user_id"),
        "usage_event_metadata": acc.usage_events(spark, sf).select(
            c("event_id").alias("id"), (c("event_id") - c("event_id") % 2).alias("usage_event_id")),
        "user_subscriptions": plans.select(c("user_id").alias("id"), "user_id"),
        "invoices": derive.table(spark, sf, "orders").filter(c("o_orderkey") % 100 != 0).select(c("o_orderkey").alias("id")),
        "invoice_line_items": acc.invoice_lines(spark, sf).select("invoice_id"),
    })


def s8_validation_records(spark, sf):
    rows = accounts._validated(spark, sf)
    records = sinks.to_validation_records(rows.withColumns({
        "details": F.struct("form_id", "pos"), "written_names": c("names"),
        "digital_names": F.array_join(F.transform("matches", lambda m: m["compared"]), " ")}))
    first = c("matches")["first_name"]
    return records.select(
        "details.form_id", "details.pos", "status", "action", F.round("confidence", 6).alias("confidence"),
        "digital_nombres", F.size(F.map_keys("matches")).alias("n_matches"), first["match"].alias("first_name_match"))


def s10_bucketed_changes(spark, sf):
    table = BucketedTable(spark, _path(spark, "keys"), "key_id").create(acc.keys(spark, sf))
    used = accounts.ops.last_use(accounts._authorized(spark, sf))
    for half in (0, 1):
        table.apply_key_changes(used.filter(c("key_id") % 2 == half))
    return table.read().select("key_id", "is_active", "last_used_at", "revoked_at")


def s11_bucketed_deletes(spark, sf):
    table = BucketedTable(spark, _path(spark, "keys"), "key_id").create(acc.keys(spark, sf))
    table.delete(acc.keys(spark, sf).filter(c("revoked_at").isNotNull()).select("key_id"))
    return table.read().select("key_id", "name")


def s12_bucketed_upserts(spark, sf):
    n = acc.users(spark, sf)
    table = BucketedTable(spark, _path(spark, "users"), "user_id").create(n.filter(c("user_id") % 3 != 2))
    moved = n.withColumns({"user_id": F.when(c("user_id") % 5 == 0, c("user_id") + 1000000).otherwise(c("user_id")),
                           "is_active": ~c("is_active"), "last_login_at": moment(AS_OF)})
    table.upsert_users(moved.filter(c("email_verified")))
    return table.read().select("user_id", "email", "is_active", "last_login_at")


def _usage_files(spark, sf, path, files):
    """Usage events dealt to files by number, so that each holds events of all times."""
    usage = acc.usage_events(spark, sf).select("event_id", "user_id", "resource", "quantity", "created_at")
    usage.repartitionByRange(files, "event_id").drop("event_id").write.parquet(path)
    return usage.drop("event_id").schema


def g15_incremental_counters(spark, sf):
    """Counters over five batches, two of them folded into the base; then the first and the last batch come again."""
    path = _path(spark, "usage")
    schema = _usage_files(spark, sf, f"{path}/events", 5)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/events")
    store = CounterStore(spark, f"{path}/counters", fold_after=2)
    keep_counters(stream, store, f"{path}/checkpoint")
    store.merge(spark.read.schema(schema).parquet(f"{path}/events"), 0)
    return store.read()


def g18_variant_columns(spark, sf):
    usage = acc.usage_events(spark, sf).select("event_id", "props", "resource")
    odd = F.when(c("event_id") % 97 == 0, F.lit("no json")).when(c("event_id") % 89 == 0, F.lit("[1]")).otherwise(c("props"))
    return metadata.variant_columns(usage.withColumn("props", odd), "props").withColumn("k", c("k").cast("string"))


def x3_best_readings(spark, sf):
    e = c("event_id")
    readings = derive.table(spark, sf, "events").select(
        (c("user_id") % 20).alias("form_id"), (e % 100).cast("string").alias("id_number"), e.alias("ord"),
        F.when(e % 11 != 0, (e * 37 % 101) / 100.0).alias("confidence"), (e * 7).alias("seed"), c("ts").cast("timestamp").alias("arrived"))
    path = _path(spark, "readings")
    readings.repartitionByRange(4, "ord").write.parquet(path)
    stream = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream, end = jobs.with_end(stream, "arrived")
    kept = jobs.drain(best.best_readings(stream, "60 days"), "best", ends=(end,), settings=best.STATE_STORE)
    return kept.select("form_id", "id_number", "ord", "confidence", "seed")


QUERIES = {
    "s1_response_files": (s1_response_files, layout.QUERIES["s1_scan_symbols"][1]),
    "s1_malformed_documents": (s1_malformed_documents, """
WITH forms AS (SELECT DISTINCT l_orderkey AS form_id FROM lineitem)
SELECT 'whole' AS kind, count(*) AS n FROM forms
UNION ALL SELECT 'cut off', count(*) FROM forms WHERE form_id % 50 = 0 HAVING count(*) > 0
UNION ALL SELECT 'no document', count(*) FROM forms WHERE form_id % 70 = 0 HAVING count(*) > 0"""),
    "s2_response_stream": (s2_response_stream, layout.QUERIES["s2_scan_words"][1]),
    "s7_violations": (s7_violations, with_accounts("""
SELECT 'users' AS table_name, 'repeated' AS rule, 'email' AS columns, email AS value, count(*) AS n
FROM users GROUP BY email HAVING count(*) > 1
UNION ALL SELECT 'api_keys', 'unknown', 'user_id', CAST(user_id AS VARCHAR), count(*)
FROM keys WHERE user_id NOT IN (SELECT user_id FROM users) GROUP BY user_id
UNION ALL SELECT 'usage_events', 'unknown', 'user_id', CAST(user_id AS VARCHAR), count(*)
FROM usage WHERE user_id NOT IN (SELECT user_id FROM users) GROUP BY user_id
UNION ALL SELECT 'usage_events', 'missing', 'id', 'NULL', count(*) FROM usage WHERE event_id % 500 = 0 HAVING count(*) > 0
UNION ALL SELECT 'usage_event_metadata', 'unknown', 'usage_event_id', CAST(event_id - event_id % 2 AS VARCHAR), count(*)
FROM usage WHERE event_id - event_id % 2 NOT IN (SELECT event_id FROM usage WHERE event_id % 500 <> 0)
GROUP BY event_id - event_id % 2
UNION ALL SELECT 'user_subscriptions', 'unknown', 'user_id', CAST(user_id AS VARCHAR), count(*)
FROM subscriptions WHERE user_id NOT IN (SELECT user_id FROM users) GROUP BY user_id
UNION ALL SELECT 'user_subscriptions', 'repeated', 'id', CAST(user_id AS VARCHAR), count(*)
FROM subscriptions GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT 'invoice_line_items', 'unknown', 'invoice_id', CAST(l_orderkey AS VARCHAR), count(*)
FROM lineitem WHERE l_orderkey % 100 = 0 GROUP BY l_orderkey""")),
    "s8_validation_records": (s8_validation_records, "WITH" + accounts.AB_SQL + accounts._VALID + """
SELECT form_id, pos, lower(status) AS status, lower(action) AS action, round(confidence, 6) AS confidence,
       CASE WHEN found THEN first_name || ' ' || first_surname ELSE '' END AS digital_nombres,
       CASE WHEN found THEN 2 ELSE 0 END AS n_matches, CASE WHEN found THEN s1 >= 0.85e0 END AS first_name_match
FROM checked"""),
    "s10_bucketed_changes": (s10_bucketed_changes, accounts.QUERIES["s10_apply_key_changes"][1]),
    "s11_bucketed_deletes": (s11_bucketed_deletes, accounts.QUERIES["s11_delete_keys"][1]),
    "s12_bucketed_upserts": (s12_bucketed_upserts, accounts.QUERIES["s12_upsert_users"][1]),
    "g15_incremental_counters": (g15_incremental_counters, accounts.QUERIES["g15_usage_counters"][1]),
    "g18_variant_columns": (g18_variant_columns, """
SELECT event_id, CASE WHEN event_id % 97 <> 0 AND event_id % 89 <> 0 THEN json_extract_string(props, '$.k') END AS k,
       event_type AS resource FROM events"""),
    "x3_best_readings": (x3_best_readings, """
SELECT form_id, id_number, min(ord) AS ord, max(confidence) AS confidence,
       first(ord * 7 ORDER BY confidence DESC NULLS LAST, ord) AS seed
FROM (SELECT user_id % 20 AS form_id, CAST(event_id % 100 AS VARCHAR) AS id_number, event_id AS ord,
             CASE WHEN event_id % 11 <> 0 THEN (event_id * 37 % 101) / 100.0e0 END AS confidence FROM events)
GROUP BY form_id, id_number"""),
}
