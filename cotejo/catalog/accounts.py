"""Queries of keys, scopes, users, usage and invoices (inventory S7-S12, N10-N21, F8-F10, J10-J17, G9-G18, L1-L3, T15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.functions import account
from cotejo.operators import keys as ops, metering, quality, validation
from cotejo.plans import derive, derive_accounts as acc
from cotejo.plans.derive import AB_SQL
from cotejo.plans.derive_accounts import AS_OF, moment, with_accounts
from cotejo.sources import sinks, tables

c = F.col
NOW = f"TIMESTAMP '{AS_OF}'"


def n10_billable_amount(spark, sf):
    u = acc.usage_events(spark, sf)
    return u.select("event_id", account.billable_amount(c("provider_cost_usd"), c("markup_percentage")).alias("billable"))


def n11_quota(spark, sf):
    counts = acc.usage_events(spark, sf).groupBy("user_id").agg(F.count("*").alias("count_current"))
    limits = acc.subscriptions(spark, sf).select("user_id", F.when(c("user_id") % 4 != 0, 40 + c("user_id") % 50).alias("limit_max"))
    return metering.quota_state(counts, limits)


def _invoices(spark, sf):
    day = c("o_orderdate")
    return derive.table(spark, sf, "orders").select(
        c("o_orderkey").alias("invoice_id"), F.when(c("o_orderstatus") == "F", day + F.expr("INTERVAL 10 DAYS")).alias("paid_at"),
        F.when(c("o_orderkey") % 13 != 0, day + F.expr("INTERVAL 30 DAYS")).alias("due_at"),
    )


def n12_invoice_state(spark, sf):
    return _invoices(spark, sf).select(
        "invoice_id", account.is_paid(c("paid_at")).alias("paid"),
        account.is_overdue(c("paid_at"), c("due_at"), moment("1998-01-01 00:00:00")).alias("overdue"),
    )


def n13_subscription_state(spark, sf):
    return acc.subscriptions(spark, sf).select(
        "user_id", account.subscription_active(c("current_period_end"), c("cancelled_at"), moment(AS_OF)).alias("active"),
        account.is_trial(c("trial_ends_at"), moment(AS_OF)).alias("trial"),
    )


def n14_annual_discount(spark, sf):
    monthly = F.when(c("p_partkey") % 19 != 0, c("p_retailprice").cast("decimal(10,2)")).otherwise(F.lit(0).cast("decimal(10,2)"))
    annual = (c("p_retailprice").cast("decimal(10,2)") * (c("p_size") % 5 + 8)).cast("decimal(10,2)")
    priced = derive.table(spark, sf, "part").select(
        "p_partkey", monthly.alias("m"), F.when(c("p_partkey") % 23 != 0, annual).alias("a"))
    return priced.select("p_partkey", account.annual_discount_pct(c("m"), c("a")).alias("discount_pct"))


def n15_key_valid(spark, sf):
    valid = account.key_valid(c("is_active"), c("revoked_at"), c("expires_at"), moment(AS_OF))
    return acc.keys(spark, sf).select("key_id", valid.alias("valid"))


def n16_expires_at(spark, sf):
    days = F.when(c("key_id") % 9 != 0, (c("key_id") % 400 - 10).cast("int"))
    return acc.keys(spark, sf).select("key_id", account.expires_at(c("created_at"), days).alias("expires_at"))


def n17_state_changes(spark, sf):
    changed = sinks.with_changes(acc.keys(spark, sf), account.revoke(moment(AS_OF)) | account.record_usage(moment(AS_OF)))
    logged = sinks.with_changes(
        acc.users(spark, sf), account.record_login(moment(AS_OF)) | account.verify_email(moment(AS_OF)))
    on, off = [sinks.with_changes(logged.filter(c("user_id") % 2 == int(not active)), account.set_active(active, moment(AS_OF)))
               for active in (True, False)]
    k = changed.select(F.lit("key").alias("kind"), c("key_id").alias("id"), "is_active", c("revoked_at").alias("t1"),
                       c("last_used_at").alias("t2"), F.lit(None).cast("boolean").alias("email_verified"))
    u = on.unionByName(off).select(
        F.lit("user").alias("kind"), c("user_id").alias("id"), "is_active", c("last_login_at").alias("t1"),
        c("updated_at").alias("t2"), "email_verified")
    return k.unionByName(u)


def n18_scope_parts(spark, sf):
    raw = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.upper("code"))).when(c("p_partkey") % 7 == 0, F.concat("code", F.lit(":x"))).otherwise(c("code"))
    code = account.normalize_scope(raw)
    return acc.part_codes(spark, sf).select("p_partkey", code.alias("code"), account.scope_category(code).alias("category"),
                                            account.scope_action(code).alias("action"))


def n19_key_hash(spark, sf):
    key = F.when(c("c_custkey") % 6 == 0, F.concat(F.lit("key_"), c("c_name"))).otherwise(acc.key_text(c("c_custkey")))
    return derive.table(spark, sf, "customer").select(
        "c_custkey", account.is_key_format(key).alias("well_formed"), account.key_hash(key).alias("key_hash"),
        account.key_prefix(key).alias("prefix"), account.is_hash_format(account.key_hash(key)).alias("hash_ok"))


def n20_clean_email(spark, sf):
    return acc.users(spark, sf).select("user_id", account.clean_email(c("email")).alias("email"))


def n21_strict_email_reasons(spark, sf):
    return acc.users(spark, sf).select("user_id", F.array_join(account.strict_email_reasons(c("email")), ",").alias("reasons"))


def f8_can_authenticate(spark, sf):
    return acc.users(spark, sf).filter(account.can_authenticate(c("is_active"), c("email_verified"))).select("user_id", "email")


def f9_active_keys_and_scopes(spark, sf):
    valid = account.key_valid(c("is_active"), c("revoked_at"), c("expires_at"), moment(AS_OF))
    k = acc.keys(spark, sf).filter(valid).select(F.lit("key").alias("kind"), c("key_id").alias("id"), c("key_prefix").alias("label"))
    s = acc.scopes(spark, sf).filter("is_active").select(F.lit("scope").alias("kind"), "id", c("code").alias("label"))
    return k.unionByName(s)


def s7_usage_event_table(spark, sf):
    u = acc.usage_events(spark, sf).withColumns({"id": c("event_id"), "event_type_id": F.length("resource")})
    billable = account.billable_amount(c("provider_cost_usd"), c("markup_percentage"))
    return tables.conform(u.withColumn("billable_amount_usd", billable), "usage_events").drop("resource_id", "resource_table")


def s8_id_records(spark, sf):
    r = sinks.to_id_records(derive.readings_a(spark, sf))
    return r.select("cedula", F.round("confidence", 6).alias("confidence"), "index")


def _new_keys(spark, sf):
    held = acc.key_codes(spark, sf)
    odd = F.when(c("key_id") % 8 == 0, F.concat("code", F.lit("_x"))).otherwise(c("code"))
    codes = held.groupBy("key_id").agg(F.collect_list(odd).alias("scopes"))
    return acc.keys(spark, sf).select("key_id", "user_id", "key_hash").join(codes, "key_id")


def s9_insert_keys(spark, sf):
    return sinks.insert_keys(_new_keys(spark, sf), acc.scopes(spark, sf))[1]


def _authorized(spark, sf):
    ks = ops.keys_with_scopes(acc.keys(spark, sf), acc.key_scopes(spark, sf), acc.scopes(spark, sf))
    return ops.authorize(acc.requests(spark, sf), ks, moment(AS_OF))


def s10_apply_key_changes(spark, sf):
    return sinks.apply_key_changes(acc.keys(spark, sf), ops.last_use(_authorized(spark, sf))).select(
        "key_id", "is_active", "last_used_at", "revoked_at")


def s11_delete_keys(spark, sf):
    gone = acc.keys(spark, sf).filter(c("revoked_at").isNotNull())
    return sinks.delete_by_id(acc.keys(spark, sf), gone, "key_id").select("key_id", "name")


def s12_upsert_users(spark, sf):
    current = acc.users(spark, sf).filter(c("user_id") % 3 != 2)
    n = acc.users(spark, sf)
    moved = n.withColumns({"user_id": F.when(c("user_id") % 5 == 0, c("user_id") + 1000000).otherwise(c("user_id")),
                           "is_active": ~c("is_active"), "last_login_at": moment(AS_OF)})
    return sinks.upsert_users(current, moved.filter(c("email_verified"))).select("user_id", "email", "is_active", "last_login_at")


def j10_key_lookup(spark, sf):
    ks = ops.keys_with_scopes(acc.keys(spark, sf), acc.key_scopes(spark, sf), acc.scopes(spark, sf))
    probes = acc.requests(spark, sf).select(account.key_hash(c("key")).alias("key_hash")).distinct()
    return ks.join(probes, "key_hash", "left_semi").select("key_id", "user_id", F.array_join("scopes", ",").alias("scopes"))


def j11_scope_code_validation(spark, sf):
    _, bad = sinks.reject_bad_scopes(_new_keys(spark, sf), acc.scopes(spark, sf))
    return bad.select("key_id", F.array_join("bad_codes", ",").alias("bad_codes"))


def j12_authorize_requests(spark, sf):
    return _authorized(spark, sf).select("request_id", "key_id", "status")


def _form_rows(spark, sf):
    part = derive.table(spark, sf, "part").select(c("p_partkey").alias("part_id"), "p_name")
    typo = F.when(c("seed") % 4 == 0, F.left("p_name", F.length("p_name") - 1)).when(
        c("seed") % 9 == 0, F.translate("p_name", "eo", "cz")).otherwise(F.upper("p_name"))
    b = derive.readings_b(spark, sf).join(part, "part_id")
    return b.select("form_id", "pos", "seed", "id_number", typo.alias("names"))


def _validated(spark, sf):
    return validation.validate_rows(_form_rows(spark, sf), acc.registry(spark, sf))


def j13_validate_rows(spark, sf):
    return _validated(spark, sf).select("form_id", "pos", "seed", "status", "action", F.round("confidence", 6).alias("confidence"))


def f10_decision_flags(spark, sf):
    return _validated(spark, sf).groupBy("is_valid", "requires_user_action", "can_auto_save").agg(F.count("*").alias("n"))


def t15_match_summary(spark, sf):
    return _validated(spark, sf).select("form_id", "pos", "seed", account.match_summary(c("matches")).alias("summary"))


def g13_processing_summary(spark, sf):
    decision = F.when(c("seed") % 3 == 0, "save").when(c("seed") % 3 == 1, "skip").otherwise("correct")
    rows = _validated(spark, sf).withColumns(
        {"is_empty": c("seed") % 41 == 0, "user_decision": decision, "batch": c("form_id") % 10})
    return validation.processing_summary(rows, "batch")


def j14_user_lookup(spark, sf):
    cleaned = account.clean_email(c("email"))
    us = acc.users(spark, sf).withColumn("email", cleaned).filter(c("email").isNotNull())
    probes = derive.table(spark, sf, "orders").select(
        F.concat(F.lower(F.format_string("customer.%09d", c("o_custkey"))), F.lit("@building.com")).alias("email")).distinct()
    known = us.select("email", "user_id")
    return probes.join(known, "email", "left").select("email", "user_id", c("user_id").isNotNull().alias("found"))


def j15_effective_limits(spark, sf):
    return ops.effective_limits(acc.keys(spark, sf), acc.subscriptions(spark, sf), acc.plan_limits(spark, sf),
                                acc.custom_limits(spark, sf), moment(AS_OF))


def j16_star_joins(spark, sf):
    """Event to type to resource, and user to profile; lookups are joined without hints, Spark checks their size."""
    kinds = derive.table(spark, sf, "events").select(c("event_type").alias("code")).distinct().select(
        "code", F.length("code").alias("resource_type_id"))
    resources = kinds.groupBy("resource_type_id").agg(F.min("code").alias("resource_name"))
    people = derive.table(spark, sf, "customer").select(c("c_custkey").alias("user_id"), "c_nationkey")
    nations = derive.table(spark, sf, "nation").select(c("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    regions = derive.table(spark, sf, "region").select(c("r_regionkey").alias("n_regionkey"), "r_name")
    e = acc.usage_events(spark, sf).select("event_id", "user_id", c("resource").alias("code"), "quantity")
    star = e.join(kinds, "code").join(resources, "resource_type_id").join(people, "user_id").join(nations, "c_nationkey").join(
        regions, "n_regionkey")
    return star.groupBy("resource_name", "r_name").agg(F.count("*").alias("n_events"), F.sum("quantity").alias("quantity"))


def j17_revocation_status(spark, sf):
    asked = derive.table(spark, sf, "orders").select(
        c("o_orderkey").alias("request_id"), (c("o_custkey") + F.when(c("o_orderkey") % 9 == 0, 10000000).otherwise(0)).alias("key_id"),
        F.floor((c("o_custkey") + c("o_orderkey") % 2) / 3).alias("requested_by"))
    return ops.revocation_status(asked, acc.keys(spark, sf)).select("request_id", "status")


def g9_catalog_rollup(spark, sf):
    return ops.catalog_rollup(acc.scopes(spark, sf))


def g10_key_totals(spark, sf):
    return ops.key_totals(acc.keys(spark, sf), moment(AS_OF))


def g11_user_count(spark, sf):
    return acc.users(spark, sf).agg(F.count("*").alias("n_users"))


def g15_usage_counters(spark, sf):
    return metering.usage_counters(acc.usage_events(spark, sf))


def g16_usage_cost(spark, sf):
    return metering.usage_cost(acc.usage_events(spark, sf), "user_id", "resource")


def g17_build_invoices(spark, sf):
    return metering.build_invoices(acc.invoice_lines(spark, sf))


def g18_metadata_columns(spark, sf):
    u = acc.usage_events(spark, sf)
    entries = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("resource"), c("resource")))
    meta = u.select("event_id", F.explode(entries).alias("key", "value"))
    return metering.metadata_columns(meta, ["k", "resource"])


def _pixels(spark, sf):
    """8 x 8 grey tiles from the embedding vectors, and a sharpened second stage."""
    e = derive.table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    grey = F.floor(F.abs(c("e").cast("double")) * 400) % 256
    base = e.select(c("vec_id").alias("image_id"), F.floor(c("i") / 8).alias("y"), (c("i") % 8).alias("x"), grey.alias("v"))
    stages = F.explode(F.array(
        F.struct(F.lit("original").alias("stage"), c("v").alias("v")),
        F.struct(F.lit("processed").alias("stage"), ((c("v") * 3 + c("x") * 5) % 256).alias("v"))))
    return base.select("image_id", "y", "x", stages.alias("s")).select("image_id", "y", "x", "s.stage", "s.v")


def g14_pixel_metrics(spark, sf):
    m = quality.pixel_metrics(_pixels(spark, sf))
    # The variance of 64 integers is a multiple of 1/4096; as an integer it does not depend on summation order.
    exact = F.round(c("sharpness") * 4096).cast("bigint").alias("sharpness_4096")
    return m.select("image_id", "stage", exact, *[F.round(k, 4).alias(k) for k in quality.METRICS[1:]])


def g14_compare_stages(spark, sf):
    out = quality.compare_stages(quality.pixel_metrics(_pixels(spark, sf)))
    return out.select("image_id", *[F.round(f"{k}_gain", 4).alias(f"{k}_gain") for k in quality.METRICS])


def g14_edge_density(spark, sf):
    """Small tiles, so that images fall into several."""
    return quality.pixel_metrics(_pixels(spark, sf), size=4).select("image_id", "stage", F.round("edge_density", 6).alias("edge_density"))


def l1_keys_by_creation(spark, sf):
    valid = account.key_valid(c("is_active"), c("revoked_at"), c("expires_at"), moment(AS_OF))
    return acc.keys(spark, sf).orderBy("user_id", F.desc("created_at"), "key_id").select("user_id", "key_id", "created_at", valid.alias("valid"))


def l2_scopes_in_order(spark, sf):
    return acc.scopes(spark, sf).orderBy("category", "code")


def l3_user_page(spark, sf):
    return ops.page(acc.users(spark, sf), "user_id", limit=50, offset=20).select("user_id", "email")


_LOCAL = "split_part(e, '@', 1)"
_DOMAIN = "split_part(e, '@', 2)"
_SPLIT = "length(e) - length(replace(e, '@', '')) = 1"
_TLD = f"list_extract(string_split({_DOMAIN}, '.'), -1)"
_RULES = [
    ("spaces", "contains(e, ' ')"), ("consecutive_dots", "contains(e, '..')"), ("no_at", "NOT contains(e, '@')"),
    ("many_at", "length(e) - length(replace(e, '@', '')) > 1"), ("local_empty", f"{_SPLIT} AND {_LOCAL} = ''"),
    ("local_too_long", f"{_SPLIT} AND length({_LOCAL}) > 64"),
    ("local_charset", f"{_SPLIT} AND NOT regexp_full_match({_LOCAL}, '[a-z0-9._+-]+')"),
    ("local_edge_dot", f"{_SPLIT} AND ({_LOCAL} LIKE '.%' OR {_LOCAL} LIKE '%.')"),
    ("domain_too_short", f"{_SPLIT} AND length({_DOMAIN}) < 3"),
    ("domain_charset", f"{_SPLIT} AND NOT regexp_full_match({_DOMAIN}, '[a-z0-9.-]+')"),
    ("no_tld", f"{_SPLIT} AND NOT contains({_DOMAIN}, '.')"),
    ("tld_too_short", f"{_SPLIT} AND contains({_DOMAIN}, '.') AND length({_TLD}) < 2"),
    ("tld_not_letters", f"{_SPLIT} AND contains({_DOMAIN}, '.') AND NOT regexp_full_match({_TLD}, '[a-z]+')"),
    ("disposable", f"{_SPLIT} AND {_DOMAIN} IN ({', '.join(repr(d) for d in account.DISPOSABLE_DOMAINS)})"),
    ("domain_edge_hyphen", f"{_SPLIT} AND ({_DOMAIN} LIKE '-%' OR {_DOMAIN} LIKE '%-')"),
    ("domain_edge_dot", f"{_SPLIT} AND ({_DOMAIN} LIKE '.%' OR {_DOMAIN} LIKE '%.')"),
]
_REASONS = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in _RULES)
_EMAIL = "'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'"
_CLEAN = f"CASE WHEN regexp_full_match(lower(trim(email, ' ')), {_EMAIL}) THEN lower(trim(email, ' ')) END"
_BILL = "coalesce(CAST(provider_cost_usd * CAST(1 + markup_percentage * 0.01 AS DECIMAL(9,4)) AS DECIMAL(12,6)), 0)"

_AUTH = f""",
held AS (SELECT key_id, list(code) AS scopes FROM key_codes GROUP BY key_id),
auth AS (
  SELECT request_id, ts, CASE WHEN request_id % 50 <> 0 AND request_id % 51 <> 0 THEN k.key_id END AS key_id,
         CASE WHEN request_id % 50 = 0 THEN 'BAD_FORMAT' WHEN request_id % 51 = 0 OR k.key_id IS NULL THEN 'NOT_FOUND'
              WHEN NOT valid THEN 'INVALID'
              WHEN list_has_any(coalesce(scopes, []), [code1, 'admin:all', split_part(code1, ':', 1) || ':all'])
                   AND (code2 IS NULL OR list_has_any(coalesce(scopes, []),
                                                      [code2, 'admin:all', split_part(code2, ':', 1) || ':all']))
              THEN 'OK' ELSE 'FORBIDDEN' END AS status
  FROM requests r LEFT JOIN live_keys k ON k.key_id = r.user_id LEFT JOIN held h ON h.key_id = k.key_id)"""

_NEW_KEYS = """,
asked AS (
  SELECT key_id, CASE WHEN key_id % 8 = 0 THEN code || '_x' ELSE code END AS code FROM key_codes),
bad AS (
  SELECT key_id, string_agg(DISTINCT code, ',' ORDER BY code) AS bad_codes FROM asked
  WHERE code NOT IN (SELECT code FROM scopes WHERE is_active) GROUP BY key_id)"""

_VALID = """,
registry AS (
  SELECT true_id AS id_number, min(CASE WHEN seed % 25 <> 1 THEN split_part(p_name, ' ', 1) END) AS first_name,
         min(CASE WHEN seed % 25 <> 1 THEN split_part(p_name, ' ', 2) END) AS first_surname
  FROM written JOIN part ON part_id = p_partkey WHERE seed % 5 <> 0 GROUP BY true_id),
form_rows AS (
  SELECT b.form_id, b.pos, b.seed, b.id_number,
         CASE WHEN b.seed % 4 = 0 THEN substr(p_name, 1, length(p_name) - 1)
              WHEN b.seed % 9 = 0 THEN translate(p_name, 'eo', 'cz') ELSE upper(p_name) END AS names
  FROM b JOIN part ON b.part_id = p_partkey),
scored AS (
  SELECT f.*, first_name, first_surname, first_name IS NOT NULL AS found,
         list_max(list_transform(string_split(upper(names), ' '), lambda w:
           1 - levenshtein(w, upper(first_name)) / greatest(length(w), length(first_name)))) AS s1,
         list_max(list_transform(string_split(upper(names), ' '), lambda w:
           1 - levenshtein(w, upper(first_surname)) / greatest(length(w), length(first_surname)))) AS s2
  FROM form_rows f LEFT JOIN registry USING (id_number)),
checked AS (
  SELECT *, CASE WHEN found THEN (s1 + s2) / 2 ELSE 0 END AS confidence,
         CASE WHEN NOT found THEN 'ERROR' WHEN (s1 + s2) / 2 >= 0.85e0 THEN 'OK' ELSE 'WARNING' END AS status,
         CASE WHEN NOT found THEN 'ALERT_NOT_FOUND' WHEN (s1 + s2) / 2 >= 0.85e0 THEN 'AUTO_SAVE'
              ELSE 'REQUIRE_VALIDATION' END AS action
  FROM scored)"""

_PIXELS = """
base AS (
  SELECT vec_id AS image_id, t.i // 8 AS y, t.i % 8 AS x,
         CAST(floor(abs(CAST(embedding[t.i + 1] AS DOUBLE)) * 400) AS BIGINT) % 256 AS v
  FROM embeddings, range(64) t(i)),
pixels AS (
  SELECT image_id, 'original' AS stage, y, x, v FROM base
  UNION ALL SELECT image_id, 'processed', y, x, (v * 3 + x * 5) % 256 FROM base),
tap AS (SELECT * FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) w(d, weight)),
blurred AS (
  SELECT p.image_id, p.stage, p.y, p.x, (sum(q.v * a.weight * b.weight) + 128) // 256 AS blur
  FROM pixels p CROSS JOIN tap a CROSS JOIN tap b
  JOIN pixels q ON q.image_id = p.image_id AND q.stage = p.stage
   AND q.y = 7 - abs(7 - abs(p.y + a.d)) AND q.x = 7 - abs(7 - abs(p.x + b.d))
  GROUP BY p.image_id, p.stage, p.y, p.x),
edges AS (
  SELECT p.image_id, p.stage, p.y, p.x, sum(q.v) - 4 * any_value(p.v) AS laplacian
  FROM pixels p CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx)
  JOIN pixels q ON q.image_id = p.image_id AND q.stage = p.stage
   AND q.y = 7 - abs(7 - abs(p.y + s.dy)) AND q.x = 7 - abs(7 - abs(p.x + s.dx))
  GROUP BY p.image_id, p.stage, p.y, p.x),
metrics AS (
  SELECT image_id, stage, var_pop(laplacian) AS sharpness, stddev_pop(v) AS contrast, avg(v) AS brightness,
         avg(abs(v - blur)) AS noise_level
  FROM pixels JOIN blurred USING (image_id, stage, y, x) JOIN edges USING (image_id, stage, y, x)
  GROUP BY image_id, stage)"""

QUERIES = {
    "n10_billable_amount": (n10_billable_amount, with_accounts(
        f"SELECT event_id, CAST({_BILL} AS DECIMAL(12,6)) AS billable FROM usage")),
    "n11_quota": (n11_quota, with_accounts("""
SELECT user_id, n AS count_current, limit_max, coalesce(n >= limit_max, false) AS exceeded,
       CASE WHEN limit_max IS NULL THEN -1 ELSE greatest(0, limit_max - n) END AS remaining
FROM (SELECT u.user_id, n, CASE WHEN s.user_id % 4 <> 0 THEN 40 + s.user_id % 50 END AS limit_max
      FROM (SELECT user_id, count(*) AS n FROM usage GROUP BY user_id) u LEFT JOIN subscriptions s USING (user_id))""")),
    "n12_invoice_state": (n12_invoice_state, """
SELECT o_orderkey AS invoice_id, o_orderstatus = 'F' AS paid,
       o_orderstatus <> 'F' AND o_orderkey % 13 <> 0
       AND o_orderdate + INTERVAL 30 DAYS < TIMESTAMP '1998-01-01' AS overdue
FROM orders"""),
    "n13_subscription_state": (n13_subscription_state, with_accounts(f"""
SELECT user_id, current_period_end >= {NOW} AND cancelled_at IS NULL AS active,
       coalesce(trial_ends_at >= {NOW}, false) AS trial FROM subscriptions""")),
    "n14_annual_discount": (n14_annual_discount, """
SELECT p_partkey, CASE WHEN p_partkey % 19 = 0 OR p_partkey % 23 = 0 THEN 0
                       ELSE CAST(round((12 * m - a) * 100 / (12 * m), 4) AS DECIMAL(9,4)) END AS discount_pct
FROM (SELECT *, CAST(p_retailprice AS DECIMAL(10,2)) AS m,
             CAST(p_retailprice AS DECIMAL(10,2)) * (p_size % 5 + 8) AS a FROM part)"""),
    "n15_key_valid": (n15_key_valid, with_accounts("SELECT key_id, valid FROM live_keys")),
    "n16_expires_at": (n16_expires_at, with_accounts("""
SELECT key_id, CASE WHEN key_id % 9 <> 0 AND key_id % 400 > 10
                    THEN created_at + to_days(CAST(key_id % 400 - 10 AS INTEGER)) END AS expires_at FROM keys""")),
    "n17_state_changes": (n17_state_changes, with_accounts(f"""
SELECT 'key' AS kind, key_id AS id, false AS is_active, {NOW} AS t1, {NOW} AS t2, CAST(NULL AS BOOLEAN) AS email_verified
FROM keys UNION ALL SELECT 'user', user_id, user_id % 2 = 0, {NOW}, {NOW}, true FROM users""")),
    "n18_scope_parts": (n18_scope_parts, with_accounts("""
SELECT p_partkey, CASE WHEN ok THEN code END AS code, CASE WHEN ok THEN split_part(code, ':', 1) END AS category,
       CASE WHEN ok THEN split_part(code, ':', 2) END AS action
FROM (SELECT *, p_partkey % 3 = 0 OR p_partkey % 7 <> 0 AS ok FROM part_codes)""")),
    "n19_key_hash": (n19_key_hash, """
SELECT c_custkey, c_custkey % 6 <> 0 AS well_formed, sha256(k) AS key_hash, substr(k, 1, 12) AS prefix, true AS hash_ok
FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'key_' || c_name
                             ELSE 'vfy_' || sha256(CAST(c_custkey AS VARCHAR)) END AS k FROM customer)"""),
    "n20_clean_email": (n20_clean_email, with_accounts(f"SELECT user_id, {_CLEAN} AS email FROM users")),
    "n21_strict_email_reasons": (n21_strict_email_reasons, with_accounts(
        f"SELECT user_id, concat_ws(',', {_REASONS}) AS reasons FROM (SELECT user_id, lower(trim(email, ' ')) AS e FROM users)")),
    "f8_can_authenticate": (f8_can_authenticate, with_accounts(
        "SELECT user_id, email FROM users WHERE is_active AND email_verified")),
    "f9_active_keys_and_scopes": (f9_active_keys_and_scopes, with_accounts("""
SELECT 'key' AS kind, key_id AS id, key_prefix AS label FROM live_keys WHERE valid
UNION ALL SELECT 'scope', id, code FROM scopes WHERE is_active""")),
    "s7_usage_event_table": (s7_usage_event_table, with_accounts(f"""
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, length(resource) AS event_type_id, quantity,
       provider_cost_usd, markup_percentage, CAST({_BILL} AS DECIMAL(12,6)) AS billable_amount_usd, created_at FROM usage""")),
    "s8_id_records": (s8_id_records, "WITH" + AB_SQL + """
SELECT id_number AS cedula, round(confidence * 100, 6) AS confidence, pos AS "index" FROM a"""),
    "s9_insert_keys": (s9_insert_keys, with_accounts("""
SELECT a.key_id, s.id AS scope_id FROM asked a JOIN scopes s USING (code)
WHERE a.key_id NOT IN (SELECT key_id FROM bad)""", _NEW_KEYS)),
    "s10_apply_key_changes": (s10_apply_key_changes, with_accounts("""
SELECT k.key_id, is_active, u.last_used_at, revoked_at
FROM keys k LEFT JOIN (SELECT key_id, max(ts) AS last_used_at FROM auth WHERE status = 'OK' GROUP BY key_id) u
ON u.key_id = k.key_id""", _AUTH)),
    "s11_delete_keys": (s11_delete_keys, with_accounts("SELECT key_id, name FROM keys WHERE revoked_at IS NULL")),
    "s12_upsert_users": (s12_upsert_users, with_accounts(f"""
SELECT u.user_id, coalesce(f.email, u.email) AS email, coalesce(f.is_active, u.is_active) AS is_active,
       f.last_login_at FROM current_users u LEFT JOIN fresh f USING (user_id)
UNION ALL
SELECT user_id, email, is_active, last_login_at FROM fresh
WHERE user_id NOT IN (SELECT user_id FROM current_users) AND email NOT IN (SELECT email FROM current_users)
QUALIFY row_number() OVER (PARTITION BY email ORDER BY user_id) = 1""", f""",
current_users AS (SELECT * FROM users WHERE user_id % 3 <> 2),
fresh AS (
  SELECT CASE WHEN user_id % 5 = 0 THEN user_id + 1000000 ELSE user_id END AS user_id, {_CLEAN} AS email,
         NOT is_active AS is_active, {NOW} AS last_login_at
  FROM users WHERE email_verified AND {_CLEAN} IS NOT NULL)""")),
    "j10_key_lookup": (j10_key_lookup, with_accounts("""
SELECT key_id, user_id, coalesce(array_to_string(list_sort(scopes), ','), '') AS scopes
FROM keys LEFT JOIN held USING (key_id)
WHERE key_id IN (SELECT user_id FROM requests WHERE request_id % 50 <> 0 AND request_id % 51 <> 0)""", _AUTH)),
    "j11_scope_code_validation": (j11_scope_code_validation, with_accounts("SELECT key_id, bad_codes FROM bad", _NEW_KEYS)),
    "j12_authorize_requests": (j12_authorize_requests, with_accounts("SELECT request_id, key_id, status FROM auth", _AUTH)),
    "j13_validate_rows": (j13_validate_rows, "WITH" + AB_SQL + _VALID + """
SELECT form_id, pos, seed, status, action, round(confidence, 6) AS confidence FROM checked"""),
    "f10_decision_flags": (f10_decision_flags, "WITH" + AB_SQL + _VALID + """
SELECT status = 'OK' AS is_valid, action <> 'AUTO_SAVE' AS requires_user_action, action = 'AUTO_SAVE' AS can_auto_save,
       count(*) AS n FROM checked GROUP BY ALL"""),
    "t15_match_summary": (t15_match_summary, "WITH" + AB_SQL + _VALID + """
SELECT form_id, pos, seed,
       CASE WHEN NOT found THEN 'Sin comparaciones disponibles' ELSE
         CASE WHEN s1 >= 0.85e0 THEN '✓' ELSE '✗' END || ' first_name: ' || first_name || printf(' (%.0f%%)', s1 * 100)
         || chr(10) || CASE WHEN s2 >= 0.85e0 THEN '✓' ELSE '✗' END || ' first_surname: ' || first_surname
         || printf(' (%.0f%%)', s2 * 100) END AS summary
FROM checked"""),
    "g13_processing_summary": (g13_processing_summary, "WITH" + AB_SQL + _VALID + """
SELECT form_id % 10 AS batch, count(*) AS total_rows, count(*) AS processed_rows,
       count(*) FILTER (WHERE seed % 41 <> 0 AND (action = 'AUTO_SAVE'
                        OR (action = 'REQUIRE_VALIDATION' AND seed % 3 = 0))) AS auto_saved,
       count(*) FILTER (WHERE seed % 41 <> 0 AND action = 'REQUIRE_VALIDATION') AS required_validation,
       count(*) FILTER (WHERE seed % 41 = 0) AS empty_rows,
       count(*) FILTER (WHERE seed % 41 <> 0 AND action = 'ALERT_NOT_FOUND') AS not_found, 0 AS errors
FROM checked GROUP BY 1"""),
    "j14_user_lookup": (j14_user_lookup, with_accounts(f"""
SELECT email, user_id, user_id IS NOT NULL AS found
FROM (SELECT DISTINCT printf('customer.%09d', o_custkey) || '@building.com' AS email FROM orders)
LEFT JOIN (SELECT {_CLEAN} AS email, user_id FROM users) USING (email)""")),
    "j15_effective_limits": (j15_effective_limits, with_accounts(f"""
SELECT key_id, limit_type_id, coalesce(cu.limit_value, pl.limit_value) AS limit_value,
       CASE WHEN cu.limit_value IS NOT NULL THEN 'custom' ELSE 'plan' END AS origin
FROM (SELECT key_id, t.i AS limit_type_id,
             CASE WHEN plan_id % 6 <> 0 THEN (plan_id + 1) * (t.i + 1) * 100 END AS limit_value
      FROM keys JOIN subscriptions USING (user_id), range(3) t(i)
      WHERE current_period_end >= {NOW} AND cancelled_at IS NULL) pl
FULL JOIN (SELECT key_id, key_id % 4 AS limit_type_id, key_id % 1000 AS limit_value FROM keys WHERE key_id % 5 = 0) cu
USING (key_id, limit_type_id)""")),
    "j16_star_joins": (j16_star_joins, with_accounts("""
SELECT resource_name, r_name, count(*) AS n_events, sum(quantity) AS quantity
FROM usage JOIN (SELECT length(event_type) AS n, min(event_type) AS resource_name FROM events GROUP BY 1)
     ON n = length(resource)
JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY 1, 2""")),
    "j17_revocation_status": (j17_revocation_status, """
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 9 = 0 THEN 'NOT_FOUND'
         WHEN o_custkey // 3 <> (o_custkey + o_orderkey % 2) // 3 THEN 'UNAUTHORIZED' ELSE 'OK' END AS status
FROM orders"""),
    "g9_catalog_rollup": (g9_catalog_rollup, with_accounts("""
SELECT category, count(*) AS n_scopes, string_agg(code, ', ' ORDER BY id) AS scopes FROM scopes WHERE is_active
GROUP BY category
UNION ALL SELECT NULL, count(*), NULL FROM scopes WHERE is_active""")),
    "g10_key_totals": (g10_key_totals, with_accounts("""
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE valid) AS active_count FROM live_keys GROUP BY user_id""")),
    "g11_user_count": (g11_user_count, "SELECT count(*) AS n_users FROM customer"),
    "g14_pixel_metrics": (g14_pixel_metrics, "WITH" + _PIXELS + """
SELECT image_id, stage, CAST(round(sharpness * 4096) AS BIGINT) AS sharpness_4096, round(contrast, 4) AS contrast,
       round(brightness, 4) AS brightness, round(noise_level, 4) AS noise_level FROM metrics"""),
    "g14_compare_stages": (g14_compare_stages, "WITH" + _PIXELS + """
SELECT image_id, round((b.sharpness - a.sharpness) / a.sharpness * 100, 4) AS sharpness_gain,
       round((b.contrast - a.contrast) / a.contrast * 100, 4) AS contrast_gain,
       round((b.brightness - a.brightness) / a.brightness * 100, 4) AS brightness_gain,
       round((a.noise_level - b.noise_level) / a.noise_level * 100, 4) AS noise_level_gain
FROM metrics a JOIN metrics b USING (image_id) WHERE a.stage = 'original' AND b.stage = 'processed'"""),
    "g14_edge_density": (g14_edge_density, "WITH" + _PIXELS + """,
sobel AS (
  SELECT p.image_id, p.stage, p.y, p.x, abs(sum(q.v * s.d * (2 - abs(s.e)))) AS vertical,
         abs(sum(r.v * s.d * (2 - abs(s.e)))) AS sideways
  FROM pixels p CROSS JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (1, -1), (1, 0), (1, 1)) s(d, e)
  JOIN pixels q ON q.image_id = p.image_id AND q.stage = p.stage
   AND q.y = 7 - abs(7 - abs(p.y + s.d)) AND q.x = 7 - abs(7 - abs(p.x + s.e))
  JOIN pixels r ON r.image_id = p.image_id AND r.stage = p.stage
   AND r.y = 7 - abs(7 - abs(p.y + s.e)) AND r.x = 7 - abs(7 - abs(p.x + s.d))
  GROUP BY p.image_id, p.stage, p.y, p.x)
SELECT image_id, stage, round(avg(CASE WHEN vertical + sideways >= 400 THEN 1e0 ELSE 0e0 END), 6) AS edge_density
FROM sobel GROUP BY image_id, stage"""),
    "g15_usage_counters": (g15_usage_counters, with_accounts("""
SELECT user_id, resource, period_type, date_trunc(unit, created_at) AS period_start,
       CASE unit WHEN 'hour' THEN date_trunc(unit, created_at) + INTERVAL 1 HOUR
                 WHEN 'day' THEN date_trunc(unit, created_at) + INTERVAL 1 DAY
                 WHEN 'month' THEN date_trunc(unit, created_at) + INTERVAL 1 MONTH
                 ELSE date_trunc(unit, created_at) + INTERVAL 1 YEAR END AS period_end,
       sum(quantity) AS count_current, max(created_at) AS last_incremented_at
FROM usage, (VALUES ('hourly', 'hour'), ('daily', 'day'), ('monthly', 'month'), ('yearly', 'year')) p(period_type, unit)
GROUP BY ALL""")),
    "g16_usage_cost": (g16_usage_cost, with_accounts(f"""
SELECT user_id, resource, sum(provider_cost_usd) AS provider_cost, sum(CAST({_BILL} AS DECIMAL(12,6))) AS billable,
       count(*) AS n_events FROM usage GROUP BY user_id, resource""")),
    "g17_build_invoices": (g17_build_invoices, """
SELECT invoice_id, n_lines, subtotal_usd, tax_amount_usd, subtotal_usd + tax_amount_usd AS total_usd
FROM (SELECT *, CAST(round(subtotal_usd * 0.19, 2) AS DECIMAL(12,2)) AS tax_amount_usd
      FROM (SELECT l_orderkey AS invoice_id, count(*) AS n_lines,
                   CAST(sum(CAST(l_quantity AS INTEGER) * CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(12,2))
                     AS subtotal_usd
            FROM lineitem GROUP BY l_orderkey))"""),
    "g18_metadata_columns": (g18_metadata_columns, """
SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS resource FROM events"""),
    "l1_keys_by_creation": (l1_keys_by_creation, with_accounts(
        "SELECT user_id, key_id, created_at, valid FROM live_keys ORDER BY user_id, created_at DESC, key_id")),
    "l2_scopes_in_order": (l2_scopes_in_order, with_accounts("SELECT * FROM scopes ORDER BY category, code")),
    "l3_user_page": (l3_user_page, with_accounts("SELECT user_id, email FROM users ORDER BY user_id LIMIT 50 OFFSET 20")),
}
