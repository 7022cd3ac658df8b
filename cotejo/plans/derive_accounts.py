"""Users, keys, scopes, usage and invoices derived from the test tables: customers own keys, parts name scopes, events
are requests and usage, orders are invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cotejo.functions import account
from cotejo.plans.derive import table

c = F.col


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


START = "2024-01-01 00:00:00"
AS_OF = "2024-06-01 00:00:00"


def _days(n: Column) -> Column:
    return F.make_interval(days=n.cast("int"))


def _email(key: Column) -> Column:
    """Mostly valid addresses; some break one rule each."""
    name, host = F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lower("c_mktsegment")
    plain = F.concat(name, F.lit("@"), host, F.lit(".com"))
    return (
        F.when(key % 12 == 1, F.concat(F.lit(" "), F.upper(plain), F.lit(" ")))
        .when(key % 12 == 2, F.concat(name, F.lit(".@"), host, F.lit(".com")))
        .when(key % 12 == 3, F.concat(name, F.lit("@"), host, F.lit("..com")))
        .when(key % 12 == 4, F.concat(name, host, F.lit(".com")))
        .when(key % 12 == 5, F.concat(name, F.lit("@"), host, F.lit(".c0m")))
        .when(key % 12 == 6, F.concat(name, F.lit("@mailinator.com")))
        .when(key % 12 == 7, F.concat(name, F.lit(" x@-"), host))
        .otherwise(plain)
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = c("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"), _email(key).alias("email"), (c("c_acctbal") > 0).alias("is_active"),
        (key % 3 != 0).alias("email_verified"), (moment(START) + _days(key % 365)).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_login_at"),
    )


def key_text(n: Column) -> Column:
    return F.concat(F.lit("vfy_"), F.sha2(n.cast("string"), 256))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    created = moment(START) + _days(k % 365)
    return table(spark, sf_dir, "customer").select(
        k.alias("key_id"), F.floor(k / 3).alias("user_id"), account.key_hash(key_text(k)).alias("key_hash"),
        account.key_prefix(key_text(k)).alias("key_prefix"), c("c_name").alias("name"), (k % 13 != 0).alias("is_active"),
        F.lit(None).cast("timestamp_ntz").alias("last_used_at"),
        F.when(k % 4 != 0, account.expires_at(created, F.lit(30) + (k % 700).cast("int"))).alias("expires_at"),
        created.alias("created_at"), F.when(c("c_acctbal") < 0, created + _days(F.lit(5))).alias("revoked_at"),
    )


def _part_code() -> Column:
    kind = F.lower("p_type")
    return (
        F.when(c("p_size") == 50, F.lit("admin:all")).when(c("p_size") % 10 == 0, F.concat(kind, F.lit(":all")))
        .otherwise(F.concat(kind, F.lit(":"), F.split_part("p_name", F.lit(" "), F.lit(2))))
    )


def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", _part_code().alias("code"))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: one row per distinct code."""
    per = part_codes(spark, sf_dir).groupBy("code").agg(F.min("p_partkey").alias("id"))
    return per.select("id", "code", account.scope_category(c("code")).alias("category"), (c("id") % 6 != 0).alias("is_active"))


def key_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key_id, code): three parts per key, by key number."""
    wanted = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("key_id"),
        F.explode(F.array(*[c("c_custkey") + F.lit(7 * i) for i in range(3)])).alias("p_partkey"),
    )
    return wanted.join(part_codes(spark, sf_dir), "p_partkey").select("key_id", "code").distinct()


def key_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = scopes(spark, sf_dir).select("code", c("id").alias("scope_id"))
    return key_codes(spark, sf_dir).join(catalog, "code").select("key_id", "scope_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, key, required (array), ts: one per event, by the key numbered like the user."""
    e = c("event_id")
    key = (
        F.when(e % 50 == 0, F.lit("not a key")).when(e % 51 == 0, key_text(c("user_id") + 1000000000))
        .otherwise(key_text(c("user_id")))
    )
    codes = part_codes(spark, sf_dir)
    parts = table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    first = codes.select(c("p_partkey").alias("first_part"), c("code").alias("first_code"))
    second = codes.select(c("p_partkey").alias("second_part"), c("code").alias("second_code"))
    events = table(spark, sf_dir, "events").select(
        e.alias("request_id"), key.alias("key"), "ts", (e % parts).alias("first_part"),
        F.when(e % 3 == 0, e * 7 % parts).alias("second_part"),
    )
    joined = events.join(first, "first_part").join(second, "second_part", "left")
    return joined.select("request_id", "key", F.array_compact(F.array("first_code", "second_code")).alias("required"), "ts")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = c("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", c("event_type").alias("resource"), (e % 3 + 1).cast("int").alias("quantity"),
        F.when(e % 17 != 0, c("value").cast("decimal(12,6)")).alias("provider_cost_usd"),
        (e % 60).cast("decimal(5,2)").alias("markup_percentage"), c("ts").alias("created_at"), "props",
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per key owner; plans are nations."""
    owner = keys(spark, sf_dir).select("user_id").distinct()
    u = c("user_id")
    return owner.select(
        u, (u % 25).alias("plan_id"), (moment(START) + _days(u % 400)).alias("current_period_end"),
        F.when(u % 17 == 0, moment(START) + _days(u % 90)).alias("cancelled_at"),
        F.when(u % 5 == 0, moment(START) + _days(u % 300)).alias("trial_ends_at"),
    )


def plan_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)]))
    n = c("n_nationkey").cast("bigint")
    rows = table(spark, sf_dir, "nation").select(n.alias("plan_id"), kinds.alias("limit_type_id"))
    value = F.when(c("plan_id") % 6 != 0, (c("plan_id") + 1) * (c("limit_type_id") + 1) * 100)
    return rows.withColumn("limit_value", value)


def custom_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    return table(spark, sf_dir, "customer").filter(k % 5 == 0).select(
        k.alias("key_id"), (k % 4).alias("limit_type_id"), (k % 1000).alias("limit_value")
    )


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("invoice_id"), c("l_quantity").cast("int").alias("quantity"),
        c("l_extendedprice").cast("decimal(12,2)").cast("decimal(12,6)").alias("unit_price_usd"), "l_returnflag",
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person per identifier that was written, four in five of them known; some without names."""
    from cotejo.plans.derive import written_rows

    part = table(spark, sf_dir, "part").select(c("p_partkey").alias("part_id"), "p_name")
    rows = written_rows(spark, sf_dir).filter(c("seed") % 5 != 0).join(part, "part_id")
    nameless = c("seed") % 25 == 1
    named = rows.select(
        c("true_id").alias("id_number"), F.when(~nameless, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("first"),
        F.when(~nameless, F.split_part("p_name", F.lit(" "), F.lit(2))).alias("last"),
    )
    people = named.groupBy("id_number").agg(F.min("first").alias("first_name"), F.min("last").alias("first_surname"))
    return people.select("id_number", "first_name", F.lit("").alias("second_name"), "first_surname",
                         F.lit(None).cast("string").alias("second_surname"))


# --- SQL ---------------------------------------------------------------------------------------------------------------
_PLAIN = "lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.com'"
ACCOUNTS_SQL = f"""
users AS (
  SELECT c_custkey AS user_id,
         CASE c_custkey % 12
           WHEN 1 THEN ' ' || upper({_PLAIN}) || ' '
           WHEN 2 THEN n || '.@' || h || '.com' WHEN 3 THEN n || '@' || h || '..com' WHEN 4 THEN n || h || '.com'
           WHEN 5 THEN n || '@' || h || '.c0m' WHEN 6 THEN n || '@mailinator.com' WHEN 7 THEN n || ' x@-' || h
           ELSE {_PLAIN} END AS email,
         c_acctbal > 0 AS is_active, c_custkey % 3 <> 0 AS email_verified,
         TIMESTAMP '{START}' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at,
         CAST(NULL AS TIMESTAMP) AS last_login_at
  FROM (SELECT *, lower(replace(c_name, '#', '.')) AS n, lower(c_mktsegment) AS h FROM customer)),
keys AS (
  SELECT c_custkey AS key_id, c_custkey // 3 AS user_id, sha256('vfy_' || sha256(CAST(c_custkey AS VARCHAR))) AS key_hash,
         substr('vfy_' || sha256(CAST(c_custkey AS VARCHAR)), 1, 12) AS key_prefix, c_name AS name,
         c_custkey % 13 <> 0 AS is_active, CAST(NULL AS TIMESTAMP) AS last_used_at,
         CASE WHEN c_custkey % 4 <> 0 THEN created_at + to_days(CAST(30 + c_custkey % 700 AS INTEGER)) END AS expires_at,
         created_at, CASE WHEN c_acctbal < 0 THEN created_at + to_days(5) END AS revoked_at
  FROM (SELECT *, TIMESTAMP '{START}' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at FROM customer)),
live_keys AS (
  SELECT *, is_active AND revoked_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}') AS valid
  FROM keys),
part_codes AS (
  SELECT p_partkey, CASE WHEN p_size = 50 THEN 'admin:all' WHEN p_size % 10 = 0 THEN lower(p_type) || ':all'
                         ELSE lower(p_type) || ':' || split_part(p_name, ' ', 2) END AS code FROM part),
scopes AS (
  SELECT min(p_partkey) AS id, code, split_part(code, ':', 1) AS category, min(p_partkey) % 6 <> 0 AS is_active
  FROM part_codes GROUP BY code),
key_codes AS (
  SELECT DISTINCT c_custkey AS key_id, code FROM customer, range(3) t(i), part_codes
  WHERE p_partkey = c_custkey + 7 * t.i),
requests AS (
  SELECT event_id AS request_id, ts, user_id, a.code AS code1, b.code AS code2
  FROM (SELECT *, (SELECT count(*) FROM part) AS parts FROM events) e
  JOIN part_codes a ON a.p_partkey = event_id % parts
  LEFT JOIN part_codes b ON b.p_partkey = CASE WHEN event_id % 3 = 0 THEN event_id * 7 % parts END),
usage AS (
  SELECT event_id, user_id, event_type AS resource, CAST(event_id % 3 + 1 AS INTEGER) AS quantity,
         CASE WHEN event_id % 17 <> 0 THEN CAST(value AS DECIMAL(12,6)) END AS provider_cost_usd,
         CAST(event_id % 60 AS DECIMAL(5,2)) AS markup_percentage, ts AS created_at, props
  FROM events),
subscriptions AS (
  SELECT DISTINCT user_id, user_id % 25 AS plan_id,
         TIMESTAMP '{START}' + to_days(CAST(user_id % 400 AS INTEGER)) AS current_period_end,
         CASE WHEN user_id % 17 = 0 THEN TIMESTAMP '{START}' + to_days(CAST(user_id % 90 AS INTEGER)) END AS cancelled_at,
         CASE WHEN user_id % 5 = 0 THEN TIMESTAMP '{START}' + to_days(CAST(user_id % 300 AS INTEGER)) END AS trial_ends_at
  FROM keys)"""


def with_accounts(body: str, extra: str = "") -> str:
    return "WITH" + ACCOUNTS_SQL + extra + "\n" + body
