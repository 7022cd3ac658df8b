"""Lookups in batches, star joins over lookup tables, output records and order inside groups (inventory J10, J14, J16, S8, L4)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cotejo.catalog.accounts import _CLEAN
from cotejo.functions import account
from cotejo.operators import keys as ops
from cotejo.plans import derive, derive_accounts as acc
from cotejo.plans.derive import with_words
from cotejo.plans.derive_accounts import with_accounts
from cotejo.sources import sinks

c = F.col


def _keys(spark, sf):
    return ops.keys_with_scopes(acc.keys(spark, sf), acc.key_scopes(spark, sf), acc.scopes(spark, sf))


def _listed(df):
    return df.select("probe", "key_id", F.array_join("scopes", ",").alias("scopes"))


def j10_keys_by_id(spark, sf):
    probes = derive.table(spark, sf, "orders").select((c("o_custkey") + c("o_orderkey") % 2 * 1000).alias("probe")).distinct()
    return _listed(ops.find_keys(_keys(spark, sf), probes, "key_id"))


def j10_keys_by_user(spark, sf):
    probes = derive.table(spark, sf, "events").select(c("user_id").alias("probe")).distinct()
    return _listed(ops.find_keys(_keys(spark, sf), probes, "user_id"))


def j14_users_by_id(spark, sf):
    probes = derive.table(spark, sf, "events").select((c("user_id") * 3).alias("user_id")).distinct()
    known = acc.users(spark, sf).select("user_id", "email")
    return probes.join(known, "user_id", "left").select("user_id", "email", c("email").isNotNull().alias("found"))


def j14_email_exists(spark, sf):
    asked = derive.table(spark, sf, "orders").select(
        F.format_string("Customer.%09d@Building.com", c("o_custkey")).alias("asked")).distinct()
    taken = acc.users(spark, sf).select(account.clean_email(c("email")).alias("email")).distinct()
    probes = asked.withColumn("email", account.clean_email(c("asked")))
    return probes.join(taken.withColumn("there", F.lit(True)), "email", "left").select(
        "asked", F.coalesce("there", F.lit(False)).alias("taken"))


def j16_invoice_stars(spark, sf):
    """Invoice to status and payment method, line to item type; lookups are joined without hints."""
    orders = derive.table(spark, sf, "orders")
    statuses = orders.select(c("o_orderstatus").alias("status_id")).distinct().withColumn(
        "status", F.when(c("status_id") == "F", "paid").when(c("status_id") == "O", "open").otherwise("draft"))
    methods = orders.select(c("o_orderpriority").alias("payment_method_id")).distinct().withColumn(
        "method", F.substring_index("payment_method_id", "-", -1))
    lines = derive.table(spark, sf, "lineitem")
    kinds = lines.select(c("l_returnflag").alias("item_type_id")).distinct().withColumn("item_type", F.lower("item_type_id"))
    invoices = orders.select(c("o_orderkey").alias("invoice_id"), c("o_orderstatus").alias("status_id"),
                             c("o_orderpriority").alias("payment_method_id"))
    star = (lines.select(c("l_orderkey").alias("invoice_id"), c("l_returnflag").alias("item_type_id"),
                         c("l_quantity").cast("int").alias("quantity"))
            .join(invoices, "invoice_id").join(statuses, "status_id").join(methods, "payment_method_id")
            .join(kinds, "item_type_id"))
    return star.groupBy("status", "method", "item_type").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("quantity"))


def j16_user_profiles(spark, sf):
    """User to profile, one to one; a user without a profile keeps its row."""
    people = derive.table(spark, sf, "customer").filter(c("c_custkey") % 4 != 0).select(
        c("c_custkey").alias("user_id"), c("c_name").alias("full_name"), c("c_nationkey").alias("country"))
    return acc.users(spark, sf).select("user_id", "is_active").join(people, "user_id", "left")


def s8_text_records(spark, sf):
    r = sinks.to_text_records(derive.page_words(spark, sf))
    return r.select("text", "confidence", c("position.x").alias("x"), c("position.y").alias("y"))


def l4_order_in_groups(spark, sf):
    """Place of every word in its form by x, by y and by detection; ties by detection."""
    words = derive.page_words(spark, sf)

    def place(*keys):
        return F.row_number().over(Window.partitionBy("form_id").orderBy(*keys))

    return words.select("form_id", "box_id", place("x", "box_id").alias("by_x"), place("y", "box_id").alias("by_y"),
                        place("box_id").alias("by_detection"))


_HELD = """,
held AS (SELECT key_id, array_to_string(list_sort(list(code)), ',') AS scopes FROM key_codes GROUP BY key_id)"""

QUERIES = {
    "j10_keys_by_id": (j10_keys_by_id, with_accounts("""
SELECT probe, key_id, coalesce(scopes, '') AS scopes
FROM (SELECT DISTINCT o_custkey + o_orderkey % 2 * 1000 AS probe FROM orders)
JOIN keys ON key_id = probe LEFT JOIN held USING (key_id)""", _HELD)),
    "j10_keys_by_user": (j10_keys_by_user, with_accounts("""
SELECT probe, key_id, coalesce(scopes, '') AS scopes FROM (SELECT DISTINCT user_id AS probe FROM events)
JOIN keys ON user_id = probe LEFT JOIN held USING (key_id)""", _HELD)),
    "j14_users_by_id": (j14_users_by_id, with_accounts("""
SELECT user_id, email, email IS NOT NULL AS found
FROM (SELECT DISTINCT user_id * 3 AS user_id FROM events) LEFT JOIN users USING (user_id)""")),
    "j14_email_exists": (j14_email_exists, with_accounts(f"""
SELECT asked, lower(asked) IN (SELECT {_CLEAN} FROM users WHERE {_CLEAN} IS NOT NULL) AS taken
FROM (SELECT DISTINCT printf('Customer.%09d@Building.com', o_custkey) AS asked FROM orders)""")),
    "j16_invoice_stars": (j16_invoice_stars, """
SELECT CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'open' ELSE 'draft' END AS status,
       list_last(string_split(o_orderpriority, '-')) AS method, lower(l_returnflag) AS item_type, count(*) AS n_lines,
       sum(CAST(l_quantity AS INTEGER)) AS quantity
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"""),
    "j16_user_profiles": (j16_user_profiles, with_accounts("""
SELECT user_id, is_active, CASE WHEN user_id % 4 <> 0 THEN c_name END AS full_name,
       CASE WHEN user_id % 4 <> 0 THEN c_nationkey END AS country
FROM users JOIN customer ON c_custkey = user_id""")),
    "s8_text_records": (s8_text_records, with_words("SELECT text, confidence, x, y FROM words")),
    "l4_order_in_groups": (l4_order_in_groups, with_words("""
SELECT form_id, box_id, row_number() OVER (PARTITION BY form_id ORDER BY x, box_id) AS by_x,
       row_number() OVER (PARTITION BY form_id ORDER BY y, box_id) AS by_y,
       row_number() OVER (PARTITION BY form_id ORDER BY box_id) AS by_detection FROM words""")),
}
