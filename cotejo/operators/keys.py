"""Key, scope and user lookups for whole request logs.

The scope catalogue and a key's own scopes are short by nature; whether a join broadcasts them is left to Spark's size
checks, and adaptive execution splits a hot key's requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.functions import account


def keys_with_scopes(keys: DataFrame, key_scopes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keys with their scope codes attached as a sorted array (empty without any)."""
    held = key_scopes.join(catalog.select(F.col("id").alias("scope_id"), "code"), "scope_id")
    held = held.groupBy("key_id").agg(F.array_sort(F.collect_set("code")).alias("scopes"))
    none = F.array().cast("array<string>")
    return keys.join(held, "key_id", "left").withColumn("scopes", F.coalesce("scopes", none))


def find_keys(keys: DataFrame, probes: DataFrame, column: str) -> DataFrame:
    """The keys whose ``column`` (id, user or hash) is in ``probes`` (``probe``), one row for each; scopes come along."""
    return probes.join(keys.withColumn("probe", F.col(column)), "probe")


def authorize(requests: DataFrame, keys: DataFrame, as_of: Column) -> DataFrame:
    """Requests (request_id, key, required, ts) with their ``status``: BAD_FORMAT, NOT_FOUND, INVALID (revoked, inactive
    or expired), FORBIDDEN (a required scope is not held) or OK. ``keys`` carries its scope array, so one join decides.
    Malformed keys have no hash; they spread over as many places as there are requests of them, none of which is a key's."""
    hashed = requests.withColumn("key_hash", F.when(account.is_key_format(F.col("key")), account.key_hash(F.col("key"))))
    known = keys.select("key_hash", "key_id", "is_active", "revoked_at", "expires_at", "scopes")
    met = F.forall("required", lambda r: F.exists("scopes", lambda s: account.scope_satisfies(s, r)))
    valid = account.key_valid(F.col("is_active"), F.col("revoked_at"), F.col("expires_at"), as_of)
    status = (
        F.when(F.col("key_hash").isNull(), "BAD_FORMAT").when(F.col("key_id").isNull(), "NOT_FOUND")
        .when(~valid, "INVALID").when(~met, "FORBIDDEN").otherwise("OK")
    )
    spot = F.coalesce("key_hash", F.concat(F.lit("-"), F.col("request_id").cast("string")))
    joined = hashed.withColumn("spot", spot).join(known.withColumnRenamed("key_hash", "spot"), "spot", "left")
    return joined.select("request_id", "key_id", "ts", status.alias("status"))


def last_use(authorized: DataFrame) -> DataFrame:
    """Per key, the time of its last successful request: input of ``apply_key_changes``."""
    return authorized.filter(F.col("status") == "OK").groupBy("key_id").agg(F.max("ts").alias("last_used_at"))


def revocation_status(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """NOT_FOUND, UNAUTHORIZED (someone else's key) or OK for each (key_id, requested_by)."""
    joined = requests.join(keys.select("key_id", F.col("user_id").alias("owner")), "key_id", "left")
    return joined.withColumn(
        "status", F.when(F.col("owner").isNull(), "NOT_FOUND")
        .when(F.col("owner") != F.col("requested_by"), "UNAUTHORIZED").otherwise("OK")
    ).drop("owner")


def catalog_rollup(catalog: DataFrame) -> DataFrame:
    """Active scopes per category: count and codes in id order; the row without a category is the grand total."""
    active = catalog.filter("is_active")
    codes = F.transform(F.sort_array(F.collect_list(F.struct("id", "code"))), lambda s: s["code"])
    per = active.groupBy("category").agg(F.count("*").alias("n_scopes"), F.array_join(codes, ", ").alias("scopes"))
    total = active.agg(F.count("*").alias("n_scopes")).select(
        F.lit(None).cast("string").alias("category"), "n_scopes", F.lit(None).cast("string").alias("scopes")
    )
    return per.unionByName(total)


def key_totals(keys: DataFrame, as_of: Column) -> DataFrame:
    valid = account.key_valid(F.col("is_active"), F.col("revoked_at"), F.col("expires_at"), as_of)
    return keys.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(valid).alias("active_count"))


def page(df: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """One page in a stated order; ``order`` must be unique for stable pages."""
    return df.orderBy(order).offset(offset).limit(limit)


def effective_limits(keys: DataFrame, subscriptions: DataFrame, plan_limits: DataFrame, custom_limits: DataFrame,
                     as_of: Column) -> DataFrame:
    """Per key and limit type: the key's custom limit, else the limit of its owner's active plan."""
    active = account.subscription_active(F.col("current_period_end"), F.col("cancelled_at"), as_of)
    owners = keys.select("key_id", "user_id").join(subscriptions.filter(active).select("user_id", "plan_id"), "user_id")
    plan = owners.join(plan_limits, "plan_id").select("key_id", "limit_type_id", F.col("limit_value").alias("plan_value"))
    custom = custom_limits.select("key_id", "limit_type_id", F.col("limit_value").alias("custom_value"))
    both = plan.join(custom, ["key_id", "limit_type_id"], "full_outer")
    return both.select("key_id", "limit_type_id", F.coalesce("custom_value", "plan_value").alias("limit_value"),
                       F.when(F.col("custom_value").isNotNull(), "custom").otherwise("plan").alias("origin"))
