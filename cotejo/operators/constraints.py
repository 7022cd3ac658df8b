"""Key, reference and uniqueness rules over the service tables, checked by grouping and anti-joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from cotejo.sources.tables import SCHEMAS, columns_of

# Columns whose values name a row of another table.
REFERENCES = {
    ("user_profiles", "user_id"): "users",
    ("api_keys", "user_id"): "users",
    ("api_key_scopes", "api_key_id"): "api_keys",
    ("api_key_scopes", "scope_id"): "api_permission_scopes",
    ("api_key_custom_limits", "api_key_id"): "api_keys",
    ("api_key_custom_limits", "limit_type_id"): "limit_types",
    ("plan_features", "plan_id"): "subscription_plans",
    ("plan_limits", "plan_id"): "subscription_plans",
    ("plan_limits", "limit_type_id"): "limit_types",
    ("user_subscriptions", "user_id"): "users",
    ("user_subscriptions", "plan_id"): "subscription_plans",
    ("user_subscriptions", "billing_cycle_id"): "subscription_billing_cycles",
    ("user_subscriptions", "status_id"): "subscription_statuses",
    ("usage_events", "user_id"): "users",
    ("usage_events", "event_type_id"): "usage_event_types",
    ("usage_event_metadata", "usage_event_id"): "usage_events",
    ("usage_counters", "user_id"): "users",
    ("usage_counters", "period_type_id"): "period_types",
    ("usage_counters", "resource_type_id"): "resource_types",
    ("usage_event_types", "resource_type_id"): "resource_types",
    ("invoices", "user_id"): "users",
    ("invoices", "subscription_id"): "user_subscriptions",
    ("invoices", "status_id"): "invoice_statuses",
    ("invoices", "payment_method_id"): "payment_methods",
    ("invoice_line_items", "invoice_id"): "invoices",
    ("invoice_line_items", "item_type_id"): "invoice_item_types",
    ("invoice_line_items", "plan_id"): "subscription_plans",
    ("invoice_line_items", "resource_type_id"): "resource_types",
}

# Columns (or pairs of them) that no two rows of a table share.
UNIQUE = {
    "users": [("email",)],
    "user_profiles": [("user_id",)],
    "api_keys": [("key_hash",)],
    "api_key_scopes": [("api_key_id", "scope_id")],
    "subscription_plans": [("plan_code",)],
    "invoices": [("invoice_number",)],
} | {name: [("code",)] for name in SCHEMAS if columns_of(name)[1][0] == "code"}

_OUT = ("table_name", "rule", "columns", "value", "n")


def _value(columns):
    return F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def _report(df: DataFrame, table: str, rule: str, columns) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(", ".join(columns)).alias("columns"),
                     _value(columns).alias("value"), F.col("n").cast("bigint").alias("n"))


def violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, rule, columns, value, n``: every value that breaks a rule, with the number of its rows.

    Rules: ``missing`` (a NULL key), ``repeated`` (a key or unique columns that several rows share; NULLs are never equal)
    and ``unknown`` (a reference to no row). A rule is checked if all its tables and columns are there. Values are grouped
    before they meet the other table, so a value that many rows share is one row of the anti-join."""
    out = []
    for name, df in tables.items():
        keys = [("id",)] if "id" in df.columns else []
        for key in keys:
            missing = df.filter(F.col(key[0]).isNull()).groupBy(*key).agg(F.count("*").alias("n"))
            out.append(_report(missing, name, "missing", key))
        for columns in keys + UNIQUE.get(name, []):
            if set(columns) <= set(df.columns):
                whole = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
                out.append(_report(whole.filter("n > 1"), name, "repeated", columns))
    for (name, column), target in REFERENCES.items():
        if name in tables and target in tables and column in tables[name].columns:
            values = tables[name].filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
            known = tables[target].select(F.col("id").alias("_id"))
            lost = values.join(known, F.col(column).cast("string") == F.col("_id").cast("string"), "left_anti")
            out.append(_report(lost, name, "unknown", (column,)))
    if not out:
        raise ValueError("no rule applies to these tables")
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.select(*_OUT)
