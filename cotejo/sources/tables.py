"""The service's tables with explicit schemas. Times are zone-less UTC, identifiers are strings, money is decimal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOOKUP = "id SMALLINT, code STRING, name STRING"

# Column names and types of the 24 tables.
SCHEMAS = {
    "users": "id STRING, email STRING, password_hash STRING, email_verified BOOLEAN, is_active BOOLEAN, "
             "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, last_login_at TIMESTAMP_NTZ",
    "user_profiles": "user_id STRING, primer_nombre STRING, segundo_nombre STRING, primer_apellido STRING, "
                     "segundo_apellido STRING, nombre_organizacion STRING, tipo_organizacion STRING, country_code STRING, "
                     "timezone STRING, telefono STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "api_keys": "id STRING, user_id STRING, key_hash STRING, key_prefix STRING, name STRING, is_active BOOLEAN, "
                "last_used_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, revoked_at TIMESTAMP_NTZ",
    "api_key_scopes": "api_key_id STRING, scope_id SMALLINT, created_at TIMESTAMP_NTZ",
    "api_permission_scopes": _LOOKUP + ", description STRING, category STRING, is_active BOOLEAN",
    "api_key_custom_limits": "id STRING, api_key_id STRING, limit_type_id SMALLINT, limit_value INT, created_at TIMESTAMP_NTZ",
    "subscription_plans": "id STRING, plan_code STRING, plan_name STRING, description STRING, "
                          "precio_mensual_usd DECIMAL(10,2), precio_anual_usd DECIMAL(10,2), is_active BOOLEAN, "
                          "is_public BOOLEAN, display_order INT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "plan_features": "id STRING, plan_id STRING, feature_name STRING, feature_value STRING, display_order INT, "
                     "created_at TIMESTAMP_NTZ",
    "plan_limits": "id STRING, plan_id STRING, limit_type_id SMALLINT, limit_value INT, is_hard_limit BOOLEAN, "
                   "created_at TIMESTAMP_NTZ",
    "user_subscriptions": "id STRING, user_id STRING, plan_id STRING, billing_cycle_id SMALLINT, status_id SMALLINT, "
                          "trial_ends_at TIMESTAMP_NTZ, current_period_start TIMESTAMP_NTZ, "
                          "current_period_end TIMESTAMP_NTZ, cancelled_at TIMESTAMP_NTZ, stripe_subscription_id STRING, "
                          "auto_renew BOOLEAN, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "usage_events": "id STRING, user_id STRING, event_type_id SMALLINT, quantity INT, provider_cost_usd DECIMAL(12,6), "
                    "markup_percentage DECIMAL(5,2), billable_amount_usd DECIMAL(12,6), resource_id STRING, "
                    "resource_table STRING, created_at TIMESTAMP_NTZ",
    "usage_event_metadata": "id STRING, usage_event_id STRING, key STRING, value STRING, created_at TIMESTAMP_NTZ",
    "usage_counters": "id STRING, user_id STRING, period_type_id SMALLINT, resource_type_id SMALLINT, "
                      "period_start TIMESTAMP_NTZ, period_end TIMESTAMP_NTZ, count_current INT, limit_max INT, "
                      "last_incremented_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "usage_event_types": _LOOKUP + ", description STRING, resource_type_id SMALLINT, default_quantity INT",
    "invoices": "id STRING, user_id STRING, subscription_id STRING, status_id SMALLINT, payment_method_id SMALLINT, "
                "invoice_number STRING, period_start TIMESTAMP_NTZ, period_end TIMESTAMP_NTZ, subtotal_usd DECIMAL(12,2), "
                "tax_percentage DECIMAL(5,2), tax_amount_usd DECIMAL(12,2), total_usd DECIMAL(12,2), "
                "issued_at TIMESTAMP_NTZ, due_at TIMESTAMP_NTZ, paid_at TIMESTAMP_NTZ, stripe_invoice_id STRING, "
                "pdf_url STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "invoice_line_items": "id STRING, invoice_id STRING, item_type_id SMALLINT, description STRING, quantity INT, "
                          "unit_price_usd DECIMAL(12,6), total_price_usd DECIMAL(12,2), plan_id STRING, "
                          "resource_type_id SMALLINT, created_at TIMESTAMP_NTZ",
    "period_types": _LOOKUP + ", duration_minutes INT",
    "resource_types": _LOOKUP + ", description STRING, is_billable BOOLEAN",
    "limit_types": _LOOKUP + ", description STRING, unit STRING, is_active BOOLEAN",
    "subscription_statuses": _LOOKUP + ", description STRING, is_active_status BOOLEAN, display_order INT",
    "subscription_billing_cycles": _LOOKUP + ", months_duration INT, display_order INT, is_active BOOLEAN",
    "invoice_statuses": _LOOKUP + ", description STRING, is_paid_status BOOLEAN, display_order INT",
    "payment_methods": _LOOKUP + ", description STRING, requires_gateway BOOLEAN, is_active BOOLEAN, display_order INT",
    "invoice_item_types": _LOOKUP + ", description STRING",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of one table with its declared schema: no inference, columns prune and filters push down."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def columns_of(name: str) -> list[tuple[str, str]]:
    """Column names and types of a table."""
    import re

    return [tuple(part.strip().split(" ", 1)) for part in re.split(r",(?![^(]*\))", SCHEMAS[name])]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast and order columns to the declared schema; columns that are not there become NULL."""
    have = set(df.columns)
    return df.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(t.lower()).alias(c) for c, t in columns_of(name)]
    )


def write_table(df: DataFrame, root: str, name: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    conform(df, name).write.mode(mode).partitionBy(*partition_by).parquet(f"{root}/{name}")
