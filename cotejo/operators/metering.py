"""Usage counters, costs, invoices and event metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cotejo.functions import account

# Counter periods and the length of each.
PERIODS = {"hourly": ("hour", "1 hour"), "daily": ("day", "1 day"), "monthly": ("month", "1 month"),
           "yearly": ("year", "1 year")}


def usage_counters(events: DataFrame) -> DataFrame:
    """Quantity per user, resource and period for all four period types.

    Events (user_id, resource, quantity, created_at) are first summed per hour; only those sums are spread over the
    four period types, so the raw events are shuffled once and a hot user is combined map-side."""
    hourly = events.groupBy("user_id", "resource", F.date_trunc("hour", "created_at").alias("hour")).agg(
        F.sum("quantity").alias("quantity"), F.max("created_at").alias("last")
    )
    periods = F.array(*[
        F.struct(
            F.lit(name).alias("period_type"), F.date_trunc(unit, "hour").cast("timestamp_ntz").alias("period_start"),
            (F.date_trunc(unit, "hour") + F.expr(f"INTERVAL {length}")).cast("timestamp_ntz").alias("period_end"),
        )
        for name, (unit, length) in PERIODS.items()
    ])
    spread = hourly.select("user_id", "resource", "quantity", "last", F.explode(periods).alias("p"))
    return spread.groupBy("user_id", "resource", "p.period_type", "p.period_start", "p.period_end").agg(
        F.sum("quantity").alias("count_current"), F.max("last").alias("last_incremented_at")
    )


def quota_state(counters: DataFrame, limits: DataFrame, keys=("user_id",)) -> DataFrame:
    """Counters with ``limit_max`` joined, ``exceeded`` and ``remaining``."""
    joined = counters.join(limits, list(keys), "left")
    count, limit = F.col("count_current"), F.col("limit_max")
    return joined.withColumns(
        {"exceeded": account.limit_exceeded(count, limit), "remaining": account.remaining_quota(count, limit)}
    )


def usage_cost(events: DataFrame, *keys: str) -> DataFrame:
    """Provider cost and billable amount per key; a missing cost counts as zero."""
    billable = account.billable_amount(F.col("provider_cost_usd"), F.col("markup_percentage"))
    return events.groupBy(*keys).agg(
        F.sum("provider_cost_usd").alias("provider_cost"), F.sum(billable).alias("billable"), F.count("*").alias("n_events")
    )


def build_invoices(lines: DataFrame, tax_percentage: str = "19.00") -> DataFrame:
    """Totals per invoice from lines (invoice_id, quantity, unit_price_usd)."""
    line_total = (F.col("quantity") * F.col("unit_price_usd")).cast("decimal(18,6)")
    sums = lines.groupBy("invoice_id").agg(
        F.round(F.sum(line_total), 2).cast("decimal(12,2)").alias("subtotal_usd"), F.count("*").alias("n_lines")
    )
    pct = F.lit(tax_percentage).cast("decimal(5,2)")
    hundredth = F.lit("0.01").cast("decimal(3,2)")
    taxed = sums.withColumn("tax_amount_usd", F.round(F.col("subtotal_usd") * pct * hundredth, 2).cast("decimal(12,2)"))
    return taxed.withColumn("total_usd", (F.col("subtotal_usd") + F.col("tax_amount_usd")).cast("decimal(12,2)"))


def metadata_columns(metadata: DataFrame, names: list[str]) -> DataFrame:
    """Key-value metadata (event_id, key, value) to one column per given key; (event, key) is unique."""
    return metadata.filter(F.col("key").isin(*names)).groupBy("event_id").pivot("key", names).agg(F.max("value"))
