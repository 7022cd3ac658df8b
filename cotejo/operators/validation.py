"""Form rows against the registry, and the decisions that follow.

No published formula exists for the fields; this one is ours: accents stripped and upper-cased, each registry field
is compared with every written word, the best edit similarity counts, and the mean over the non-empty fields is the
confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.functions import account, ident, text as tx

FIELDS = ("first_name", "second_name", "first_surname", "second_surname")
THRESHOLD = 0.85


def _plain(text: Column) -> Column:
    return F.upper(tx.strip_accents(tx.normalize_whitespace(text)))


def validate_rows(rows: DataFrame, registry: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (.., id_number, names) with status, action, confidence, matches and the decision flags. A person without
    first name and first surname counts as not found. ``registry`` has one row per identifier."""
    people = registry.select("id_number", *FIELDS)
    joined = rows.join(people, "id_number", "left").withColumn("words", F.split(_plain(F.col("names")), " "))
    blank = [F.coalesce(F.col(f), F.lit("")) == "" for f in ("first_name", "first_surname")]
    found = ~(blank[0] & blank[1])

    def match(field: str) -> Column:
        best = F.array_max(F.transform("words", lambda w: tx.edit_similarity(w, _plain(F.col(field)))))
        return F.when(
            F.coalesce(F.col(field), F.lit("")) != "",
            F.struct(F.lit(field).alias("field_name"), (best >= threshold).alias("match"), best.alias("similarity"),
                     F.col(field).alias("compared")),
        )

    matches = F.array_compact(F.array(*[match(f) for f in FIELDS]))
    scored = joined.withColumn("matches", F.when(found, matches).otherwise(F.slice(matches, 1, 0)))
    total = F.aggregate("matches", F.lit(0.0), lambda acc, m: acc + m["similarity"])
    mean = F.when(F.size("matches") > 0, total / F.size("matches")).otherwise(F.lit(0.0))
    scored = scored.withColumn("confidence", ident.clamp_unit(mean))
    status = F.when(~found, "ERROR").when(F.col("confidence") >= threshold, "OK").otherwise("WARNING")
    action = (
        F.when(F.col("status") == "ERROR", "ALERT_NOT_FOUND").when(F.col("status") == "OK", "AUTO_SAVE")
        .otherwise("REQUIRE_VALIDATION")
    )
    decided = scored.withColumn("status", status).withColumn("action", action)
    return decided.withColumns(account.decision_flags(F.col("status"), F.col("action"))).drop("words", *FIELDS)


def processing_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """One pass over validated rows (is_empty, action, user_decision). A ``save`` decision on a review also counts as
    saved; a row that is neither empty nor decided is an error."""
    filled = ~F.col("is_empty")
    review = filled & (F.col("action") == "REQUIRE_VALIDATION")
    saved = (filled & (F.col("action") == "AUTO_SAVE")) | (review & (F.coalesce("user_decision", F.lit("")) == "save"))
    error = filled & F.col("action").isNull()
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total_rows"), F.count_if(~error).alias("processed_rows"), F.count_if(saved).alias("auto_saved"),
        F.count_if(review).alias("required_validation"), F.count_if(F.col("is_empty")).alias("empty_rows"),
        F.count_if(filled & (F.col("action") == "ALERT_NOT_FOUND")).alias("not_found"), F.count_if(error).alias("errors"),
    )
