"""Queries of the digit vote (inventory V1-V7, G2-G4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.catalog.common import PAIRS_SQL, positional_pairs, with_vote
from cotejo.operators import voting
from cotejo.plans.derive import with_readings


def v1_length_arbitration(spark, sf):
    p = positional_pairs(spark, sf)
    choice = voting.length_choice(F.col("a_id"), F.col("a_conf"), F.col("b_id"), F.col("b_conf"))
    return p.select(
        "form_id", "pos", "a_id", "b_id", choice.alias("choice"),
        voting.is_standard_length(F.length("a_id")).alias("a_standard"),
        voting.is_standard_length(F.length("b_id")).alias("b_standard"),
    )


def v2_digit_at_position(spark, sf):
    p = positional_pairs(spark, sf)
    longest = F.greatest(F.length("a_id"), F.length("b_id"))
    p = p.select("*", F.explode(F.sequence(F.lit(0), longest - 1)).alias("i"))
    a = voting.digit_at(F.col("a_id"), F.col("a_digits"), F.col("i"))
    b = voting.digit_at(F.col("b_id"), F.col("b_digits"), F.col("i"))
    return p.select(
        "form_id", "pos", "i", a["digit"].alias("a_digit"), a["conf"].alias("a_digit_conf"),
        b["digit"].alias("b_digit"), b["conf"].alias("b_digit_conf"),
    )


KEYS = ("form_id", "pos")


def v3_effective_threshold(spark, sf):
    c = F.col
    rows = voting.digit_rows(positional_pairs(spark, sf), *KEYS).filter(c("i").isNotNull())
    return rows.select(
        *KEYS, "i",
        F.round(voting.effective_threshold(c("ad"), c("ac"), c("bd"), c("bc"), c("prob")), 6).alias("threshold"),
        F.round(voting.ambiguity_limit(c("prob")), 6).alias("min_gap"),
    )


def _votes(spark, sf):
    votes = voting.digit_votes(positional_pairs(spark, sf), *KEYS).filter(F.col("i").isNotNull())
    kept = {k: F.when(~F.col("rejected"), F.col(k)) for k in ("chosen", "conf", "source", "type")}
    return votes.withColumns(kept)


def _combined(spark, sf):
    return voting.combine_pairs(positional_pairs(spark, sf), *KEYS)


def v4_digit_comparison(spark, sf):
    return _votes(spark, sf).select(*KEYS, "i", "rejected", "chosen", F.round("conf", 6).alias("conf"), "type")


def v5_conflict_resolution(spark, sf):
    return _votes(spark, sf).filter(F.col("ad") != F.col("bd")).select(
        *KEYS, "i", F.col("ad").alias("a_digit"), F.col("bd").alias("b_digit"), "rejected", "source", "chosen"
    )


def v6_combined_record(spark, sf):
    return v7_fallback(spark, sf).filter(F.col("outcome") != "fallback")


def v7_fallback(spark, sf):
    return _combined(spark, sf).select(*KEYS, "outcome", "id_number", F.round("confidence", 6).alias("confidence"))


def g2_vote_statistics(spark, sf):
    s = voting.vote_statistics(_combined(spark, sf).filter(F.col("outcome") == "vote"))
    return s.select(
        *KEYS, "total_digits", "unanimous_count", "conflict_count", "conflict_flag",
        *[F.round(k, 6).alias(k) for k in ("unanimous_ratio", "conflict_ratio", "mean_confidence")],
    )


def g3_comparison_table(spark, sf):
    rows = voting.comparison_table(positional_pairs(spark, sf), *KEYS)
    return rows.withColumns({k: F.round(k, 4) for k in ("a_pct", "b_pct", "chosen_pct")})


def g4_confusion_matrix(spark, sf):
    m = voting.confusion_matrix(positional_pairs(spark, sf))
    return m.withColumn("share", F.round("share", 6))


QUERIES = {
    "v1_length_arbitration": (v1_length_arbitration, with_vote("""
SELECT form_id, pos, a_id, b_id, choice, length(a_id) IN (8, 9, 10) AS a_standard,
       length(b_id) IN (8, 9, 10) AS b_standard
FROM chosen_length""")),
    "v2_digit_at_position": (v2_digit_at_position, with_readings("""
SELECT form_id, pos, t.i AS i,
       CASE WHEN t.i < length(a_id) THEN substr(a_id, t.i + 1, 1) END AS a_digit,
       CASE WHEN t.i < length(a_id) THEN a_digits[t.i + 1] ELSE 0e0 END AS a_digit_conf,
       CASE WHEN t.i < length(b_id) THEN substr(b_id, t.i + 1, 1) END AS b_digit,
       CASE WHEN t.i < length(b_id) THEN b_digits[t.i + 1] ELSE 0e0 END AS b_digit_conf
FROM pairs, unnest(range(CAST(greatest(length(a_id), length(b_id)) AS BIGINT))) AS t(i)""", PAIRS_SQL)),
    "v3_effective_threshold": (v3_effective_threshold, with_vote("""
SELECT form_id, pos, i, round(floor_conf, 6) AS threshold, round(min_gap, 6) AS min_gap FROM digits""")),
    "v4_digit_comparison": (v4_digit_comparison, with_vote("""
SELECT form_id, pos, i, rejected, CASE WHEN NOT rejected THEN chosen END AS chosen,
       CASE WHEN NOT rejected THEN round(conf, 6) END AS conf, CASE WHEN NOT rejected THEN type END AS type
FROM digits""")),
    "v5_conflict_resolution": (v5_conflict_resolution, with_vote("""
SELECT form_id, pos, i, ad AS a_digit, bd AS b_digit, rejected, CASE WHEN NOT rejected THEN source END AS source,
       CASE WHEN NOT rejected THEN chosen END AS chosen
FROM digits WHERE ad <> bd""")),
    "v6_combined_record": (v6_combined_record, with_vote("""
SELECT form_id, pos, outcome, id_number, round(confidence, 6) AS confidence FROM combined
WHERE outcome <> 'fallback'""")),
    "v7_fallback": (v7_fallback, with_vote("""
SELECT form_id, pos, outcome, id_number, round(confidence, 6) AS confidence FROM combined""")),
    "g2_vote_statistics": (g2_vote_statistics, with_vote("""
SELECT form_id, pos, total_digits, unanimous_count, conflict_count,
       conflict_count / total_digits > 0.40e0 OR unanimous_count / total_digits < 0.60e0 AS conflict_flag,
       round(unanimous_count / total_digits, 6) AS unanimous_ratio,
       round(conflict_count / total_digits, 6) AS conflict_ratio, round(confidence, 6) AS mean_confidence
FROM voted WHERE NOT rejected""")),
    "g3_comparison_table": (g3_comparison_table, with_vote("""
SELECT d.form_id, d.pos, d.i AS digit_pos, ad AS a_digit, round(ac * 100, 4) AS a_pct, bd AS b_digit,
       round(bc * 100, 4) AS b_pct, chosen, round(conf * 100, 4) AS chosen_pct, source, type
FROM digits d JOIN voted v ON d.form_id = v.form_id AND d.pos = v.pos WHERE NOT v.rejected""")),
    "g4_confusion_matrix": (g4_confusion_matrix, with_vote("""
SELECT ad AS a_digit, bd AS b_digit, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY ad), 6) AS share
FROM digits GROUP BY ad, bd""")),
}
