"""Shared pieces of the query catalogue: paired readings in Spark and the vote in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cotejo.plans import derive
from cotejo.plans.derive import with_readings


def pair_columns(df: DataFrame, side: str) -> DataFrame:
    return df.select(
        "form_id", "pos", F.col("id_number").alias(f"{side}_id"), F.col("confidence").alias(f"{side}_conf"),
        F.col("digit_conf").alias(f"{side}_digits"),
    )


def positional_pairs(spark, sf_dir) -> DataFrame:
    a = pair_columns(derive.readings_a(spark, sf_dir), "a")
    b = pair_columns(derive.readings_b(spark, sf_dir), "b")
    return a.join(b, ["form_id", "pos"])


PAIRS_SQL = """,
pairs AS (
  SELECT form_id, pos, a.id_number AS a_id, a.confidence AS a_conf, a.digit_conf AS a_digits,
         b.id_number AS b_id, b.confidence AS b_conf, b.digit_conf AS b_digits
  FROM a JOIN b USING (form_id, pos))"""

VOTE_SQL = """,
prio AS (
  SELECT *,
         CASE length(a_id) WHEN 10 THEN 3 WHEN 8 THEN 2 WHEN 9 THEN 1 ELSE 0 END AS ra,
         CASE length(b_id) WHEN 10 THEN 3 WHEN 8 THEN 2 WHEN 9 THEN 1 ELSE 0 END AS rb
  FROM pairs),
chosen_length AS (
  SELECT *, CASE WHEN length(a_id) = length(b_id) THEN NULL WHEN ra > rb THEN 'a' WHEN rb > ra THEN 'b'
                 WHEN a_conf >= b_conf THEN 'a' ELSE 'b' END AS choice
  FROM prio),
digits0 AS (
  SELECT form_id, pos, t.i AS i, substr(a_id, t.i + 1, 1) AS ad, a_digits[t.i + 1] AS ac,
         substr(b_id, t.i + 1, 1) AS bd, b_digits[t.i + 1] AS bc
  FROM chosen_length, unnest(range(CAST(length(a_id) AS BIGINT))) AS t(i)
  WHERE length(a_id) = length(b_id)),
digits1 AS (
  SELECT *, CASE least(ad, bd) || greatest(ad, bd)
              WHEN '17' THEN 0.15e0 WHEN '27' THEN 0.12e0 WHEN '56' THEN 0.10e0
              WHEN '38' THEN 0.08e0 WHEN '06' THEN 0.08e0 WHEN '49' THEN 0.07e0 END AS prob
  FROM digits0),
digits2 AS (
  SELECT *, CASE WHEN ad <> bd AND prob IS NOT NULL AND ac < 0.58e0 AND bc >= 0.75e0
                 THEN 0.58e0 - 0.10e0 ELSE 0.58e0 END AS floor_conf,
         CASE WHEN prob IS NULL THEN 0.10e0 ELSE greatest(0.05e0, 0.10e0 - prob) END AS min_gap
  FROM digits1),
digits AS (
  SELECT *,
         (ac < floor_conf OR bc < floor_conf OR (ad <> bd AND abs(ac - bc) < min_gap)) AS rejected,
         CASE WHEN ad = bd OR ac > bc THEN ad ELSE bd END AS chosen,
         CASE WHEN ad = bd THEN least(0.99e0, (ac + bc) / 2 + 0.03e0) WHEN ac > bc THEN ac ELSE bc END AS conf,
         CASE WHEN ad = bd THEN 'both'
              ELSE CASE WHEN ac > bc THEN 'primary' ELSE 'secondary' END
                   || CASE WHEN ad IN ('1', '7') AND bd IN ('1', '7')
                            AND ((ac < 0.70e0 AND bc > 0.80e0) OR (bc < 0.70e0 AND ac > 0.80e0))
                           THEN ' (ajustado)' ELSE '' END END AS source,
         CASE WHEN ad = bd THEN 'unanimous' ELSE 'highest_confidence' END AS type
  FROM digits2),
voted AS (
  SELECT form_id, pos, bool_or(rejected) AS rejected, string_agg(chosen, '' ORDER BY i) AS id_number,
         sum(conf) / count(*) AS confidence, count(*) AS total_digits,
         count(*) FILTER (WHERE type = 'unanimous') AS unanimous_count,
         count(*) FILTER (WHERE type <> 'unanimous') AS conflict_count
  FROM digits GROUP BY form_id, pos),
combined AS (
  SELECT c.form_id, c.pos, c.a_id, c.b_id, c.a_conf, c.b_conf,
         CASE WHEN c.choice IS NOT NULL THEN 'length' WHEN v.rejected THEN 'fallback' ELSE 'vote' END AS outcome,
         CASE WHEN c.choice = 'a' THEN a_id WHEN c.choice = 'b' THEN b_id WHEN NOT v.rejected THEN v.id_number
              WHEN a_conf >= b_conf THEN a_id ELSE b_id END AS id_number,
         CASE WHEN c.choice = 'a' THEN a_conf WHEN c.choice = 'b' THEN b_conf WHEN NOT v.rejected THEN v.confidence
              WHEN a_conf >= b_conf THEN a_conf ELSE b_conf END AS confidence
  FROM chosen_length c LEFT JOIN voted v USING (form_id, pos))"""


def with_vote(body: str) -> str:
    return with_readings(body, PAIRS_SQL + VOTE_SQL)
