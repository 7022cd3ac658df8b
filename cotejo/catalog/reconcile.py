"""Queries of de-duplication, consensus, pairing and unions (inventory G1, G8, J1, J3, J4, V9, F6, U1-U3, L5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.catalog.common import VOTE_SQL, positional_pairs
from cotejo.functions import text as tx
from cotejo.operators import pairing, reconcile as rec
from cotejo.plans import derive, digit_ensemble
from cotejo.plans.derive import WRITTEN_SQL, with_detections, with_readings

c = F.col

DEDUPED_SQL = """,
best_a AS (
  SELECT form_id, id_number, min(ord) AS ord,
         arg_max({'confidence': confidence, 'digit_conf': digit_conf}, confidence * 100000 - ord) AS best
  FROM det_a GROUP BY form_id, id_number),
best_b AS (
  SELECT form_id, id_number, min(ord) AS ord,
         arg_max({'confidence': confidence, 'digit_conf': digit_conf}, confidence * 100000 - ord) AS best
  FROM det_b GROUP BY form_id, id_number),
list_a AS (
  SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY ord) - 1 AS pos, id_number AS a_id,
         best.confidence AS a_conf, best.digit_conf AS a_digits FROM best_a),
list_b AS (
  SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY ord) - 1 AS pos, id_number AS b_id,
         best.confidence AS b_conf, best.digit_conf AS b_digits FROM best_b)"""


def g1_dedupe_best(spark, sf):
    return rec.dedupe_best(derive.detections_a(spark, sf)).select("form_id", "id_number", "ord", "confidence", "seed")


def j1_whole_id_consensus(spark, sf):
    a, b = rec.dedupe_best(derive.detections_a(spark, sf)), rec.dedupe_best(derive.detections_b(spark, sf))
    return rec.whole_id_consensus(a, b)


def _lists(spark, sf):
    a = digit_ensemble.reading_list(derive.detections_a(spark, sf), "a")
    b = digit_ensemble.reading_list(derive.detections_b(spark, sf), "b")
    return a, b


def j3_pair_readings(spark, sf):
    return pairing.pair_readings(*_lists(spark, sf)).select("form_id", "pos", "b_pos", "how", "a_id", "b_id")


def _lossy_lists(spark, sf):
    """B reads no row of every seventh form, so those forms have an unpaired remainder."""
    a, b = _lists(spark, sf)
    return a, b.filter(c("form_id") % 7 != 0)


def j4_unpaired_remainder(spark, sf):
    a, b = _lossy_lists(spark, sf)
    pairs = a.join(b, ["form_id", "pos"])
    return pairing.unpaired_remainder(a, b, pairs)


def v9_digit_ensemble(spark, sf):
    out = digit_ensemble.reconcile(derive.detections_a(spark, sf), derive.detections_b(spark, sf))
    return out.withColumn("confidence", F.round("confidence", 6))


def v9_positional_ensemble(spark, sf):
    out = digit_ensemble.reconcile_by_position(derive.detections_a(spark, sf), derive.detections_b(spark, sf))
    return out.withColumn("confidence", F.round("confidence", 6))


def l5_surer_candidate(spark, sf):
    pick = rec.surer(c("a_conf"), c("b_conf"))
    return positional_pairs(spark, sf).select(
        "form_id", "pos", pick.alias("side"), F.when(pick == "a", c("a_id")).otherwise(c("b_id")).alias("id_number")
    )


def _provider_readings(spark, sf):
    """Readings of five recognisers; provider and confidence by rule."""
    seed = c("seed")
    names = F.array(*[F.lit(n) for n in rec.ACCEPTANCE])
    return derive.written_rows(spark, sf).select(
        "form_id", "pos", F.element_at(names, (seed % 5 + 1).cast("int")).alias("provider"),
        F.left("true_id", (F.lit(12) - seed % 11).cast("int")).alias("id_number"),
        (seed % 103 / 100.0 - 0.02e0).alias("confidence"),
    )


PROVIDERS_SQL = WRITTEN_SQL + """,
prov AS (
  SELECT form_id, pos, (['google', 'azure', 'tesseract', 'easyocr', 'paddleocr'])[seed % 5 + 1] AS provider,
         substr(true_id, 1, 12 - seed % 11) AS id_number, CAST(seed % 103 AS DOUBLE) / 100 - 0.02e0 AS confidence
  FROM written)"""


def f6_accept_readings(spark, sf):
    return rec.accept_readings(_provider_readings(spark, sf))


def _passes(spark, sf):
    w = derive.written_rows(spark, sf)
    seed = c("seed")
    for rank, mode in enumerate((4, 6, 11, 13)):
        text = F.when(seed % 7 == rank, F.concat(F.left("true_id", F.lit(3)), F.lit(". "), F.substr("true_id", F.lit(4))))
        text = text.when(seed % 13 == rank, F.concat("true_id", F.lit("x"))).otherwise(c("true_id"))
        yield w.filter((seed + mode) % 3 != 0).select(
            "form_id", text.alias("id_number"), (c("pos") * 4 + rank).alias("ord"), F.lit("tesseract").alias("provider"),
            ((seed * mode) % 101 / 100.0 - 0.01e0).alias("confidence"),
        )


def u1_multi_pass_union(spark, sf):
    return rec.multi_pass_union(*_passes(spark, sf)).select("form_id", "id_number", "ord", F.round("confidence", 6).alias("confidence"))


def u2_fallback_if_empty(spark, sf):
    first = rec.accept_readings(_provider_readings(spark, sf).filter(c("provider") == "easyocr"))
    first = first.select("form_id", "id_number", "confidence")
    text = F.concat(F.lit("N. "), c("true_id"), F.lit("/x"), c("pos").cast("string"))
    second = derive.written_rows(spark, sf).select(
        "form_id", F.explode(tx.all_digit_runs(text)).alias("id_number"), (c("seed") % 101 / 100.0).alias("confidence")
    )
    local = rec.fallback_if_empty(first, second).withColumn("rule", F.lit("fixed"))
    other = rec.fallback_if_empty(first, second, factor=0.8).withColumn("rule", F.lit("scaled"))
    return local.unionByName(other).withColumn("confidence", F.round("confidence", 6))


def u3_preferred_provider(spark, sf):
    return rec.preferred_provider(_provider_readings(spark, sf))


def g8_extraction_counters(spark, sf):
    raw = _provider_readings(spark, sf).withColumn("id_number", F.left("id_number", F.length("id_number") - 1))
    long_ids = raw.withColumn("id_number", F.concat("id_number", "id_number"))
    return rec.extraction_counters(raw.unionByName(raw.filter(c("pos") == 0)).unionByName(long_ids), "provider")


QUERIES = {
    "g1_dedupe_best": (g1_dedupe_best, with_detections("""
SELECT form_id, id_number, min(ord) AS ord, max(confidence) AS confidence,
       arg_max(seed, confidence * 100000 - ord) AS seed FROM det_a GROUP BY form_id, id_number""")),
    "j1_whole_id_consensus": (j1_whole_id_consensus, with_detections("""
SELECT form_id, id_number,
       CASE WHEN a.ord IS NOT NULL AND b.ord IS NOT NULL THEN 1e0 ELSE coalesce(a.best.confidence, b.best.confidence) END
         AS confidence,
       coalesce(a.ord, b.ord) AS idx, CASE WHEN a.ord IS NULL THEN 2 WHEN b.ord IS NULL THEN 1 ELSE 0 END AS part
FROM best_a a FULL JOIN best_b b USING (form_id, id_number)""", DEDUPED_SQL)),
    "j3_pair_readings": (j3_pair_readings, None),
    "j4_unpaired_remainder": (j4_unpaired_remainder, with_detections("""
SELECT form_id, 1 AS part, pos, 'unpaired_a' AS outcome, a_id AS id_number, a_conf AS confidence
FROM list_a l SEMI JOIN uneven USING (form_id)
WHERE a_conf >= 0.58e0 AND NOT EXISTS (SELECT 1 FROM paired p WHERE p.form_id = l.form_id AND p.a_id = l.a_id)
UNION ALL
SELECT form_id, 2, pos, 'unpaired_b', b_id, b_conf
FROM lossy_b l SEMI JOIN uneven USING (form_id)
WHERE b_conf >= 0.58e0 AND NOT EXISTS (SELECT 1 FROM paired p WHERE p.form_id = l.form_id AND p.b_id = l.b_id)""",
        DEDUPED_SQL + """,
lossy_b AS (SELECT * FROM list_b WHERE form_id % 7 <> 0),
paired AS (SELECT form_id, pos, a_id, b_id FROM list_a JOIN lossy_b USING (form_id, pos)),
uneven AS (
  SELECT form_id FROM (SELECT form_id, 1 AS s FROM list_a UNION ALL SELECT form_id, -1 FROM lossy_b)
  GROUP BY form_id HAVING abs(sum(s)) > 2)""")),
    "v9_digit_ensemble": (v9_digit_ensemble, None),
    "v9_positional_ensemble": (v9_positional_ensemble, with_detections("""
SELECT form_id, pos, outcome, id_number, round(confidence, 6) AS confidence FROM combined""",
        DEDUPED_SQL + ", pairs AS (SELECT * FROM list_a JOIN list_b USING (form_id, pos))" + VOTE_SQL)),
    "l5_surer_candidate": (l5_surer_candidate, with_readings("""
SELECT form_id, pos, CASE WHEN a.confidence >= b.confidence THEN 'a' ELSE 'b' END AS side,
       CASE WHEN a.confidence >= b.confidence THEN a.id_number ELSE b.id_number END AS id_number
FROM a JOIN b USING (form_id, pos)""")),
    "f6_accept_readings": (f6_accept_readings, "WITH" + PROVIDERS_SQL + """
SELECT form_id, pos, provider, id_number,
       CASE WHEN provider = 'tesseract' THEN greatest(confidence, 0.3e0) ELSE confidence END AS confidence
FROM prov
WHERE length(id_number) BETWEEN 3 AND 11
  AND CASE WHEN provider = 'tesseract' THEN confidence >= 0e0 WHEN provider IN ('easyocr', 'paddleocr')
           THEN confidence >= 0.3e0 ELSE true END"""),
    "u1_multi_pass_union": (u1_multi_pass_union, "WITH" + WRITTEN_SQL + """,
passes AS (
  SELECT form_id, pos * 4 + rank AS ord, CAST((seed * mode) % 101 AS DOUBLE) / 100 - 0.01e0 AS confidence,
         CASE WHEN seed % 7 = rank THEN substr(true_id, 1, 3) || '. ' || substr(true_id, 4)
              WHEN seed % 13 = rank THEN true_id || 'x' ELSE true_id END AS raw
  FROM written, (VALUES (0, 4), (1, 6), (2, 11), (3, 13)) m(rank, mode)
  WHERE (seed + mode) % 3 <> 0),
kept AS (
  SELECT form_id, ord, regexp_replace(raw, '[ .,]', '', 'g') AS id_number, greatest(confidence, 0.3e0) AS confidence
  FROM passes WHERE confidence >= 0e0)
SELECT form_id, id_number, min(ord) AS ord, round(max(confidence), 6) AS confidence
FROM kept WHERE regexp_full_match(id_number, '[0-9]{3,11}') GROUP BY form_id, id_number"""),
    "u2_fallback_if_empty": (u2_fallback_if_empty, "WITH" + PROVIDERS_SQL + """,
first AS (
  SELECT form_id, id_number, confidence FROM prov
  WHERE provider = 'easyocr' AND length(id_number) BETWEEN 3 AND 11 AND confidence >= 0.3e0),
second AS (
  SELECT form_id, unnest(regexp_extract_all('N. ' || true_id || '/x' || pos, '[0-9]+')) AS id_number,
         CAST(seed % 101 AS DOUBLE) / 100 AS confidence
  FROM written),
extra AS (
  SELECT * FROM second ANTI JOIN first USING (form_id) WHERE length(id_number) BETWEEN 3 AND 11)
SELECT form_id, id_number, round(confidence, 6) AS confidence, rule FROM (
  SELECT *, 'fixed' AS rule FROM first UNION ALL SELECT *, 'scaled' FROM first
  UNION ALL SELECT form_id, id_number, 0.6e0, 'fixed' FROM extra
  UNION ALL SELECT form_id, id_number, confidence * 0.8e0, 'scaled' FROM extra)"""),
    "u3_preferred_provider": (u3_preferred_provider, "WITH" + PROVIDERS_SQL + """
SELECT form_id, pos, provider, id_number, confidence
FROM (SELECT *, min(rank) OVER (PARTITION BY form_id) AS best
      FROM (SELECT *, list_position(['google', 'azure', 'tesseract'], provider) AS rank FROM prov) WHERE rank > 0)
WHERE rank = best"""),
    "g8_extraction_counters": (g8_extraction_counters, "WITH" + PROVIDERS_SQL + """,
raw AS (SELECT provider, pos, substr(id_number, 1, length(id_number) - 1) AS id_number FROM prov),
everything AS (
  SELECT provider, id_number FROM raw UNION ALL SELECT provider, id_number FROM raw WHERE pos = 0
  UNION ALL SELECT provider, id_number || id_number FROM raw)
SELECT provider, count(*) AS raw, count(DISTINCT id_number) FILTER (WHERE ok) AS "unique",
       count(*) FILTER (WHERE ok) - count(DISTINCT id_number) FILTER (WHERE ok) AS duplicates,
       count(*) FILTER (WHERE length(id_number) < 3) AS too_short,
       count(*) FILTER (WHERE length(id_number) > 11) AS too_long
FROM (SELECT *, length(id_number) BETWEEN 3 AND 11 AS ok FROM everything) GROUP BY provider"""),
}
