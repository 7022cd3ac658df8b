"""Queries of the column functions (inventory S3, T1-T14, N1-N9, N22, F1-F6, F10, A1, A2, A7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.catalog.common import PAIRS_SQL, positional_pairs
from cotejo.functions import geometry as geo, ident, text as tx
from cotejo.plans import derive
from cotejo.plans.derive import WRITTEN_SQL, with_readings
from cotejo.sources.responses import scan_lines

c = F.col


def _documents(spark, sf):
    return derive.table(spark, sf, "documents").select("doc_id", "text")


def _lines(spark, sf):
    return scan_lines(_documents(spark, sf), "text", "doc_id")


LINES_SQL = """
lines0 AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
lines AS (SELECT * FROM lines0 WHERE regexp_replace(line, '@B', '', 'g') <> '')"""


def _sql(body: str, ctes: str = "") -> str:
    whole = ("WITH" + ctes + "\n" if ctes else "") + body
    return whole.replace("@B", tx.BLANKS)


def _on_text(expr):
    def run(spark, sf):
        return _documents(spark, sf).select("doc_id", *[e.alias(n) for n, e in expr(c("text")).items()])

    return run


def _on_lines(expr):
    def run(spark, sf):
        return _lines(spark, sf).select("doc_id", "line_no", *[e.alias(n) for n, e in expr(c("line")).items()])

    return run


def s3_scan_lines(spark, sf):
    return _lines(spark, sf)


def t5_fix_confusable_letters(spark, sf):
    turns = derive.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", tx.fix_confusable_letters(c("text")).alias("digits"))


def t11_sequence_ratio(spark, sf):
    p = positional_pairs(spark, sf)
    return p.select("form_id", "pos", "a_id", "b_id", tx.sequence_ratio(c("a_id"), c("b_id")).alias("ratio"))


def t12_edit_similarity(spark, sf):
    p = positional_pairs(spark, sf)
    return p.select("form_id", "pos", F.round(tx.edit_similarity(c("a_id"), c("b_id")), 6).alias("similarity"))


def t14_full_name(spark, sf):
    cu = derive.table(spark, sf, "customer")
    key = c("c_custkey")
    second = F.when(key % 5 == 0, "").when(key % 7 == 0, None).otherwise(c("c_mktsegment"))
    third = F.when(key % 11 != 0, c("c_nationkey").cast("string"))
    return cu.select("c_custkey", tx.full_name(c("c_name"), second, third, F.lit("")).alias("full_name"))


def n1_normalize_confidence(spark, sf):
    li = derive.table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.round(ident.normalize_confidence(c("l_quantity") * 3), 6).alias("from_percent"),
        ident.normalize_confidence(c("l_discount")).alias("from_fraction"),
        ident.normalize_confidence(c("l_discount") - 0.05e0).alias("shifted"),
    )


def n2_confidence_level(spark, sf):
    conf = c("l_quantity") / 50.0
    return derive.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ident.confidence_level(conf).alias("level"), ident.is_high(conf).alias("high"),
        ident.is_acceptable(conf).alias("acceptable"), ident.is_low(conf).alias("low"),
        (conf >= 0.8).alias("meets"),
    )


def n3_format_confidence(spark, sf):
    w = derive.written_rows(spark, sf)
    return w.select(
        "form_id", "pos", ident.format_confidence((c("seed") % 101) / 100.0).alias("whole"),
        ident.format_confidence((c("seed") % 201) / 200.0).alias("halves"),
        ident.format_confidence((c("seed") % 1001) / 1000.0, 1).alias("tenths"),
    )


def n4_format_id(spark, sf):
    w = derive.written_rows(spark, sf)
    padded = F.when(c("seed") % 4 == 0, F.concat(F.lit("0"), c("true_id"))).otherwise(c("true_id"))
    return w.select("form_id", "pos", ident.format_id(padded).alias("dotted"), ident.format_id(padded, " ").alias("spaced"))


def _candidate_ids(spark, sf):
    """Texts that are sometimes identifiers: cut, padded, lettered, blank."""
    seed, t = c("seed"), c("true_id")
    raw = (
        F.when(seed % 6 == 0, F.concat(F.lit(" "), t, F.lit(" "))).when(seed % 6 == 1, F.concat(F.lit("0"), t))
        .when(seed % 6 == 2, F.left(t, (seed % 10).cast("int"))).when(seed % 6 == 3, F.concat(t, F.lit("77")))
        .when(seed % 6 == 4, F.concat(F.left(t, F.lit(4)), F.lit("-C"), F.substr(t, F.lit(5)))).otherwise(t)
    )
    return derive.written_rows(spark, sf).select("form_id", "pos", "seed", raw.alias("raw"),
                                                 (c("seed") % 101 / 100.0).alias("conf"))


CANDIDATES_SQL = WRITTEN_SQL + """,
cand AS (
  SELECT form_id, pos, seed, CAST(seed % 101 AS DOUBLE) / 100 AS conf,
         CASE seed % 6 WHEN 0 THEN ' ' || true_id || ' ' WHEN 1 THEN '0' || true_id
           WHEN 2 THEN substr(true_id, 1, seed % 10) WHEN 3 THEN true_id || '77'
           WHEN 4 THEN substr(true_id, 1, 4) || '-C' || substr(true_id, 5) ELSE true_id END AS raw
  FROM written)"""


def n5_is_valid_id(spark, sf):
    raw = c("raw")
    return _candidate_ids(spark, sf).select(
        "form_id", "pos", ident.is_valid_id(raw).alias("valid"), ident.is_strict_id(raw).alias("strict"),
        ident.try_create(raw).alias("created"), ident.try_create(raw, False).alias("created_no_zero"),
        ident.is_colombian(raw).alias("colombian"), ident.from_raw_reading(raw).alias("from_raw"),
    )


def _rectangles(spark, sf):
    seed = c("seed")
    return derive.written_rows(spark, sf).select(
        "form_id", "pos", (seed % 900).cast("int").alias("x"), (seed % 700).cast("int").alias("y"),
        (seed % 90 + 1).cast("int").alias("w"), (seed % 70 + 1).cast("int").alias("h"),
        (seed % 1000).cast("int").alias("px"), (seed % 777).cast("int").alias("py"),
    )


RECT_SQL = WRITTEN_SQL + """,
rect AS (
  SELECT form_id, pos, CAST(seed % 900 AS INTEGER) AS x, CAST(seed % 700 AS INTEGER) AS y,
         CAST(seed % 90 + 1 AS INTEGER) AS w, CAST(seed % 70 + 1 AS INTEGER) AS h,
         CAST(seed % 1000 AS INTEGER) AS px, CAST(seed % 777 AS INTEGER) AS py
  FROM written)"""


def n6_distance(spark, sf):
    return _rectangles(spark, sf).select(
        "form_id", "pos", F.round(geo.distance(c("x"), c("y"), c("px"), c("py")), 6).alias("distance"),
        geo.manhattan(c("x"), c("y"), c("px"), c("py")).alias("manhattan"),
    )


def n7_bounds_and_translate(spark, sf):
    moved = geo.translate(c("x"), c("y"), F.lit(-300), F.lit(-200))
    return _rectangles(spark, sf).select(
        "form_id", "pos", geo.within_bounds(c("x"), c("y"), 100, 100, 500, 400).alias("inside"),
        moved["x"].alias("moved_x"), moved["y"].alias("moved_y"),
    )


def n8_rectangle_parts(spark, sf):
    box = (c("x"), c("y"), c("w"), c("h"))
    k, mid = geo.corners(*box), geo.center(*box)
    return _rectangles(spark, sf).select(
        "form_id", "pos", k["top_right"]["x"].alias("right_x"), k["bottom_right"]["y"].alias("bottom_y"),
        mid["x"].alias("center_x"), mid["y"].alias("center_y"), geo.area(c("w"), c("h")).alias("area"),
        geo.contains(*box, c("px"), c("py")).alias("contains_point"),
    )


def n9_rectangle_overlaps(spark, sf):
    hit = geo.overlaps(c("x"), c("y"), c("w"), c("h"), c("px"), c("py"), c("h"), c("w"))
    return _rectangles(spark, sf).select("form_id", "pos", hit.alias("overlap"))


def n22_image_size(spark, sf):
    w, h = (c("x") * 13).cast("int"), (c("y") * 17).cast("int")
    fitted = geo.fitted_size(w, h)
    problem = geo.size_problem(w, h)
    return _rectangles(spark, sf).select("form_id", "pos", (problem == "").alias("valid"), problem.alias("reason"),
                        fitted["w"].alias("fit_w"), fitted["h"].alias("fit_h"))


def f1_specifications(spark, sf):
    raw, conf = c("raw"), c("conf")
    return _candidate_ids(spark, sf).select(
        "form_id", "pos", ident.has_only_digits(raw).alias("only_digits"), ident.has_length(raw).alias("length_ok"),
        ident.has_length(raw, 6, 10).alias("length_6_10"), ident.has_confidence(conf, 50.0).alias("confident"),
        ident.has_no_leading_zero(raw).alias("no_leading_zero"),
    )


def f2_combinators(spark, sf):
    raw, conf = c("raw"), c("conf")
    digits, sure, zero = ident.has_only_digits(raw), ident.has_confidence(conf, 80.0), ident.has_no_leading_zero(raw)
    return _candidate_ids(spark, sf).filter((digits & sure) | ~zero).select("form_id", "pos", "raw")


def f3_presets(spark, sf):
    raw, conf = c("raw"), c("conf")
    return _candidate_ids(spark, sf).select(
        "form_id", "pos", ident.valid_for_processing(raw, conf).alias("processing"),
        ident.colombian_spec(raw, conf).alias("colombian"), ident.high_confidence_spec(raw, conf).alias("high"),
        ident.composite_spec(raw, conf, 6, 10, 70.0, False).alias("composite"),
    )


def f4_record_is_valid(spark, sf):
    return _candidate_ids(spark, sf).filter(ident.record_is_valid(c("raw"), c("conf"))).select("form_id", "pos", "raw")


def f5_validation_tier(spark, sf):
    tiers = _candidate_ids(spark, sf).select(ident.validation_tier(c("raw"), c("conf")).alias("tier"), "conf")
    return tiers.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("mean_conf"))


def a1_row_band(spark, sf):
    y = c("py").cast("double") - 20.0
    height = (c("y") + 200).cast("double")
    return _rectangles(spark, sf).select("form_id", "pos", geo.row_band(y, height, 15).alias("row_index"))


def a2_fixed_rows(spark, sf):
    height = (c("c_custkey") * 7 % 900 + 100).cast("int")
    pages = derive.table(spark, sf, "customer").select("c_custkey", F.explode(geo.fixed_rows(height)).alias("r"))
    return pages.select("c_custkey", "r.row_index", "r.y_start", "r.y_end")


def a7_crop_and_slices(spark, sf):
    height = (c("c_custkey") % 900 + 60).cast("int")
    pages = derive.table(spark, sf, "customer").select("c_custkey", height.alias("height"))
    rows = pages.select("c_custkey", "height", F.explode(geo.uniform_slices(c("height"), 15)).alias("r"))
    crop = geo.crop_span(c("r.y_start"), c("r.y_end"), c("height"))
    return rows.select("c_custkey", "r.row_index", "r.y_start", "r.y_end", crop["y_start"].alias("crop_start"),
                       crop["y_end"].alias("crop_end"))


_FORM_WORDS = "|".join(tx.FORM_WORDS)
_ROW_WORDS = "|".join(tx.ROW_FORM_WORDS)
_PARTICLES = ", ".join(f"'{w}'" for w in tx.NAME_PARTICLES)
_EDGE = r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$"

QUERIES = {
    "s3_scan_lines": (s3_scan_lines, _sql("SELECT doc_id, line_no, line FROM lines", LINES_SQL)),
    "t1_digits_only": (_on_text(lambda t: {"digits": tx.digits_only(t)}), _sql("""
SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents""")),
    "t2_digit_runs": (_on_text(lambda t: {"ids": F.array_join(tx.digit_runs(t), ","),
                                          "n_runs": F.size(tx.all_digit_runs(t))}), _sql("""
SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]{7,10}'), ',') AS ids,
       len(regexp_extract_all(text, '[0-9]+')) AS n_runs FROM documents""")),
    "t3_clean_general": (_on_text(lambda t: {"cleaned": tx.clean_general(t)}), _sql(r"""
SELECT doc_id, regexp_replace(text, '[ .,_/\\-]', '', 'g') AS cleaned FROM documents""")),
    "t4_normalize_whitespace": (_on_text(lambda t: {"cleaned": tx.normalize_whitespace(t)}), _sql("""
SELECT doc_id, trim(regexp_replace(text, '@B', ' ', 'g'), ' ') AS cleaned FROM documents""")),
    "t5_fix_confusable_letters": (t5_fix_confusable_letters, _sql("""
SELECT conv_id, turn, regexp_replace(translate(text, 'lI|OoSsBZzG', '11100558226'), '[^0-9]', '', 'g') AS digits
FROM conversations""")),
    "t6_looks_like_name": (_on_lines(lambda t: {"is_name": tx.looks_like_name(t)}), _sql(f"""
SELECT doc_id, line_no,
       length(line) >= 2 AND NOT regexp_matches(lower(line), '{_FORM_WORDS}')
       AND length(regexp_replace(line, '[^\\p{{L}}\\s]', '', 'g')) / length(line) >= 0.7e0
       AND NOT regexp_matches(replace(line, ' ', ''), '^[0-9]+$') AS is_name
FROM lines""", LINES_SQL)),
    "t7_is_valid_name": (_on_lines(lambda t: {"valid": tx.is_valid_name(t)}), _sql("""
SELECT doc_id, line_no, length(t) >= 4 AND (len(w) >= 2 OR (len(w) = 1 AND length(w[1]) >= 4)) AS valid
FROM (SELECT *, list_filter(regexp_split_to_array(t, '@B'), lambda x: length(x) >= 2) AS w
      FROM (SELECT *, regexp_replace(trim(line, ' '), '\\.+$', '') AS t FROM lines))""", LINES_SQL)),
    "t8_format_name": (_on_lines(lambda t: {"name": tx.format_name(t)}), _sql(f"""
SELECT doc_id, line_no, array_to_string(list_filter(list_transform(w, lambda x, i:
         CASE WHEN i > 1 AND lower(x) IN ({_PARTICLES}) THEN lower(x)
              ELSE replace(upper(substr(x, 1, 1)), 'ẞ', 'Ss') || lower(substr(x, 2)) END), lambda x: x <> ''), ' ') AS name
FROM (SELECT *, list_transform(list_filter(regexp_split_to_array(t, '@B'), lambda x: length(x) >= 2),
                               lambda x: regexp_replace(x, '{_EDGE}', '', 'g')) AS w
      FROM (SELECT *, regexp_replace(trim(line, ' '), '\\.+$', '') AS t FROM lines))""", LINES_SQL)),
    "t9_format_name_rowwise": (_on_lines(lambda t: {"name": tx.format_name_rowwise(t)}), _sql(f"""
SELECT doc_id, line_no, array_to_string(list_transform(w, lambda x, i:
         CASE WHEN i > 1 AND lower(x) IN ({_PARTICLES}) THEN lower(x)
              ELSE replace(upper(substr(x, 1, 1)), 'ẞ', 'Ss') || lower(substr(x, 2)) END), ' ') AS name
FROM (SELECT *, list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(line, '@B', ' ', 'g'), ' '),
                '{_EDGE}', '', 'g'), '@B'), lambda x: x <> '') AS w FROM lines)""", LINES_SQL)),
    "t10_clean_printed_name": (_on_text(lambda t: {"name": tx.clean_printed_name(t)}), _sql("""
SELECT doc_id, trim(regexp_replace(upper(regexp_replace(translate(text, chr(10) || chr(13), '  '),
         '[^A-ZÁÉÍÓÚÑa-záéíóúñ\\s]', '', 'g')), '@B', ' ', 'g'), ' ') AS name FROM documents""")),
    "t11_sequence_ratio": (t11_sequence_ratio, None),
    "t12_edit_similarity": (t12_edit_similarity, with_readings("""
SELECT form_id, pos, round(1 - levenshtein(a_id, b_id) / greatest(length(a_id), length(b_id)), 6) AS similarity
FROM pairs""", PAIRS_SQL)),
    "t13_strip_accents": (_on_text(lambda t: {"plain": tx.strip_accents(t)}), _sql(f"""
SELECT doc_id, translate(text, '{tx.ACCENTED}', '{tx.PLAIN}') AS plain FROM documents""")),
    "t14_full_name": (t14_full_name, _sql("""
SELECT c_custkey, concat_ws(' ', nullif(c_name, ''),
         CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END,
         CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_nationkey AS VARCHAR) END) AS full_name
FROM customer""")),
    "n1_normalize_confidence": (n1_normalize_confidence, _sql("""
SELECT l_orderkey, l_linenumber,
       CASE WHEN q > 1 THEN CASE WHEN q / 100 <= 1 THEN round(q / 100, 6) END ELSE q END AS from_percent,
       l_discount AS from_fraction,
       CASE WHEN l_discount - 0.05e0 >= 0 THEN l_discount - 0.05e0 END AS shifted
FROM (SELECT *, l_quantity * 3 AS q FROM lineitem)""")),
    "n2_confidence_level": (n2_confidence_level, _sql("""
SELECT l_orderkey, l_linenumber,
       CASE WHEN q >= 0.95e0 THEN 'VERY_HIGH' WHEN q >= 0.85e0 THEN 'HIGH' WHEN q >= 0.7e0 THEN 'MEDIUM'
            WHEN q >= 0.5e0 THEN 'LOW' ELSE 'VERY_LOW' END AS level,
       q >= 0.85e0 AS high, q >= 0.5e0 AS acceptable, q < 0.3e0 AS low, q >= 0.8e0 AS meets
FROM (SELECT *, l_quantity / 50 AS q FROM lineitem)""")),
    "n3_format_confidence": (n3_format_confidence, _sql("""
SELECT form_id, pos, printf('%.0f%%', CAST(seed % 101 AS DOUBLE) / 100 * 100) AS whole,
       printf('%.0f%%', CAST(seed % 201 AS DOUBLE) / 200 * 100) AS halves,
       printf('%.1f%%', CAST(seed % 1001 AS DOUBLE) / 1000 * 100) AS tenths
FROM written""", WRITTEN_SQL)),
    "n4_format_id": (n4_format_id, _sql("""
SELECT form_id, pos, replace(format('{:,}', CAST(true_id AS BIGINT)), ',', '.') AS dotted,
       replace(format('{:,}', CAST(true_id AS BIGINT)), ',', ' ') AS spaced
FROM written""", WRITTEN_SQL)),
    "n5_is_valid_id": (n5_is_valid_id, _sql("""
SELECT form_id, pos, regexp_full_match(raw, '[0-9]{3,11}') AS valid, regexp_full_match(raw, '[0-9]{6,11}') AS strict,
       CASE WHEN regexp_full_match(t, '[0-9]{3,11}') THEN t END AS created,
       CASE WHEN regexp_full_match(t, '[1-9][0-9]{2,10}') THEN t END AS created_no_zero,
       regexp_full_match(raw, '[1-9][0-9]{5,9}') AS colombian,
       CASE WHEN length(d) BETWEEN 3 AND 11 THEN d END AS from_raw
FROM (SELECT *, trim(raw, ' ') AS t, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM cand)""", CANDIDATES_SQL)),
    "n6_distance": (n6_distance, _sql("""
SELECT form_id, pos, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 6) AS distance,
       abs(x - px) + abs(y - py) AS manhattan FROM rect""", RECT_SQL)),
    "n7_bounds_and_translate": (n7_bounds_and_translate, _sql("""
SELECT form_id, pos, x >= 100 AND x < 500 AND y >= 100 AND y < 400 AS inside,
       CASE WHEN x >= 300 AND y >= 200 THEN x - 300 END AS moved_x,
       CASE WHEN x >= 300 AND y >= 200 THEN y - 200 END AS moved_y FROM rect""", RECT_SQL)),
    "n8_rectangle_parts": (n8_rectangle_parts, _sql("""
SELECT form_id, pos, x + w AS right_x, y + h AS bottom_y, x + w // 2 AS center_x, y + h // 2 AS center_y,
       w * h AS area, px >= x AND px < x + w AND py >= y AND py < y + h AS contains_point FROM rect""", RECT_SQL)),
    "n9_rectangle_overlaps": (n9_rectangle_overlaps, _sql("""
SELECT form_id, pos, x < px + h AND px < x + w AND y < py + w AND py < y + h AS overlap FROM rect""", RECT_SQL)),
    "n22_image_size": (n22_image_size, _sql("""
SELECT form_id, pos, reason = '' AS valid, reason,
       CASE WHEN iw <= 4000 AND ih <= 4000 THEN iw ELSE CAST(trunc(iw * ratio) AS INTEGER) END AS fit_w,
       CASE WHEN iw <= 4000 AND ih <= 4000 THEN ih ELSE CAST(trunc(ih * ratio) AS INTEGER) END AS fit_h
FROM (SELECT *, least(coalesce(4000e0 / nullif(iw, 0), 1e9), coalesce(4000e0 / nullif(ih, 0), 1e9)) AS ratio,
             CASE WHEN iw < 100 OR ih < 100 THEN printf('too small: %dx%d (min 100x100)', iw, ih)
                  WHEN iw > 10000 OR ih > 10000 THEN printf('too large: %dx%d (max 10000x10000)', iw, ih)
                  ELSE '' END AS reason
      FROM (SELECT form_id, pos, x * 13 AS iw, y * 17 AS ih FROM rect))""", RECT_SQL)),
    "f1_specifications": (f1_specifications, _sql("""
SELECT form_id, pos, regexp_full_match(raw, '[0-9]+') AS only_digits, length(raw) BETWEEN 3 AND 11 AS length_ok,
       length(raw) BETWEEN 6 AND 10 AS length_6_10, conf * 100 >= 50e0 AS confident,
       raw NOT LIKE '0%' AS no_leading_zero FROM cand""", CANDIDATES_SQL)),
    "f2_combinators": (f2_combinators, _sql("""
SELECT form_id, pos, raw FROM cand
WHERE (regexp_full_match(raw, '[0-9]+') AND conf * 100 >= 80e0) OR raw LIKE '0%'""", CANDIDATES_SQL)),
    "f3_presets": (f3_presets, _sql("""
SELECT form_id, pos, ok AND conf * 100 >= 50e0 AS processing,
       ok AND conf * 100 >= 50e0 AND raw NOT LIKE '0%' AS colombian, ok AND conf * 100 >= 85e0 AS high,
       regexp_full_match(raw, '[1-9][0-9]{5,9}') AND conf * 100 >= 70e0 AS composite
FROM (SELECT *, regexp_full_match(raw, '[0-9]{3,11}') AS ok FROM cand)""", CANDIDATES_SQL)),
    "f4_record_is_valid": (f4_record_is_valid, _sql("""
SELECT form_id, pos, raw FROM cand WHERE regexp_full_match(raw, '[0-9]{3,11}') AND conf >= 0.5e0""", CANDIDATES_SQL)),
    "f5_validation_tier": (f5_validation_tier, _sql("""
SELECT CASE WHEN NOT regexp_full_match(raw, '[0-9]+') THEN 'NONE'
            WHEN NOT length(raw) BETWEEN 6 AND 15 THEN 'BASIC'
            WHEN conf * 100 >= 85e0 THEN 'STRICT' ELSE 'MEDIUM' END AS tier,
       count(*) AS n, round(avg(conf), 6) AS mean_conf
FROM cand GROUP BY 1""", CANDIDATES_SQL)),
    "a1_row_band": (a1_row_band, _sql("""
SELECT form_id, pos, greatest(0, least(14, CAST(trunc((py - 20e0) / ((y + 200e0) / 15)) AS INTEGER))) AS row_index
FROM rect""", RECT_SQL)),
    "a2_fixed_rows": (a2_fixed_rows, _sql("""
SELECT c_custkey, row_index, y_start, y_end
FROM (SELECT c_custkey, t.i AS row_index, CAST(trunc(15 + t.i * step) AS INTEGER) AS y_start,
             CAST(trunc(15 + (t.i + 1) * step) AS INTEGER) AS y_end
      FROM (SELECT c_custkey, (c_custkey * 7 % 900 + 100 - 15) / 15 AS step FROM customer), range(15) t(i))
WHERE y_end - y_start >= 25""")),
    "a7_crop_and_slices": (a7_crop_and_slices, _sql("""
SELECT c_custkey, row_index, y_start, y_end, greatest(0, y_start - 10) AS crop_start,
       least(height, y_end + 10) AS crop_end
FROM (SELECT c_custkey, height, t.i AS row_index, t.i * (height // 15) AS y_start,
             least((t.i + 1) * (height // 15), height) AS y_end
      FROM (SELECT c_custkey, c_custkey % 900 + 60 AS height FROM customer), range(15) t(i))
WHERE y_end - y_start > 5""")),
}
