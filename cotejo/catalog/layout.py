"""Queries of response scans and layout (inventory S1, S2, S4-S6, A3-A6, G5-G7, G12, F7, J2, J5-J9, V8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cotejo.functions import text as tx
from cotejo.operators import layout as lay, matching
from cotejo.plans import derive
from cotejo.plans.derive import A_SQL, with_words
from cotejo.plans.form_pairs import form_pairs, vote_pairs
from cotejo.plans.staging import staged
from cotejo.sources import responses as src

c = F.col

# Row height and raised rows for the clustering queries: raised rows touch the row above.
TALL = {"step": 90, "shift": 40}


def s1_scan_symbols(spark, sf):
    return src.scan_symbols(derive.responses_a(spark, sf))


def s2_scan_words(spark, sf):
    return src.scan_words(derive.responses_b(spark, sf))


def s4_word_boxes_a(spark, sf):
    return src.word_boxes_a(derive.responses_a(spark, sf))


def s4_word_boxes_b(spark, sf):
    return src.word_boxes_b(derive.responses_b(spark, sf))


def s5_block_boxes_a(spark, sf):
    return src.block_boxes_a(derive.responses_a(spark, sf)).withColumn("confidence", F.round("confidence", 6))


def s5_line_boxes_b(spark, sf):
    return src.line_boxes_b(derive.responses_b(spark, sf))


def s6_digit_symbols(spark, sf):
    r = derive.responses_a(spark, sf)
    digits = src.digit_symbols(src.symbols_of(c("pages")))
    return r.select("form_id", F.size(digits).alias("n"), F.array_join(F.transform(digits, lambda s: s["text"]), "").alias("digits"))


def s6_numeric_words(spark, sf):
    r = derive.responses_b(spark, sf)
    words = src.numeric_words(src.words_of(c("blocks")))
    return r.select("form_id", F.array_join(F.transform(words, lambda w: w["text"]), "|").alias("words"))


def a4_split_id_boxes(spark, sf):
    boxes = lay.split_id_boxes(derive.page_words(spark, sf))
    return boxes.select("form_id", "box_id", "part", "text", F.round("y", 6).alias("y"), F.round("h", 6).alias("h"))


def a5_cluster_words(spark, sf):
    words = staged(derive.page_words(spark, sf, **TALL), "words").filter(tx.looks_like_name(c("text")))
    return lay.cluster_words(words).select("form_id", "box_id", "cluster")


def g5_merge_names(spark, sf):
    names = lay.name_boxes(staged(derive.page_words(spark, sf, **TALL), "words"))
    return names.withColumn("confidence", F.round("confidence", 6))


def _id_lines(spark, sf):
    rows = staged(derive.word_rows(spark, sf), "word-rows")
    words = derive.row_words(rows)
    return lay.locate_id_lines(derive.page_lines(rows), words), words


def j8_locate_id_lines(spark, sf):
    return _id_lines(spark, sf)[0]


def j7_same_row_names(spark, sf):
    rows = lay.same_row_names(*_id_lines(spark, sf))
    return rows.withColumn("name_conf", F.round("name_conf", 6))


def _row_blocks(spark, sf, provider="a"):
    words = derive.page_words(spark, sf)
    if provider == "b":
        words = words.filter(c("seed") % 37 != 0).withColumn(
            "text", F.when((c("k") == 2) & (c("seed") % 5 == 0), F.left("text", F.lit(9))).otherwise(c("text")))
    faint = F.when(c("seed") % 29 == 0, 0.2).otherwise(c("confidence"))
    words = words.withColumns({"confidence": faint, "page_width": F.lit(1000)})
    return lay.assign_rows(words.drop("pos", "k"), F.lit(540.0))


def _rounded(rows):
    return rows.withColumns({"names_conf": F.round("names_conf", 6), "id_conf": F.round("id_conf", 6)})


def g6_assemble_rows_a(spark, sf):
    return _rounded(lay.assemble_rows_a(_row_blocks(spark, sf)))


def g6_assemble_rows_b(spark, sf):
    return _rounded(lay.assemble_rows_b(_row_blocks(spark, sf, "b")))


def g7_paragraph_columns(spark, sf):
    paragraphs = src.paragraph_boxes_a(derive.responses_a(spark, sf)).withColumn("page_width", F.lit(1000))
    rows = lay.assemble_rows_a(lay.assign_rows(paragraphs, F.lit(540.0)))
    return rows.select("form_id", "row_index", "names", "id_number", F.round("names_conf", 6).alias("names_conf"),
                       F.round("id_conf", 6).alias("id_conf"))


def j2_row_consensus(spark, sf):
    from cotejo.operators.reconcile import row_consensus

    a, b = lay.assemble_rows_a(_row_blocks(spark, sf)), lay.assemble_rows_b(_row_blocks(spark, sf, "b"))
    return row_consensus(a, b).select("form_id", "row_index", "provider", "names", "id_number", "is_empty")


def a3_densify_rows(spark, sf):
    rows = lay.assemble_rows_a(_row_blocks(spark, sf)).select("form_id", "row_index", "names", "id_number", "is_empty")
    forms = derive.table(spark, sf, "orders").select(c("o_orderkey").alias("form_id"))
    return lay.densify_rows(rows, forms)


def g12_form_summary(spark, sf):
    return lay.form_summary(a3_densify_rows(spark, sf))


def f7_empty_rows(spark, sf):
    li = derive.table(spark, sf, "lineitem")
    names = F.when(c("l_linenumber") % 3 == 0, "").otherwise(F.left("l_returnflag", (c("l_linenumber") % 2 + 1).cast("int")))
    number = F.when(c("l_partkey") % 4 == 0, "").otherwise(c("l_partkey").cast("string"))
    empty = lay.is_empty_row(names, number, c("l_discount") * 8, c("l_tax") * 8)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", empty.alias("is_empty"))


def a6_first_row_texts(spark, sf):
    words = derive.page_words(spark, sf)
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("box_id", "text"))), lambda b: b["text"])
    rows = words.groupBy("form_id", "pos").agg(blocks.alias("blocks"))
    return lay.first_row_texts(rows).select("form_id", "pos", "name", "id_number")


def _targets(spark, sf):
    """Identifiers to look up; every seventh differs from what the recogniser saw, every form % 13 has no response."""
    t = c("true_id")
    target = F.when(c("seed") % 7 == 0, F.concat(F.substr(t, F.lit(2)), F.left(t, F.lit(1)))).otherwise(t)
    return derive.written_rows(spark, sf).select("form_id", "pos", target.alias("id_number"))


def _digit_conf_text(mapped):
    return mapped.select(
        "form_id", "pos", "found",
        F.array_join(F.transform("digit_conf", lambda v: F.format_string("%.10f", F.round(v, 10))), " ").alias("confs"),
    )


def j9_digit_confidences_symbols(spark, sf):
    streams = derive.responses_a(spark, sf).filter(c("form_id") % 13 != 0).select(
        "form_id", src.symbols_of(c("pages")).alias("symbols"))
    return _digit_conf_text(lay.map_digit_confidences(_targets(spark, sf), streams))


def j9_digit_confidences_words(spark, sf):
    streams = derive.responses_b(spark, sf).filter(c("form_id") % 13 != 0).select(
        "form_id", src.words_of(c("blocks")).alias("symbols"))
    return _digit_conf_text(lay.map_digit_confidences(_targets(spark, sf), streams))


def j6_pair_by_proximity(spark, sf):
    pairs = form_pairs(derive.page_words(spark, sf, **TALL))
    return pairs.withColumns({"name_conf": F.round("name_conf", 6), "id_conf": F.round("id_conf", 6)})


def _pair_lists(spark, sf):
    """Name-identifier pairs of both recognisers: B drops the last letter of some names."""
    a, b = [r.withColumnRenamed("p_name", "name") for r in derive.named_readings(spark, sf)]
    cut = F.when(c("seed") % 4 == 0, F.left("name", F.length("name") - 1)).otherwise(c("name"))

    def listed(df, seed):
        sure = (F.lit(60) + seed % 39) / 100.0
        return df.select("form_id", "pos", "name", "id_number", sure.alias("name_conf"), c("confidence").alias("id_conf"), "digit_conf")

    return listed(a, c("seed")), listed(b.withColumn("name", cut), c("seed") * 7)


def j5_match_pairs(spark, sf):
    a, b = _pair_lists(spark, sf)
    keep = ["form_id", "pos", "name", "id_number"]
    return matching.match_pairs(a.select(*keep), b.select(*keep)).withColumn("score", F.round("score", 6))


def v8_vote_pairs(spark, sf):
    out = vote_pairs(*_pair_lists(spark, sf))
    return out.withColumns({"id_conf": F.round("id_conf", 6), "name_conf": F.round("name_conf", 6)})


NAMES_SQL = """,
named AS (
  SELECT * FROM words WHERE length(text) >= 2
    AND NOT regexp_matches(lower(text), '""" + "|".join(tx.FORM_WORDS) + r"""')
    AND length(regexp_replace(text, '[^\p{L}\s]', '', 'g')) / length(text) >= 0.7e0
    AND NOT regexp_matches(replace(text, ' ', ''), '^[0-9]+$')),
reach AS (
  SELECT form_id, box_id, box_id AS other FROM named
  UNION
  SELECT r.form_id, r.box_id, n.box_id
  FROM reach r JOIN named m ON m.form_id = r.form_id AND m.box_id = r.other
  JOIN named n ON n.form_id = r.form_id AND abs(n.y - m.y) < 60 AND abs(n.x - m.x) < 350),
clustered AS (SELECT form_id, box_id, min(other) AS cluster FROM reach GROUP BY form_id, box_id)"""

LINES_SQL = """,
lines AS (
  SELECT form_id, pos AS line_no, string_agg(text, ' ' ORDER BY k) AS line FROM words GROUP BY form_id, pos),
id_lines AS (
  SELECT *, regexp_replace(line, '[^0-9]', '', 'g') AS id_number FROM lines),
word_digits AS (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM words),
located AS (
  SELECT l.form_id, line_no, id_number, arg_min(x, box_id) AS x, arg_min(y + h / 2, box_id) AS y
  FROM id_lines l JOIN word_digits w ON w.form_id = l.form_id AND w.digits <> '' AND contains(l.id_number, w.digits)
  WHERE length(id_number) BETWEEN 7 AND 11 GROUP BY l.form_id, line_no, id_number)"""

_PARTICLES = ", ".join(f"'{w}'" for w in tx.NAME_PARTICLES)


def _rows_sql(name: str, source: str, share: float, conf: str, repair: bool) -> str:
    digits = "translate(id_raw, 'lI|OoSsBZzG', '11100558226')" if repair else "id_raw"
    return f""",
{name} AS (
  SELECT *, (names = '' AND id_number = '') OR (names_conf < 0.3e0 AND id_conf < 0.3e0)
            OR (length(names) < 2 AND length(id_number) < 6) AS is_empty, trim(names || ' | ' || id_raw, ' ') AS raw_text
  FROM (SELECT *, regexp_replace({digits}, '[^0-9]', '', 'g') AS id_number FROM (
    SELECT form_id, row_index,
           trim(coalesce(string_agg(text, ' ' ORDER BY box_id) FILTER (WHERE x < 1000 * {share}), ''), ' ') AS names,
           trim(coalesce(string_agg(text, ' ' ORDER BY box_id) FILTER (WHERE x >= 1000 * {share}), ''), ' ') AS id_raw,
           coalesce({conf}(confidence) FILTER (WHERE x < 1000 * {share}), 0) AS names_conf,
           coalesce({conf}(confidence) FILTER (WHERE x >= 1000 * {share}), 0) AS id_conf
    FROM {source} GROUP BY form_id, row_index)))"""


_BAND = "greatest(0, least(14, CAST(trunc(y / (540e0 / 15)) AS INTEGER)))"
BLOCKS_SQL = f""",
blocks_a AS (
  SELECT form_id, box_id, text, x, CASE WHEN seed % 29 = 0 THEN 0.2e0 ELSE confidence END AS confidence,
         {_BAND} AS row_index FROM words),
blocks_b AS (
  SELECT form_id, box_id, CASE WHEN k = 2 AND seed % 5 = 0 THEN substr(text, 1, 9) ELSE text END AS text, x,
         CASE WHEN seed % 29 = 0 THEN 0.2e0 ELSE confidence END AS confidence, {_BAND} AS row_index
  FROM words WHERE seed % 37 <> 0)"""
ROWS_A = _rows_sql("rows_a", "blocks_a", 0.6, "avg", True)
ROWS_B = _rows_sql("rows_b", "blocks_b", 0.5, "max", False)
ROW_COLUMNS = ("form_id, row_index, names, id_number, round(names_conf, 6) AS names_conf, round(id_conf, 6) AS id_conf, "
               "is_empty, raw_text")

SYMBOLS_SQL = """,
symbols AS (
  SELECT form_id, seed, pos, k, t.i AS i, substr(text, t.i + 1, 1) AS text,
         CASE WHEN (seed + t.i) % 5 <> 0 THEN CAST(60 + (seed + t.i) % 40 AS DOUBLE) / 100
              WHEN seed % 17 = 0 AND k = 0 THEN 0.95e0 ELSE confidence END AS confidence
  FROM words, unnest(range(CAST(length(text) AS BIGINT))) AS t(i))"""

_JOIN_TARGETS = """,
targets AS (
  SELECT form_id, pos, CASE WHEN seed % 7 = 0 THEN substr(true_id, 2) || substr(true_id, 1, 1) ELSE true_id END
         AS id_number FROM written),
mapped AS (
  SELECT t.form_id, t.pos, t.id_number, coalesce(instr(digits, id_number), 0) AS at0, confs, mean
  FROM targets t LEFT JOIN (SELECT * FROM stream WHERE form_id % 13 <> 0) s ON s.form_id = t.form_id)"""
_MAPPED = """
SELECT form_id, pos, at0 > 0 AS found,
       array_to_string(list_transform(
         CASE WHEN at0 > 0 THEN list_slice(confs, at0, at0 + length(id_number) - 1)
              ELSE list_transform(range(length(id_number)), lambda i: coalesce(mean, 0.85e0)) END,
         lambda v: printf('%.10f', round(v, 10))), ' ') AS confs
FROM mapped"""

QUERIES = {
    "s1_scan_symbols": (s1_scan_symbols, with_words("""
SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY pos, k, i) - 1 AS ord, text, confidence
FROM symbols""", SYMBOLS_SQL)),
    "s2_scan_words": (s2_scan_words, with_words("""
SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY box_id) - 1 AS ord, text,
       CASE WHEN seed % 17 = 0 THEN 0.95e0 ELSE confidence END AS confidence
FROM words""")),
    "s4_word_boxes_a": (s4_word_boxes_a, with_words("""
SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY box_id) - 1 AS box_id, text, x, w, y, h,
       CASE WHEN seed % 17 = 0 AND k = 0 THEN 0.95e0 ELSE confidence END AS confidence
FROM words WHERE seed % 19 <> 0""")),
    "s4_word_boxes_b": (s4_word_boxes_b, with_words("""
SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY box_id) - 1 AS box_id, text, x, w, y, h,
       CASE WHEN seed % 17 = 0 THEN 0.95e0 ELSE confidence END AS confidence
FROM words WHERE seed % 19 <> 0""")),
    "s5_block_boxes_a": (s5_block_boxes_a, with_words("""
SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY pos) - 1 AS box_id,
       string_agg(text, ' ' ORDER BY k) AS text, 400e0 AS x, CAST(pos * 36 + 10 AS DOUBLE) AS y,
       round(avg(CASE WHEN seed % 17 = 0 AND k = 0 THEN 0.95e0 ELSE confidence END), 6) AS confidence
FROM words WHERE seed % 23 <> 0 GROUP BY form_id, pos, seed""")),
    "s5_line_boxes_b": (s5_line_boxes_b, with_words("""
SELECT form_id, row_number() OVER (PARTITION BY form_id ORDER BY pos, k // 2) - 1 AS box_id,
       string_agg(text, ' ' ORDER BY k) AS text,
       CASE WHEN seed % 23 = 0 THEN 0e0 WHEN k // 2 = 0 THEN 100e0 ELSE 600e0 END AS x,
       CASE WHEN seed % 23 = 0 THEN 0e0 ELSE CAST(pos * 36 AS DOUBLE) END AS y,
       CASE WHEN seed % 17 = 0 THEN 0.95e0 ELSE CAST(50 + seed % 50 AS DOUBLE) / 100 END AS confidence
FROM words GROUP BY form_id, pos, seed, k // 2""")),
    "s6_digit_symbols": (s6_digit_symbols, with_words("""
SELECT form_id, count(*) FILTER (WHERE text BETWEEN '0' AND '9') AS n,
       string_agg(text, '' ORDER BY pos, k, i) FILTER (WHERE text BETWEEN '0' AND '9') AS digits
FROM symbols GROUP BY form_id""", SYMBOLS_SQL)),
    "s6_numeric_words": (s6_numeric_words, with_words("""
SELECT form_id, string_agg(text, '|' ORDER BY box_id) AS words FROM words
WHERE regexp_matches(text, '[0-9]') GROUP BY form_id""")),
    "a4_split_id_boxes": (a4_split_id_boxes, with_words("""
SELECT form_id, box_id, 0 AS part, true_id AS text, round(y, 6) AS y, round(h / 2, 6) AS h
FROM words JOIN written USING (form_id, pos) WHERE k = 2 AND text LIKE '% 7654321'
UNION ALL
SELECT form_id, box_id, 1, '7654321', round(y + h * ((length(true_id) + 1) / length(text)), 6), round(h / 2, 6)
FROM words JOIN written USING (form_id, pos) WHERE k = 2 AND text LIKE '% 7654321'
UNION ALL
SELECT form_id, box_id, 0, replace(text, '.', ''), round(y, 6), round(h, 6) FROM words
WHERE k = 2 AND text NOT LIKE '% %'""")),
    "a5_cluster_words": (a5_cluster_words, with_words("SELECT form_id, box_id, cluster FROM clustered", NAMES_SQL,
                                                      recursive=True, **TALL)),
    "g5_merge_names": (g5_merge_names, with_words(f"""
SELECT form_id, cluster, array_to_string(list_transform(list_filter(string_split(text, ' '), lambda z: length(z) >= 2),
         lambda z, i: CASE WHEN i > 1 AND lower(z) IN ({_PARTICLES}) THEN lower(z)
                           ELSE upper(z[1]) || lower(substr(z, 2)) END), ' ') AS text,
       x, y, w, h, confidence
FROM (SELECT form_id, cluster, string_agg(text, ' ' ORDER BY x, box_id) AS text, min(x) AS x, min(y) AS y,
             max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, round(avg(confidence), 6) AS confidence
      FROM named JOIN clustered USING (form_id, box_id) GROUP BY form_id, cluster)
WHERE length(text) >= 4""", NAMES_SQL, recursive=True, **TALL)),
    "j8_locate_id_lines": (j8_locate_id_lines, with_words(
        "SELECT form_id, line_no, id_number, x, y FROM located", LINES_SQL)),
    "j7_same_row_names": (j7_same_row_names, with_words(f"""
SELECT form_id, line_no, id_number, array_to_string(list_transform(string_split(text, ' '),
         lambda z, i: CASE WHEN i > 1 AND lower(z) IN ({_PARTICLES}) THEN lower(z)
                           ELSE upper(z[1]) || lower(substr(z, 2)) END), ' ') AS name, name_conf
FROM (SELECT l.form_id, line_no, id_number, string_agg(text, ' ' ORDER BY w.x, box_id) AS text,
             round(avg(confidence), 6) AS name_conf
      FROM located l JOIN words w ON w.form_id = l.form_id AND w.y + w.h / 2 >= l.y - 25 AND w.y + w.h / 2 <= l.y + 25
           AND w.x < l.x - 50 AND length(text) >= 2
           AND NOT regexp_matches(lower(text), '{"|".join(tx.ROW_FORM_WORDS)}')
           AND length(regexp_replace(text, '[^\\p{{L}}\\s]', '', 'g')) / length(text) >= 0.7e0
      GROUP BY l.form_id, line_no, id_number)
WHERE length(text) >= 4""", LINES_SQL)),
    "g6_assemble_rows_a": (g6_assemble_rows_a, with_words(f"SELECT {ROW_COLUMNS} FROM rows_a", BLOCKS_SQL + ROWS_A)),
    "g6_assemble_rows_b": (g6_assemble_rows_b, with_words(f"SELECT {ROW_COLUMNS} FROM rows_b", BLOCKS_SQL + ROWS_B)),
    "g7_paragraph_columns": (g7_paragraph_columns, with_words("""
SELECT form_id, row_index, names, id_number, round(names_conf, 6) AS names_conf, round(id_conf, 6) AS id_conf
FROM paragraph_rows""", f""",
paragraphs AS (
  SELECT form_id, box_id, text, x + w / 2 AS x,
         CASE WHEN seed % 17 = 0 AND k = 0 THEN 0.95e0 ELSE confidence END AS confidence,
         greatest(0, least(14, CAST(trunc((y + h / 2) / (540e0 / 15)) AS INTEGER))) AS row_index
  FROM words)""" + _rows_sql("paragraph_rows", "paragraphs", 0.6, "avg", True))),
    "j2_row_consensus": (j2_row_consensus, with_words("""
SELECT form_id, row_index, provider, CASE provider WHEN 'a' THEN a_names ELSE b_names END AS names,
       CASE provider WHEN 'a' THEN a_id ELSE b_id END AS id_number,
       CASE provider WHEN 'a' THEN a_empty ELSE b_empty END AS is_empty
FROM (SELECT coalesce(a.form_id, b.form_id) AS form_id, coalesce(a.row_index, b.row_index) AS row_index,
             a.names AS a_names, b.names AS b_names, a.id_number AS a_id, b.id_number AS b_id,
             a.is_empty AS a_empty, b.is_empty AS b_empty,
             CASE WHEN b.form_id IS NULL THEN 'a' WHEN a.form_id IS NULL THEN 'b'
                  WHEN a.is_empty AND b.is_empty THEN 'a' WHEN a.is_empty THEN 'b' WHEN b.is_empty THEN 'a'
                  WHEN a.id_number = b.id_number OR a.id_conf >= b.id_conf THEN 'a' ELSE 'b' END AS provider
      FROM rows_a a FULL JOIN rows_b b ON a.form_id = b.form_id AND a.row_index = b.row_index)""",
        BLOCKS_SQL + ROWS_A + ROWS_B)),
    "a3_densify_rows": (a3_densify_rows, with_words("""
SELECT o_orderkey AS form_id, t.i AS row_index, coalesce(names, '') AS names, coalesce(id_number, '') AS id_number,
       coalesce(is_empty, true) AS is_empty
FROM orders CROSS JOIN range(15) t(i) LEFT JOIN rows_a r ON r.form_id = o_orderkey AND r.row_index = t.i""",
        BLOCKS_SQL + ROWS_A)),
    "g12_form_summary": (g12_form_summary, with_words("""
SELECT o_orderkey AS form_id, 15 AS n_rows, count(*) FILTER (WHERE is_empty = false) AS with_data,
       15 - count(*) FILTER (WHERE is_empty = false) AS "empty"
FROM orders LEFT JOIN rows_a r ON r.form_id = o_orderkey GROUP BY o_orderkey""", BLOCKS_SQL + ROWS_A)),
    "f7_empty_rows": (f7_empty_rows, """
SELECT l_orderkey, l_linenumber, l_partkey,
       (names = '' AND number = '') OR (l_discount * 8 < 0.3e0 AND l_tax * 8 < 0.3e0)
       OR (length(names) < 2 AND length(number) < 6) AS is_empty
FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS names,
             CASE WHEN l_partkey % 4 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS number FROM lineitem)"""),
    "a6_first_row_texts": (a6_first_row_texts, with_words("""
SELECT form_id, pos, upper(name1[1]) || lower(substr(name1, 2)) || ' ' || upper(name2[1]) || lower(substr(name2, 2))
       AS name, true_id AS id_number FROM words0""")),
    "j9_digit_confidences_symbols": (j9_digit_confidences_symbols, with_words(_MAPPED, SYMBOLS_SQL + """,
stream AS (
  SELECT form_id, string_agg(text, '' ORDER BY pos, k, i) AS digits, list(confidence ORDER BY pos, k, i) AS confs,
         avg(confidence) AS mean
  FROM symbols WHERE text BETWEEN '0' AND '9' GROUP BY form_id)""" + _JOIN_TARGETS)),
    "j9_digit_confidences_words": (j9_digit_confidences_words, with_words(_MAPPED, """,
numeric AS (
  SELECT form_id, box_id, regexp_replace(text, '[^0-9]', '', 'g') AS d,
         CASE WHEN seed % 17 = 0 THEN 0.95e0 ELSE confidence END AS confidence FROM words WHERE k = 2),
stream AS (
  SELECT form_id, string_agg(d, '' ORDER BY box_id) AS digits,
         flatten(list(list_transform(range(length(d)), lambda i: confidence) ORDER BY box_id)) AS confs,
         avg(confidence) AS mean
  FROM numeric GROUP BY form_id)""" + _JOIN_TARGETS)),
    "j5_match_pairs": (j5_match_pairs, None),
    "j6_pair_by_proximity": (j6_pair_by_proximity, None),
    "v8_vote_pairs": (v8_vote_pairs, None),
}
