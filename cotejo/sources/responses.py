"""Scans over recogniser responses.

A response is one row per form: recogniser A nests pages > blocks > paragraphs > words > symbols, recogniser B nests
blocks > lines > words. The schemas are explicit, so reading JSON needs no inference pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cotejo.functions.text import BLANKS

DEFAULT_CONFIDENCE = 0.95

_VERTICES = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
RESPONSE_A = (
    "form_id BIGINT, full_text STRING, pages ARRAY<STRUCT<blocks: ARRAY<STRUCT<vertices: " + _VERTICES
    + ", paragraphs: ARRAY<STRUCT<vertices: " + _VERTICES
    + ", words: ARRAY<STRUCT<confidence: DOUBLE, vertices: " + _VERTICES
    + ", symbols: ARRAY<STRUCT<text: STRING, confidence: DOUBLE>>>>>>>>>>"
)
RESPONSE_B = (
    "form_id BIGINT, blocks ARRAY<STRUCT<lines: ARRAY<STRUCT<text: STRING, confidence: DOUBLE, "
    "polygon: ARRAY<DOUBLE>, words: ARRAY<STRUCT<text: STRING, confidence: DOUBLE, polygon: ARRAY<DOUBLE>>>>>>>"
)


def read_responses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _flat(nested: Column, *levels: str) -> Column:
    """Descend through arrays of structs, keeping reading order."""
    def field(level: str):
        return lambda s: F.coalesce(s[level], F.array())

    out = nested
    for level in levels:
        out = F.flatten(F.transform(out, field(level)))
    return out


def _missing_as_default(conf: Column) -> Column:
    return F.coalesce(conf, F.lit(DEFAULT_CONFIDENCE))


def symbols_of(pages: Column) -> Column:
    """Array of ``struct<text, confidence>`` in reading order; symbol, then word, then default confidence."""
    words = _flat(pages, "blocks", "paragraphs", "words")
    return F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.coalesce(w["symbols"], F.array()),
                lambda s: F.struct(
                    s["text"].alias("text"), F.coalesce(s["confidence"], _missing_as_default(w["confidence"])).alias("confidence")
                ),
            ),
        )
    )


def words_of(blocks: Column) -> Column:
    """Array of ``struct<text, confidence>`` for recogniser B."""
    return F.transform(
        _flat(blocks, "lines", "words"),
        lambda w: F.struct(w["text"].alias("text"), _missing_as_default(w["confidence"]).alias("confidence")),
    )


def scan_symbols(responses: DataFrame) -> DataFrame:
    return responses.select("form_id", F.posexplode(symbols_of(F.col("pages"))).alias("ord", "s")).select(
        "form_id", "ord", F.col("s.text").alias("text"), F.col("s.confidence").alias("confidence")
    )


def scan_words(responses: DataFrame) -> DataFrame:
    return responses.select("form_id", F.posexplode(words_of(F.col("blocks"))).alias("ord", "w")).select(
        "form_id", "ord", F.col("w.text").alias("text"), F.col("w.confidence").alias("confidence")
    )


def scan_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Non-blank lines of a text column with their line number."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.filter(F.regexp_replace("line", BLANKS, "") != "")


def digit_symbols(symbols: Column) -> Column:
    return F.filter(symbols, lambda s: s["text"].rlike("^[0-9]+$"))


def numeric_words(words: Column) -> Column:
    return F.filter(words, lambda w: w["text"].rlike("[0-9]"))


def _span(values: Column, name: str, size: str) -> list[Column]:
    low, high = F.array_min(values), F.array_max(values)
    return [low.alias(name), (high - low).alias(size)]


def _box(text: Column, xs: Column, ys: Column, confidence: Column) -> Column:
    return F.struct(F.trim(text).alias("text"), *_span(xs, "x", "w"), *_span(ys, "y", "h"), confidence.alias("confidence"))


def word_boxes_a(responses: DataFrame) -> DataFrame:
    """One box per word of recogniser A; words with fewer than four vertices or blank text are dropped."""
    words = F.filter(
        _flat(F.col("pages"), "blocks", "paragraphs", "words"),
        lambda w: F.coalesce(F.size(w["vertices"]) >= 4, F.lit(False)),
    )
    boxes = F.transform(
        words,
        lambda w: _box(
            F.array_join(F.transform(w["symbols"], lambda s: s["text"]), ""),
            F.transform(w["vertices"], lambda v: v["x"]), F.transform(w["vertices"], lambda v: v["y"]),
            _missing_as_default(w["confidence"]),
        ),
    )
    return _explode_boxes(responses, boxes)


def word_boxes_b(responses: DataFrame) -> DataFrame:
    """One box per word of recogniser B from its interleaved x/y polygon; fewer than eight coordinates are dropped."""
    words = F.filter(
        _flat(F.col("blocks"), "lines", "words"), lambda w: F.coalesce(F.size(w["polygon"]) >= 8, F.lit(False))
    )
    boxes = F.transform(
        words,
        lambda w: _box(
            w["text"], F.filter(w["polygon"], lambda _, i: i % 2 == 0), F.filter(w["polygon"], lambda _, i: i % 2 == 1),
            _missing_as_default(w["confidence"]),
        ),
    )
    return _explode_boxes(responses, boxes)


def _explode_boxes(responses: DataFrame, boxes: Column) -> DataFrame:
    kept = F.filter(boxes, lambda b: b["text"] != "")
    return responses.select("form_id", F.posexplode(kept).alias("box_id", "b")).select("form_id", "box_id", "b.*")


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def block_boxes_a(responses: DataFrame) -> DataFrame:
    """One box per block: centroid of its vertices, words joined by a blank, mean word confidence."""

    def block_box(b: Column) -> Column:
        words = _flat(b["paragraphs"], "words")
        text = F.array_join(
            F.transform(words, lambda w: F.array_join(F.transform(w["symbols"], lambda s: s["text"]), "")), " "
        )
        return F.struct(
            F.trim(text).alias("text"), _mean(F.transform(b["vertices"], lambda v: v["x"])).alias("x"),
            _mean(F.transform(b["vertices"], lambda v: v["y"])).alias("y"),
            _mean(F.transform(words, lambda w: _missing_as_default(w["confidence"]))).alias("confidence"),
        )

    placed = F.filter(_flat(F.col("pages"), "blocks"), lambda b: F.coalesce(F.size(b["vertices"]) > 0, F.lit(False)))
    return _explode_boxes(responses, F.transform(placed, block_box))


def paragraph_boxes_a(responses: DataFrame) -> DataFrame:
    """As :func:`block_boxes_a`, one level down."""

    def box(q: Column) -> Column:
        text = F.array_join(
            F.transform(q["words"], lambda w: F.array_join(F.transform(w["symbols"], lambda s: s["text"]), "")), " "
        )
        return F.struct(
            F.trim(text).alias("text"), _mean(F.transform(q["vertices"], lambda v: v["x"])).alias("x"),
            _mean(F.transform(q["vertices"], lambda v: v["y"])).alias("y"),
            _mean(F.transform(q["words"], lambda w: _missing_as_default(w["confidence"]))).alias("confidence"),
        )

    placed = F.filter(
        _flat(F.col("pages"), "blocks", "paragraphs"), lambda q: F.coalesce(F.size(q["vertices"]) > 0, F.lit(False))
    )
    return responses.select("form_id", F.posexplode(F.transform(placed, box)).alias("box_id", "b")).select(
        "form_id", "box_id", "b.*"
    )


def line_boxes_b(responses: DataFrame) -> DataFrame:
    """One box per line of recogniser B at its first polygon point (0, 0 without a polygon)."""

    def coordinate(line: Column, i: int) -> Column:
        return F.coalesce(F.try_element_at(line["polygon"], F.lit(i)), F.lit(0.0))

    boxes = F.transform(
        _flat(F.col("blocks"), "lines"),
        lambda n: F.struct(
            n["text"].alias("text"), coordinate(n, 1).alias("x"), coordinate(n, 2).alias("y"),
            _missing_as_default(n["confidence"]).alias("confidence"),
        ),
    )
    return responses.select("form_id", F.posexplode(boxes).alias("box_id", "b")).select("form_id", "box_id", "b.*")
