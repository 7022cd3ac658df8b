"""Geometry joins: boxes to rows, words to names, names to identifiers.

A form is one page, but nothing here relies on it being short: joins carry a position band, a grid cell or the digits
themselves as equi-keys next to the form, and aggregates combine before they shuffle."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cotejo.functions import geometry as geo, groups, text as tx
from cotejo.operators.graph import components
from cotejo.params import LayoutParams
from cotejo.plans.staging import staged

DEFAULT = LayoutParams()


# --- identifiers in boxes -------------------------------------------------------------------------------------------
def split_id_boxes(boxes: DataFrame) -> DataFrame:
    """One box per 7-10-digit run of a text, placed down the box in proportion to where the run starts; without a run,
    the whole box when all its digits together number 7-10. Adds ``part``, the run's number within its box."""
    text, total = F.col("text"), F.length("text")
    runs = tx.digit_runs(text)
    found = F.aggregate(
        runs,
        F.struct(F.lit(1).alias("cursor"), F.array().cast("array<struct<text:string,start:int>>").alias("out")),
        lambda acc, run: _append_run(acc, run, text),
    )["out"]
    digits = tx.digits_only(text)
    whole = F.when(F.length(digits).between(7, 10), F.array(F.struct(digits.alias("text"), F.lit(0).alias("start"))))
    pieces = F.when(F.size(runs) > 0, found).otherwise(whole)
    share = F.greatest(F.size(runs), F.lit(1))
    split = boxes.select("*", share.alias("share"), F.posexplode(pieces).alias("part", "piece"))
    return split.withColumns(
        {"y": F.col("y") + F.col("h") * (F.col("piece.start") / total), "h": F.col("h") / F.col("share"),
         "text": F.col("piece.text")}
    ).drop("piece", "share")


def _append_run(acc: Column, run: Column, text: Column) -> Column:
    at = F.call_function("locate", run, text, acc["cursor"])
    piece = F.struct(run.alias("text"), (at - 1).cast("int").alias("start"))
    return F.struct(
        (at + F.length(run)).cast("int").alias("cursor"), F.concat(acc["out"], F.array(piece)).alias("out")
    )


# --- name clusters ----------------------------------------------------------------------------------------------------
def _cell_links(columns: DataFrame, cells: DataFrame, p: LayoutParams) -> DataFrame:
    """Links (form_id, a, b) between the labels of touching cells of different columns.

    Words of cells side by side differ by less than a cell in height, so the cells' extremes decide. For diagonal neighbours
    some word has to be near in both directions: the words of such a pair, one row for each distinct x, pass in order of x,
    the lowest word so far against the highest of the other cell."""
    steps = F.array(*[F.struct(F.lit(dx).alias("side"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (1, 1), (-1, 1))])
    other = cells.select("form_id", F.col("cx").alias("ox"), F.col("cy").alias("oy"), *[
        F.col(k).alias(f"other_{k}") for k in ("label", "left", "right", "high")])
    here = cells.withColumn("step", F.explode(steps)).withColumns(
        {"ox": F.col("cx") + F.col("step.side"), "oy": F.col("cy") + F.col("step.dy")})
    across = F.when(F.col("step.side") > 0, F.col("other_left") - F.col("right")).otherwise(F.col("left") - F.col("other_right"))
    down = (F.col("step.dy") == 0) | (F.col("other_high") - F.col("low") < p.cluster_dy)
    met = here.join(other, ["form_id", "ox", "oy"]).filter(
        (F.col("label") != F.col("other_label")) & (across < p.cluster_dx) & down)
    met = staged(met.select("form_id", F.col("label").alias("a"), F.col("other_label").alias("b"), "cx", "cy", "step.side",
                            "step.dy"), "neighbours")
    sure = met.filter("dy = 0").select("form_id", "a", "b")
    maybe = met.filter("dy = 1").drop("dy")
    pair = ["form_id", "cx", "cy", "side"]
    upper = columns.join(maybe, ["form_id", "cx", "cy"]).select(
        *pair, "a", "b", (F.col("side") * F.col("x") + p.cluster_dx).alias("at"), (F.col("low") + p.cluster_dy).alias("reach"),
        F.lit(None).cast("double").alias("top"))
    lower = maybe.withColumns({"ox": F.col("cx") + F.col("side"), "oy": F.col("cy") + 1}).join(
        columns.withColumnsRenamed({"cx": "ox", "cy": "oy"}), ["form_id", "ox", "oy"]).select(
        *pair, "a", "b", (F.col("side") * F.col("x")).alias("at"), F.lit(None).cast("double").alias("reach"),
        F.col("high").cast("double").alias("top"))
    # Words of the lower cell come first among equals, since a distance of exactly a cell is no contact.
    order = Window.partitionBy(*pair).orderBy(F.desc("at"), F.col("top").isNull())
    passed = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = upper.unionByName(lower).withColumn("passed", passed).filter(F.col("top") < F.col("passed"))
    return sure.unionByName(near.select("form_id", "a", "b").distinct())


#: Words and lines up to which a form is looked through in its own row.
FEW = 512


def _clusters(p: LayoutParams):
    @F.arrow_udf("array<bigint>")
    def clusters(words: pa.Array) -> pa.Array:
        n, flat = groups.sizes(words), words.flatten()
        box, x, y = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
        # By rising box_id, so that the lowest node is the lowest box.
        order = np.lexsort((box, np.repeat(np.arange(len(n)), n)))
        box, x, y = box[order], x[order], y[order]
        found = np.zeros(len(box), np.int64)
        for own, _, i, j in groups.pairs(n, n):
            px, py = x[own], y[own]
            near = (np.abs(px[i] - px[j]) < p.cluster_dx) & (np.abs(py[i] - py[j]) < p.cluster_dy)
            found[order[own]] = box[own][groups.lowest_reached(len(px), i[near], j[near])]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(found))

    return clusters


def _clustered_in_rows(words: DataFrame, p: LayoutParams) -> DataFrame:
    """Words of forms with few of them are compared in pairs, each form in its own row."""
    rows = words.dropna(subset=["form_id", "box_id", "x", "y"]).groupBy("form_id").agg(
        F.collect_list(F.struct(*[k for k in words.columns if k != "form_id"])).alias("words"))
    places = F.arrays_zip(F.col("words.box_id").cast("array<bigint>"), *[F.col(f"words.{k}").cast("array<double>") for k in "xy"])
    rows = rows.select("form_id", "words", _clusters(p)(places).alias("clusters"))
    rows = rows.select("form_id", F.explode(F.arrays_zip("words", "clusters")).alias("w"))
    kept = [F.col(k if k == "form_id" else f"w.words.{k}").alias(k) for k in words.columns]
    return rows.select(*kept, F.col("w.clusters").cast(words.schema["box_id"].dataType).alias("cluster"))


def cluster_words(words: DataFrame, p: LayoutParams = DEFAULT, few: int = FEW) -> DataFrame:
    """Add ``cluster``: the lowest box_id reachable over steps of |dx| < cluster_dx and |dy| < cluster_dy on a form.

    A form with at most ``few`` words is looked through in its own row, see :func:`_clustered_in_rows`, a crowded one on a
    grid, see :func:`_clustered_on_grid`."""
    calm, large = _parted(few, words)
    rows = _clustered_in_rows(*calm, p)
    return rows if large is None else rows.unionByName(_clustered_on_grid(*large, p).select(rows.columns))


def _clustered_on_grid(words: DataFrame, p: LayoutParams) -> DataFrame:
    """Words are first put on a grid of that cell size. All words of one cell are mutual neighbours, so a cell is one node
    however many words it holds, and only the eight cells around it can touch it. Cells below one another touch if their
    extremes do, so the runs of each column come from one pass down it. Runs, known by their lowest box_id, are linked in
    joins, and so are their components; no task sees a page."""
    gx, gy = F.floor(F.col("x") / p.cluster_dx), F.floor(F.col("y") / p.cluster_dy)
    placed = words.withColumns({"cx": gx, "cy": gy})
    columns = staged(placed.groupBy("form_id", "cx", "cy", "x").agg(
        F.max("y").alias("low"), F.min("y").alias("high"), F.min("box_id").alias("label")), "columns")
    cells = columns.groupBy("form_id", "cx", "cy").agg(
        F.min("label").alias("label"), F.min("x").alias("left"), F.max("x").alias("right"), F.min("high").alias("high"),
        F.max("low").alias("low"))
    down = Window.partitionBy("form_id", "cx").orderBy("cy")
    touches = (F.lag("cy").over(down) == F.col("cy") - 1) & (F.col("high") - F.lag("low").over(down) < p.cluster_dy)
    cells = cells.withColumn("opens", F.when(touches, 0).otherwise(1)).withColumn("run", F.sum("opens").over(down))
    lowest = F.min("label").over(Window.partitionBy("form_id", "cx", "run"))
    cells = staged(cells.withColumn("label", lowest).drop("opens", "run"), "runs")
    roots = components(_cell_links(columns.drop("label"), cells, p))
    by_cell = cells.select("form_id", "cx", "cy", "label").join(
        roots.withColumnRenamed("node", "label"), ["form_id", "label"], "left")
    by_cell = by_cell.select("form_id", "cx", "cy", F.coalesce("root", "label").alias("cluster"))
    return placed.join(by_cell, ["form_id", "cx", "cy"]).drop("cx", "cy")


def merge_names(clustered: DataFrame) -> DataFrame:
    """One name per cluster: words by x (ties: detection order), valid names only, title case, bounding box, mean
    confidence."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("x", "box_id", "text"))), lambda w: w["text"])
    merged = clustered.groupBy("form_id", "cluster").agg(
        tx.normalize_whitespace(F.array_join(words, " ")).alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"),
        F.avg("confidence").alias("confidence"),
    )
    return merged.filter(tx.is_valid_name(F.col("text"))).select(
        "form_id", "cluster", tx.format_name(F.col("text")).alias("text"), "x", "y",
        (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "confidence",
    )


def name_boxes(boxes: DataFrame, p: LayoutParams = DEFAULT) -> DataFrame:
    """Word boxes that look like names, clustered and merged."""
    return merge_names(cluster_words(_like_names(boxes, p), p))


def short_name_boxes(boxes: DataFrame, p: LayoutParams = DEFAULT) -> DataFrame:
    """:func:`name_boxes` of forms that are known to have few words."""
    return merge_names(_clustered_in_rows(_like_names(boxes, p), p))


def _like_names(boxes: DataFrame, p: LayoutParams) -> DataFrame:
    return boxes.filter(tx.looks_like_name(F.col("text"), p.letter_ratio))


# --- same-row extraction ----------------------------------------------------------------------------------------------
def _parted(few: int, *tables: DataFrame) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The tables' rows of forms with at most ``few`` rows in each table, and those of the crowded forms, if there are any."""
    long = [t.groupBy("form_id").agg(F.count("*").alias("n")).filter(F.col("n") > few).select("form_id") for t in tables]
    crowded = staged(reduce(DataFrame.unionByName, long).distinct(), "crowded")
    if crowded.isEmpty():
        return list(tables), None
    return tuple([t.join(crowded, "form_id", how) for t in tables] for how in ("left_anti", "left_semi"))


def locate_id_lines(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Lines with 7-11 digits, each with the position of the first word whose digits occur in them: form_id, line_no,
    id_number, x, y (the word's vertical centre). Lines without such a word are dropped.

    Lines and words of a form meet in one row; a crowded form's by digit strings, see :func:`_located_by_strings`."""
    lines, words = lines.select("form_id", "line_no", "line"), words.select("form_id", "box_id", "text", "x", "y", "h")
    calm, large = _parted(FEW, lines, words)
    located = _located_in_place(*_id_digits(*calm))
    return located if large is None else located.unionByName(_located_by_strings(*_id_digits(*large)))


def _id_digits(lines: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The digits of lines that may hold an identifier, and of words that may be part of one."""
    ids = lines.select("form_id", "line_no", tx.digits_only(F.col("line")).alias("id_number"))
    words = words.withColumn("digits", tx.digits_only(F.col("text")))
    return ids.filter(F.length("id_number").between(7, 11)), words.filter(F.length("digits").between(1, 11))


def _located_in_place(ids: DataFrame, words: DataFrame) -> DataFrame:
    middle = (F.col("y") + F.col("h") / 2).alias("y")
    boxes = words.groupBy("form_id").agg(F.sort_array(F.collect_list(F.struct("box_id", "digits", "x", middle))).alias("boxes"))
    lines = ids.groupBy("form_id").agg(F.collect_set(F.struct("line_no", "id_number")).alias("lines"))
    rows = lines.join(boxes, "form_id").select("form_id", "boxes", F.explode("lines").alias("l"))
    hits = F.filter("boxes", lambda b: F.contains(F.col("l.id_number"), b["digits"]))
    found = rows.select("form_id", "l.*", F.explode(F.slice(hits, 1, 1)).alias("w"))
    return found.select("form_id", "line_no", "id_number", "w.x", "w.y")


def _located_by_strings(ids: DataFrame, words: DataFrame) -> DataFrame:
    """"Occurs in" as an equi-join on digit strings: the words of a form are reduced to the first one per distinct
    string, and a line lists its substrings (66 at most) only for the lengths that the form's words have."""
    first = words.groupBy("form_id", "digits").agg(
        F.min_by(F.struct("box_id", "x", (F.col("y") + F.col("h") / 2).alias("y")), F.col("box_id")).alias("w")
    )
    lengths = first.groupBy("form_id").agg(F.collect_set(F.length("digits")).alias("lengths"))
    fitting = F.filter("lengths", lambda k: k <= F.length("id_number"))
    parts = F.flatten(
        F.transform(
            fitting,
            lambda k: F.transform(
                F.sequence(F.lit(1), F.length("id_number") - k + 1), lambda i: F.substr(F.col("id_number"), i, k)
            ),
        )
    )
    wanted = ids.join(lengths, "form_id").select("form_id", "line_no", "id_number", F.explode(F.array_distinct(parts)).alias("digits"))
    hits = wanted.join(first, ["form_id", "digits"])
    return hits.groupBy("form_id", "line_no", "id_number").agg(F.min_by("w", F.col("w.box_id")).alias("w")).select(
        "form_id", "line_no", "id_number", "w.x", "w.y"
    )


def same_row_names(ids: DataFrame, words: DataFrame, p: LayoutParams = DEFAULT) -> DataFrame:
    """Names left of each identifier on its row: words whose vertical centre lies within ``row_band`` of the id's y and
    that start more than ``left_margin`` left of it. Names under four characters are dropped. ``ids`` are as
    :func:`locate_id_lines` gives them, one row for each form_id, line_no and id_number.

    An identifier looks through the names of its form in its own row; a crowded form's meet by strips."""
    ids = ids.select("form_id", "line_no", "id_number", "x", "y")
    calm, large = _parted(FEW, words.select("form_id", "box_id", "text", "x", "y", "h", "confidence"))
    if large is None:
        rows = _names_in_place(ids, *calm, p)
    else:
        crowded = large[0].select("form_id").distinct()
        rows = _names_in_place(ids.join(crowded, "form_id", "left_anti"), *calm, p).unionByName(
            _names_by_strips(ids.join(crowded, "form_id", "left_semi"), *large, p))
    return rows.filter(F.length("name") >= 4)


def _names_in_place(ids: DataFrame, words: DataFrame, p: LayoutParams) -> DataFrame:
    middle = (F.col("y") + F.col("h") / 2).alias("cy")
    named = words.filter(tx.looks_like_row_name(F.col("text"), p.letter_ratio)).groupBy("form_id").agg(
        F.sort_array(F.collect_list(F.struct("x", "box_id", "text", middle, "confidence"))).alias("named"))
    low, high, right = F.col("y") - p.row_band, F.col("y") + p.row_band, F.col("x") - p.left_margin
    near = F.filter("named", lambda w: (w["cy"] >= low) & (w["cy"] <= high) & (w["x"] < right))

    def row_name(hits: Column) -> Column:
        name = tx.format_name_rowwise(F.array_join(hits["text"], " "))
        return F.struct(name.alias("name"), _mean(hits["confidence"]).alias("name_conf"))

    # A generator, so that the hits are looked for once and no filter is pushed into them.
    names = F.transform(F.filter(F.array(near), lambda hits: F.size(hits) > 0), row_name)
    return ids.join(named, "form_id").select("form_id", "line_no", "id_number", F.inline(names))


def _mean(values: Column) -> Column:
    """The mean of an array's values, NULLs left out."""
    none = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    return F.aggregate(
        values, none,
        lambda acc, v: F.when(v.isNull(), acc).otherwise(F.struct((acc["total"] + v).alias("total"), (acc["n"] + 1).alias("n"))),
        lambda acc: F.when(acc["n"] > 0, acc["total"] / acc["n"]))


def _names_by_strips(ids: DataFrame, words: DataFrame, p: LayoutParams) -> DataFrame:
    """The band as an equi-key: strips of twice the band height, each id looking into the two strips its band meets."""
    strip = 2 * p.row_band
    span = F.sequence(F.floor((F.col("y") - p.row_band) / strip), F.floor((F.col("y") + p.row_band) / strip))
    wanted = ids.select("form_id", "line_no", "id_number", F.col("x").alias("id_x"), F.col("y").alias("id_y"),
                        F.explode(span).alias("strip"))
    middle = F.col("y") + F.col("h") / 2
    named = words.filter(tx.looks_like_row_name(F.col("text"), p.letter_ratio)).select(
        "form_id", "box_id", F.col("text").alias("word"), "x", middle.alias("cy"), "confidence",
        F.floor(middle / strip).alias("strip"),
    )
    near = (F.col("cy") >= F.col("id_y") - p.row_band) & (F.col("cy") <= F.col("id_y") + p.row_band)
    hits = wanted.join(named, ["form_id", "strip"]).filter(near & (F.col("x") < F.col("id_x") - p.left_margin))
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("x", "box_id", "word"))), lambda w: w["word"]), " "
    )
    return hits.groupBy("form_id", "line_no", "id_number").agg(
        tx.format_name_rowwise(text).alias("name"), F.avg("confidence").alias("name_conf")
    )


# --- form rows ----------------------------------------------------------------------------------------------------------
def _ordered_text(condition: Column) -> Column:
    kept = F.array_sort(F.collect_list(F.when(condition, F.struct("box_id", "text"))))
    return F.trim(F.array_join(F.transform(kept, lambda b: b["text"]), " "))


def assemble_rows(blocks: DataFrame, column_share: float, confidence: str, repair_letters: bool,
                  p: LayoutParams = DEFAULT, keys=("form_id", "row_index")) -> DataFrame:
    """Blocks with ``row_index`` and ``page_width`` to one row per key: names left of the column boundary, the
    identifier right of it. ``confidence`` is ``mean`` or ``max``; ``repair_letters`` turns look-alike letters into
    digits first."""
    left = F.col("x") < F.col("page_width") * column_share
    combine = F.avg if confidence == "mean" else F.max
    rows = blocks.groupBy(*keys).agg(
        _ordered_text(left).alias("names"), _ordered_text(~left).alias("id_raw"),
        F.coalesce(combine(F.when(left, F.col("confidence"))), F.lit(0.0)).alias("names_conf"),
        F.coalesce(combine(F.when(~left, F.col("confidence"))), F.lit(0.0)).alias("id_conf"),
    )
    clean = tx.fix_confusable_letters if repair_letters else tx.digits_only
    rows = rows.withColumn("id_number", clean(F.col("id_raw")))
    raw_text = F.trim(F.concat("names", F.lit(" | "), "id_raw"))
    return rows.select(
        *keys, "names", "id_number", "names_conf", "id_conf",
        is_empty_row(*[F.col(k) for k in ("names", "id_number", "names_conf", "id_conf")], p).alias("is_empty"),
        raw_text.alias("raw_text"),
    )


def assemble_rows_a(blocks: DataFrame, p: LayoutParams = DEFAULT, keys=("form_id", "row_index")) -> DataFrame:
    return assemble_rows(blocks, p.name_column_a, "mean", True, p, keys)


def assemble_rows_b(blocks: DataFrame, p: LayoutParams = DEFAULT, keys=("form_id", "row_index")) -> DataFrame:
    return assemble_rows(blocks, p.name_column_b, "max", False, p, keys)


def is_empty_row(names: Column, id_number: Column, names_conf: Column, id_conf: Column,
                 p: LayoutParams = DEFAULT) -> Column:
    """Nothing read, both confidences too low, or too little text."""
    nothing = (names == "") & (id_number == "")
    unsure = (names_conf < p.empty_confidence) & (id_conf < p.empty_confidence)
    short = (F.length(names) < 2) & (F.length(id_number) < 6)
    return nothing | unsure | short


def densify_rows(rows: DataFrame, forms: DataFrame, p: LayoutParams = DEFAULT) -> DataFrame:
    """All expected rows of every form, and any that were read beyond them; rows that were not read come out empty."""
    grid = forms.select("form_id", F.explode(F.sequence(F.lit(0), F.lit(p.expected_rows - 1))).alias("row_index"))
    full = grid.join(rows, ["form_id", "row_index"], "full")
    blank = {"names": F.lit(""), "id_number": F.lit(""), "is_empty": F.lit(True)}
    return full.withColumns({k: F.coalesce(F.col(k), v) for k, v in blank.items()})


def form_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("form_id").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("is_empty")).alias("with_data"),
        F.count_if(F.col("is_empty")).alias("empty"),
    )


def assign_rows(blocks: DataFrame, page_height: Column, p: LayoutParams = DEFAULT) -> DataFrame:
    return blocks.withColumn("row_index", geo.row_band(F.col("y"), page_height, p.expected_rows))


def first_row_texts(rows: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Name and identifier of a row's text blocks (an array of strings): all name-like blocks joined; the first 7-10
    digit run, or a block whose digits number 7-10."""
    trimmed = F.transform(F.col(blocks), lambda b: F.trim(b))
    names = F.array_join(F.filter(trimmed, lambda b: tx.looks_like_row_name(b)), " ")

    def id_of(b: Column) -> Column:
        digits = tx.digits_only(b)
        return F.coalesce(F.try_element_at(tx.digit_runs(b), F.lit(1)), F.when(F.length(digits).between(7, 10), digits))

    ids = F.filter(F.transform(trimmed, id_of), lambda i: i.isNotNull())
    return rows.withColumns(
        {"name": tx.format_name_rowwise(names), "id_number": F.coalesce(F.try_element_at(ids, F.lit(1)), F.lit(""))}
    )


# --- per-digit confidences ------------------------------------------------------------------------------------------
BLOCK = 512
#: Digits up to which a stream is joined whole to the identifiers of its form.
LONG_STREAM = 4096


def _stream_grams(stream: DataFrame, wanted: DataFrame) -> DataFrame:
    """First occurrence of every digit string of a wanted length in its form's stream, with its confidences. Streams are cut
    into blocks that overlap by the longest identifier of the form, so a long one spreads over many tasks."""
    lengths = wanted.filter(F.length("target") > 0).groupBy("form_id").agg(
        F.collect_set(F.length("target")).alias("lengths"))
    known = stream.join(lengths, "form_id").withColumn("overlap", F.array_max("lengths") - 1)
    starts = F.sequence(F.lit(1), F.length("digits"), F.lit(BLOCK))
    blocks = known.filter(F.length("digits") > 0).select(
        "form_id", "lengths", "digits", "confs", "overlap", F.explode(starts).alias("from")
    ).select(
        "form_id", "lengths", "from", F.substr("digits", F.col("from"), F.col("overlap") + BLOCK).alias("digits"),
        F.slice("confs", F.col("from"), F.col("overlap") + BLOCK).alias("confs"),
    )
    size = F.least(F.length("digits"), F.lit(BLOCK))
    at = blocks.select("*", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    each = at.select("*", F.explode("lengths").alias("k")).filter(F.col("at") + F.col("k") - 1 <= F.length("digits"))
    grams = each.select(
        "form_id", F.substr("digits", F.col("at"), F.col("k")).alias("target"), (F.col("from") + F.col("at")).alias("place"),
        F.slice("confs", F.col("at"), F.col("k")).alias("hit"),
    )
    met = grams.join(wanted.select("form_id", "target").distinct(), ["form_id", "target"], "left_semi")
    return met.groupBy("form_id", "target").agg(F.min_by("hit", F.col("place")).alias("hit"))


def map_digit_confidences(ids: DataFrame, streams: DataFrame, missing: float = 0.85) -> DataFrame:
    """Confidence of every digit of every identifier. ``streams`` holds per form the ordered ``symbols`` (text,
    confidence) that the recogniser saw; a word-level recogniser repeats the word's confidence for each digit.

    The identifier is looked up in the concatenated digits (first occurrence, which may cross words). When it is not
    there every digit gets the mean of the digit-bearing symbols, 0.0 without any; without a response, ``missing``."""
    digit_symbols = F.filter("symbols", lambda s: s["text"].rlike("[0-9]"))
    stream = streams.select(
        "form_id",
        F.array_join(F.transform("symbols", lambda s: tx.digits_only(s["text"])), "").alias("digits"),
        F.flatten(
            F.transform("symbols", lambda s: F.array_repeat(s["confidence"], F.length(tx.digits_only(s["text"]))))
        ).alias("confs"),
        F.when(
            F.size(digit_symbols) > 0,
            F.aggregate(digit_symbols, F.lit(0.0), lambda acc, s: acc + s["confidence"]) / F.size(digit_symbols),
        ).otherwise(F.lit(0.0)).alias("mean"),
    )
    stream = staged(stream, "digit-streams")
    wanted = ids.withColumn("target", tx.digits_only(F.col("id_number")))
    # Of a short stream every identifier of its form can look through all of it; the long ones are listed by digit strings.
    short = F.length("digits") <= LONG_STREAM
    mapped = wanted.join(stream.select("form_id", "mean", *[F.when(short, F.col(k)).alias(k) for k in ("digits", "confs")]),
                         "form_id", "left")
    at, long = F.instr(F.col("digits"), F.col("target")), F.length("target")
    mapped = mapped.withColumn("hit", F.when((long > 0) & (at > 0), F.slice("confs", at, long))).drop("digits", "confs")
    crowded = stream.filter(~short)
    if not crowded.isEmpty():
        grams = _stream_grams(crowded, wanted).withColumnRenamed("hit", "far")
        mapped = mapped.join(grams, ["form_id", "target"], "left").withColumn("hit", F.coalesce("hit", "far")).drop("far")
    flat = F.array_repeat(F.coalesce("mean", F.lit(missing)), F.length("target"))
    return mapped.withColumns({"digit_conf": F.coalesce("hit", flat), "found": F.col("hit").isNotNull()}).drop(
        "mean", "hit", "target"
    )
