"""Repeated passages by suffix order and longest previous factors.

A passage counts as repeated from ``length`` bytes on. Two equal strings of that length contain the same anchor at the same
place: the smallest hash among their k-grams. So each document is cut into contexts, the strings that share an anchor, and
anchors meet in Spark by hash:

1. A context that occurs whole elsewhere is settled by counting.
2. Contexts of one anchor that differ go to one task as bytes. There the suffixes are put in order by prefix doubling up to
   ``length``; in that order, the previous and next suffix of the same run with a smaller position are the longest
   previous factors, which tell the first occurrence from the later ones.
3. An anchor with very many different contexts is not gathered. Equal strings have their anchor at the same place, so the
   contexts are split by where a string has it, in ranges that double. A range that occurs whole elsewhere is settled by
   counting; one whose common bytes occur nowhere else is done; the first of each other kind is halved, and so on.

Texts that are equal are one class all along, so copies add rows only where they are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cotejo.llm.textops import mix, slices, small_batches, text_bytes
from cotejo.plans.staging import staged

LENGTH = 400
#: The anchor k-gram's share of the length.
GRAM_SHARE = 0.24
SHORTEST = 100
#: Different contexts of one anchor that one task takes.
GROUP = 2000
#: Bytes whose suffixes are sorted at once, unless one anchor has more.
SORT_BYTES = 1 << 20
PIECE = 2 << 20
_POSITION = np.uint64((1 << 31) - 1)
_RANDOM = np.random.default_rng(77)
_CODES = _RANDOM.integers(1, 2**63 - 1, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RANDOM.integers(1, 2**60, 2, dtype=np.uint64) * np.uint64(8) + np.uint64(5)
_BACK = np.array([pow(int(m), -1, 2**64) for m in _STEP], np.uint64)


class Rolling:
    """Hashes of any substrings of ``data``, each in constant time."""

    def __init__(self, data: np.ndarray, which: int):
        self.back = np.full(len(data) + 1, _BACK[which], np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)
        forward = np.full(max(len(data), 1), _STEP[which], np.uint64)
        forward[0] = 1
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[which][data] * np.cumprod(forward)[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def contexts(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The contexts of one text: first string start, number of strings, anchor offset, anchor hash, context hash."""
    if len(data) < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    one, two = Rolling(data, 0), Rolling(data, 1)
    gram = int(length * GRAM_SHARE)
    at = np.arange(len(data) - gram + 1)
    grams = one.of(at, at + gram)
    low = sliding_minimum((grams & ~_POSITION) | at.astype(np.uint64), length - gram + 1)
    anchor = (low & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    count = np.diff(np.append(first, len(anchor)))
    anchor = anchor[first]
    whole = two.of(first, first + count - 1 + length)
    whole = mix(whole + (anchor - first).astype(np.uint64) * _STEP[0] + count.astype(np.uint64) * _STEP[1])
    return first, count, anchor - first, grams[anchor].view(np.int64), whole.view(np.int64)


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first ``length`` bytes, equal prefixes sharing a rank; prefix doubling from 8 bytes.
    Only suffixes with at least ``length`` bytes before the end of ``data`` are ranked."""
    starts = len(data) - 7
    words = np.zeros(starts, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | data[k:k + starts].astype(np.uint64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    known = 8
    while known < length:
        step = min(known, length - known)
        n = len(rank) - step
        rank = np.unique(rank[:n] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1].astype(np.int64)
        known += step
    return rank


def previous_factors(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in one text order (``position``): whether an equal prefix starts earlier, and whether one starts later.

    In suffix order with ties by position, the neighbour before in a run of equal rank is the previous smaller position
    whose common prefix reaches the full length; the neighbour after is the next larger one.
    """
    order = np.lexsort((position, rank))
    same = rank[order][1:] == rank[order][:-1]
    earlier, later = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [start, end) spans; touching ones join."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _anchored(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                rows: list[np.ndarray] = []
                columns: list[list[np.ndarray]] = [[], [], [], [], []]
                for i in range(len(offsets) - 1):
                    text = data[offsets[i]:offsets[i + 1]]
                    for base in range(0, max(1, len(text) - length + 1), PIECE):
                        found = contexts(text[base:base + PIECE + length - 1], length)
                        rows.append(np.full(len(found[0]), i))
                        for column, values in zip(columns, (found[0] + base, *found[1:])):
                            column.append(values)
                yield pa.RecordBatch.from_arrays(
                    [part.column("txt").take(pa.array(np.concatenate(rows))),
                     *[pa.array(np.concatenate(c), t) for c, t in zip(
                         columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]],
                    names=["txt", "first", "n", "anchor_at", "anchor", "context"])

    return texts.filter(F.octet_length("text") >= length).select("txt", "text").mapInArrow(
        run, "txt binary, first int, n int, anchor_at int, anchor bigint, context bigint")


def _context_bytes(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (one row per context, with its text) joined with the texts and cut out of them."""
    per_text = wanted.groupBy("txt", "doc").agg(F.collect_list(F.struct("anchor", "context", "first", "n", "anchor_at")).alias("cuts"))
    per_text = staged(per_text.select(F.col("txt").alias("t"), F.col("doc").alias("d"), "cuts"), "suffix-wanted")
    joined = texts.join(per_text, (F.col("txt") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    cut = joined.select("txt", "doc_id", F.col("text").cast("binary").alias("text"), F.explode("cuts").alias("cut"))
    return cut.select(
        "cut.anchor", "cut.context", "txt", F.col("doc_id").alias("doc"), "cut.first", "cut.n", "cut.anchor_at",
        F.substring(F.col("text"), F.col("cut.first") + 1, F.col("cut.n") + length - 1).alias("bytes"),
    ).dropDuplicates(["anchor", "context"])


_FOUND = "anchor bigint, context bigint, at int, upto int"


def _by_suffix_order(groups: DataFrame, length: int, keep_first: bool) -> DataFrame:
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        sizes = np.array([len(r[6]) for r in rows])
        base = np.cumsum(sizes) - sizes
        n = np.array([r[5] for r in rows])
        # Text order: by first document (null last), then text, then place.
        places = {t: k for k, t in enumerate(sorted({(r[3] is None, r[3] or 0, r[2]) for r in rows}))}
        text = np.array([places[r[3] is None, r[3] or 0, r[2]] for r in rows], np.int64)
        row = np.repeat(np.arange(len(rows)), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rank = suffix_ranks(data, length)[base[row] + within]
        position = (text[row] << 31) + np.array([r[4] for r in rows])[row] + within
        earlier, later = previous_factors(rank, position)
        hit = earlier if keep_first else earlier | later
        start = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (row[1:] != row[:-1]))))
        end = np.flatnonzero(hit & np.concatenate((~hit[1:] | (row[1:] != row[:-1]), [True])))
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in row[start]], pa.int64()), pa.array([rows[i][1] for i in row[start]], pa.int64()),
             pa.array(within[start], pa.int32()), pa.array(within[end] + 1, pa.int32())],
            names=["anchor", "context", "at", "upto"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("anchor", "context", "txt", "doc", "first", "n", "bytes")]):
                if held and size > SORT_BYTES and r[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield solve(held)

    parts = 2 * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ("anchor", "context", "txt", "doc", "first", "n", "bytes")
    return groups.select(*columns).repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(run, _FOUND)


def place_classes(length: int) -> list[tuple[int, int]]:
    """Ranges [low, high] of the bytes that a string has before its anchor: doubling from both ends to the middle."""
    half, out, low = length // 2, [(0, 0)], 1
    while low <= half:
        out.append((low, min(2 * low - 1, half)))
        low *= 2
    behind, low = [], 1
    while low < length - half:
        behind.append((length - min(2 * low - 1, length - half - 1), length - low))
        low *= 2
    return out + behind[::-1] + [(length, length)]


_CONTEXT = ("anchor", "context", "none", "doc", "txt", "first", "n", "anchor_at", "bytes", "sure")


def _ranged(rows: DataFrame, length: int, halve: bool) -> DataFrame:
    """``rows`` (contexts, or their ranges of places to be halved) with one row for each range that has strings of the context:
    ``at`` and ``upto`` tell its strings, ``whole`` hashes all their bytes, ``core`` those that all strings of the range have."""
    classes = place_classes(length)
    bounds = ("low", "high") * halve

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (raw, n, q, *old) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("bytes", "n", "anchor_at", *bounds)])):
                middle = sum(old) // 2
                spots = np.array([(low, high, q - min(high, q), q - max(low, q - n + 1) + 1)
                                  for low, high in ([(old[0], middle), (middle + 1, old[1])] if halve else classes)], np.int64)
                low, high, at, upto = spots[spots[:, 2] < spots[:, 3]].T
                data = np.frombuffer(raw, np.uint8)
                one, two = Rolling(data, 0), Rolling(data, 1)
                hashes = [h.of(*span).view(np.int64) for span in ((at, upto - 1 + length), (q - low, q + length - high))
                          for h in (one, two)]
                out.extend(zip([i] * len(at), low, high, at, upto, *hashes))
            index, *values = list(zip(*out)) or [()] * 9
            index = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(index) for c in _CONTEXT],
                 *[pa.array(v, t) for v, t in zip(values, [pa.int32()] * 4 + [pa.int64()] * 4)]],
                names=[*_CONTEXT, "low", "high", "at", "upto", "whole1", "whole2", "core1", "core2"])

    rows = rows.select(*_CONTEXT, *bounds)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in _CONTEXT)
    return rows.mapInArrow(run, kinds + ", low int, high int, at int, upto int, whole1 bigint, whole2 bigint, "
                                        "core1 bigint, core2 bigint")


def _by_place(groups: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Runs of repeated strings of crowded anchors. Where all strings of a range of places occur together elsewhere, counting
    settles them, and the first of them goes on for all. A range whose core is met nowhere else has no more of them; the
    others are halved, down to single strings."""
    whole = ["anchor", "low", "high", "before", "until", "whole1", "whole2"]
    core = ["anchor", "low", "high", "core1", "core2"]
    place = F.struct("none", "doc", "txt", (F.col("first") + F.col("at")).alias("p"))
    # The same bytes lie as far from the anchor, wherever it is in the context.
    named = {"place": place, "before": F.col("anchor_at") - F.col("at"), "until": F.col("anchor_at") - F.col("upto")}
    rows = groups.withColumns({"none": F.col("doc").isNull(), "sure": F.lit(False)})
    found, halve = groups.sparkSession.createDataFrame([], _FOUND), False
    while True:
        ranges = staged(_ranged(rows, length, halve).withColumns(named), "suffix-ranges")
        if ranges.isEmpty():
            return found
        same = ranges.groupBy(*whole).agg(F.count(F.lit(1)).alias("m"), F.min("place").alias("head"))
        ranges = staged(ranges.join(same, whole), "suffix-ranges-met")
        first = F.col("place") == F.col("head")
        found = found.union(ranges.filter(~first if keep_first else (F.col("m") > 1) & ~F.col("sure")).select(*found.columns))
        on = ranges.filter(first & (F.col("low") < F.col("high"))).withColumn("sure", F.col("sure") | (F.col("m") > 1))
        met = on.groupBy(*core).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
        rows, halve = on.join(met, core), True


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """``txt, spans`` for every text with bytes to remove: merged later by the caller. ``docs`` has ``doc_id, text, txt``."""
    rows = staged(_anchored(docs, length), "suffix-contexts")
    stats = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("context").alias("lo"),
                                       F.max("context").alias("hi")).filter("m > 1")
    met = rows.join(stats.select("anchor", (F.col("lo") != F.col("hi")).alias("open")), "anchor")
    met = met.groupBy("anchor", "context", "open", "txt", "first", "n", "anchor_at").agg(F.count(F.lit(1)).alias("copies"))
    owner = docs.groupBy("txt").agg(F.min("doc_id").alias("doc"))
    met = staged(met.join(owner, "txt"), "suffix-met")

    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "txt", "first", "n", "anchor_at")
    per_context = staged(met.groupBy("anchor", "context", "open").agg(
        F.sum("copies").alias("m"), F.min(place).alias("low")), "suffix-classes")
    open_ = per_context.filter("open").select("anchor", "context", "low.*")
    size = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"))
    cut = staged(_context_bytes(docs, open_, length).join(size, "anchor"), "suffix-bytes")
    found = _by_suffix_order(cut.filter(F.col("size") <= GROUP), length, keep_first).union(
        _by_place(cut.filter(F.col("size") > GROUP), length, keep_first))
    # A context has few runs, so they meet it in one row.
    found = found.groupBy("anchor", "context").agg(F.collect_list(F.struct("at", "upto")).alias("runs"))

    known = met.join(per_context.select("anchor", "context", "m", "low"), ["anchor", "context"])
    settled = (place != F.col("low")) if keep_first else F.col("m") > 1

    def span(at: Column, upto: Column) -> Column:
        return F.struct((F.col("first") + at).alias("start"), (F.col("first") + upto - 1 + length).alias("end"))

    whole = known.filter(settled).select("txt", F.array(span(F.lit(0), F.col("n"))).alias("spans"))
    part = known.filter(~settled & F.col("open")).join(found, ["anchor", "context"]).select(
        "txt", F.transform("runs", lambda r: span(r["at"], r["upto"])).alias("spans"))
    return whole.union(part).groupBy("txt").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup_passages(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, keep_text: bool = False,
                   columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``columns``, ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``kept``.

    Every byte that lies in a ``length``-byte string that occurs more than once, in the same document or another, is
    removed; strings are judged on the input and never cross documents. With ``keep_first`` the first occurrence stays
    (order: doc_id, null last; then digest of the text; then place), so of equal texts the one with the smallest id is
    kept as it would be alone. A cut through a UTF-8 character leaves its other bytes; ``kept`` drops those. Null texts
    are empty; texts shorter than ``length`` stay whole; rows repeating both id and text count as copies, and with
    ``keep_first`` all of those of the smallest id keep what one keeps. An empty table gives an empty one.
    """
    if length < SHORTEST:
        raise ValueError(f"length must be at least {SHORTEST}")
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], body.alias("text"),
                        F.unhex(F.md5(body)).alias("txt"))
    narrow = texts.select("doc_id", "text", "txt")
    spans = repeated_spans(narrow, length, keep_first)
    if keep_first:
        owner = narrow.groupBy("txt").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("m"))
        spans = owner.filter("m > 1").join(spans, "txt", "full").select("txt", "owner", "spans")
    else:
        spans = spans.withColumn("owner", F.lit(None).cast("long"))
    spans = spans.withColumnRenamed("txt", "t")
    later = F.col("owner").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("owner")) & (F.octet_length("text") >= length)
    joined = texts.join(spans, F.col("txt") == F.col("t"), "left").withColumn("all", later)
    kept_columns = ["doc_id", *[f"c{i}" for i in range(len(columns))]]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept_columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans_, all_ in zip(*[batch.column(c).to_pylist() for c in ("text", "spans", "all")]):
                raw = text.encode()
                cuts = [(0, len(raw))] if all_ else merge_spans((s["start"], s["end"]) for s in spans_ or ())
                rest, at = [], 0
                for start, end in cuts:
                    rest.append(raw[at:start])
                    at = end
                left = b"".join(rest) + raw[at:]
                row = (len(raw), len(raw) - len(left), len(cuts), hashlib.sha256(left).hexdigest(),
                       left.decode("utf-8", "ignore") if keep_text else None)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept_columns], *[pa.array(v, t) for v, t in zip(
                    out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]],
                names=[*kept_columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = joined.select(*kept_columns, "text", "spans", "all").mapInArrow(
        run, f"{kinds}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "doc_id", "n_bytes", "n_removed",
                       "n_spans", "kept_sha256", *["kept"] * keep_text)
