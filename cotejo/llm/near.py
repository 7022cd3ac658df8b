"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's sketch is the smallest hashes of its word shingles. Documents with equal sets are one class. Inverted lists
are kept for three neighbouring retained values together (with at most one value left out between two), so a frequent
shingle alone brings nobody together. Pairs at a Jaccard similarity of exactly 0.8 that share no list were counted in a
model of ``list_keys``: see ``ANCHORS``.

Links are found in two rounds, so that a group of copies never gives all its pairs:

1. In each list, every class meets the list's most connected one. Union sketches filter, full sets confirm.
2. Lists with the same first value and the same most connected class are joined into one, and of lists with the same
   members one is kept. Where classes are not in one component yet, those outside the largest component are held block by
   block while the others pass; a task reports no pair whose ends are already connected.

Components of the confirmed links are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cotejo.llm.graph import components
from cotejo.llm.textops import mix, row_shingles, slices, small_batches, text_bytes, word_hashes, word_spans
from cotejo.plans.staging import staged

#: Retained values that start a list, and the steps to the second and third value. In a
#: numpy model of long texts at exactly 0.8, pairs without a common list were 0 of 100,000 where one set holds the other and
#: 0 of 100,000 where both have values of their own; with 10 such values they were 117 and 8.
ANCHORS = 24
STEPS = ((1, 1), (1, 2), (2, 1), (2, 2))
SKETCH = 64
#: Rows of two longs that are broadcast at most; a longer list of candidates is joined by shuffling.
BROADCAST_ROWS = 500_000
#: Values that round 2 compares; sets up to this size are compared whole.
WIDE_SKETCH = 512
#: Classes of a block that one task holds, and of the largest component that pass it by.
BLOCK = 1024
STREAM = 16_384
COLUMNS = 2048
_LOW = np.uint64(0xFFFFFFFF)
_CODES = np.random.default_rng(8).integers(1, 2**63 - 1, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, counts = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    bounds = np.append(0, np.cumsum(counts))
    for i in range(len(counts)):
        yield np.unique(row_shingles(hashes[bounds[i]:bounds[i + 1]], words))


def list_keys(values: np.ndarray) -> np.ndarray:
    """Keys of the inverted lists of one sketch: the first value's high half over a hash of all three. Sets of up to three
    values have none: at 0.8 they link to equal sets only."""
    values = values[:ANCHORS + 4]
    out = []
    if len(values) > 3:
        for one, two in STEPS:
            n = min(ANCHORS, len(values) - one - two)
            if n > 0:
                three = mix(values[:n] * _CODES[0] + values[one:n + one] * _CODES[1]
                            + values[one + two:n + one + two] * _CODES[2])
                out.append((mix(values[:n]) & ~_LOW) | (three & _LOW))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def class_of(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest() if len(values) else None


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard similarity from the k smallest values of the union; exact when both sets have at most k."""
    low = np.union1d(a[:k], b[:k])
    if len(a) > k or len(b) > k:
        low = low[:k]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), low, assume_unique=True)) / max(len(low), 1)


def margin(k: int, threshold: float) -> float:
    """What an estimate from k values may fall short of the threshold: four standard deviations."""
    return 4.0 * (threshold * (1.0 - threshold) / k) ** 0.5


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(*text_bytes(part.column("text")), words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([class_of(s) for s in sets], pa.binary()),
                     pa.array([list_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n", "cls", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n bigint, cls binary, keys array<bigint>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(*text_bytes(part.column("text")), words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["cls", "n", "full"])

    return docs.select("text").mapInArrow(run, "cls binary, n bigint, full binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets link, after the sketches and the set sizes let them pass."""
    def check(k: int | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                passed = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    if k:
                        passed.append(union_estimate(x, y, k) >= percent / 100 - margin(k, percent / 100))
                    else:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        passed.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))
        return run

    def joined(pairs: DataFrame, value) -> DataFrame:
        left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), value.alias("x"))
        right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), value.alias("y"))
        sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        return pairs.join(left, "a").join(right, "b").filter(sized).select("a", "b", "x", "y")

    near = joined(pairs, F.substring("full", 1, 8 * SKETCH + 8)).mapInArrow(check(SKETCH), "a binary, b binary")
    near = staged(near.distinct(), "near-pairs")
    return joined(near, F.col("full")).mapInArrow(check(None), "a binary, b binary")


def _common(values: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Number of values that each row of ``left`` shares with each row, by products of ``COLUMNS`` values at a time. Values
    of a single row are shared with nobody but itself."""
    length = np.array([len(v) for v in values])
    _, ids, often = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(values)), length)
    shared = often[ids] > 1
    place = np.cumsum(often > 1) - 1
    row, column = row[shared], place[ids[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(values)), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        low, high = np.searchsorted(column, (at, at + COLUMNS))
        dense = np.zeros((len(values), min(COLUMNS, width - at)), np.float32)
        dense[row[low:high], column[low:high] - at] = 1
        common += (dense[left] @ dense.T).astype(np.int64)
    return common


def _compare_group(roots: list[bytes], minor: np.ndarray, self_too: bool, values: list[np.ndarray], sizes: np.ndarray,
                   percent: int, parent: dict[bytes, bytes]) -> list[tuple[int, int, bool]]:
    """Pairs of a block: (row, row, certain). Certain links only as far as they connect something; ``parent`` remembers what
    they have connected."""
    length = np.array([len(v) for v in values])
    left = np.flatnonzero(minor)
    common = _common(values, left)
    whole = length == sizes
    top = np.array([np.uint64(2**64 - 1) if w else v[-1] for v, w in zip(values, whole)], np.uint64)
    union = np.zeros_like(common)
    for k, i in enumerate(left):
        limit = np.minimum(top[i], top)
        mine = np.searchsorted(values[i], limit, "right")
        theirs = np.array([len(v) if t <= l else np.searchsorted(v, l, "right") for v, t, l in zip(values, top, limit)]) \
            if not whole.all() else length
        union[k] = mine + theirs - common[k]
    certain = whole[left][:, None] & whole[None, :]
    share = common * 100 / np.maximum(union, 1)
    sized = np.minimum(sizes[left][:, None], sizes) * 100 >= np.maximum(sizes[left][:, None], sizes) * percent
    passed = sized & np.where(certain, common * 100 >= percent * union,
                              share >= percent - 100 * margin(WIDE_SKETCH, percent / 100))
    for r in roots:
        parent.setdefault(r, r)

    def find(r: bytes) -> bytes:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    out = []
    rows, columns = np.nonzero(passed)
    for k in np.lexsort((-share[rows, columns], ~certain[rows, columns])):
        i, j = int(left[rows[k]]), int(columns[k])
        sure = bool(certain[rows[k], columns[k]])
        if i == j or (minor[j] and not self_too and minor[i] == minor[j]):
            continue
        one, two = find(roots[i]), find(roots[j])
        if one != two:
            out.append((i, j, sure))
            if sure:
                parent[max(one, two)] = min(one, two)
    return out


def _second_round(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, certain`` from lists (``key, cls, root``) with more than one component.

    The classes outside a list's largest component fall into blocks. A task holds one block and lets pass by the classes of
    the largest component, in streams if there are very many, and those of the later blocks; so a class outside is copied
    once for each earlier block, and one inside once for each block."""
    spread = lists.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    parts = lists.join(spread, "key").groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = parts.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("all"))
    largest = largest.select("key", F.col("top.root").alias("major_root"),
                             F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("blocks"),
                             F.ceil(F.col("top.m") / STREAM).cast("int").alias("streams"))
    rows = lists.join(largest, "key").withColumn("minor", F.col("root") != F.col("major_root"))
    code = F.xxhash64("cls")
    rows = rows.withColumns({"block": F.pmod(code, F.col("blocks").cast("long")).cast("int"),
                             "stream": F.pmod(code, F.col("streams").cast("long")).cast("int")})

    def spot(i, s, own: bool) -> Column:
        return F.struct(i.alias("i"), s.alias("s"), F.lit(own).alias("own"))

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    held = F.transform(F.sequence(F.lit(0), F.col("streams") - 1), lambda s: spot(F.col("block"), s, True))
    passing = F.transform(F.filter(every, lambda i: i < F.col("block")), lambda i: spot(i, F.lit(0), False))
    placed = rows.withColumn("at", F.explode(F.when(F.col("minor"), F.concat(held, passing)).otherwise(
        F.transform(every, lambda i: spot(i, F.col("stream"), False)))))
    placed = placed.select("cls", "root", F.xxhash64("key", "at.i", "at.s").alias("grp"), "key", "at.i", "at.s", "at.own")
    wide = sets.select("cls", F.col("n").alias("size"), F.substring("full", 1, 8 * WIDE_SKETCH).alias("sketch"))
    placed = placed.join(wide, "cls")
    cut = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(cut * 2, "grp").sortWithinPartitions("grp", "key", "i", "s", F.desc("own"))

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("key", "i", "s", "own", "cls", "root", "size", "sketch")])

    def compared(group: list[tuple], own: int, parent: dict) -> list[tuple[bytes, bytes, bool]]:
        minor = np.arange(len(group)) < own
        pairs = _compare_group([r[5] for r in group], minor, own == len(group), [np.frombuffer(r[7], "<u8") for r in group],
                               np.array([r[6] for r in group]), percent, parent)
        return [(group[x][4], group[y][4], sure) for x, y, sure in pairs]

    most = BLOCK

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, bytes, bool]] = []
        for (_, _, s), group in groupby(rows_of(batches), lambda r: r[:3]):
            own, others, parent = [], [], {}
            for r in group:
                (own if r[3] else others).append(r)
                if len(others) == most:
                    found += compared(own + others, len(own), parent) if own else []
                    others = []
            if own and others:
                found += compared(own + others, len(own), parent)
            if len(own) > 1 and s == 0:
                found += compared(own, len(own), parent)
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return placed.mapInArrow(run, "a binary, b binary, certain boolean").groupBy("a", "b").agg(
        F.bool_or("certain").alias("certain"))


def _pairs(found: list[tuple[bytes, bytes, bool]]) -> pa.RecordBatch:
    a, b, sure = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sure, pa.bool_())],
                                      names=["a", "b", "certain"])


def text_digest(text) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the distinct runs of ``words`` words, or the
    whole text's words as one run if there are fewer. Null, empty and wordless texts have no set and link with nothing.
    Documents link if 100 x intersection >= ``percent`` x union; ``component_id`` is the smallest doc_id reachable and
    ``kept`` marks it. Rows that repeat an id get the same answer; null ids are never the smallest. An empty table gives
    an empty one; other columns are not read.
    """
    placed = _placed(docs, words, percent)
    least = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("low"))
    component = F.coalesce("low", "doc_id")
    return placed.join(least, "root", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_digest, linked, copies``: of each group of near-duplicates the smallest doc_id (null last) with, of its
    texts in the group, the one of smallest digest; ``copies`` counts the rows that have both. Texts without a set link with
    nothing and are all there, not ``linked``."""
    placed = _placed(docs, words, percent)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "m")).alias("low")
    of_key = placed.filter("root IS NOT NULL").groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("m"))
    first = of_key.groupBy("root").agg(low).select("low.doc_id", "low.text_hash", F.lit(True).alias("linked"), "low.m")
    alone = placed.filter("root IS NULL").groupBy("doc_id", "text_hash").agg(
        F.lit(False).alias("linked"), F.count(F.lit(1)).alias("m"))
    return first.union(alone.select(first.columns)).toDF("doc_id", "text_digest", "linked", "copies")


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest doc_id (null last), and of several texts or rows of
    that id in the group a single one. Texts without words are in no group, and all stay."""
    kept = staged(representatives(docs, words, percent), "near-kept").select(
        F.col("doc_id").alias("_id"), F.col("text_digest").alias("_digest"), "linked", "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_digest(docs.text) == F.col("_digest"))
    out = docs.join(kept.filter("NOT linked OR copies = 1"), same, "left_semi")
    repeated = kept.filter("linked AND copies > 1")
    several = repeated.count()
    if several:
        # Rows that repeat an id and its text may differ elsewhere; the choice does not depend on their order.
        rows = docs.join(F.broadcast(repeated) if several <= BROADCAST_ROWS else repeated, same, "left_semi")
        one = rows.groupBy(F.col("doc_id").alias("_id"), text_digest(rows.text).alias("_digest")).agg(
            F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
        out = out.union(one.select("_row.*"))
    return out


def _placed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, root`` for every row; rows of one root are near-duplicates."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie between 80 and 100")
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", text_digest(F.col("text")).alias("text_hash"), "text")
    rows = staged(_sketched(texts, words), "near-sketches")

    classes = rows.filter(F.size("keys") > 0).select("cls", "keys").dropDuplicates(["cls"])
    postings = classes.select("cls", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    postings = staged(postings.join(shared, "key"), "near-postings")

    weight = postings.groupBy("cls").agg(F.sum("m").alias("w"))
    centre = (postings.join(weight, "cls").groupBy("key").agg(F.max(F.struct("w", "cls")).alias("top"))
              .select("key", F.col("top.cls").alias("b")))
    spokes = staged(postings.join(centre, "key").filter("cls <> b").select(F.col("cls").alias("a"), "b").distinct(),
                    "near-spokes")

    wanted = (rows.join(postings.select("cls").distinct(), "cls").groupBy("cls")
              .agg(F.min(F.struct("text_hash", "doc_id")).alias("one")))
    wanted = staged(wanted.select(F.col("one.text_hash").alias("h"), F.col("one.doc_id").alias("d")), "near-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    chosen = texts.join(wanted, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    sets = staged(_full_sets(chosen, words).dropDuplicates(["cls"]), "near-sets")

    first = staged(_confirmed(spokes, sets, percent), "near-links")
    labels = components(first)
    wide = postings.join(centre, "key").select(
        F.xxhash64("b", F.shiftrightunsigned("key", 32)).alias("key"), "cls").distinct()
    same = wide.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.shiftright(F.xxhash64("cls", F.lit(i)), 24))
                                                                  .alias(f"sum{i}") for i in range(2)])
    one = same.groupBy("m", "sum0", "sum1").agg(F.min("key").alias("key")).select("key")
    lists = wide.join(one, "key").join(labels, F.col("cls") == F.col("node"), "left").select(
        "key", "cls", F.coalesce("root", "cls").alias("root"))
    second = staged(_second_round(lists, sets, percent), "near-second")
    doubtful = _confirmed(second.filter("NOT certain").select("a", "b"), sets, percent)
    links = first.union(second.filter("certain").select("a", "b")).union(doubtful)
    labels = components(links)

    return rows.join(labels, rows.cls == labels.node, "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("root", "cls").alias("root"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y USING (shingle)
      WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * both_ >= 80 * (na.n + nb.n - both_)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents
      UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.low AS component_id, d.doc_id = c.low AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node, min(reached) AS low FROM r GROUP BY node) c ON c.node = d.doc_id"""
