"""Ranked lexical search: every document is scored for every item by dense blocked matrix products.

The distinct terms of the items are the vocabulary. One pass over the documents keeps each one's number of terms and its
occurrences of vocabulary terms; a second one turns them into whole-number impacts and multiplies tiles: the terms that a few
items name, times the impacts of these terms in a tile of documents, in float64. Terms are taken together only as long as
their largest possible sum stays below 2^53, so each product is exact; the products are added as 64-bit integers. Each tile
hands on an item's best documents and whatever ties with the last of them can still matter by its id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window as W, functions as F

from cotejo.llm.textops import slices, small_batches, span_array, text_bytes, word_spans
from cotejo.plans.staging import staged

TOP = 10
#: Bytes of item texts that are gathered and searched for at a time, on average.
BLOCK_BYTES = 2 << 20
#: Items of one product, and cells of a dense tile of document impacts.
ITEM_TILE = 8
CELLS = 2 << 20
#: Sums of whole numbers below this are exact in float64.
EXACT = 2**53

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All terms of a batch of texts in order, and how many each row has."""
    starts, ends, counts = word_spans(data, offsets, SEPARATORS)
    return span_array(data, starts, ends, lower=True), counts


class ItemBlock:
    """Items held by one pass: their vocabulary and, in tiles, how often each item names each term."""

    def __init__(self, items: list[Row]):
        raw = [r.text.encode() for r in items]
        offsets = np.cumsum([0] + [len(r) for r in raw]).astype(np.int64)
        found, counts = terms(np.frombuffer(b"".join(raw), np.uint8), offsets)
        coded = found.dictionary_encode()
        self.ids, self.vocabulary = [r.item_id for r in items], coded.dictionary
        code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(items)), counts)
        self.tiles = []
        for low in range(0, len(items), ITEM_TILE):
            mine = (row >= low) & (row < low + ITEM_TILE)
            columns, at = np.unique(code[mine], return_inverse=True)
            named = np.zeros((min(ITEM_TILE, len(items) - low), len(columns)))
            np.add.at(named, (row[mine] - low, at), 1)
            if len(columns):
                self.tiles.append((low, columns, named))


def _occurrences(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Every document with a term: ``doc_id, n`` (all its terms) and the codes and numbers of its vocabulary terms."""
    size = max(1, len(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, counts = terms(*text_bytes(part.column("text")))
                code = pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(counts)), counts)
                pair, tf = np.unique((row * size + code)[code >= 0], return_counts=True)
                bounds = np.searchsorted(pair, np.arange(len(counts) + 1) * size)
                codes, tf = (pair % size).astype("<i4"), tf.astype("<i8")
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(some)), pa.array(counts[some].astype(np.int64))]
                    + [pa.array([x[bounds[i]:bounds[i + 1]].tobytes() for i in some], pa.binary()) for x in (codes, tf)],
                    names=["doc_id", "n", "codes", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n bigint, codes binary, tf binary"), "search-terms")


def _frequencies(held: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each vocabulary term, summed in each task first. One row per term comes back."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, _ = text_bytes(batch.column("codes"))
            total += np.bincount(data.copy().view("<i4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["code", "n"])

    out = np.zeros(size, np.int64)
    for r in held.select("codes").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out


def weights(documents: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What one naming of a term adds to a document's score."""
    m = 25 + (75 * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def exact_product(named: np.ndarray, dense: np.ndarray, exact: int = EXACT) -> np.ndarray:
    """``named @ dense`` of whole numbers in 64-bit integers, by float64 products of as many terms as stay below ``exact``."""
    out = np.zeros((named.shape[0], dense.shape[1]), np.int64)
    most = [int(a) * int(b) for a, b in zip(named.max(axis=0), dense.max(axis=1))]
    start, held = 0, 0
    for i, bound in enumerate([*most, exact]):
        if held + bound >= exact and i > start:
            out += (named[:, start:i] @ dense[start:i]).astype(np.int64)
            start, held = i, 0
        if bound >= exact and i < len(most):
            out += named[:, i, None].astype(np.int64) * dense[i].astype(np.int64)
            start, held = i + 1, 0
        else:
            held += bound
    return out


class Best:
    """The best ``top`` documents of each item so far, ties by id (null last)."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def offer(self, low: int, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """Scores of the items from ``low`` on (rows) in a tile of documents (columns)."""
        at, column = np.nonzero(scores >= self.least[low:low + len(scores), None])
        if not len(at):
            return
        item = np.append(self.item, at + low)
        score = np.append(self.score, scores[at, column])
        doc, none = np.append(self.doc, doc[column]), np.append(self.none, none[column])
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, last = order[place < self.top], order[place == self.top - 1]
        self.least[np.append(self.item, at + low)[last]] = score[last]
        self.item, self.score, self.doc, self.none = item[place < self.top], score[order], doc[order], none[order]


def _rank_block(held: DataFrame, block: ItemBlock, documents: int, length: int, top: int, kinds: dict) -> DataFrame:
    """Each task's best documents for each item of the block, then the best of all."""
    size = len(block.vocabulary)
    weight = weights(documents, _frequencies(held, size))
    rows = max(1, min(4096, CELLS // size))
    tiles, items = block.tiles, len(block.ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, top)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                (codes, bounds), (tf, _) = text_bytes(part.column("codes")), text_bytes(part.column("tf"))
                codes, tf = codes.copy().view("<i4"), tf.copy().view("<i8")
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds) // 4)
                n = part.column("n").to_numpy()
                dense = np.zeros((size, part.num_rows))
                dense[codes, row] = impacts(weight[codes], tf, n[row], documents, length)
                here = np.zeros(size, bool)
                here[codes] = True
                none = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                doc = pc.fill_null(part.column("doc_id"), 0).to_numpy()
                for low, columns, named in tiles:
                    met = here[columns]
                    if met.any():
                        best.offer(low, exact_product(named[:, met], dense[columns[met]]), doc, none)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item.astype(np.int32)), pa.array(best.doc, mask=best.none), pa.array(best.score)],
            names=["item", "doc_id", "score"])

    found = held.mapInArrow(run, "item int, doc_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    names = held.sparkSession.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kinds['item_id']}")
    return (found.withColumn("rank", rank).filter(F.col("rank") <= top).join(F.broadcast(names), "item")
            .select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of highest score above 0 for each item, equal scores by
    ascending doc_id (null last).

    ``docs``: ``doc_id`` (whole numbers), ``text``; ``items``: ``item_id``, ``text``. Texts that are null or have no term
    count and match nothing; a row of ``docs`` is a document even if it repeats another, and equal rows rank next to each
    other. Equal rows of ``items`` are one item; rows of one id with different texts are ranked each on its own. Empty
    tables give an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = {"item_id": items.schema["item_id"].dataType.simpleString()}
    items = items.select("item_id", "text").filter("text IS NOT NULL").distinct()
    weight = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-weight // block_bytes)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    out = spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id bigint, score bigint")
    for number in range(blocks):
        # A block's items come to the driver; its size is bounded by ``block_bytes``, a single longer item aside.
        block = ItemBlock(items.filter(place == number).orderBy("item_id", "text").collect())
        if not block.tiles:
            continue
        held = _occurrences(docs, block.vocabulary)
        documents, length = held.agg(F.count(F.lit(1)), F.sum("n")).first()
        if documents:
            out = out.union(staged(_rank_block(held, block, documents, length, top, kinds), "search-best"))
    return out


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
ORACLE_SQL = f"""
WITH doc_terms AS (
  SELECT row_no, doc_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), {_TERM})) AS term
  FROM (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents)),
item_terms AS (
  SELECT item_id, term, count(*) AS named
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {_LETTERS}), {_TERM})) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
sizes AS (SELECT row_no, doc_id, count(*) AS n FROM doc_terms GROUP BY ALL),
totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM sizes),
held AS (
  SELECT row_no, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY ALL), totals),
scored AS (
  SELECT i.item_id, s.row_no, s.doc_id,
         CAST(sum(i.named * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * s.n * documents) // length)))) AS BIGINT)
           AS score
  FROM held h JOIN weighed USING (term) JOIN item_terms i USING (term) JOIN sizes s ON s.row_no = h.row_no, totals
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
