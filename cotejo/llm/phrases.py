"""Phrase collocations from depth-truncated suffix subtrees, partitioned vertically by word prefixes (after ERA).

A suffix is a word and up to ``DEPTH - 1`` words behind it in its piece. As in an elastic range, the next words are read only
where a prefix can still count: behind words, then behind word pairs, that occur often enough. Both are looked up in bitmaps
over hash slots, whose false hits cost time only. Suffixes are counted in each task and stored; prefixes are grouped under a
budget of stored suffixes, one that exceeds it being extended by a word; each group's subtree is then built on its own by
sorting, and the totals of its leaves are the counts of its nodes.

A word is carried as a 63-bit hash of language and word. The table of all distinct words shows whether a counted word shares
its hash with another; if so, everything starts again with another seed, so results are exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cotejo.llm.textops import mix, slices, small_batches, span_array, text_bytes, word_hashes, word_spans
from cotejo.plans.staging import staged

DEPTH = 4
LEAST = 30
TOP = 2000
#: A candidate goes if a longer one around it occurs at least that often, in per cent.
COVERED = 80
#: Stored suffixes of one group, as many as one task sorts at a time.
GROUP_ROWS = 250_000
#: Bytes of text counted at a time, and counted entries a task holds before it hands them on.
SLICE = 4 << 20
HELD = 2_000_000
#: Rows of one Arrow batch that a task hands on.
OUT_ROWS = 65_536
#: Bitmaps have between 2**20 and 2**30 slots, about one for each word of the corpus.
SLOT_BITS = (20, 30)
BITMAP_BITS = 32_768

STOPS = np.zeros(256, bool)
STOPS[[*map(ord, ".,;:!?"), 0x0A, 0x0B, 0x0C, 0x0D]] = True
GAPS = STOPS.copy()
GAPS[[0x20, 0x09]] = True
KEYS = [f"w{i + 1}" for i in range(DEPTH)]


class Words:
    """The words of a slice of documents, in order: distinct (language, word) pairs and the code of each word's pair."""

    def __init__(self, part: pa.RecordBatch, seed: int):
        data, offsets = text_bytes(part.column("text"))
        starts, ends, counts = word_spans(data, offsets, GAPS)
        row = np.repeat(np.arange(len(counts)), counts)
        stops = np.append(0, np.cumsum(STOPS[data], dtype=np.int64))
        #: Whether the next word continues this one's piece.
        self.joined = (row[1:] == row[:-1]) & (stops[starts[1:]] == stops[ends[:-1]])
        coded = span_array(data, starts, ends, lower=True).dictionary_encode()
        langs = part.column("lang").cast(pa.large_string()).dictionary_encode()
        size = max(1, len(coded.dictionary))
        pair, self.code = np.unique(
            langs.indices.to_numpy().astype(np.int64)[row] * size + coded.indices.to_numpy(), return_inverse=True)
        self.words, self.langs = coded.dictionary.take(pa.array(pair % size)), langs.dictionary.take(pa.array(pair // size))
        salt = np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * seed + 1)
        inner, outer = _hashes(self.words), _hashes(self.langs)
        self.hash = mix(inner ^ mix(outer + salt)) | np.uint64(1)


def _hashes(values: pa.LargeBinaryArray) -> np.ndarray:
    data, offsets = text_bytes(values)
    out = np.zeros(len(values), np.uint64)
    some = offsets[1:] > offsets[:-1]
    out[some] = word_hashes(data, offsets[:-1][some], offsets[1:][some], lower=False)
    return out


def _gathered(batches: Iterable[pa.RecordBatch], seed: int, most: int) -> Iterator[Words]:
    """Words of as many rows at a time as hold about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", most):
            held.append(part)
            size += part.nbytes
            if size >= most:
                yield Words(pa.Table.from_batches(held).combine_chunks().to_batches()[0], seed)
                held, size = [], 0
    if held and sum(p.num_rows for p in held):
        yield Words(pa.Table.from_batches(held).combine_chunks().to_batches()[0], seed)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, OUT_ROWS):
        yield batch.slice(start, OUT_ROWS)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def pair_hashes(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(one * np.uint64(0xD6E8FEB86659FD93) + two)


def has(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def bitmap(rows: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """One bit for each of ``2**bits`` slots, set by ``rows``; at most ``2**(bits - 3)`` bytes come to the driver."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    parts = rows.groupBy(F.bitmap_bucket_number(slot + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits"))
    for r in parts.collect():
        start = (r.bucket - 1) * BITMAP_BITS // 8
        out[start:start + BITMAP_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _word_counts(texts: DataFrame, seed: int) -> DataFrame:
    most = SLICE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _gathered(batches, seed, most):
            yield from _cut(pa.RecordBatch.from_arrays(
                [w.langs, w.words.cast(pa.large_string()), pa.array(w.hash.view(np.int64)),
                 pa.array(np.bincount(w.code, minlength=len(w.hash)).astype(np.int64))], names=["lang", "word", "h", "n"]))

    counted = texts.mapInArrow(run, "lang string, word string, h bigint, n bigint")
    return staged(counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "phrase-words")


def _pair_slots(texts: DataFrame, seed: int, often: np.ndarray, bits: int, pair_bits: int) -> DataFrame:
    """Occurrences of word pairs, counted by hash slot."""
    most, entries = SLICE, HELD

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return _cut(pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["slot", "n"]))

        keys = counts = np.zeros(0, np.int64)
        for w in _gathered(batches, seed, most):
            good = has(often, slots(w.hash, bits))[w.code]
            both = np.flatnonzero(w.joined & good[1:] & good[:-1])
            found = slots(pair_hashes(w.hash[w.code[both]], w.hash[w.code[both + 1]]), pair_bits)
            keys, counts = _merged(np.append(keys, found), np.append(counts, np.ones(len(found), np.int64)))
            if len(keys) > entries:
                yield from out()
                keys = counts = np.zeros(0, np.int64)
        yield from out()

    return texts.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def _suffixes(texts: DataFrame, seed: int, often: np.ndarray, bits: int, pairs: np.ndarray, pair_bits: int) -> DataFrame:
    """Suffixes of two words and more, each read on as long as its last two words may occur often; 0 where it ends."""
    most = SLICE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _gathered(batches, seed, most):
            good = has(often, slots(w.hash, bits))[w.code]
            follows = np.append(w.joined & good[1:] & good[:-1], np.zeros(DEPTH, bool))
            at = np.flatnonzero(follows)
            follows[at] = has(pairs, slots(pair_hashes(w.hash[w.code[at]], w.hash[w.code[at + 1]]), pair_bits))
            at = np.flatnonzero(follows)
            columns, alive = [w.code[at] + 1], np.ones(len(at), bool)
            for k in range(1, DEPTH):
                alive = alive & follows[at + k - 1]
                columns.append(np.where(alive, w.code[np.minimum(at + k, len(w.code) - 1)] + 1, 0))
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            opens = np.ones(len(order), bool)
            opens[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            first = np.flatnonzero(opens)
            hashes = np.append(np.uint64(0), w.hash).view(np.int64)
            yield from _cut(pa.RecordBatch.from_arrays(
                [pa.array(hashes[c[first]]) for c in columns] + [pa.array(np.diff(np.append(first, len(order))))],
                names=[*KEYS, "n"]))

    return staged(texts.mapInArrow(run, ", ".join(f"{k} bigint" for k in KEYS) + ", n bigint"), "phrase-suffixes")


def _grouped(suffixes: DataFrame, budget: int) -> DataFrame:
    """Adds ``words``, the length of the prefix that a suffix is dealt by, and ``part``, that prefix's group.

    A prefix with more than ``budget`` stored suffixes is extended; there are at most total / budget of these. Suffixes that
    share a prefix of full depth are equal and are summed, so no prefix exceeds the budget.
    """
    total = suffixes.count()
    length, out, above = F.lit(1), suffixes, suffixes
    for k in range(1, DEPTH):
        prefix = KEYS[:k]
        above = staged(above.groupBy(*prefix).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > budget)
                       .select(*[F.col(c).alias(f"p{c}") for c in prefix], F.lit(1).alias(f"above{k}")), "phrase-prefixes")
        same = [F.col(c) == F.col(f"p{c}") for c in prefix]
        out = out.join(above, same, "left").drop(*[f"p{c}" for c in prefix])
        above = suffixes.join(above, same, "left_semi")
        length = length + F.coalesce(F.col(f"above{k}"), F.lit(0))
    out = out.withColumn("words", length).select(*KEYS, "n", "words")
    deep = out.filter(F.col("words") == DEPTH).groupBy(*KEYS, "words").agg(F.sum("n").alias("n"))
    out = out.filter(F.col("words") < DEPTH).unionByName(deep)
    prefix = F.xxhash64(*[F.when(F.col("words") > i, F.col(c)) for i, c in enumerate(KEYS)])
    return out.withColumn("part", F.pmod(prefix, F.lit(max(1, -(-2 * total // budget)))))


def subtree(columns: list[np.ndarray], n: np.ndarray, words: np.ndarray, least: int) -> list[list[np.ndarray]]:
    """Nodes of two words and more of the tree of these suffixes, with the totals of their leaves. A node below ``least`` is
    left out, unless it is shorter than the prefix its suffixes were dealt by, so that others may hold more of it."""
    order = np.lexsort(columns[::-1])
    columns, n, words = [c[order] for c in columns], n[order], words[order]
    opens = np.zeros(len(n), bool)
    opens[:1] = True
    nodes = []
    for depth, column in enumerate(columns, 1):
        opens[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(opens)
        if depth == 1 or not len(first):
            continue
        total = np.add.reduceat(n, first)
        keep = (column[first] != 0) & ((total >= least) | (words[first] > depth))
        first = first[keep]
        nodes.append([c[first] if i < depth else np.zeros(len(first), np.int64) for i, c in enumerate(columns)] + [total[keep]])
    return nodes


def _nodes(suffixes: DataFrame, least: int, budget: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in (*KEYS, "n", "words")]
        nodes = subtree(columns[:DEPTH], columns[DEPTH], columns[DEPTH + 1], least)
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*nodes)], names=[*KEYS, "n"])

    kinds = ", ".join(f"{k} bigint" for k in (*KEYS, "n"))
    found = _grouped(suffixes, budget).groupBy("part").applyInArrow(build, kinds)
    return staged(found.groupBy(*KEYS).agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrase-nodes")


def _padded(columns: list[Column]) -> Column:
    columns = [c.alias(k) for c, k in zip([*columns, *[F.lit(0).cast("long")] * DEPTH], KEYS)]
    return F.struct(*columns)


def _scored(nodes: DataFrame, often: DataFrame) -> DataFrame:
    """Candidates that no longer one covers, with ``a, l, r, score`` of their lowest-scoring cut."""
    keyed = nodes.select(_padded([F.col(k) for k in KEYS]).alias("phrase"), F.col("n").alias("a"))
    parts = keyed.union(often.select(_padded([F.col("h")]), "n"))
    length = sum((F.when(F.col(f"phrase.{k}") != 0, 1).otherwise(0) for k in KEYS), F.lit(0))

    def words(low: int, high: int) -> Column:
        return _padded([F.col(f"phrase.{k}") for k in KEYS[low:high]])

    inside = [F.when(length > high - low, F.when(length >= high, words(low, high)))
              for low in range(DEPTH) for high in range(low + 2, DEPTH + 1) if high - low < DEPTH]
    longer = (keyed.select(F.explode(F.array_compact(F.array(*inside))).alias("phrase"), F.col("a").alias("around"))
              .groupBy("phrase").agg(F.max("around").alias("around")))
    big = [F.col(c).cast("decimal(20,0)") for c in ("a", "around")]
    open_ = keyed.join(longer, "phrase", "left").filter(
        F.col("around").isNull() | (big[1] * F.lit(100) < big[0] * F.lit(COVERED))).drop("around")

    cuts = [F.when(length > k, F.struct(F.lit(k).alias("k"), words(0, k).alias("left"), words(k, DEPTH).alias("right")))
            for k in range(1, DEPTH)]
    cut = open_.select("phrase", "a", F.explode(F.array_compact(F.array(*cuts))).alias("cut")).select("phrase", "a", "cut.*")
    cut = (cut.join(parts.select(F.col("phrase").alias("left"), F.col("a").alias("l")), "left")
           .join(parts.select(F.col("phrase").alias("right"), F.col("a").alias("r")), "right"))
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    worst = cut.withColumn("score", score).groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    return worst.select("phrase.*", "a", "worst.l", "worst.r", "worst.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = GROUP_ROWS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases by score, then occurrences ``a`` (both
    falling), then the phrase's bytes.

    Pieces end at ``.,;:!?`` and line breaks, words at blanks and tabs; only A-Z are lower-cased. A null language is ``und``,
    a null or empty text has no words; repeated rows count as often as they occur. Words and texts of any length count whole.
    Tables without a phrase of ``least`` occurrences give an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL AND text <> ''")
    for seed in itertools.count():
        words = _word_counts(texts, seed)
        shared = words.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
        if shared.filter((F.col("m") > 1) & (F.col("n") >= least)).isEmpty():
            break
    often = staged(words.filter(F.col("n") >= least), "phrase-often")
    total = words.agg(F.sum("n")).first()[0] or 0
    pair_bits = min(max(total.bit_length(), SLOT_BITS[0]), SLOT_BITS[1])
    bits = max(pair_bits - 3, SLOT_BITS[0])
    known = bitmap(often, F.shiftrightunsigned("h", 64 - bits), bits)
    pairs = _pair_slots(texts, seed, known, bits, pair_bits).filter(F.col("n") >= least)
    nodes = _nodes(_suffixes(texts, seed, known, bits, bitmap(pairs, F.col("slot"), pair_bits), pair_bits), least, budget)

    spelled = often.select("lang", F.col("h").alias("w1"), F.col("word").alias("s1"))
    scored = _scored(nodes, often.select("h", "n")).join(spelled, "w1")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scored.withColumn("place", F.rank().over(order)).filter(F.col("place") <= top).drop("place")
    for i, k in enumerate(KEYS[1:], 2):
        best = best.join(often.select(F.col("h").alias(k), F.col("word").alias(f"s{i}")), k, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"s{i + 1}" for i in range(DEPTH)]))
    last = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return (best.withColumn("rank", last.cast("long")).filter(F.col("rank") <= top).join(sizes, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, {_LETTERS}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
suffixes AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
phrases AS (
  SELECT lang, words[i:i + k - 1] AS phrase, k, count(*) AS a
  FROM suffixes, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM phrases WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM phrases WHERE a >= {LEAST}),
inner_ AS (
  SELECT lang, phrase[i:i + m - 1] AS phrase, max(a) AS around
  FROM (SELECT lang, phrase, k, a, unnest([1, 2, 3]) AS i FROM often WHERE k > 2), (SELECT unnest([2, 3]) AS m)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
left_ AS (
  SELECT o.* FROM often o LEFT JOIN inner_ i ON i.lang = o.lang AND i.phrase = o.phrase
  WHERE o.k > 1 AND (i.around IS NULL OR 100::HUGEINT * i.around < {COVERED}::HUGEINT * o.a)),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM left_),
scored AS (
  SELECT u.lang, u.phrase, u.a, p.a AS l, q.a AS r, c, CAST((2000000::HUGEINT * u.a) // (p.a + q.a) AS BIGINT) AS score
  FROM cuts u JOIN often p ON p.lang = u.lang AND p.phrase = u.phrase[1:c]
              JOIN often q ON q.lang = u.lang AND q.phrase = u.phrase[c + 1:]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score FROM worst)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN sizes USING (lang) QUALIFY rank <= {TOP}"""
