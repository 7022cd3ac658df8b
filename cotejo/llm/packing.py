"""Packing documents into training sequences along a space-filling curve.

A document becomes a hashed vector (square roots of token counts in ``BUCKETS`` signed buckets, scaled to length one), a fixed
random projection takes it to ``DIMS`` dimensions, and the cell it falls into, in units of each dimension's mean and
deviation over all documents, gives its Hilbert key (Skilling 2004). Documents sorted by range of that key are laid end to end
and cut into sequences, so a sequence holds neighbours. Positions come from running sums within a range and the totals of the
ranges before it. What is left after the last whole sequence is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cotejo.llm.textops import LOWER, slices, small_batches, span_array, text_bytes, word_spans
from cotejo.plans.staging import staged

LENGTH = 2048
END_ID = 1
BUCKETS = 512
DIMS = 4
BITS = 10
#: Pieces whose token ids a task remembers, at most, and the length of the longest that it remembers.
KNOWN = 500_000
KNOWN_CHARS = 32
#: Bytes of text encoded at a time.
SLICE = 4 << 20

#: White space that no token of the word vocabulary spans, so a text can be cut there.
BREAKS = np.zeros(256, bool)
BREAKS[[0x20, 0x09, 0x0A, 0x0D]] = True
#: What the library itself has to take apart: control characters, the apostrophe of contractions, all beyond ASCII. The letters
#: U+00C0 to U+00FF, C3 and another byte, are spared below; without a mark behind them they are composed already.
ODD = np.zeros(256, bool)
ODD[[*range(0x00, 0x20), 0x27, *range(0x7F, 0x100)]] = True
ODD[BREAKS] = False
#: Letters, other marks, digits; a digit is a piece of its own.
KIND = np.zeros(256, np.int8)
KIND[[*range(0x30, 0x3A)]] = 2
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
#: The way of taking texts apart that the pieces follow.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Merger:
    """Merges the characters of many plain pieces at once, in rounds: in each, every piece merges its pair of lowest rank. A
    merge makes pairs of higher rank only, so this is the order in which the pairs of one piece would be merged."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        # Byte-level vocabularies write a byte as the character of its number, or in turn from 256 on if that is not visible.
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        chars = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*seen}))}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = len(vocabulary)
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.inner, self.last = (np.array([vocabulary[chars[b] + tail] for b in range(256)], np.int32) for tail in ("", end))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        chars = np.frombuffer(b"".join(pieces), np.uint8)
        symbols, ends = self.inner[chars], np.cumsum(sizes)
        symbols[ends - 1] = self.last[chars[ends - 1]]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(symbols), self.NONE, np.int32)
        inside = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        done = []
        while len(symbols):
            opens = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, opens), np.diff(np.append(opens, len(piece))))
            over = lowest == self.NONE
            if over.any():
                done.append((piece[over], symbols[over]))
                symbols, piece, rank, lowest = symbols[~over], piece[~over], rank[~over], lowest[~over]
                if not len(symbols):
                    break
            hit = rank == lowest
            # Of overlapping pairs, as in a run of one letter, every other one is merged.
            twice = np.flatnonzero(hit[1:] & hit[:-1])
            for i in twice.tolist():
                if hit[i] and hit[i + 1] and piece[i] == piece[i + 1]:
                    hit[i + 1] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            rank[at] = self.NONE
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, piece, rank, at = symbols[keep], piece[keep], rank[keep], place[at]
            left = np.concatenate((at[at > 0] - 1, at[at + 1 < len(symbols)]))
            same = piece[left] == piece[left + 1]
            rank[left[~same]] = self.NONE
            left = left[same]
            rank[left] = self._rank(symbols[left], symbols[left + 1])
        piece, symbols = (np.concatenate(x) for x in zip(*done)) if done else (piece, symbols)
        order = np.argsort(piece, kind="stable")
        return symbols[order], np.bincount(piece, minlength=len(pieces))


@functools.lru_cache(maxsize=1)
def tokenizer(path: str):
    """The tokenizer, and the merges of a plain piece if it takes texts apart by ``PATTERN``."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    made = json.loads(whole.to_str())
    steps = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
    parts, model = (made["pre_tokenizer"] or {}).get("pretokenizers", []), made["model"]
    plain = (steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"]
             and parts[0]["pattern"] == {"Regex": PATTERN} and model["type"] == "BPE" and not model.get("ignore_merges"))
    return whole, Merger(model["vocab"], model["merges"], model["end_of_word_suffix"] or "") if plain else None


def vocabulary_size(path: str) -> int:
    return tokenizer(path)[0].get_vocab_size()


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends of what is encoded on its own, whether it has something odd, how many there are in each row, and the
    data with plain words in lower case. A word with an odd byte stays whole; others fall into letters, digits and marks."""
    starts, ends, counts = word_spans(data, offsets, BREAKS)
    if not len(starts):
        return starts, ends, np.zeros(0, bool), counts, data
    strange, kind, lower = ODD[data], KIND[data], LOWER[data]
    accented = np.flatnonzero(data == 0xC3)
    second = data[accented + 1]
    accented, second = (x[(second != 0x97) & (second != 0xB7)] for x in (accented, second))  # U+00D7 and U+00F7 are no letters
    for at in (accented, accented + 1):
        strange[at], kind[at] = False, 1
    lower[accented + 1] = np.where(second <= 0x9E, second | 0x20, second)
    strange = np.append(0, np.cumsum(strange, dtype=np.int32))
    odd = strange[ends] > strange[starts]
    opens = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=opens[1:])
    opens |= kind == 2
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    whole = np.zeros(len(data) + 1, np.int8)
    whole[starts[odd]] = 1
    whole[ends[odd]] -= 1
    whole = np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
    lower[whole] = data[whole]
    opens &= inside & ~whole
    opens[starts] = True
    first = np.flatnonzero(opens)
    # A piece ends where the next one of its word starts, or with the word.
    word = np.cumsum(np.isin(first, starts, assume_unique=True)) - 1
    stops = np.minimum(np.append(first[1:], len(data)), ends[word])
    return first, stops, odd[word], np.diff(np.searchsorted(first, offsets)), lower


class WordEncoder:
    """Token ids of texts: each distinct piece is encoded once, as long as a task remembers it."""

    def __init__(self, path: str):
        self.whole, self.merger = tokenizer(path)
        self.place: dict[bytes, int] = {}
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encode(self, pieces: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn and how many each has."""
        kinds = np.flatnonzero(plain), np.flatnonzero(~plain)
        flat, sizes = self.merger([pieces[i] for i in kinds[0].tolist()])
        odd = [pieces[i].decode() for i in kinds[1].tolist()]
        lists = [e.ids for low in range(0, len(odd), 10_000)
                 for e in self.whole.encode_batch_fast(odd[low:low + 10_000], add_special_tokens=False)]
        flat = np.append(flat, np.fromiter(itertools.chain.from_iterable(lists), np.int32))
        sizes = np.append(sizes, np.fromiter(map(len, lists), np.int64, len(lists)))
        order = np.argsort(np.concatenate(kinds), kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        total = np.append(0, np.cumsum(sizes))
        return flat[np.arange(total[-1]) + np.repeat(first - total[:-1], sizes)], sizes

    def _learn(self, pieces: list[bytes], plain: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Places of pieces in the store, after encoding those that are not in it."""
        if len(self.bounds) > KNOWN:
            self.__dict__.update(place={}, flat=np.zeros(0, np.int32), bounds=np.zeros(1, np.int64))
        place = np.fromiter(map(self.place.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            flat, sizes = self._encode([pieces[i] for i in missing.tolist()], plain[missing])
            place[missing] = len(self.bounds) - 1 + np.arange(len(missing))
            kept = missing[short[missing]]
            self.place.update(zip([pieces[i] for i in kept.tolist()], place[kept].tolist()))
            self.flat = np.append(self.flat, flat)
            self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(sizes))
        return place

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in turn, and the n + 1 bounds of the rows."""
        if self.merger is None:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
            lists = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return (np.array([x for ids in lists for x in ids], np.int32),
                    np.append(0, np.cumsum([len(ids) for ids in lists], dtype=np.int64)))
        starts, ends, odd, counts, lower = piece_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        distinct = span_array(lower, starts, ends).dictionary_encode()
        code = distinct.indices.to_numpy()
        # Codes are given in order of first occurrence.
        first = np.flatnonzero(np.append(True, code[1:] > np.maximum.accumulate(code)[:-1]))
        short = (ends - starts)[first] <= KNOWN_CHARS
        place = self._learn(distinct.dictionary.to_pylist(), short & ~odd[first], short)
        size = np.diff(self.bounds)[place][code]
        total = np.append(0, np.cumsum(size))
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.bounds[place][code] - total[:-1], size)]
        return ids, total[np.append(0, np.cumsum(counts))]


def hashed_vectors(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Projected vectors, one row per document; a document without tokens is the origin."""
    rng = np.random.default_rng(20_240_601)
    projection = rng.standard_normal((BUCKETS, DIMS))
    bucket = (np.arange(int(ids.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % BUCKETS
    out = np.zeros((len(bounds) - 1, DIMS))
    for low in range(0, len(out), 256):
        within = bounds[low:low + 257]
        rows = len(within) - 1
        at = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, np.diff(within))
        at += bucket[ids[within[0]:within[-1]]].astype(np.int64)
        counts = np.bincount(at, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
        # The squared length of the square roots is the number of tokens.
        out[low:low + rows] = np.sqrt(counts) @ projection / np.sqrt(np.maximum(np.diff(within), 1))[:, None]
    return out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (a row of ``dims`` coordinates below ``2**bits``) along the Hilbert curve."""
    x = [c.astype(np.int64) for c in cells.T]
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            inside = (x[i] >> level) & 1 == 1
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> level) & 1
    return key


def _tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """One stored row per document: an own number, the key, a digest of the text, its ids (2 bytes each if the vocabulary
    allows, else 4) and its vector."""
    small = max(vocabulary_size(path), end_id + 1) <= 1 << 16

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, bounds = encode(*text_bytes(part.column("text")))
                vectors = hashed_vectors(ids, bounds)
                packed = np.insert(ids, bounds[1:], end_id).astype("<u2" if small else "<u4")
                bounds = bounds + np.arange(len(bounds))
                raw = [packed[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("number"), part.column("doc_id"), part.column("digest"), pa.array(np.diff(bounds)),
                     pa.array(raw, pa.binary()), *(pa.array(v) for v in vectors.T)],
                    names=["number", "doc_id", "digest", "n", "ids", *(f"v{i}" for i in range(DIMS))])

    rows = docs.select(F.monotonically_increasing_id().alias("number"), "doc_id", "text",
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    axes = ", ".join(f"v{i} double" for i in range(DIMS))
    return staged(rows.mapInArrow(
        run, f"number bigint, doc_id {kind}, digest bigint, n bigint, ids binary, {axes}"), "pack-tokens")


def _keyed(tokens: DataFrame) -> DataFrame:
    """Adds the Hilbert key; cells span three deviations to each side of the mean, and what lies beyond is in the last."""
    axes = [f"v{i}" for i in range(DIMS)]
    spread = tokens.agg(*[F.avg(a) for a in axes], *[F.stddev_pop(a) for a in axes]).first()
    mean = np.array([m or 0.0 for m in spread[:DIMS]])
    unit = np.array([d if d else 1.0 for d in spread[DIMS:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.stack([batch.column(a).to_numpy() for a in axes], axis=1)
            place = ((vectors - mean) / unit + 3) / 6 * (1 << BITS)
            keys = hilbert_keys(np.clip(np.floor(place), 0, (1 << BITS) - 1).astype(np.int64), BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys)] + [batch.column(c) for c in ("doc_id", "digest", "number", "n")],
                names=["key", "doc_id", "digest", "number", "n"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "digest", "number", "n", *axes).mapInArrow(
        run, f"key bigint, doc_id {kind}, digest bigint, number bigint, n bigint")


def _placed(keyed: DataFrame) -> tuple[DataFrame, dict[int, int], int]:
    """Each document's range along the curve and the ids before it there, the ids before each range, and all ids."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("number"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), batch.column("n")],
                names=["number", "part", "before", "n"])
            before = int(ends[-1]) if len(n) else before

    order = ["key", "doc_id", "digest", "number"]
    placed = staged(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("number", "n").mapInArrow(
        run, "number bigint, part int, before bigint, n bigint"), "pack-places")
    # One row for each range of the sort.
    sums = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, total = {}, 0
    for part, n in sums:
        base[part] = total
        total += n
    return placed.drop("n"), base, total


def sequence_bounds(total: int, length: int) -> np.ndarray:
    """Starts of the sequences after the last whole one, and the end: the rest in falling powers of two."""
    rest = total % length
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return total - rest + np.append(0, np.cumsum(powers, dtype=np.int64)).astype(np.int64)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID,
                   keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (its place in that sequence) and, if asked, ``ids``.

    A document is its ids without special tokens, then ``end_id``; strings of special tokens are ordinary text. The
    tokenizer in ``path`` has to drop white space. Sequences have ``length`` ids but for the last few, which are powers of
    two. A null text is empty and gives ``end_id`` alone. Documents of equal key follow each other by doc_id (null first),
    then by digest of the text; rows that repeat both are interchangeable, and each is packed. Texts of any length are cut
    at word breaks for the tokenizer only. An empty table gives an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    tokens = _tokens(docs, path, end_id)
    placed, base, total = _placed(_keyed(tokens))
    tail = sequence_bounds(total, length)
    whole = total // length
    width = "<u2" if max(vocabulary_size(path), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = np.array([base[p] for p in batch.column("part").to_pylist()], np.int64)
            starts += batch.column("before").to_numpy()
            rows: list[list] = [[] for _ in range(8)]
            for i, (at, raw) in enumerate(zip(starts.tolist(), batch.column("ids"))):
                ids = np.frombuffer(raw.as_buffer(), width).astype("<u4")
                done = 0
                while done < len(ids):
                    here = at + done
                    sequence = here // length
                    low, high = sequence * length, (sequence + 1) * length
                    if sequence >= whole:
                        k = int(np.searchsorted(tail, here, "right")) - 1
                        sequence, low, high = whole + k, int(tail[k]), int(tail[k + 1])
                    piece = ids[done:done + high - here]
                    for column, value in zip(rows, (i, done, len(piece), zlib.crc32(piece.tobytes()), len(ids), sequence,
                                                    here - low, piece if keep_ids else None)):
                        column.append(value)
                    done += len(piece)
            out = [batch.column("doc_id").take(pa.array(rows[0], pa.int64()))]
            out += [pa.array(c, pa.int64()) for c in rows[1:7]]
            yield pa.RecordBatch.from_arrays(out + [pa.array(rows[7], pa.list_(pa.int64()))] * keep_ids, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = ", ".join(f"`{c}` {kind if c == 'doc_id' else 'array<bigint>' if c == 'ids' else 'bigint'}" for c in names)
    return tokens.select("number", "doc_id", "ids").join(placed, "number").mapInArrow(run, kinds)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the packed sequences themselves, from pieces with ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids", F.col("doc_id").alias("doc_id"))))
    return pieces.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
