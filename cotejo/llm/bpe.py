"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming UTF-8 decoder.

Merging by rank has the prefix property: the encoding of a text cut behind any of its tokens is the encoding of that
part, and a token row is an encoding exactly when each two neighbours stay apart when merged on their own. So the last
token of every prefix is unique, and an automaton can read a piece byte by byte: its state is the last token written and
the bytes read since. A position is alive while some longer token could still start there; once all alive positions share
a boundary, the tokens before it are written. Lookahead is bounded by the longest token behind the alive positions.

States and transitions are made when first met and kept in an open-addressing table, so all pieces of a batch advance
together, one byte per step, with array operations.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cotejo.llm.textops import slices, small_batches, text_bytes, word_hashes

#: Transitions kept before the automaton starts afresh; one slice adds at most one per byte.
TRANSITIONS = 300_000
#: Distinct pieces whose ids are remembered before the memory is emptied.
PIECES = 500_000
ENCODE_SLICE = 2 << 20
#: Ids that the streaming decoder takes at a time.
DECODE_CHUNK = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes pieces (matches of the splitting pattern) by merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.none = max(self.bytes_of) + 1
        self.fits: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self.merge(token, until=2)
                if len(parts) != 2 or parts[0] + parts[1] != token or self.merge(token) != [token]:
                    raise ValueError(f"token {token!r} is not reached by merging")
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
        self.reset()

    def merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Plain merging by rank down to ``until`` parts; used on single tokens only."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        none = self.none
        while len(parts) > until:
            found = [self.ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives these two tokens again.

        Merges are undone from the latest to the earliest. The parts that meet at the boundary meet until the next
        merge of one of them; a pair of lower rank than that would have joined first, and of equal pairs the left one.
        """
        key = (left, right)
        if key not in self.fits:
            if len(self.fits) > TRANSITIONS:
                self.fits.clear()
            apart, limit = True, None
            while True:
                joint = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
                if joint is not None and (limit is None or joint < limit):
                    apart = False
                    break
                born = left if left in self.halves else -1, right if right in self.halves else -1
                if born == (-1, -1):
                    break
                if born[0] > born[1]:
                    limit, left = left, self.halves[left][1]
                else:
                    limit, right = right + 1, self.halves[right][0]
            self.fits[key] = apart
        return self.fits[key]

    def reset(self) -> None:
        """Forget all states but the first."""
        self.state_of: dict[tuple[int, bytes], int] = {}
        self.states: list[tuple] = []
        self.output_of: dict[tuple[int, ...], int] = {(): 0}
        self.outputs: list[tuple[int, ...]] = [()]
        self.final: list[int] = []
        self.slots = 1 << 16
        self.keys = np.full(self.slots, -1, np.int64)
        self.goes = np.zeros(self.slots, np.int32)
        self.says = np.zeros(self.slots, np.int32)
        self.n = 0
        self._state(-1, b"", {}, (0,))

    def _output(self, tokens: tuple[int, ...]) -> int:
        if tokens not in self.output_of:
            self.output_of[tokens] = len(self.outputs)
            self.outputs.append(tokens)
        return self.output_of[tokens]

    def _state(self, before: int, pending: bytes, last: dict, alive: tuple) -> int:
        key = (before, pending)
        if key not in self.state_of:
            self.state_of[key] = len(self.states)
            self.states.append((before, pending, last, alive))
            self.final.append(self._output(self._chain(last, len(pending), 0)))
        return self.state_of[key]

    @staticmethod
    def _chain(last: dict, end: int, stop: int) -> tuple[int, ...]:
        tokens = []
        while end > stop:
            end, token = last[end]
            tokens.append(token)
        return tuple(reversed(tokens))

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and output of one transition, found once."""
        before, pending, last, alive = self.states[state]
        text = pending + bytes([byte])
        end = len(text)
        last = dict(last)
        for j in alive:
            token = self.ranks.get(text[j:])
            if token is not None:
                previous = last[j][1] if j else before
                if previous < 0 or self.stay_apart(previous, token):
                    last[end] = (j, token)
                    break
        alive = tuple(j for j in alive if text[j:] in self.prefixes) + (end,)
        shared = None
        for j in alive:
            path = {j}
            while j:
                j = last[j][0]
                path.add(j)
            shared = path if shared is None else shared & path
        cut = max(shared)
        says = self._output(self._chain(last, cut, 0))
        if cut:
            before = last[cut][1]
        kept = {}
        for j in alive:
            while j > cut:
                kept[j - cut] = (last[j][0] - cut, last[j][1])
                j = last[j][0]
        if cut not in alive:  # no token can start at the boundary any more, so the one before it no longer matters
            before = -1
        return self._state(before, text[cut:], kept, tuple(j - cut for j in alive)), says

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or of the free place where it would go."""
        mask = self.slots - 1
        at = ((keys * np.int64(-7046029254386353131)) >> np.int64(20)) & mask
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return at

    def _add(self, keys: np.ndarray, goes: np.ndarray, says: np.ndarray) -> None:
        """Store new transitions; their keys are distinct."""
        while (self.n + len(keys)) * 2 >= self.slots:
            full = np.flatnonzero(self.keys >= 0)
            old = self.keys[full], self.goes[full], self.says[full]
            self.slots *= 2
            self.keys = np.full(self.slots, -1, np.int64)
            self.goes, self.says = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
            self._place(*old)
        self._place(keys, goes, says)
        self.n += len(keys)

    def _place(self, keys: np.ndarray, goes: np.ndarray, says: np.ndarray) -> None:
        while len(keys):
            at = self._find(keys)
            _, one = np.unique(at, return_index=True)
            self.keys[at[one]], self.goes[at[one]], self.says[at[one]] = keys[one], goes[one], says[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, goes, says = keys[rest], goes[rest], says[rest]

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces in order, and the number of tokens of each piece."""
        if self.n > TRANSITIONS:
            self.reset()
        lanes = len(starts)
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        state = np.zeros(lanes, np.int64)
        who: list[np.ndarray] = []
        said: list[np.ndarray] = []
        active = lanes
        for k in range(int(size[0]) if lanes else 0):
            active = int(np.searchsorted(-size[:active], -k, "left"))
            keys = state[:active] * 256 + data[at[:active] + k]
            slot = self._find(keys)
            new = np.unique(keys[self.keys[slot] != keys])
            if len(new):
                made = np.array([self._step(key >> 8, key & 255) for key in new.tolist()], np.int32)
                self._add(new, made[:, 0], made[:, 1])
                slot = self._find(keys)
            state[:active] = self.goes[slot]
            says = self.says[slot]
            loud = np.flatnonzero(says)
            if len(loud):
                who.append(loud)
                said.append(says[loud])
        says = np.array(self.final, np.int32)[state]
        loud = np.flatnonzero(says)
        who.append(loud)
        said.append(says[loud])
        lane = order[np.concatenate(who)]
        out = np.concatenate(said)[np.argsort(lane, kind="stable")]
        lane = np.sort(lane, kind="stable")
        sizes = np.array([len(t) for t in self.outputs], np.int64)
        flat = np.array([i for t in self.outputs for i in t] or [0], np.uint32)
        first = np.cumsum(sizes) - sizes
        n = sizes[out]
        where = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first[out], n)
        return flat[where], np.bincount(lane, n, lanes).astype(np.int64)


class Splitter:
    """Cuts texts into the matches of the public splitting pattern with array operations on code points.

    ``pattern`` must be the one this class knows; the classes of letters, digits and white space come from ``regex``.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3

    def __init__(self, pattern: str):
        if pattern != self.PATTERN:
            raise ValueError("unknown splitting pattern")
        self.kind = np.full(0x110000, self.OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for code, what in ((self.LETTER, r"\p{L}+"), (self.DIGIT, r"\p{N}+"), (self.SPACE, r"\s+")):
            for m in regex.finditer(what, every):
                low, high = ord(every[m.start()]), ord(every[m.end() - 1])
                self.kind[low:high + 1] = code

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts of all pieces, none across rows, and the piece count of each row."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(rows, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        n = len(points)
        row_start = np.zeros(n + 1, bool)
        row_start[np.searchsorted(lead, offsets)] = True
        first = row_start[:n].copy()
        first[1:] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(first)
        run_kind = kind[runs]
        run_end = np.append(runs[1:], n)
        begins = first
        # A white-space run before other text leaves its last character to what follows, alone or joined.
        open_ended = (run_kind == self.SPACE) & ~row_start[run_end]
        tails = run_end[open_ended] - 1
        begins[tails] = True
        joined = tails[points[tails] == 0x20]
        begins[joined + 1] = False
        # An apostrophe on its own that begins a piece takes a contraction with it.
        marks = runs[(run_kind == self.OTHER) & (run_end - runs == 1)]
        marks = marks[begins[marks] & (points[marks] == 0x27)]
        padded = np.append(points, np.zeros(2, np.uint32))
        stops = np.append(row_start, [True, True])
        one, two = padded[marks + 1], padded[marks + 2]
        there = ~stops[marks + 1]
        short = there & np.isin(one, [ord(c) for c in "stmd"])
        long = there & ~stops[marks + 2] & (
            ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
            | ((one == ord("l")) & (two == ord("l"))))
        for taken, size in ((marks[short], 2), (marks[long], 3)):
            begins[taken + 1] = False
            after = taken + size
            begins[after[after < n]] = True
        starts = np.flatnonzero(begins)
        counts = np.diff(np.searchsorted(starts, np.searchsorted(lead, offsets)))
        return lead[starts].astype(np.int64), counts


class Utf8Stream:
    """Incremental UTF-8 decoder: ``feed`` returns the text that is complete, ``close`` what is left.

    The state is the start of an unfinished character: how many bytes it still needs and in which range the next must
    lie. Invalid bytes become U+FFFD, one for each maximal part of a character.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _need(held: bytes) -> int:
        """Bytes still missing for the character begun by ``held``; 0 if it can't be continued."""
        b = held[0]
        size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if not size:
            return 0
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
        for k, c in enumerate(held[1:]):
            if not (low if k == 0 else 0x80) <= c <= (high if k == 0 else 0xBF):
                return 0
        return max(0, size - len(held))

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for k in (1, 2, 3):
            if k <= len(data) and data[-k] >= 0xC0:
                keep = k if self._need(data[-k:]) else 0
                break
        self.held = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


class Vocabulary:
    """Bytes of every token, for decoding whole id arrays by gathers."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        self.size = np.zeros(top, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.first = np.cumsum(self.size) - self.size
        flat = bytearray(int(self.size.sum()))
        for token, i in ranks.items():
            flat[self.first[i]:self.first[i] + len(token)] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """Raises IndexError for an id beyond the vocabulary."""
        n = self.size[ids]
        where = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.first[ids], n)
        return self.flat[where].tobytes()

    def decode_stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of a stream of id arrays; a character split between two arrays comes with the later one."""
        stream = Utf8Stream()
        for ids in chunks:
            yield stream.feed(self.decode(np.asarray(ids)))
        yield stream.close()


    def read_back(self, ids: np.ndarray, chunk: int = DECODE_CHUNK) -> bytes:
        """The bytes of a text's ids, through the streaming decoder."""
        return "".join(self.decode_stream(ids[i:i + chunk] for i in range(0, len(ids), chunk))).encode()


class Codec:
    """Encoder and decoder for one rank file; one for the tasks that a Python worker runs at a time."""

    _made: dict[tuple[str, str], "Codec"] = {}

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.transducer = Transducer(ranks)
        self.splitter = Splitter(pattern)
        self.vocabulary = Vocabulary(ranks)
        self.forget()

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    @classmethod
    def release(cls) -> None:
        """Give up the codecs and what Arrow holds in reserve; a worker lives on after its task, and with it what it holds."""
        cls._made.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and the bounds of each row's ids. Pieces met before come from a bounded memory;
        the others, each once, go through the transducer."""
        starts, counts = self.splitter.pieces(data, offsets)
        lengths = np.diff(np.append(starts, len(data)))
        seen, spot, which = np.unique(
            word_hashes(data, starts, starts + lengths, lower=False), return_index=True, return_inverse=True)
        if len(self.known) > PIECES:
            self.forget()
        at = np.searchsorted(self.known, seen)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != seen if len(self.known) else seen == seen)
        if len(new):
            ids, each = self.transducer.encode(data, starts[spot[new]], lengths[spot[new]])
            self.place = np.insert(self.place, at[new], np.arange(len(new)) + len(self.size))
            self.known = np.insert(self.known, at[new], seen[new])
            self.first = np.append(self.first, np.cumsum(each) - each + len(self.flat))
            self.size = np.append(self.size, each)
            self.flat = np.append(self.flat, ids)
            at = np.searchsorted(self.known, seen)
        row = self.place[at][which]
        n = self.size[row]
        ends = np.cumsum(n)
        where = np.arange(int(n.sum())) - np.repeat(ends - n - self.first[row], n)
        return self.flat[where], np.append(0, ends)[np.append(0, np.cumsum(counts))]


def encode_texts(df: DataFrame, ranks_path: str, pattern: str = Splitter.PATTERN, column: str = "text",
                 key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """Encode a text column: the key, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit), ``ids_sha256``,
    ``decoded_sha256`` (of the bytes the ids decode to) and ``round_trip`` (they decode to the text again).

    Null and empty texts have no tokens. Rows, repeated ones too, stay as they are; other columns are not read. An
    empty table gives an empty one. ``keep_ids=False`` leaves ``ids`` out.
    """
    small_batches(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()
    fields = f"{key} {key_type}, n_tokens bigint" + ", ids binary" * keep_ids
    fields += ", ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        try:
            for batch in batches:
                for part in slices(batch, "text", ENCODE_SLICE):
                    data, offsets = text_bytes(part.column("text"))
                    ids, bounds = codec.encode(data, offsets)
                    rows = [ids[bounds[i]:bounds[i + 1]] for i in range(len(bounds) - 1)]
                    packed = [r.astype("<u4").tobytes() for r in rows]
                    decoded = [codec.vocabulary.read_back(r) for r in rows]
                    whole = [d == data[offsets[i]:offsets[i + 1]].tobytes() for i, d in enumerate(decoded)]
                    columns = [part.column("key"), pa.array(np.diff(bounds), pa.int64())]
                    columns += [pa.array(packed, pa.binary())] * keep_ids
                    columns += [pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                                pa.array([hashlib.sha256(d).hexdigest() for d in decoded]), pa.array(whole)]
                    names = [key, "n_tokens"] + ["ids"] * keep_ids + ["ids_sha256", "decoded_sha256", "round_trip"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            del codec
            Codec.release()

    return df.selectExpr(f"`{key}` AS key", f"`{column}` AS text").mapInArrow(run, fields)


def decode_ids(df: DataFrame, ranks_path: str, ids: str = "ids", key: str = "doc_id", chunk: int = DECODE_CHUNK) -> DataFrame:
    """Decode packed ids (as :func:`encode_texts` gives them) to ``text`` through the streaming decoder, ``chunk`` ids
    at a time. Null ids give null; bytes that are not UTF-8 become U+FFFD."""
    small_batches(df.sparkSession)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(load_ranks(ranks_path))
        for batch in batches:
            texts = []
            for packed in batch.column("ids").to_pylist():
                if packed is None:
                    texts.append(None)
                    continue
                row = np.frombuffer(packed, "<u4")
                texts.append("".join(vocabulary.decode_stream(row[i:i + chunk] for i in range(0, len(row), chunk))))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=[key, "text"])

    return df.selectExpr(f"`{key}` AS key", f"`{ids}` AS ids").mapInArrow(run, f"{key} {key_type}, text string")
