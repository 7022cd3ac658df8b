"""Packing along the Hilbert curve: the curve itself, the tokens, and whole sequences against the public library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cotejo.llm import packing
from tests import oracle

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    out = Tokenizer.from_file(WORDS)
    out.encode_special_tokens = True
    return out


@pytest.mark.parametrize("bits, dims", [(1, 2), (4, 2), (3, 3), (2, 4)])
def test_curve_visits_every_cell_by_single_steps(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


ODD = st.text(st.sampled_from(list("abstABH1''\u0331\x1c\x7f'  \n\t\r\x0b\x0c\x85é́ΣςçÅİ漢ㄱ1٣!?lv  　_<|>\U0001F600")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD | st.text(max_size=30), min_size=1, max_size=5))
def test_ids_equal_the_library(reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, bounds = packing.WordEncoder(WORDS)(data, np.cumsum([0] + [len(r) for r in raw]).astype(np.int64))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == reference.encode(text, add_special_tokens=False).ids


def test_known_words_stay_bounded(reference, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 3)
    encode = packing.WordEncoder(WORDS)
    for text in ("one two three", "four two five six", "seven " * 9, "x" * 500 + " one"):
        raw = text.encode()
        ids, _ = encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids
        assert len(encode.place) <= 8


def whole(rows, texts, reference, length):
    """Checks pieces against the library: every id once, sequences gapless and unpadded."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = {k: reference.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for k, t in texts.items()}
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert all(r.doc_tokens == len(want[key]) for r in pieces)
        ends = [0] + [r.start + r.length for r in pieces]
        assert [r.start for r in pieces] == ends[:-1] and ends[-1] == len(want[key])
        for r in pieces:
            assert r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(want[key][r.start:ends[-1]][:r.length], "<u4").tobytes())
    sizes = []
    for key in sorted(by_sequence):
        pieces = sorted(by_sequence[key], key=lambda r: r.offset)
        ends = [0] + [r.offset + r.length for r in pieces]
        assert [r.offset for r in pieces] == ends[:-1]
        sizes.append(ends[-1])
    assert sorted(by_sequence) == list(range(len(sizes)))
    assert all(n == length or n < length and n & (n - 1) == 0 for n in sizes)
    return by_sequence


def test_registered_table_is_packed_whole(spark, reference):
    docs = spark.read.parquet(f"{oracle.DATA}/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    by_sequence = whole(packing.pack_documents(docs, WORDS).collect(), texts, reference, packing.LENGTH)
    order = [r.doc_id for k in sorted(by_sequence) for r in sorted(by_sequence[k], key=lambda r: r.offset)]
    again = packing.pack_documents(docs.repartition(7), WORDS).orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in again] == order


def test_neighbours_on_the_curve_are_alike(spark):
    draw = random.Random(3)
    topics = [[f"{t}{chr(97 + i)}" for i in range(26)] for t in ("ka", "mo", "su", "be")]
    rows = [(i, " ".join(draw.choices(topics[i % 4], k=60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = [r.doc_id for r in packing.pack_documents(docs, WORDS).orderBy("sequence_id", "offset").collect()]
    same = sum(a % 4 == b % 4 for a, b in zip(order, order[1:]))
    assert same > 0.7 * len(order)


def test_odd_rows(spark, reference):
    long = "word " * 5000 + "x" * 30_000
    rows = [(1, None, "t"), (2, "", "t"), (3, " \n", "t"), (4, long, "t"), (None, "lone", "t"), (6, "a <|endoftext|> b", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = packing.pack_documents(docs, WORDS, length=64, keep_ids=True)
    whole(got.collect(), {r[0]: r[1] for r in rows}, reference, 64)
    laid = packing.sequences(got).orderBy("sequence_id").collect()
    flat = [x for r in laid for x in r.ids]
    assert len(flat) == sum(len(reference.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert flat.count(packing.END_ID) >= len(rows) and [len(r.ids) for r in laid[:-7]] == [64] * len(laid[:-7])
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_repeated_rows_are_each_packed(spark):
    rows = [(7, "the same words")] * 50 + [(7, "other words")] * 3 + [(None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack_documents(docs, WORDS, length=16).collect()
    assert sum(r.length for r in got) == 50 * 4 + 3 * 3 + 40
    assert sum(r.length for r in got if r.doc_id is None) == 40
    places = sorted((r.sequence_id, r.offset) for r in got)
    assert len(set(places)) == len(places)
