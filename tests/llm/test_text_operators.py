"""Operators on single documents: statistics, severity, tokens, archives."""

import hashlib
import json
import math
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cotejo.llm import bpe, quality, textops, toxicity, warc
from tests import oracle

SF = f"{oracle.DATA}/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, source string"


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]).astype(np.int64)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.transducer.ranks,
                             special_tokens={})


ODD = st.text(st.sampled_from(list("abst'  \n\té漢1٣!?lvred　\U0001F600")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD | st.text(max_size=30), min_size=1, max_size=5))
def test_tokens_equal_the_reference_encoder(codec, reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, bounds = codec.encode(*packed(texts))
    for i, text in enumerate(texts):
        row = ids[bounds[i]:bounds[i + 1]]
        assert row.tolist() == reference.encode_ordinary(text)
        assert codec.vocabulary.decode(row) == text.encode()


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_pieces_equal_the_pattern(codec, text):
    data, offsets = packed([text])
    starts, _ = codec.splitter.pieces(data, offsets)
    ends = [*starts[1:], len(data)]
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == regex.findall(public_tokenizers.PATTERN, text)


def test_transducer_forgets_and_goes_on(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "TRANSITIONS", 10)
    monkeypatch.setattr(bpe, "PIECES", 10)
    for text in ("onandthe other wh", "there are idiots", "Zugeü chbetz vergeber", "the other"):
        ids, _ = codec.encode(*packed([text]))
        assert ids.tolist() == reference.encode_ordinary(text)


def test_long_piece_without_a_break(codec, reference):
    text = "ab" * 3000 + " " * 500
    assert codec.encode(*packed([text]))[0].tolist() == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30), st.lists(st.integers(0, 30), max_size=6))
def test_streamed_utf8_equals_whole_decoding(data, cuts):
    stream, at, out = bpe.Utf8Stream(), 0, []
    for cut in sorted(c for c in cuts if c <= len(data)):
        out.append(stream.feed(data[at:cut]))
        at = cut
    out += [stream.feed(data[at:]), stream.close()]
    assert "".join(out) == data.decode("utf-8", "replace")


def test_encode_and_decode_tables(spark, reference):
    rows = [(1, None, "a"), (2, "", "a"), (3, "The same. " * 4000, "a"), (3, "The same. " * 4000, "a"), (None, "x é", "b")]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash"))
    got = bpe.encode_texts(df, RANKS).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    for r in got:
        text = next(t for k, t, _ in rows if k == r.doc_id) or ""
        want = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert bytes(r.ids) == want and r.n_tokens == len(want) // 4
        assert (r.ids_sha256, r.decoded_sha256) == (hashlib.sha256(want).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode_ids(bpe.encode_texts(df, RANKS), RANKS, chunk=1).collect()
    assert {(r.doc_id, r.text) for r in back} == {(k, t or "") for k, t, _ in rows}
    assert bpe.encode_texts(df.limit(0), RANKS).count() == 0


def test_word_helpers_equal_plain_python():
    texts = ["", "  ", "One two\tTwo  three\x0bfour", "x", "é ü\n é"]
    data, offsets = packed(texts)
    starts, ends, counts = textops.word_spans(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in regex.findall(r"[^\x20\x09-\x0D]+", t)] and counts.tolist() == [0, 0, 5, 1, 3]
    hashes = textops.word_hashes(data, starts, ends)
    assert hashes[1] == hashes[2] and len(set(hashes.tolist())) == 7
    assert textops.distinct_per_row(hashes, counts).tolist() == [0, 0, 4, 1, 2]
    assert len(textops.row_shingles(hashes[:5], 4)) == 2 and len(textops.row_shingles(hashes[:2], 4)) == 1


# --- quality ---------------------------------------------------------------------------------------------------------
def test_statistics_of_known_texts():
    x = quality.statistics(*packed(["", "The the. Of\n", "a"]))
    at = {n: i for i, n in enumerate(quality.FEATURES)}
    assert not x[0].any()
    row = x[1]
    assert math.isclose(row[at["log_words"]], math.log1p(3), rel_tol=1e-6)
    assert math.isclose(row[at["word_length"]], 9 / 3, rel_tol=1e-6) and row[at["longest_word"]] == 4
    assert math.isclose(row[at["upper"]], 2 / 12, rel_tol=1e-6) and math.isclose(row[at["line"]], 1 / 12, rel_tol=1e-6)


def test_flat_trees_equal_walking_them():
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.FEATURES)), np.float32)
    y = ((x[:, 0] > .5) ^ (x[:, 3] > .3)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)
    def walk(row):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return total
    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert (((forest.score(x) > .5) == y).mean()) > .95


def test_quality_of_odd_rows_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{oracle.DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{oracle.DATA}/sf0.01/labels.parquet")
    forest = quality.train(docs, labels)
    got = quality.score(docs, forest).join(labels, "doc_id").filter("held_out").collect()
    right = [r for r in got if r.predicted == r.quality]
    assert len(right) >= 0.9 * len(got)
    odd = spark.createDataFrame([(None, None, None), (5, "", "s"), (5, "", "s"), (6, "word " * 50_000, "s")], DOCS)
    rows = quality.score(odd.withColumn("score", F.lit(1)), forest).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= .3) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert quality.score(odd.limit(0), forest).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, none).collect()} == {.5}


# --- toxicity ----------------------------------------------------------------------------------------------------------
def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 600)
    row, word = np.repeat(np.arange(600), 2), np.tile([0, 1], 600)
    value = np.column_stack((grade + rng.normal(0, .3, 600), rng.normal(0, 1, 600))).ravel()
    weights, thresholds = toxicity.fit(row, word, value, grade, 2)
    assert list(thresholds) == sorted(thresholds) and weights[0] > 5 * abs(weights[1])


def test_toxic_words_are_learned_and_odd_rows_pass(spark):
    rng = random.Random(2)
    def text(bad):
        words = [rng.choice("lorem ipsum dolor amet erat quam nunc velit".split()) for _ in range(60)]
        for _ in range(bad):
            words.insert(rng.randrange(60), rng.choice(["Villain,", "rotter", "ROTTERS"]))
        return " ".join(words)
    rows = [(i, text(0 if i % 4 else 1 + i % 9), "s") for i in range(800)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.rate(docs, model).collect()}
    held = [i for i in range(800) if got[i] and int(i % 4 == 0) != got[i].predicted]
    assert len(held) <= 8
    severe = np.mean([got[i].expected_severity for i in range(0, 800, 4) if i % 9 > 5])
    mild = np.mean([got[i].expected_severity for i in range(0, 800, 4) if i % 9 < 3])
    assert severe > mild > np.mean([got[i].expected_severity for i in range(1, 800, 4)])
    odd = spark.createDataFrame([(None, None, "s"), (1, "", "s"), (1, "", "s"), (2, "lorem " * 40_000, "s")], DOCS)
    assert [r.predicted for r in toxicity.rate(odd, model).collect()] == [0] * 4
    assert toxicity.without_toxic(odd, model).collect() == odd.collect()
    assert toxicity.rate(odd.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.rate(docs, nothing).collect()} == {0}


# --- archives -----------------------------------------------------------------------------------------------------------
PAGES = "page_id bigint, url string, html string"


def test_archives_round_trip_and_are_plain_zstandard(spark, tmp_path):
    big, other = "<p>" + "same body " * 200, "<p>" + "é" * 600
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (7, "http://c", big), (3, None, "short"), (4, "u", "short"),
            (5, "u", None), (6, "u", ""), (None, "u", big), (8, "u", other), (9, "u", "x\r\n\r\n" * 300)]
    rows += [(100 + i, f"http://p/{i}", f"<html>{i} " + "filler text " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1))
    folder = f"{tmp_path}/archives"
    warc.write_archives(df, folder)
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert len(got) == len(rows)
    for page_id, url, html in rows:
        raw, r = (html or "").encode(), got[page_id]
        copy = html == big and page_id != 7
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 7) if copy else ("response", None))
        assert r.payload is None if copy else bytes(r.payload) == raw
    # Every file begins with the dictionary's frame, and a common reader that is given it reads all frames.
    seen = 0
    for file in sorted(tmp_path.glob("archives/part-*")):
        data = file.read_bytes()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
        with reader.stream_reader(data[8 + size:], read_across_frames=True) as stream:
            seen += stream.read().count(b"WARC/1.1\r\n")
    assert seen == len(rows)


def test_archives_of_few_and_no_pages(spark, tmp_path):
    one = spark.createDataFrame([(1, "u", "x" * 2000)], PAGES)
    assert [r.record_type for r in warc.archive_round_trip(one.union(one)).collect()] == ["response"] * 2
    assert warc.archive_round_trip(one.limit(0)).count() == 0


def test_a_damaged_archive_is_refused():
    frame = zstandard.ZstdCompressor().compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.read_frames(frame + b"junk"))
    with pytest.raises(ValueError):
        list(warc.read_frames(frame[:-3]))
