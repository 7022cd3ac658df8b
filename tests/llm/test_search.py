"""Lexical search against a plain scorer, exact products, ties and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cotejo.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=10):
    """The contract in plain Python, for distinct items."""
    bags = [(key, Counter(TERM.findall((text or "").translate(LOWER)))) for key, text in docs]
    bags = [(key, bag, sum(bag.values())) for key, bag in bags if bag]
    documents, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for key, bag, n in bags:
            m = 100 - 75 + (75 * n * documents) // length
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                        * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t in TERM.findall((text or "").translate(LOWER)) if t in bag)
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, rank, None if none else key, -score) for rank, (score, none, key) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **options):
    got = search.search(spark.createDataFrame(docs, "doc_id bigint, text string"),
                        spark.createDataFrame(items, "item_id bigint, text string"), **options)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["ÉA", "日本", "x-y", "Z"]
    return [(i, " ".join(draw.choices(words, k=draw.choice((0, 1, 5, 30, 80))))) for i in range(n)]


@pytest.mark.parametrize("cells, tile, block", [(search.CELLS, search.ITEM_TILE, search.BLOCK_BYTES), (100, 1, 60)])
def test_equal_to_the_plain_scorer(spark, monkeypatch, cells, tile, block):
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "ITEM_TILE", tile)
    docs, items = corpus(1, 120), corpus(2, 7)
    assert ranked(spark, docs, items, block_bytes=block) == plain(docs, items)


def test_ties_go_to_the_smaller_id_and_repeats_count(spark):
    docs = [(i, "same text here") for i in reversed(range(300))] + [(None, "same text here")] * 3 + [(999, "same same text")]
    docs += [(1000 + i, "other things") for i in range(400)]
    items = [(1, "same"), (2, "same same TEXT"), (3, "here"), (4, "absent")]
    assert ranked(spark, docs, items) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,"), (4, "a b"), (None, "a a a"), (4, "a b"), (5, "a " * 40_000 + "b"), (6, "c")]
    items = [(1, "a"), (None, "b a"), (3, None), (4, ""), (5, "?!"), (6, "a"), (6, "b"), (6, "b")]
    want = plain(docs, [(1, "a"), (None, "b a"), (6, "a"), (6, "b")])
    assert ranked(spark, docs, items) == want
    clash = spark.createDataFrame([(1, "a", 3, "x")], "doc_id bigint, text string, rank int, item_id string")
    assert search.search(clash, clash.withColumn("item_id", clash.doc_id)).count() == 1
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == []
    assert ranked(spark, [(1, None), (2, "")], items) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3), st.integers(1, 8), st.integers(1, 4), st.randoms(), st.sampled_from([50, 10_000, 2**53]))
def test_products_are_exact(items, width, rows, draw, exact):
    named = np.array([[draw.choice((0, 1, 2, 5)) for _ in range(width)] for _ in range(items)], float)
    dense = np.array([[draw.randrange(exact // draw.choice((1, 4, 100)) or 1) for _ in range(rows)] for _ in range(width)], float)
    want = [[sum(int(a) * int(b) for a, b in zip(r, c)) for c in dense.T] for r in named]
    assert search.exact_product(named, dense, exact).tolist() == want
