"""Collocations against a plain count, small groups, colliding words and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import phrases
from tests import oracle

SF = f"{oracle.DATA}/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=2000):
    """The contract in plain Python."""
    count = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            count.update(("und" if lang is None else lang, words[i:i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    n = Counter()
    for (lang, phrase), a in count.items():
        n[lang] += a if len(phrase) == 1 else 0
    often = {key: a for key, a in count.items() if a >= least}
    around = Counter()
    for (lang, phrase), a in often.items():
        for k in range(2, len(phrase)):
            for i in range(len(phrase) - k + 1):
                key = lang, phrase[i:i + k]
                around[key] = max(around[key], a)
    found = {}
    for (lang, phrase), a in often.items():
        if len(phrase) > 1 and 100 * around[lang, phrase] < 80 * a:
            cuts = [(often[lang, phrase[:k]], often[lang, phrase[k:]]) for k in range(1, len(phrase))]
            score, k = min((2_000_000 * a // (left + right), k) for k, (left, right) in enumerate(cuts))
            found.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), *cuts[k]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, some in found.items()
                  for rank, (s, a, p, left, right) in enumerate(sorted(some)[:top], 1))


def mined(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string, phrase string, n int, w1 string")
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def corpus(seed, n):
    draw = random.Random(seed)
    words = ["the", "The", "new", "york", "É", "x\x00y", "日本"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\xa0"]
    def text():
        return "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.choice((0, 3, 40, 90))))
    out = [(draw.choice(["en", "en", "de", None, "und", ""]), text()) for _ in range(n)]
    return out + [("en", "big red new york city, " * 40)] * 3 + [("zz", None), ("zz", ""), ("yy", "lone words")]


@pytest.mark.parametrize("budget, piece, held", [(phrases.GROUP_ROWS, phrases.SLICE, phrases.HELD), (5, 300, 10), (1, 1, 0)])
def test_equal_to_the_plain_count(spark, monkeypatch, budget, piece, held):
    monkeypatch.setattr(phrases, "SLICE", piece)
    monkeypatch.setattr(phrases, "HELD", held)
    rows = corpus(5, 400)
    got = mined(spark, [(*r, "p", 1, "w") for r in rows], budget=budget)
    assert got == plain(rows) and len({r[0] for r in got}) >= 4


def test_top_and_least(spark):
    rows = corpus(6, 150)
    assert mined(spark, [(*r, "p", 1, "w") for r in rows], least=12, top=5) == plain(rows, 12, 5)


def test_saturated_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "bitmap", lambda rows, slot, bits: np.full(1 << (bits - 3), 255, np.uint8))
    rows = corpus(7, 100)
    assert mined(spark, [(*r, "p", 1, "w") for r in rows]) == plain(rows)


def test_words_that_share_a_hash_start_it_again(spark, monkeypatch):
    real, seeds = phrases._word_counts, []

    def colliding(texts, seed):
        seeds.append(seed)
        return real(texts, seed) if seed else real(texts, seed).withColumn("h", F.lit(1).cast("long"))

    monkeypatch.setattr(phrases, "_word_counts", colliding)
    rows = corpus(8, 100)
    assert mined(spark, [(*r, "p", 1, "w") for r in rows]) == plain(rows) and seeds == [0, 1]


def test_empty_and_rare(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None, "", 1, ""), (None, "", "", 1, "")]) == []
    assert mined(spark, [("en", "a b c", "", 1, "")] * 29) == []
    assert mined(spark, [("en", "a b", "", 1, "")] * 30) == [("en", 1, "a b", 30, 30, 30, 60, 1_000_000)]


def test_totals_of_a_subtree():
    columns = [np.array(c) for c in ([1, 1, 1, 2], [5, 5, 6, 5], [7, 0, 7, 0], [0, 0, 8, 0])]
    nodes = phrases.subtree(columns, np.array([3, 4, 5, 6]), np.array([1, 1, 1, 1]), 5)
    got = sorted(tuple(int(x) for x in r) for level in nodes for r in zip(*level))
    assert got == [(1, 5, 0, 0, 7), (1, 6, 0, 0, 5), (1, 6, 7, 0, 5), (1, 6, 7, 8, 5), (2, 5, 0, 0, 6)]
    assert [len(level[0]) for level in phrases.subtree(columns, np.array([3, 4, 5, 6]), np.full(4, 3), 99)] == [3, 0, 0]
