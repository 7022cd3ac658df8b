"""Operators that compare documents or vectors with each other, against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import mixing, near, neighbours, passages, queries, simhash, suffix, training
from cotejo.llm.graph import components
from tests import oracle

DOCS = "doc_id bigint, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def some_texts(seed=5):
    """Random prose with exact and near copies, shared passages, repeated lines, odd and very long rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))
    texts = [prose(rng.randint(60, 200)) for _ in range(40)]
    base = prose(150)
    for k in range(30):
        words = base.split(" ")
        for _ in range(k % 9):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
        texts.append(" ".join(words))
    passage = prose(90)
    texts += [prose(20) + "\n" + passage + "\n" + prose(30) for _ in range(8)] + [texts[0]] * 4 + [texts[1].upper()]
    texts += ["", None, "   ", "one", "One", "two words", "ab " * 900, "long " + "x" * 5000 + " tail", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return rows + [(None, texts[3], "s"), (None, None, None), rows[5], rows[5]]


# --- near-duplicates ---------------------------------------------------------------------------------------------------
def brute_components(rows, width, percent=80):
    sets = []
    for _, text, _ in rows:
        words = WORD.findall(lower(text or ""))
        sets.append({tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = defaultdict(lambda: None)
    for i, (k, _, _) in enumerate(rows):
        if k is not None and (low[find(i)] is None or k < low[find(i)]):
            low[find(i)] = k
    return sorted(((k, len(sets[i]), low[find(i)]) for i, (k, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("width, wide, block", [(4, 512, 512), (5, 512, 3), (4, 40, 4)])
def test_components_equal_brute_force(spark, monkeypatch, width, wide, block):
    monkeypatch.setattr(near, "WIDE_SKETCH", wide)
    monkeypatch.setattr(near, "BLOCK", block)
    rows = some_texts()
    df = spark.createDataFrame(rows, DOCS).withColumns({"cls": F.lit(1), "keys": F.lit("x")})
    got = near.near_duplicates(df, width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_second_round_links_what_the_first_cannot(spark):
    """A chain whose ends share no list centre still becomes one component."""
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(words[10 * k:10 * k + 110] if k < 2 else words[5 * k:5 * k + 110]), "s") for k in range(3)]
    got = near.near_duplicates(spark.createDataFrame(rows, DOCS), 4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4)


def test_long_lists_in_blocks_and_streams(spark, monkeypatch):
    """Copies with some words changed, a few too many to link with most, and unlike texts around one passage."""
    monkeypatch.setattr(near, "BLOCK", 4)
    monkeypatch.setattr(near, "STREAM", 16)
    draw = random.Random(12)
    base = [f"w{i}" for i in range(160)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(draw.choice((1, 2, 3, 6, 8, 12))):
            words[draw.randrange(160)] = f"x{draw.randrange(1000)}"
        rows.append((k, " ".join(words), "s"))
    rows += [(100 + k, passage + " " + " ".join(f"u{k // 2}{i}" for i in range(30 + k % 2)), "s") for k in range(40)]
    got = near.near_duplicates(spark.createDataFrame(rows, DOCS), 4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4)


@pytest.mark.parametrize("nested", [True, False])
def test_pairs_at_the_threshold_share_a_list(nested):
    """Sets of which one holds the other (a passage was added), and sets with values of their own, at 0.8 exactly."""
    rng = np.random.default_rng(3)
    for _ in range(10_000):
        union = rng.integers(0, 2**64, 400, np.uint64)
        a, b = (union[:320], union) if nested else (union[:360], np.append(union[:320], union[360:]))
        assert len(np.intersect1d(near.list_keys(np.sort(a)), near.list_keys(np.sort(b)), assume_unique=True))


def test_near_duplicates_of_nothing_and_bad_threshold(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        near.near_duplicates(empty, percent=70)


def test_estimate_is_exact_for_small_sets_and_close_for_large():
    rng = np.random.default_rng(3)
    pool = rng.permutation(np.unique(rng.integers(0, 2**63, 9000, dtype=np.uint64)))
    a, b = np.sort(pool[:5000]), np.sort(pool[1000:6000])
    assert abs(near.union_estimate(a, b, 512) - 4000 / 6000) < .1
    assert near.union_estimate(a[:40], a[20:60], 64) == 20 / 60


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {r.node: r.root for r in components(links).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- repeated passages ---------------------------------------------------------------------------------------------------
def brute_passages(rows, length, keep_first):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    raws = [(k, (t or "").encode()) for k, t, _ in order]
    seen = defaultdict(list)
    for i, (k, raw) in enumerate(raws):
        for s in range(len(raw) - length + 1):
            seen[raw[s:s + length]].append((i, s))
    gone = defaultdict(set)
    for places in seen.values():
        head = [p for p in places if raws[p[0]] == raws[places[0][0]] and p[1] == places[0][1]]
        for p in places if not keep_first and len(places) > 1 else [p for p in places if p not in head]:
            gone[p[0]].update(range(p[1], p[1] + length))
    out = []
    for i, (k, raw) in enumerate(raws):
        keep = np.ones(len(raw), bool)
        keep[list(gone[i])] = False
        runs = int((np.diff(np.append(0, (~keep).astype(int))) == 1).sum())
        left = np.frombuffer(raw, np.uint8)[keep].tobytes()
        out.append((k, len(raw), int((~keep).sum()), runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("group, piece", [(2000, 2 << 20), (1, 700)])
def test_passages_equal_brute_force(spark, monkeypatch, keep_first, group, piece):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "PIECE", piece)
    rows = some_texts()
    df = spark.createDataFrame(rows, DOCS).withColumns({"txt": F.lit(1), "first": F.lit("x"), "spans": F.lit(2)})
    got = suffix.dedup_passages(df, 120, keep_first, keep_text=True, columns=("source", "txt")).collect()
    assert sorted((tuple(r)[2:] for r in got), key=str) == brute_passages(rows, 120, keep_first)
    assert {(r.source, r.txt) for r in got} == {("s", 1), (None, 1)}


@pytest.mark.parametrize("keep_first", [True, False])
def test_a_crowded_anchor_makes_few_rows(spark, monkeypatch, keep_first):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh") for _ in range(260))
    rows = [(i, "".join(rng.choice("ijklmnop") for _ in range(150)) + passage[:240 + i % 20] + "%05d" % i * 30, "s")
            for i in range(120)]
    strings = 120 * (240 - 120 + 1)
    made, held = {}, suffix.staged

    def counted(df, name):
        out = held(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(suffix, "GROUP", 20)
    monkeypatch.setattr(suffix, "staged", counted)
    found, by_place = [], suffix._by_place
    monkeypatch.setattr(suffix, "_by_place", lambda *args: found.append(by_place(*args)) or found[0])
    got = suffix.dedup_passages(spark.createDataFrame(rows, DOCS), 120, keep_first, keep_text=True).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_passages(rows, 120, keep_first)
    assert max(sum(n) for n in made.values()) < strings / 3 and found[0].count() < strings / 3


def test_passages_of_nothing_and_short_length(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffix.dedup_passages(empty).count() == 0
    with pytest.raises(ValueError):
        suffix.dedup_passages(empty, length=10)


def test_suffix_ranks_are_the_suffix_order():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    rank = suffix.suffix_ranks(data, 21)
    strings = [data[i:i + 21].tobytes() for i in range(len(data) - 20)]
    order = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert len(rank) == len(strings) and rank.tolist() == [order[s] for s in strings]
    earlier, later = suffix.previous_factors(rank, np.arange(len(rank)))
    assert earlier.tolist() == [s in strings[:i] for i, s in enumerate(strings)]
    assert later.tolist() == [s in strings[i + 1:] for i, s in enumerate(strings)]


# --- sentence spans --------------------------------------------------------------------------------------------------------
def brute_sentences(rows):
    texts = {(k, t or "") for k, t, _ in rows}
    cut = {}
    seen = defaultdict(list)
    for key in texts:
        found, current = [], []
        words = list(WORD.finditer(key[1]))
        for j, m in enumerate(words):
            current.append(m)
            if m.group()[-1] in ".!?" or j == len(words) - 1 or "\n" in key[1][m.end():words[j + 1].start()]:
                found.append(current)
                current = []
        cut[key] = found
        for i in range(len(found)):
            n = 0
            for j in range(i, len(found)):
                n += len(found[j])
                if n >= passages.LONG_WORDS or (j > i and n >= passages.WORDS):
                    seen[tuple(lower(m.group()) for s in found[i:j + 1] for m in s)].append((key, i, j))
                    break
    return texts, cut, seen


def test_sentences_equal_brute_force(spark):
    rows = [r for r in some_texts() if r[0] is not None or r[1] is None]
    df = spark.createDataFrame(rows, DOCS).withColumns({"at": F.lit(1), "cuts": F.lit(2)})
    got = passages.dedup_sentences(df, keep_text=True).collect()
    assert len(got) == len(rows)
    texts, cut, seen = brute_sentences(rows)
    gone = defaultdict(set)
    for places in seen.values():
        for key, i, j in sorted(places, key=lambda p: (p[0][0] is None, p[0][0] or 0, p[1]))[1:]:
            gone[key].update(range(i, j + 1))
    by_id = {k: t for k, t in texts}
    for r in got:
        key = (r.doc_id, by_id[r.doc_id])
        sentences = cut[key]
        bounds = [s[0].start() for s in sentences] + [len(key[1])]
        kept = key[1][:bounds[0]] + "".join(
            key[1][bounds[i]:bounds[i + 1]] for i in range(len(sentences)) if i not in gone[key])
        assert (r.kept, r.n_sentences, r.n_removed) == (kept, len(sentences), len(gone[key]))
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert r.removed_bytes == r.n_bytes - len(kept.encode())
    assert any(gone.values()) and passages.dedup_sentences(df.limit(0)).count() == 0


def test_every_repeated_run_goes_to_its_last_sentence(spark, tmp_path):
    def sentence(name, n):
        return " ".join(f"{name}{i}" for i in range(n)) + "."
    passage = " ".join(sentence(f"p{n}x", n) for n in (19, 10, 3))
    short = "Just so. Not quite."
    rows = [(k, f"{sentence(f'a{k}x', 15)} {passage} {sentence(f'b{k}x', 15)} {short} {sentence(f'c{k}x', 15)}", "s")
            for k in range(3)]
    rows += [(k, f"{sentence('long', 40)} {sentence(f'd{k}x', 5)}", "s") for k in (3, 4)]
    rows.append((5, "Not quite. Just so.", "s"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_sentences(spark, str(tmp_path)).collect()}
    assert {k: (r.n_sentences, r.n_removed) for k, r in got.items()} == {
        0: (8, 0), 1: (8, 5), 2: (8, 5), 3: (2, 0), 4: (2, 1), 5: (2, 0)}
    left = f"{sentence('a1x', 15)} {sentence('b1x', 15)} {sentence('c1x', 15)}"
    assert got[1].kept_sha256 == hashlib.sha256(left.encode()).hexdigest()


# --- fingerprints ----------------------------------------------------------------------------------------------------------
def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (k, t, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((k, len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [256, 5])
def test_edited_texts_follow_the_order_of_ids(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    rows = [(k if k is None else k * 37 - 600 + rng.randrange(30), t, s) for k, t, s in some_texts()]
    for some in (rows, [r for r in rows if r[0] is not None], rows[:1], [r for r in rows if r[0] is None]):
        df = spark.createDataFrame(some, DOCS).withColumns({"b": F.lit(1), "copy": F.lit(2)})
        got = simhash.edited_fingerprints(df).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == edited(some)
    assert simhash.edited_fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_texts_have_equal_fingerprints_and_votes_are_right(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    texts = ["a b a c a b", "one", "", " ", "x y " * 200, "a b a c a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: (r.t_0, r.t_1) for r in simhash.fingerprints(df, ["k"], ["t"]).collect()}
    assert got[0] == got[5] and got[2] == got[3] and len(set(got.values())) == 4
    hashed = df.select("k", F.explode(simhash.terms(F.col("t"))).alias("h")).select(
        "k", "h", F.xxhash64("h").alias("g")).collect()
    for k in got:
        terms = [(r.h, r.g) for r in hashed if r.k == k]
        for w in range(2):
            want = sum(1 << i for i in range(64) if 2 * sum(t[w] >> i & 1 for t in terms) > len(terms))
            # Bits stand in order of the lanes, the first one highest.
            assert got[k][w] % 2**64 == int("".join(reversed(f"{want:064b}")), 2)


def test_radius_search_finds_every_pair(spark):
    rng = random.Random(1)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(20)]
    points = set()
    for a, b in base:
        for flips in range(6):
            x, y = a, b
            for bit in rng.sample(range(128), flips):
                x, y = (x ^ 1 << bit, y) if bit < 64 else (x, y ^ 1 << bit - 64)
            points.add((x - (1 << 64) * (x >> 63), y - (1 << 64) * (y >> 63)))
    points = sorted(points)
    index = spark.createDataFrame(points, "i0 bigint, i1 bigint")
    queries = spark.createDataFrame(points[::3], "q0 bigint, q1 bigint")
    def apart(p, q):
        return sum(bin((x ^ y) % 2**64).count("1") for x, y in zip(p, q))
    for radius, blocks in ((3, 4), (7, 8)):
        got = {tuple(r) for r in simhash.within_radius(queries, index, radius, blocks).collect()}
        assert got == {(*p, *q) for p in points[::3] for q in points if apart(p, q) <= radius}
    with pytest.raises(ValueError):
        simhash.within_radius(queries, index, 4, 4)


def test_next_lower_of_sparse_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    ids = sorted({-10**12, -7, -6, -5, 0, 1, 2, 3, 10**6, 10**6 + 1, 10**15} | set(range(50, 90)))
    got = {r.id: r.lower for r in simhash.next_lower(spark.createDataFrame([(i,) for i in ids], "id bigint")).collect()}
    assert got == dict(zip(ids, [None, *ids]))


# --- nearest neighbours -----------------------------------------------------------------------------------------------------
def brute_nearest(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 3]
    out = {}
    for i, v in good:
        if i % every == 0:
            scored = sorted((-float(sum(a * b for a, b in zip(v, w))), j) for j, w in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def test_small_tables_are_exact_with_ties_copies_and_bad_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, [1.0, 1.0, 1.0]) for i in range(30)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 1.0]), (260, [float("nan"), 1.0, 1.0]),
             (280, [float("inf"), 1.0, 1.0]), (300, [1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(df, 20, 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(rows, 20, 20)
    assert {q: [(i, v, s) for i, (v, s) in enumerate(w, 1)] for q, w in want.items()} == {q: sorted(g) for q, g in got.items()}


def test_fewer_candidates_and_no_vectors(spark):
    kinds = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], kinds)
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(few.limit(0)).count() == 0 and neighbours.nearest(few.limit(1)).count() == 0


def test_recall_over_several_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 300)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 1500)] + .6 * rng.standard_normal((1500, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest(df).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 1500, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (75 * 20) >= .9


# --- mixing -------------------------------------------------------------------------------------------------------------------
def brute_targets(sizes):
    """Reshare until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: Fraction((3, 1, 2)[i % 3]) for i, s in enumerate(names)}
    full, left = {}, Fraction(3, 2) * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = Fraction(2 * sizes[s])
            left -= full[s]


def mixed_rows(seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) + "!" * rng.randint(0, 9), rng.choice(["a", "B", "é", "z", None, "z", "z"]))
            for i in range(600)]
    rows += [(1000 + i, "big " * 5000, "huge") for i in range(2)] + [(2000, None, "none"), (2001, "", "none"), (None, "a b", "a")]
    return rows + [rows[7], rows[7]]


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 3)
    rows = mixed_rows()
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("x"), "draw": F.lit(1), "of": F.lit(2)})
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    goal = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - float(goal[r.source])) < 1e-6 * max(1, r.target)
    assert all(abs(taken[s] - float(goal[s])) <= .5 + 1e-6 for s in sizes)
    assert sum(goal.values()) == Fraction(3, 2) * sum(sizes.values())


def test_noise_is_drawn_later(spark):
    rows = [(i, "word " * 20 + ("*** " * 20 if i % 2 else "word " * 20), "ab"[i % 4 // 2]) for i in range(800)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS), share=.5, cycle=(1.0,)).collect()
    plain, noisy = (sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1))
    assert plain > 3 * noisy


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOCS)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_mixed_documents_repeat_rows(spark):
    df = spark.createDataFrame(mixed_rows(), DOCS).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    times = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    for r in mixing.mix_sources(df).collect():
        assert times.get(r.doc_id, 0) == (int(r.taken / r.size + .5) if r.size else 0)


def test_mixed_sources_meet_their_targets_whatever_the_ids(spark):
    """Null and repeated ids in several sources: each source's words come near its target all the same."""
    draw = random.Random(4)
    rows = [(draw.choice((None, 7, i)), " ".join(f"w{draw.randrange(99)}" for _ in range(draw.randint(1, 9))), f"s{i % 3}")
            for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    got = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        got[r.source] += len(r.text.split())
    goal = {r.source: r.target for r in mixing.mix_sources(df).select("source", "target").distinct().collect()}
    assert set(got) == set(goal) and all(abs(got[s] - goal[s]) <= 0.02 * goal[s] + 9 for s in goal)


def test_labelled_rows_are_bounded_by_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "s") for i in range(50)] + [(2, None, "s"), (3, "c", "s"), (None, "n", "s")], DOCS)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    got = training.labelled(docs, labels, "quality")
    chosen = [r for r in got.collect()]
    held = {r.doc_id for r in docs.filter(training.held_out()).select("doc_id").collect()}
    assert sorted((r.doc_id, r.label) for r in chosen) == [x for x in [(1, 1), (3, 0)] if x[0] not in held]
    assert sorted(map(str, chosen)) == sorted(map(str, training.labelled(docs.repartition(5), labels, "quality").collect()))
