"""Pairing and matching against plain-Python brute force, with limits low enough that long groups take the split paths."""

import difflib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cotejo.functions import sequences
from cotejo.operators import graph, layout, matching, pairing
from cotejo.operators.reconcile import dedupe_best, dense_position
from cotejo.params import LayoutParams, VoteParams
from cotejo.plans import derive, digit_ensemble, staging
from cotejo.plans.form_pairs import form_pairs
from tests import oracle

LIST = "form_id bigint, pos bigint, {s}_id string, {s}_conf double, {s}_digits array<double>"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def number(rng, alphabet="0123456789", n=6):
    return "".join(rng.choice(alphabet) for _ in range(n))


def brute_pairs(a, b, window=2):
    """[(i, j, how)] by the positional rule, one list at a time."""
    used, out = set(), []
    for i in range(min(len(a), len(b))):
        if ratio(a[i], b[i]) >= 0.30:
            used.add(i)
            out.append((i, i, "positional"))
            continue
        options = [(-ratio(a[i], b[j]), j) for j in range(max(0, i - window), min(len(b), i + window + 1)) if j not in used]
        options = [o for o in options if o[0] < 0]
        j, how = (min(options)[1], "repaired") if options else (i, "forced")
        used.add(j)
        out.append((i, j, how))
    return out


def lists(spark, forms):
    rows = {"a": [], "b": []}
    for form, sides in forms.items():
        for side, ids in zip("ab", sides):
            rows[side] += [(form, i, v, 0.9, [0.9] * len(v)) for i, v in enumerate(ids)]
    return [spark.createDataFrame(rows[s], LIST.format(s=s)).repartition(3) for s in "ab"]


@pytest.mark.parametrize("chunk", [2, 3, 5, 512])
def test_pairing_equals_brute_force(spark, chunk):
    rng = random.Random(7)
    # Few digits per form and disjoint alphabets make many weak, zero and tied ratios; form 0 is long.
    forms = {0: tuple([number(rng, rng.choice(["012", "345", "6789"]), 4) for _ in range(150)] for _ in range(2))}
    for f in range(1, 40):
        n, m = rng.randint(0, 9), rng.randint(0, 9)
        forms[f] = ([number(rng, rng.choice(["012", "345", "6789"]), 4) for _ in range(n)],
                    [number(rng, rng.choice(["012", "345", "6789"]), 4) for _ in range(m)])
    got = pairing.pair_readings(*lists(spark, forms), chunk=chunk).select("form_id", "pos", "b_pos", "how").collect()
    want = {(f, *p) for f, (a, b) in forms.items() for p in brute_pairs(a, b)}
    assert {h for *_, h in want} == {"positional", "repaired", "forced"}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_one_side_only_gives_nothing_unless_the_gap_is_large(spark):
    det = "form_id bigint, id_number string, ord bigint, confidence double, digit_conf array<double>"
    def rows(form, n):
        return [(form, f"{10**9 + i}", i, 0.95, [0.9] * 10) for i in range(n)]
    a = spark.createDataFrame(rows(1, 2) + rows(2, 3), det)
    b = spark.createDataFrame([], det)
    got = digit_ensemble.reconcile(a, b).orderBy("pos").collect()
    assert [(r["form_id"], r["pos"], r["outcome"]) for r in got] == [(2, i, "unpaired_a") for i in range(3)]


def test_dense_position_over_chunks(spark):
    rows = [(1, s, str(s)) for s in range(0, 100, 3)] + [(2, 7, "x"), (2, 9, "y")]
    raw = spark.createDataFrame(rows, "form_id bigint, ord bigint, id_number string")
    got = dense_position(raw, chunk=8).orderBy("form_id", "ord").collect()
    assert [r["pos"] for r in got] == [*range(34), 0, 1]


def test_dense_position_puts_an_empty_slot_first(spark):
    rows = [(1, None, "n"), (1, 0, "a"), (1, 3, "b"), (1, 20, "c")]
    raw = spark.createDataFrame(rows, "form_id bigint, ord bigint, id_number string")
    for chunk in (8, 4096):
        assert {r["id_number"]: r["pos"] for r in dense_position(raw, chunk=chunk).collect()} == {"n": 0, "a": 1, "b": 2, "c": 3}


def test_dedupe_keeps_best_in_first_slot(spark):
    rows = [(1, "a", 0, 0.5, "p"), (1, "b", 1, 0.9, "q"), (1, "a", 2, 0.8, "r"), (1, "b", 3, 0.9, "s")]
    df = spark.createDataFrame(rows, "form_id int, id_number string, ord int, confidence double, tag string")
    got = {(r["id_number"], r["ord"], r["confidence"], r["tag"]) for r in dedupe_best(df).collect()}
    assert got == {("a", 0, 0.8, "r"), ("b", 1, 0.9, "q")}


def brute_match(a, b, limit=0.6):
    used, out = set(), []
    for i, (a_name, a_id) in enumerate(a):
        best, best_j = 0.0, None
        for j, (b_name, b_id) in enumerate(b):
            if j not in used:
                s = ratio(a_id, b_id) * 0.8 + ratio(a_name.lower(), b_name.lower()) * 0.2
                if s > best:
                    best, best_j = s, j
        if best_j is not None and best >= limit:
            used.add(best_j)
            out.append((i, best_j))
    return out


@pytest.mark.parametrize("similarities, few", [((), 4096), (matching.SIMILARITIES, 0), ((), 0), ((0.9, 0.61), 12)])
def test_match_pairs_equals_brute_force(spark, similarities, few):
    rng = random.Random(3)
    names = ["Ana Ruiz", "ANA RUIZ", "Luis Paz", "Eva Sol"]
    forms = {f: [[(rng.choice(names), number(rng, "0123", 5)) for _ in range(n)] for n in (size, size + f % 3)]
             for f, size in enumerate((20, 3, 1, 6, 0, 4))}
    def side(k):
        rows = [(f, i, *p) for f, s in forms.items() for i, p in enumerate(s[k])]
        return spark.createDataFrame(rows, "form_id bigint, pos bigint, name string, id_number string")
    got = matching.match_pairs(side(0), side(1), similarities=similarities, few=few).select("form_id", "pos", "b_pos").collect()
    want = {(f, *p) for f, (a, b) in forms.items() for p in brute_match(a, b)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_long_lists_and_copies_equal_brute_force(spark):
    rng = random.Random(8)
    def rows(n, tail):
        out = [("Ana Ruiz", number(rng, "0123456789", rng.choice((8, 8, 9, 10)))) for _ in range(n)]
        return out + [("Eva Sol", "12345678")] * tail
    a = rows(60, 12)
    b = [(name[:-1] if i % 3 else name, ident[:3] + rng.choice("0123456789") + ident[4:]) for i, (name, ident) in enumerate(a)]
    b = b[::-1][:50] + rows(5, 7) + [("Eva Sol", None), (None, "12345678"), ("x" * 40, "9" * 30), ("", "")]
    a += [("y" * 40, "9" * 29 + "8"), ("", ""), (None, None)]
    def side(rows_):
        return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows_)],
                                     "form_id bigint, pos bigint, name string, id_number string")
    got = {(r["pos"], r["b_pos"]) for r in matching.match_pairs(side(a), side(b), few=100).collect()}
    whole = [[(i, r) for i, r in enumerate(rows_) if None not in r] for rows_ in (a, b)]
    want = {(whole[0][i][0], whole[1][j][0]) for i, j in brute_match(*[[r for _, r in w] for w in whole])}
    assert got == want


def test_forms_with_few_pairs_are_matched_where_they_lie(spark):
    rows = [(f, i, "Ana Ruiz", f"{f}{i}345") for f in range(30) for i in range(4)]
    a, b = [spark.createDataFrame(rows, "form_id bigint, pos bigint, name string, id_number string").repartition(3, "form_id")
            for _ in "ab"]
    before = staging.written()
    got = matching.match_pairs(a, b)
    assert [p for p in staging.written() if p not in before and "-crowded-" not in p] == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.split("\n") if "Exchange" in x]) == 2
    assert {(r["form_id"], r["pos"], r["b_pos"]) for r in got.collect()} == {(f, i, i) for f, i, *_ in rows}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("012ñ😀", max_size=70), min_size=1, max_size=4), st.lists(st.text("012é😀", max_size=70), min_size=1, max_size=4))
def test_no_ratio_is_above_its_bound(a, b):
    x, y = [v.ravel() for v in np.meshgrid(np.arange(len(a)), np.arange(len(b)))]
    found = sequences.ratios([a[i] for i in x], [b[j] for j in y])
    bounds = sequences.subsequence_bounds(a, b, x, y)
    assert (found <= bounds).all() and (bounds <= 1).all()
    assert all(v == 1 for i, j, v in zip(x, y, bounds) if a[i] == b[j])


@settings(max_examples=300, deadline=None)
@given(st.text("0123ab", max_size=14), st.text("0123ab", max_size=14), st.sampled_from([0.5, 0.625, 0.85, 0.96, -0.1]))
def test_texts_of_the_ratio_share_a_signature(a, b, ratio):
    total = len(a) + len(b)
    met = set(matching.signatures(a, [len(b), 5], ratio, True)) & set(matching.signatures(b, [len(a), 3], ratio, False))
    if (difflib.SequenceMatcher(None, a, b, False).ratio() if total else 1.0) >= ratio:
        assert met


def brute_proximity(names, ids, p=LayoutParams()):
    used, out = set(), []
    for i in sorted(ids, key=lambda r: r["y"]):
        cx, cy = i["x"] + i["w"] / 2, i["y"] + i["h"] / 2
        best, best_n = math.inf, None
        for n in names:
            if n["text"] in used:
                continue
            nx, ny = n["x"] + n["w"] / 2, n["y"] + n["h"] / 2
            dx, dy = cx - nx, (cy - ny) * 2
            d = math.sqrt(dx * dx + dy * dy)
            d *= 2 if ny > cy + 50 else 1
            d *= 1.5 if abs(dx) > 500 else 1
            if d < best:
                best, best_n = d, n
        if best_n is not None and best < p.max_pair_distance:
            used.add(best_n["text"])
            out.append((best_n["text"], i["text"], int(best)))
    return out


@pytest.mark.parametrize("reaches, few", [((1.0,), 4096), (matching.REACHES, 0), ((1.0,), 0), ((0.01, 0.1, 0.3, 1.0), 20)])
def test_pair_by_proximity_equals_brute_force(spark, reaches, few):
    rng = random.Random(11)
    def box(f, k, text):
        return dict(form_id=f, ord=k, text=text, x=float(rng.randrange(0, 1500)), y=float(rng.randrange(0, 900)),
                    w=float(rng.randrange(20, 90)), h=20.0, confidence=0.9)
    forms = {}
    for f, (n, m) in enumerate([(25, 30), (2, 3), (4, 1), (0, 2), (3, 0), (12, 9)]):
        # Some names repeat: a text is taken once for all its boxes. One name lies out of everybody's reach.
        names = [box(f, k, f"name {rng.randrange(max(1, n - 3))}") for k in range(n)]
        if names:
            names[-1]["y"] = 9000.0
        forms[f] = names, [box(f, k, f"id{f}-{k}") for k in range(m)]
    schema = "form_id bigint, ord bigint, text string, x double, y double, w double, h double, confidence double"
    names, ids = [spark.createDataFrame([r for s in forms.values() for r in s[k]], schema) for k in (0, 1)]
    got = matching.pair_by_proximity(names.withColumnRenamed("ord", "cluster"), ids, reaches=reaches, few=few)
    got = [tuple(r) for r in got.select("form_id", "name", "id_number", "distance").collect()]
    want = {(f, *p) for f, s in forms.items() for p in brute_proximity(*s)}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("unit", [1, 35, 70])
def test_clusters_equal_transitive_closure(spark, unit):
    rng = random.Random(5)
    # With units that divide a cell many words are exactly a cell apart, which is no contact.
    rows = [(f, k, float(unit * rng.randrange(-500 // unit, 4000 // unit)), float(unit // 7 * rng.randrange(900 // (unit // 7))
             if unit > 1 else rng.randrange(0, 900))) for f in range(6) for k in range(60)]
    rows += [(9, k, 10.0 + k % 7, 5.0 + k % 5) for k in range(300)]
    df = spark.createDataFrame(rows, "form_id bigint, box_id bigint, x double, y double")
    got = {(r["form_id"], r["box_id"]): r["cluster"] for r in layout.cluster_words(df).collect()}
    want = {}
    for f in {r[0] for r in rows}:
        words = {k: (x, y) for g, k, x, y in rows if g == f}
        seen = set()
        for start in sorted(words):
            if start in seen:
                continue
            todo = [start]
            seen.add(start)
            while todo:
                x, y = words[todo[0]]
                want[f, todo.pop(0)] = start
                near = [k for k, (u, v) in words.items() if k not in seen and abs(u - x) < 350 and abs(v - y) < 60]
                seen.update(near)
                todo += near
    assert got == want


def test_clusters_on_the_grid_and_in_rows_are_the_same(spark):
    rng = random.Random(6)
    rows = [(f, k, f"w{k}", float(rng.randrange(-900, 4000)), float(rng.randrange(0, 1500))) for f in range(8) for k in range(90)]
    rows += [(9, 1, "alone", 5.0, 5.0), (9, 2, "nowhere", None, 5.0)]
    df = spark.createDataFrame(rows, "form_id bigint, box_id int, text string, x double, y double")
    found = [layout.cluster_words(df, few=few) for few in (0, 512)]
    assert {f.name: f.dataType for f in found[0].schema} == {f.name: f.dataType for f in found[1].schema}
    grid, in_rows = [sorted(d.select(*df.columns, "cluster").collect()) for d in found]
    assert grid == in_rows and len(grid) == len(rows) - 1


def test_short_forms_are_paired_where_they_lie(spark):
    rng = random.Random(9)
    texts = ["ana", "ruiz", "luis", "firma", "12345678", "1.234.567", "1234567 7654321", "12", None]
    rows = [(f, k, rng.choice(texts), float(rng.randrange(0, 1500)), float(rng.randrange(0, 900)), 80.0, 20.0, rng.randrange(100) / 100)
            for f in range(25) for k in range(rng.randrange(1, 25))]
    schema = "form_id bigint, box_id bigint, text string, x double, y double, w double, h double, confidence double"
    boxes = spark.createDataFrame(rows, schema).repartition(3, "form_id")
    before = staging.written()
    short = form_pairs(boxes)
    assert [p for p in staging.written() if p not in before and "-crowded-" not in p] == []
    got, want = [sorted(map(tuple, d.withColumn("name_conf", F.round("name_conf", 9)).collect()))
                 for d in (short, form_pairs(boxes, few=0))]
    assert got == want and len(got) > 25


def test_words_are_the_same_one_by_one_and_by_rows(spark):
    sf = f"{oracle.DATA}/sf0.001"
    one, by_row = [sorted(map(tuple, d.collect())) for d in (
        derive.page_words(spark, sf, 90, 40), derive.row_words(derive.word_rows(spark, sf, 90, 40)))]
    assert one == by_row


def test_components_of_chains_and_rings(spark):
    chain = [(1, i, i + 1) for i in range(100)]
    ring = [(2, i, (i + 7) % 50) for i in range(50)]
    lone = [(3, 5, 5), (3, 8, 6), (3, 9, 8)]
    links = spark.createDataFrame(chain + ring + lone, "form_id bigint, a bigint, b bigint").repartition(5)
    got = {(r.form_id, r.node): r.root for r in graph.components(links).collect()}
    assert got == {**{(1, i): 0 for i in range(101)}, **{(2, i): 0 for i in range(50)}, (3, 6): 6, (3, 8): 6, (3, 9): 6}


def test_a_run_of_open_chunks_is_composed(spark):
    rng = random.Random(4)
    forms = {0: tuple([number(rng, rng.choice(["01", "23"]), 3) for _ in range(150)] for _ in range(2))}
    got = pairing.pair_readings(*lists(spark, forms), chunk=3).select("form_id", "pos", "b_pos", "how").collect()
    assert {tuple(r) for r in got} == {(f, *q) for f, (a, b) in forms.items() for q in brute_pairs(a, b)}


def test_partitioning_does_not_matter(spark):
    rng = random.Random(2)
    forms = {f: tuple([number(rng, "01234", 5) for _ in range(7)] for _ in range(2)) for f in range(30)}
    a, b = lists(spark, forms)
    def run(x, y):
        return sorted(map(tuple, pairing.pair_readings(x, y).select("form_id", "pos", "b_pos", "how").collect()))
    assert run(a, b) == run(a.repartition(7, F.rand(1)), b.orderBy(F.desc("b_id")))


@pytest.mark.parametrize("window", [0, 1, 3, 4])
def test_other_repair_windows_equal_brute_force(spark, window):
    rng = random.Random(window)
    forms = {f: tuple([number(rng, rng.choice(["012", "345", "6789"]), 4) for _ in range(rng.randint(0, 30))]
                      for _ in range(2)) for f in range(20)}
    p = VoteParams(repair_window=window)
    got = pairing.pair_readings(*lists(spark, forms), p, chunk=4).select("form_id", "pos", "b_pos", "how").collect()
    assert {tuple(r) for r in got} == {(f, *q) for f, (a, b) in forms.items() for q in brute_pairs(a, b, window)}


def test_too_wide_a_window_is_refused(spark):
    with pytest.raises(ValueError):
        pairing.pair_readings(*lists(spark, {0: (["1"], ["2"])}), VoteParams(repair_window=9))


def test_a_name_without_a_place_is_no_option(spark):
    box = "form_id bigint, {k} bigint, text string, x double, y double, w double, h double, confidence double"
    names = spark.createDataFrame([(1, 1, "ANA", None, 10.0, 5.0, 5.0, .9), (1, 2, "EVA", 90.0, 10.0, 5.0, 5.0, .9)],
                                  box.format(k="cluster"))
    ids = spark.createDataFrame([(1, 1, "123456", 10.0, 10.0, 5.0, 5.0, .9)], box.format(k="ord"))
    got = matching.pair_by_proximity(names, ids).collect()
    assert [(r["name"], r["id_number"]) for r in got] == [("EVA", "123456")]


def test_rows_beyond_the_expected_ones_stay(spark):
    rows = spark.createDataFrame([(1, 17, "ANA", "123456", False)],
                                 "form_id bigint, row_index int, names string, id_number string, is_empty boolean")
    forms = spark.createDataFrame([(1,)], "form_id bigint")
    for expected in (15, 20):
        got = layout.densify_rows(rows, forms, LayoutParams(expected_rows=expected)).collect()
        assert {r["row_index"]: r["names"] for r in got} == {**{i: "" for i in range(expected)}, 17: "ANA"}
