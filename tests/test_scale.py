"""Plans and operators that have to stay short when forms and rows are many."""

import gzip
import re

import pytest
from pyspark.sql import functions as F

from cotejo.operators import layout, matching, pairing, voting
from cotejo.plans import derive, digit_ensemble
from cotejo.plans.staging import staged
from cotejo.sources import documents, responses

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [derive.responses_a, derive.responses_b, derive.page_words])
def test_rows_of_a_form_meet_once(spark, make):
    """Words and symbols are made after the one exchange by form, never folded or exchanged themselves."""
    plan = make(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?:hashpartitioning\(form_id|SinglePartition)", plan)) == 1
    nested = [line for line in plan.splitlines() if "collect_list" in line and ("vertices" in line or "polygon" in line)]
    assert not nested


def test_pairs_of_a_form_meet_in_its_own_row(spark):
    """Identifiers and names are exchanged once by form, and nothing they hold is looked up again."""
    box = "x double, y double, w double, h double, confidence double"
    names = spark.createDataFrame([(1, 7, "ana", 0.0, 0.0, 5.0, 5.0, 0.9)], f"form_id bigint, cluster bigint, text string, {box}")
    ids = spark.createDataFrame([(1, 3, "1234567", 20.0, 0.0, 5.0, 5.0, 0.8)], f"form_id bigint, ord bigint, text string, {box}")
    got = matching.pair_by_proximity(names, ids)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"[a-z]Join", plan)) == 1 and len(re.findall(r"Exchange hashpartitioning", plan)) <= 2
    assert [tuple(r) for r in got.collect()] == [(1, "ana", "1234567", 0.9, 0.8, 20, 0.0, 0.0, 20.0, 0.0)]


def test_packed_documents_read_back_and_stay_small(spark, tmp_path):
    forms = derive.responses_b(spark, SF)
    documents.write_documents(forms, str(tmp_path / "docs"))
    files = documents.files_of(str(tmp_path / "docs"))
    plain = forms.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    assert sum(size for _, size in files) * 4 < plain
    assert len(documents.ranges(files, 100)) == len(files)
    back = documents.read_documents(spark, str(tmp_path / "docs"), responses.RESPONSE_B, rangeBytes=100)
    assert back.count() == forms.count() and back.filter("malformed IS NOT NULL").isEmpty()
    assert back.drop("file", "start", "malformed").exceptAll(forms).isEmpty()


def test_lines_of_a_packed_file_keep_their_place(tmp_path):
    raw = b"one\r\n\r\ntwo\n" + "é".encode() * 2_000_000 + b"\nend"
    (tmp_path / "a.gz").write_bytes(gzip.compress(raw))
    got = [r for p in documents.ranges(documents.files_of(str(tmp_path)), 7) for b in documents.read_range(str(tmp_path), p)
           for r in b.to_pylist()]
    assert [r["line"] for r in got] == ["one", "two", "é" * 2_000_000, "end"]
    assert all(raw[r["start"]:].startswith(r["line"].encode()) for r in got)


def test_short_streams_are_looked_through_in_place(spark, monkeypatch):
    symbols = "array<struct<text:string,confidence:double>>"
    seen = {f: [("12", 0.5), ("a3", 0.25), ("123", 1.0)][: f + 1] for f in range(3)}
    streams = spark.createDataFrame(list(seen.items()), f"form_id bigint, symbols {symbols}")
    ids = spark.createDataFrame([(f, i) for f in range(4) for i in ("123", "2", "99", "")], "form_id bigint, id_number string")

    def run():
        return sorted(map(tuple, layout.map_digit_confidences(ids, streams).collect()))

    short = run()
    assert (2, "123", [0.5, 0.5, 0.25], True) in short and (3, "2", [0.85], False) in short and len(short) == 16
    plan = layout.map_digit_confidences(ids, streams)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    monkeypatch.setattr(layout, "LONG_STREAM", 2)
    assert run() == short


PAIR = "form_id int, a_id string, a_conf double, a_digits array<double>, b_id string, b_conf double, b_digits array<double>"


def test_a_pair_votes_in_its_own_row(spark):
    """The vote neither groups nor sorts digit rows, and decides as they do."""
    rows = []
    for k in range(400):
        a = "".join(str((k * 7 + i * i) % 10) for i in range(k % 12))
        b = a if k % 3 else a.translate(str.maketrans("175638", "716583"))
        sides = [[(55 + (k * s + i * 13) % 45) / 100 for i in range(len(a) - (k % 41 == 0))] for s in (3, 11)]
        rows.append((k, a, .8, sides[0], b, .9, sides[1]))
    pairs = spark.createDataFrame(rows, PAIR)
    combined, table = voting.combine_pairs(pairs, "form_id"), voting.comparison_table(pairs, "form_id")
    for df in (combined, table):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Aggregate|Window|Sort|Exchange", plan)
    digits: dict = {}
    for d in voting.digit_votes(pairs.filter("a_id <> ''"), "form_id").filter("i IS NOT NULL").collect():
        digits.setdefault(d.form_id, []).append(d)
    outcomes = set()
    for r in combined.collect():
        own = sorted(digits.get(r.form_id, []), key=lambda d: d.i)
        refused = not own or any(d.rejected for d in own)
        assert r.outcome == ("fallback" if refused else "vote") and r.total_digits == len(own)
        assert r.unanimous_count == sum(d.ad == d.bd for d in own) == len(own) - r.conflict_count
        if not refused:
            assert r.id_number == "".join(d.chosen for d in own)
            assert r.confidence == pytest.approx(sum(d.conf for d in own) / len(own))
        else:
            assert (r.id_number, r.confidence) == (r.b_id, .9)
        outcomes.add((r.outcome, r.a_id == r.b_id))
    assert len(outcomes) == 4
    kept = {k: v for k, v in digits.items() if not any(d.rejected for d in v)}
    got = [(r.form_id, r.digit_pos, r.chosen, r.source, r.type) for r in table.collect()]
    assert sorted(got) == sorted((d.form_id, d.i, d.chosen, d.source, d.type) for v in kept.values() for d in v)


def test_written_rows_are_dealt_by_count(spark, monkeypatch):
    """Bytes would put too many rows into a task: they pack well and grow when digits are made of them."""
    monkeypatch.setattr(derive, "ROWS_A_TASK", 500)
    tasks = -(-derive.table(spark, SF, "lineitem").count() // 500)
    for make in (derive.written_rows, derive.readings_a, derive.readings_b, derive.page_words):
        plan = make(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert re.findall(r"Exchange hashpartitioning\(form_id#\d+L?, (\d+)\)", plan) == [str(tasks)]


def test_lists_are_made_and_exchanged_once(spark):
    """Readings are de-duplicated and ranked in one pass, and pairs are read from the table where the lists met."""
    raw = derive.detections_a(spark, SF)
    assert "Union" not in raw._jdf.queryExecution().executedPlan().toString()
    a, b = digit_ensemble.reading_list(raw, "a"), digit_ensemble.reading_list(derive.detections_b(spark, SF), "b")
    for df in (a, b, pairing.pair_readings(a, b)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Aggregate|Window|Join|Exchange", plan)


def test_names_of_a_row_are_found_in_its_own_row(spark, monkeypatch):
    """Lines, words and names of a form meet by form alone; crowded forms meet by digit strings and strips, with equal results."""
    rows = staged(derive.word_rows(spark, SF), "word-rows")
    box = "form_id bigint, box_id bigint, text string, x double, y double, h double, confidence double"
    odd = [(-1, 1, "12", 400., 0., 10., .5), (-1, 2, "Ana", 0., 0., 10., None), (-1, 3, "34567", 500., 0., 10., .5),
           (-1, 4, "Eva", 10., 2., 10., None), (-2, 1, "1234567", 400., 90., 10., .5), (-2, 2, "Ines", 0., 90., 10., None),
           (-2, 3, "de", 5., 115., 10., .25), (-2, 4, "Luz", 7., 115.5, 10., .5)]
    words = derive.row_words(rows).select(*box.replace(",", "").split()[::2]).unionByName(spark.createDataFrame(odd, box))
    again = spark.createDataFrame([(-1, 0, "Ana 1234567"), (-1, 0, "Ana 1234567"), (-2, 0, "1234567"), (-3, 0, "1234567")],
                                  "form_id bigint, line_no bigint, line string")
    lines = derive.page_lines(rows).unionByName(again)

    def run():
        names = layout.same_row_names(layout.locate_id_lines(lines, words), words)
        return names._jdf.queryExecution().executedPlan().toString(), sorted(
            (tuple(r) for r in names.withColumn("name_conf", F.round("name_conf", 6)).collect()))

    plan, got = run()
    assert len(re.findall("Join", plan)) == 2 and not re.search("strip|Exchange hashpartitioning\\(form_id[^,]*, [a-z]", plan)
    assert got[:2] == [(-2, 0, "1234567", "Ines de", .25), (-1, 0, "1234567", "Ana Eva", None)] and len(got) > 4000
    for few in (1, 15):
        monkeypatch.setattr(layout, "FEW", few)
        assert run()[1] == got
