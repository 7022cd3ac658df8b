"""Literal expectations for the column functions."""

import difflib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cotejo.functions import account, geometry, ident, sequences, text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [("lO23456", "1023456"), ("B765432I", "87654321"), ("a|Zz", "122")])
def test_letter_repair(spark, raw, want):
    assert one(spark, tx.fix_confusable_letters(F.lit(raw))) == want


def test_interrupted_digits(spark):
    assert one(spark, tx.digits_only(F.lit("107 116C1931"))) == "1071161931"


def test_digit_runs_are_greedy(spark):
    assert one(spark, tx.digit_runs(F.lit("12345678901 1234567 123456"))) == ["1234567890", "1234567"]


@pytest.mark.parametrize("raw, want", [
    ("JUAN DE LA CRUZ", "Juan de la Cruz"), ("ana x lópez.", "Ana López"), (".. de luis", "de Luis"), ("(maria) del mar..", "Maria del Mar"),
])
def test_format_name(spark, raw, want):
    assert one(spark, tx.format_name(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [
    ("Juan", True), ("x", False), ("Firma", False), ("12345", False), ("José 1", True), ("J0n3s", False), ("", False),
])
def test_looks_like_name(spark, raw, want):
    assert one(spark, tx.looks_like_name(F.lit(raw))) is want


@pytest.mark.parametrize("raw, want", [("Mauro", True), ("Ana", False), ("de la", True), ("a b c", False), ("Ana.", False)])
def test_is_valid_name(spark, raw, want):
    assert one(spark, tx.is_valid_name(F.lit(raw))) is want


PAIRS = [("1036221525", "7036227525"), ("12345", "54321"), ("", "1"), ("abcd", "bcde"), ("1112223334", "3332221114"), ("77", "77")]


def test_sequence_ratio_and_shortcut(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string")
    rows = df.select("a", "b", tx.sequence_ratio(F.col("a"), F.col("b")).alias("r"),
                     tx.surely_similar(F.col("a"), F.col("b"), 0.3).alias("sure")).collect()
    for r in rows:
        want = difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()
        assert r["r"] == want
        assert not r["sure"] or want >= 0.3


@pytest.mark.parametrize("value, want", [(95.0, 0.95), (0.4, 0.4), (1.0, 1.0), (101.0, None), (-0.1, None)])
def test_normalize_confidence(spark, value, want):
    assert one(spark, ident.normalize_confidence(F.lit(value))) == want


def test_identifier_rules(spark):
    assert one(spark, ident.format_id(F.lit("0012345678"))) == "12.345.678"
    assert one(spark, ident.mask_id(F.lit("1036221525"))) == "*******525"
    assert one(spark, ident.try_create(F.lit(" 123 "))) == "123"
    assert one(spark, ident.try_create(F.lit("0123"), False)) is None
    assert one(spark, ident.is_colombian(F.lit("012345678"))) is False
    assert one(spark, ident.from_raw_reading(F.lit("ABC"))) is None
    assert one(spark, ident.format_confidence(F.lit(0.8567))) == "86%"
    assert one(spark, ident.format_confidence(F.lit(0.8567), 2)) == "85.67%"
    with pytest.raises(ValueError):
        ident.has_length(F.lit("1"), 5, 4)


def test_quota_and_money(spark):
    five, none = F.lit(5).cast("bigint"), F.lit(None).cast("bigint")
    assert one(spark, account.limit_exceeded(five, five)) is True and one(spark, account.remaining_quota(five, five)) == 0
    assert one(spark, account.limit_exceeded(five, none)) is False and one(spark, account.remaining_quota(five, none)) == -1
    cost, markup = F.lit("1.000000").cast("decimal(12,6)"), F.lit("30.00").cast("decimal(5,2)")
    assert str(one(spark, account.billable_amount(cost, markup))) == "1.300000"
    money = [F.lit(v).cast("decimal(10,2)") for v in ("10.00", "96.00")]
    assert float(one(spark, account.annual_discount_pct(*money))) == 20.0


@pytest.mark.parametrize("held, required, want", [
    ("documents:all", "documents:read", True), ("documents:all", "users:read", False), ("admin:all", "users:read", True),
    ("users:read", "admin:all", False), ("documents:read", "documents:read", True),
])
def test_scope_satisfies(spark, held, required, want):
    assert one(spark, account.scope_satisfies(F.lit(held), F.lit(required))) is want


@pytest.mark.parametrize("raw, want", [
    ("Documents:Read", "documents:read"), ("documents", None), ("documents:", None), ("_documents:read", None),
    ("a:b:c", None), ("a:b", "a:b"), ("user_profile:update", "user_profile:update"),
])
def test_normalize_scope(spark, raw, want):
    assert one(spark, account.normalize_scope(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [
    ("ok@example.com", []), ("a b@example.com", ["spaces", "local_charset"]), ("noat.example.com", ["no_at"]),
    ("x@yopmail.com", ["disposable"]), ("a@b@c.com", ["many_at"]), ("a@b", ["domain_too_short", "no_tld"]),
    ("a@-b.c1", ["tld_not_letters", "domain_edge_hyphen"]),
])
def test_strict_email(spark, raw, want):
    assert one(spark, account.strict_email_reasons(F.lit(raw))) == want


def test_key_expires_at_its_boundary(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    assert one(spark, account.key_valid(F.lit(True), none, now, now)) is False
    assert one(spark, account.key_valid(F.lit(True), none, none, now)) is True


def test_geometry(spark):
    assert one(spark, geometry.row_band(F.lit(-5.0), F.lit(540.0), 15)) == 0
    assert one(spark, geometry.row_band(F.lit(539.9), F.lit(540.0), 15)) == 14
    assert one(spark, geometry.overlaps(*[F.lit(v) for v in (0, 0, 100, 100, 50, 50, 100, 100)])) is True
    assert one(spark, geometry.overlaps(*[F.lit(v) for v in (0, 0, 100, 100, 100, 0, 10, 10)])) is False
    rows = one(spark, geometry.fixed_rows(F.lit(544)))
    assert len(rows) == 15 and (rows[0]["y_start"], rows[-1]["y_end"]) == (15, 544)
    fitted = one(spark, geometry.fitted_size(F.lit(8000), F.lit(6000)))
    assert (fitted["w"], fitted["h"]) == (4000, 3000)


def test_match_summary(spark):
    m = F.array(F.struct(F.lit("first_name").alias("field_name"), F.lit(True).alias("match"), F.lit(0.9).alias("similarity"), F.lit("Ana").alias("compared")))
    assert one(spark, account.match_summary(m)) == "✓ first_name: Ana (90%)"
    assert one(spark, account.match_summary(F.slice(m, 1, 0))) == "Sin comparaciones disponibles"


def test_sequence_ratio_equals_difflib():
    rng = random.Random(11)
    def text(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    a, b = [], []
    for alphabet, n in (("01", 11), ("0123456789", 11), ("abé漢 ", 40), ("a", 6)):
        a += [text(alphabet, n) for _ in range(400)]
        b += [text(alphabet, n) for _ in range(400)]
    want = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    assert sequences.ratios(a, b, batch=97).tolist() == want
    bound = sequences.common_bound(a[:60], b[:60])
    assert all(bound[i, i] >= want[i] for i in range(60))


def test_sequence_ratio_of_null(spark):
    df = spark.createDataFrame([("12", None), (None, "3"), (None, None), ("", ""), ("12", "21")], "a string, b string")
    assert [r[0] for r in df.select(tx.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, None, 1.0, 0.5]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=30) | st.text("abc12", max_size=40), st.text("ab", max_size=30) | st.text("abc12é", max_size=40))
def test_automata_match_like_the_standard_library(a, b):
    blocks = difflib.SequenceMatcher(None, a, b, False).get_matching_blocks()
    assert sequences.matched_long(a, b) == sum(m.size for m in blocks) == sequences.matched([a], [b])[0]


def test_ratios_of_long_pairs():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    b = a[:400] + "".join(rng.choice("abcdefgh ") for _ in range(300)) + a[500:]
    want = difflib.SequenceMatcher(None, a, b, False).ratio()
    assert sequences.ratios([a, "x", a], [b, "x", ""]).tolist() == [want, 1.0, 0.0]
    far = "ab" * 20_000
    assert sequences.ratios([far], [far[1:]])[0] == 2 * (len(far) - 1) / (2 * len(far) - 1)
