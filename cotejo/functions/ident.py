"""Identifier numbers, confidences and the predicates ("specifications") over them.

Specifications are plain boolean columns, so ``&``, ``|`` and ``~`` combine them and Catalyst pushes them down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def normalize_confidence(value: Column) -> Column:
    """Fraction in [0, 1]; values above 1 are percents; anything else is NULL."""
    fraction = F.when(value > 1.0, value / 100.0).otherwise(value)
    return F.when((fraction >= 0.0) & (fraction <= 1.0), fraction)


def confidence_level(c: Column) -> Column:
    return (
        F.when(c >= 0.95, "VERY_HIGH").when(c >= 0.85, "HIGH").when(c >= 0.70, "MEDIUM")
        .when(c >= 0.50, "LOW").otherwise("VERY_LOW")
    )


def is_high(c: Column, threshold: float = 0.85) -> Column:
    return c >= threshold


def is_acceptable(c: Column, threshold: float = 0.50) -> Column:
    return c >= threshold


def is_low(c: Column, threshold: float = 0.30) -> Column:
    return c < threshold


def format_confidence(c: Column, decimals: int = 0) -> Column:
    """Percent text such as ``86%``; halves round to even."""
    return F.format_string("%." + str(decimals) + "f%%", F.bround(c * 100.0, decimals))


def is_valid_id(value: Column, shortest: int = 3, longest: int = 11) -> Column:
    return F.coalesce(value.rlike("^[0-9]{%d,%d}$" % (shortest, longest)), F.lit(False))


def is_strict_id(value: Column) -> Column:
    return is_valid_id(value, 6, 11)


def is_colombian(value: Column) -> Column:
    return F.coalesce(value.rlike("^[1-9][0-9]{5,9}$"), F.lit(False))


def try_create(value: Column, allow_leading_zero: bool = True) -> Column:
    """The trimmed identifier, or NULL when it is not one."""
    t = F.trim(value)
    ok = is_valid_id(t)
    if not allow_leading_zero:
        ok = ok & ~t.startswith("0")
    return F.when(ok, t)


def from_raw_reading(value: Column) -> Column:
    return try_create(F.regexp_replace(value, "[^0-9]", ""))


def format_id(value: Column, separator: str = ".") -> Column:
    """Thousands grouping; leading zeros vanish."""
    return F.replace(F.format_number(value.cast("bigint"), 0), F.lit(","), F.lit(separator))


def mask_id(value: Column, shown: int = 3) -> Column:
    """Only the last digits, for output that leaves the trusted zone."""
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(value) - shown, F.lit(0))), F.right(value, F.lit(shown)))


def has_only_digits(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9]+$"), F.lit(False))


def has_length(value: Column, shortest: int = 3, longest: int = 11) -> Column:
    if shortest > longest:
        raise ValueError("shortest must not exceed longest")
    return F.coalesce(F.length(value).between(shortest, longest), F.lit(False))


def has_confidence(confidence: Column, percent: float) -> Column:
    return F.coalesce(confidence * 100.0 >= percent, F.lit(False))


def has_no_leading_zero(value: Column) -> Column:
    return F.coalesce(~value.startswith("0"), F.lit(False))


def all_of(*specs: Column) -> Column:
    return reduce(lambda a, b: a & b, specs)


def any_of(*specs: Column) -> Column:
    return reduce(lambda a, b: a | b, specs)


def valid_for_processing(value: Column, confidence: Column, percent: float = 50.0) -> Column:
    return all_of(has_only_digits(value), has_length(value), has_confidence(confidence, percent))


def colombian_spec(value: Column, confidence: Column, percent: float = 50.0) -> Column:
    return valid_for_processing(value, confidence, percent) & has_no_leading_zero(value)


def high_confidence_spec(value: Column, confidence: Column, percent: float = 85.0) -> Column:
    return valid_for_processing(value, confidence, percent)


def composite_spec(value: Column, confidence: Column, shortest: int = 3, longest: int = 11,
                   percent: float = 50.0, allow_leading_zero: bool = True) -> Column:
    spec = all_of(has_only_digits(value), has_length(value, shortest, longest), has_confidence(confidence, percent))
    return spec if allow_leading_zero else spec & has_no_leading_zero(value)


def record_is_valid(value: Column, confidence: Column, minimum: float = 0.5) -> Column:
    return is_valid_id(value) & F.coalesce(confidence >= minimum, F.lit(False))


def validation_tier(value: Column, confidence: Column) -> Column:
    """The strictest tier met: STRICT within MEDIUM within BASIC, else NONE."""
    basic = has_only_digits(value)
    medium = basic & has_length(value, 6, 15)
    strict = medium & has_confidence(confidence, 85.0)
    return F.when(strict, "STRICT").when(medium, "MEDIUM").when(basic, "BASIC").otherwise("NONE")


def clamp_unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
