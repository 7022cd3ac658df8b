"""Tunable parameters, one frozen dataclass per concern."""

from __future__ import annotations

from dataclasses import dataclass, field

# How likely two handwritten digits are taken for one another.
CONFUSION = {
    "17": 0.15,
    "27": 0.12,
    "56": 0.10,
    "38": 0.08,
    "06": 0.08,
    "49": 0.07,
}

# Identifier lengths in order of preference, best first.
LENGTH_PRIORITY = {10: 3, 8: 2, 9: 1}


@dataclass(frozen=True)
class VoteParams:
    """Digit vote. ``min_agreement_ratio`` and ``max_conflict_ratio`` only flag, they never drop rows."""

    min_digit_confidence: float = 0.58
    min_agreement_ratio: float = 0.60
    confidence_boost: float = 0.03
    boost_cap: float = 0.99
    max_conflict_ratio: float = 0.40
    ambiguity_threshold: float = 0.10
    ambiguity_floor: float = 0.05
    relaxation: float = 0.10
    relaxing_confidence: float = 0.75
    label_weak: float = 0.70
    label_sure: float = 0.80
    allow_low_confidence_override: bool = True
    min_positional_ratio: float = 0.30
    repair_window: int = 2
    min_count_gap: int = 2
    confusion: dict = field(default_factory=lambda: dict(CONFUSION))
    length_priority: dict = field(default_factory=lambda: dict(LENGTH_PRIORITY))


@dataclass(frozen=True)
class LayoutParams:
    """Page geometry, in pixels."""

    cluster_dx: float = 350.0
    cluster_dy: float = 60.0
    row_band: float = 25.0
    left_margin: float = 50.0
    max_pair_distance: float = 2000.0
    below_limit: float = 50.0
    below_penalty: float = 2.0
    far_dx: float = 500.0
    far_penalty: float = 1.5
    vertical_weight: float = 2.0
    letter_ratio: float = 0.7
    expected_rows: int = 15
    header: int = 15
    min_row_height: int = 25
    crop_padding: int = 10
    name_column_a: float = 0.6
    name_column_b: float = 0.5
    empty_confidence: float = 0.30
