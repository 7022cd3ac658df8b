"""The full reconciliation of two recognisers' detection lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cotejo.operators.pairing import one_list, pair_placed, place_lists, unpaired_remainder
from cotejo.operators.reconcile import dedupe_best, dense_position
from cotejo.operators.voting import combine_pairs
from cotejo.params import VoteParams


def reading_list(detections: DataFrame, side: str) -> DataFrame:
    """De-duplicated detections of one side as a dense list: form_id, pos, <side>_id, <side>_conf, <side>_digits."""
    best = dedupe_best(detections.select("form_id", "id_number", "ord", "confidence", "digit_conf"))
    listed = dense_position(best)
    return listed.select(
        "form_id", "pos", F.col("id_number").alias(f"{side}_id"), F.col("confidence").alias(f"{side}_conf"),
        F.col("digit_conf").alias(f"{side}_digits"),
    )


def reconcile(detections_a: DataFrame, detections_b: DataFrame, p: VoteParams = VoteParams()) -> DataFrame:
    """form_id, part, pos, outcome, id_number, confidence: combined pairs in form order (part 0), then the unpaired
    rest of A (1) and of B (2). A form read by one recogniser only, by at most ``min_count_gap`` rows, gives nothing."""
    placed = place_lists(reading_list(detections_a, "a"), reading_list(detections_b, "b"), p)
    pairs = pair_placed(placed, p)
    combined = combine_pairs(pairs, "form_id", "pos", "b_pos", p=p).select(
        "form_id", F.lit(0).alias("part"), "pos", "outcome", "id_number", "confidence"
    )
    return combined.unionByName(unpaired_remainder(one_list(placed, "a"), one_list(placed, "b"), pairs, p))


def reconcile_by_position(detections_a: DataFrame, detections_b: DataFrame, p: VoteParams = VoteParams()) -> DataFrame:
    """The variant without repair: position i of A always pairs with position i of B."""
    a, b = reading_list(detections_a, "a"), reading_list(detections_b, "b")
    return combine_pairs(a.join(b, ["form_id", "pos"]), "form_id", "pos", p=p).select(
        "form_id", "pos", "outcome", "id_number", "confidence"
    )
