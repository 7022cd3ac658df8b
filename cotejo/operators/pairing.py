"""Positional pairing of two reading lists with a small repair window (+-2 by default), exact for forms of any length.

Position i of A pairs with position i of B when they are similar enough. Otherwise A takes the most similar B reading
in the window that nobody took before (first wins ties), or is forced onto position i. "Nobody before" makes the
repair sequential, but its memory is short: with a window of w, what matters at i is which of i-w..i+w-1 are taken. That
is 2w bits, so a long form is cut into chunks, each chunk is a function from 4**w possible states to as many, and only
chunks whose last rows need repair have to be chained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cotejo.functions.text import sequence_ratio, surely_similar
from cotejo.params import VoteParams
from cotejo.plans.staging import staged

DEFAULT = VoteParams()
CHUNK = 512
# The wider the window, the more states a chunk is folded for.
WIDEST_WINDOW = 5

_PICKS = "array<struct<pos:bigint,step:int>>"


def settled(window: int) -> int:
    """Bits for i-w..i-1: the state after w or more positional pairs, and at the start of a form."""
    return (1 << window) - 1


def _shift_right(bits: Column, n: Column) -> Column:
    return F.call_function("shiftright", bits, F.least(n, F.lit(30)).cast("int"))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), n.cast("int"))


def _advance(bits: Column, gap: Column, window: int) -> Column:
    """Taken bits seen from ``gap`` positions further on; the positions jumped over paired positionally."""
    jumped = F.lit(settled(window))
    for n in range(window - 1, -1, -1):
        jumped = F.when(gap == n + 1, ((1 << n) - 1) << (window - n)).otherwise(jumped)
    return _shift_right(bits, gap).bitwiseOR(jumped.cast("int"))


def _fold(weak: Column, start: Column, entry: Column, window: int) -> Column:
    """Walk one chunk's weak positions in order. ``entry`` holds the bits for start-w..start+w-1."""
    zero = F.struct(
        (start - 1).alias("prev"), (entry * 2).cast("int").alias("bits"), F.array().cast(_PICKS).alias("picks")
    )

    def step(acc: Column, w: Column) -> Column:
        def with_bits(bits: Column) -> Column:
            free = F.filter(w["steps"], lambda s: _shift_right(bits, s + window).bitwiseAND(1) == 0)
            return F.struct(bits.alias("bits"), F.try_element_at(free, F.lit(1)).alias("step"))

        def taken(s: Column) -> Column:
            return F.struct(
                w["pos"].alias("prev"),
                s["bits"].bitwiseOR(_bit(F.coalesce(s["step"], F.lit(0)) + window)).cast("int").alias("bits"),
                F.concat(acc["picks"], F.array(F.struct(w["pos"].alias("pos"), s["step"].alias("step")))).alias("picks"),
            )

        bits = F.array(_advance(acc["bits"], w["pos"] - acc["prev"], window).cast("int"))
        return F.transform(F.transform(bits, with_bits), taken)[0]

    return F.aggregate(weak, zero, step)


def _exit_bits(folded: Column, end: Column, window: int) -> Column:
    return _advance(folded["bits"], end - folded["prev"], window).bitwiseAND((1 << 2 * window) - 1).cast("int")


def _entry_states(open_end: DataFrame, start: int) -> DataFrame:
    """``form_id, chunk, entry`` of every chunk that follows one with an open end.

    A run of chunks with open ends is one function after the other. Spans of them are composed in joins, each round with the
    span that ends where one's own begins, so a run of n chunks takes about log n rounds and no task sees a whole form."""
    spans = staged(open_end.withColumn("first", F.col("chunk")), "spans")
    while True:
        before = spans.select("form_id", (F.col("chunk") + 1).alias("first"), F.col("first").alias("earlier"),
                              F.col("exits").alias("inner"))
        met = spans.join(before, ["form_id", "first"], "left")
        if met.filter(F.col("earlier").isNotNull()).isEmpty():
            return spans.select("form_id", (F.col("chunk") + 1).alias("chunk"), F.col("exits")[start].alias("entry"))
        through = F.transform("inner", lambda s: F.col("exits")[s])
        spans = staged(met.select("form_id", "chunk", F.when(F.col("earlier").isNull(), F.col("exits")).otherwise(through)
                                  .alias("exits"), F.coalesce("earlier", "first").alias("first")), "spans")


def resolve_repairs(weak: DataFrame, chunk: int = CHUNK, window: int = DEFAULT.repair_window) -> DataFrame:
    """``weak``: form_id, pos, steps (window offsets of usable B positions, best first). Returns form_id, pos, step;
    a NULL step is a forced positional pair."""
    if not 0 <= window <= WIDEST_WINDOW:
        raise ValueError(f"the repair window must lie between 0 and {WIDEST_WINDOW}")
    pieces = weak.groupBy("form_id", F.floor(F.col("pos") / chunk).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "steps"))).alias("weak")
    )
    pieces = pieces.withColumns({"start": F.col("chunk") * chunk, "end": (F.col("chunk") + 1) * chunk})
    last = F.element_at("weak", -1)["pos"]
    open_end = pieces.filter(last >= F.col("end") - window).select(
        "form_id", "chunk",
        F.transform(
            F.sequence(F.lit(0), F.lit((1 << 2 * window) - 1)),
            lambda s: _exit_bits(_fold(F.col("weak"), F.col("start"), s, window), F.col("end"), window),
        ).alias("exits"),
    )
    entries = _entry_states(open_end, settled(window))
    entered = pieces.join(entries, ["form_id", "chunk"], "left")
    folded = _fold(F.col("weak"), F.col("start"), F.coalesce("entry", F.lit(settled(window))), window)
    return entered.select("form_id", F.explode(folded["picks"]).alias("p")).select("form_id", "p.pos", "p.step")


def place_lists(a: DataFrame, b: DataFrame, p: VoteParams = DEFAULT) -> DataFrame:
    """The two lists side by side as one staged table, a row for each form_id and pos that either has: their columns, ``in_a``,
    ``in_b``, and ``unsure`` where both are there and no common prefix or suffix proves them similar. The wide rows are exchanged
    here only; sure pairs and single readings are filters of this table."""
    met = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), ["form_id", "pos"], "full_outer")
    met = met.withColumns({"in_a": F.coalesce("in_a", F.lit(False)), "in_b": F.coalesce("in_b", F.lit(False))})
    a_id, b_id = F.col("a_id"), F.col("b_id")
    unsure = F.col("in_a") & F.col("in_b") & ~surely_similar(a_id, b_id, p.min_positional_ratio)
    return staged(met.withColumn("unsure", unsure), "lists")


def one_list(placed: DataFrame, side: str) -> DataFrame:
    """The list of ``side`` out of :func:`place_lists`."""
    return placed.filter(F.col(f"in_{side}")).select("form_id", "pos", *[c for c in placed.columns if c.startswith(f"{side}_")])


def _repaired(weak: DataFrame, placed: DataFrame, p: VoteParams, chunk: int) -> DataFrame:
    """The pairs of weak positions. They are few, so the B readings around them are staged with all they hold, and every later
    step starts from short tables."""
    a_columns, b_columns = ([c for c in placed.columns if c.startswith(f"{side}_")] for side in "ab")
    weak = weak.select("form_id", "pos", *a_columns)
    window = F.explode(F.array(*[F.lit(k) for k in range(-p.repair_window, p.repair_window + 1)]))
    near = weak.select("form_id", "pos", "a_id", window.alias("step")).withColumn("b_pos", F.col("pos") + F.col("step"))
    tried = near.join(one_list(placed, "b").withColumnRenamed("pos", "b_pos"), ["form_id", "b_pos"])
    tried = staged(tried.withColumn("ratio", sequence_ratio(F.col("a_id"), F.col("b_id"))).drop("a_id"), "tried")
    usable = F.when(F.col("ratio") > 0, F.struct((-F.col("ratio")).alias("r"), F.col("step").alias("step")))
    steps = tried.groupBy("form_id", "pos").agg(
        F.transform(F.sort_array(F.collect_list(usable)), lambda s: s["step"]).alias("steps")
    )
    picks = resolve_repairs(staged(steps, "steps"), chunk, p.repair_window).select(
        "form_id", "pos", F.coalesce("step", F.lit(0)).alias("step"),
        F.when(F.col("step").isNull(), "forced").otherwise("repaired").alias("how"),
    )
    found = picks.join(tried.select("form_id", "pos", "step", "b_pos", *b_columns), ["form_id", "pos", "step"])
    pairs = weak.join(found, ["form_id", "pos"]).select("form_id", "b_pos", "pos", *a_columns, "how", *b_columns)
    return staged(pairs, "repairs")


def pair_placed(placed: DataFrame, p: VoteParams = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """:func:`pair_readings` of lists that :func:`place_lists` put side by side. Python sees the unsure pairs only."""
    unsure = placed.filter("unsure").withColumn("ratio", sequence_ratio(F.col("a_id"), F.col("b_id")))
    weak = F.coalesce(F.col("ratio") < p.min_positional_ratio, F.lit(False))
    judged = staged(unsure.withColumn("weak", weak).drop("ratio"), "judged")
    repaired = _repaired(judged.filter("weak"), placed, p, chunk)
    sure = placed.filter(F.col("in_a") & F.col("in_b") & ~F.col("unsure")).unionByName(judged.filter(~F.col("weak")).drop("weak"))
    return sure.withColumns({"b_pos": F.col("pos"), "how": F.lit("positional")}).select(repaired.columns).unionByName(repaired)


def pair_readings(a: DataFrame, b: DataFrame, p: VoteParams = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """Pairs of A and B readings (form_id, pos, a_id/a_conf/a_digits, b_*): adds ``b_pos`` and ``how`` (positional,
    repaired, forced). A B reading may serve two pairs: positional and forced pairs do not check for earlier use."""
    return pair_placed(place_lists(a, b, p), p, chunk)


def unpaired_remainder(a: DataFrame, b: DataFrame, pairs: DataFrame, p: VoteParams = DEFAULT) -> DataFrame:
    """Readings whose value is in no pair, for forms whose two lists differ by more than ``min_count_gap`` rows."""
    signed = a.select("form_id", F.lit(1).alias("s")).unionByName(b.select("form_id", F.lit(-1).alias("s")))
    uneven = signed.groupBy("form_id").agg(F.sum("s").alias("gap")).filter(F.abs("gap") > p.min_count_gap)
    odd = staged(uneven.select("form_id"), "uneven")

    def rest(df: DataFrame, side: str, part: int) -> DataFrame:
        sure = df.filter(F.col(f"{side}_conf") * 100 >= p.min_digit_confidence * 100)
        used = pairs.select("form_id", f"{side}_id").join(odd, "form_id", "left_semi")
        left = sure.join(odd, "form_id", "left_semi").join(used, ["form_id", f"{side}_id"], "left_anti")
        return left.select(
            "form_id", F.lit(part).alias("part"), "pos", F.lit(f"unpaired_{side}").alias("outcome"),
            F.col(f"{side}_id").alias("id_number"), F.col(f"{side}_conf").alias("confidence"),
        )

    return rest(a, "a", 1).unionByName(rest(b, "b", 2))
