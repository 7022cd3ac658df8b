"""SimHash document fingerprints of 128 bits, in DataFrame operations only.

Every occurrence of a term (two neighbouring words) votes for or against each bit with the term's hash, so a term weighs
as often as it occurs. Votes are counted sixteen bits to a lane, four lanes to a long, by ordinary sums over the exploded
terms; the lanes are opened once per document. Fingerprints within a Hamming radius are found through tables of blocks:
with more blocks than differing bits, one block is equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cotejo.plans.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
BITS = 128
LANES = 0x0001000100010001
#: Terms counted together; below 2**16, so no lane overflows.
CHUNK = 1 << 15
#: Documents meant for one bucket of neighbours.
BUCKET = 256
RADIUS = 3
BLOCKS = 4


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def terms(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words; of a single word alone; of the empty string without words."""
    def paired(words: Column) -> Column:
        pairs = F.transform(F.slice(words, 1, F.greatest(F.lit(1), F.size(words) - 1)),
                            lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
        return F.when(F.size(words) > 0, pairs).otherwise(F.array(F.xxhash64(F.lit(""))))

    return bound(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), paired)


def fingerprints(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """``keys`` and, for each text column c, the fingerprint as two longs ``c_0`` and ``c_1``. ``keys`` identify a row;
    rows with equal keys and texts come out as one. If ``rows`` are dealt by some of the keys, nothing is shuffled."""
    def numbered(kind: int, text: str) -> Column:
        return F.transform(terms(F.col(text)), lambda h, i: F.struct(
            F.lit(kind).alias("kind"), F.floor(i / CHUNK).cast("int").alias("chunk"), h.alias("h")))

    kinds = F.concat(*[numbered(k, c) for k, c in enumerate(texts)])
    votes = rows.select(*keys, F.explode(kinds).alias("t")).select(
        *keys, "t.kind", "t.chunk", F.col("t.h").alias("h0"), F.xxhash64("t.h").alias("h1"))
    sums = [F.sum(F.shiftrightunsigned(f"h{w}", s).bitwiseAND(F.lit(LANES))).alias(f"s{w}_{s}")
            for w in range(2) for s in range(16)]
    counted = votes.groupBy(*keys, "kind", "chunk").agg(F.count(F.lit(1)).alias("n"), *sums)
    # Bit i of word w: lane i / 16 of the sum with shift i % 16.
    def opened(sums: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function(
            "shiftrightunsigned", F.get(sums, F.floor(i / 64).cast("int") * 16 + i % 16),
            (F.floor((i % 64) / 16) * 16).cast("int")).bitwiseAND(F.lit(0xFFFF)))

    lanes = F.array(*[f"s{w}_{s}" for w in range(2) for s in range(16)])
    parts = counted.select(*keys, "kind", "n", bound(lanes, opened).alias("votes"))
    total = parts.groupBy(*keys, "kind").agg(F.sum("n").alias("n"), F.collect_list("votes").alias("votes"))
    first = F.get("votes", F.lit(0))
    added = F.when(F.size("votes") == 1, first).otherwise(F.aggregate(
        F.slice("votes", 2, F.greatest(F.size("votes") - 1, F.lit(0))), first,
        lambda a, b: F.zip_with(a, b, lambda x, y: x + y)))

    def word(votes: Column, w: int) -> Column:
        return F.aggregate(F.slice(votes, 64 * w + 1, 64), F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, 1).bitwiseOR(
            F.when(v * 2 > F.col("n"), 1).otherwise(0).cast("long")))

    both = bound(added, lambda votes: F.array(word(votes, 0), word(votes, 1)))
    voted = total.select(*keys, "kind", both.alias("f")).select(
        *keys, "kind", F.get("f", F.lit(0)).alias("f0"), F.get("f", F.lit(1)).alias("f1"))
    return voted.groupBy(*keys).agg(*[
        F.max(F.when(F.col("kind") == k, F.col(f"f{w}"))).alias(f"{c}_{w}") for k, c in enumerate(texts) for w in range(2)])


def as_text(c: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(f"{c}_{w}")), 16, "0") for w in range(2)]))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    apart = sum((F.bit_count(F.col(f"{a}_{w}").bitwiseXOR(F.col(f"{b}_{w}"))) for w in range(2)), F.lit(0))
    return F.lit(1.0) - apart / F.lit(float(BITS))


def next_lower(ids: DataFrame) -> DataFrame:
    """``id, lower`` for distinct longs ``id``: the next smaller one, null for the smallest. Buckets of about ``BUCKET`` ids
    by value, and buckets of those, so no task sorts more than one bucket in ``BUCKET`` squared."""
    size = ids.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    if size[0] <= BUCKET:
        return ids.withColumn("lower", F.lead("id").over(W.orderBy(F.col("id").desc())))
    width = max(1, -(-(size[2] - size[1] + 1) * BUCKET // size[0]))
    ids = ids.withColumn("b", F.expr(f"id div {width} - if(id < 0 and id % {width} <> 0, 1, 0)"))
    inside = ids.withColumn("lower", F.lead("id").over(W.partitionBy("b").orderBy(F.col("id").desc())))
    tops = staged(ids.groupBy("b").agg(F.max("id").alias("top")), "simhash-tops")
    below = next_lower(tops.select(F.col("b").alias("id"))).select(F.col("id").alias("bb"), F.col("lower").alias("lb"))
    across = below.join(tops, below.lb == tops.b).select("bb", F.col("top").alias("across"))
    joined = inside.join(across, inside.b == across.bb, "left")
    return joined.select("id", F.coalesce("lower", "across").alias("lower"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256``, the fingerprints ``own``, ``edited`` and ``next`` as pairs of longs.

    Documents stand by doc_id, descending, null last, equal ids by text; the next of the last is the first. The edited text
    of a document has its last floor(n_chars / 2) code points replaced by the first as many of the next one. Null texts
    are empty, and an empty text has the fingerprint of its single term, the empty string. A single document is its own
    next one; repeated rows follow each other. An empty table gives an empty one; other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    spread = (size[2] - size[1] + 1) if size[0] else 1
    width = max(1, -(-spread * BUCKET // max(size[0], 1)))
    bucket = F.expr(f"doc_id div {width} - if(doc_id < 0 and doc_id % {width} <> 0, 1, 0)")
    docs = docs.withColumn("none", F.col("doc_id").isNull()).withColumn("b", F.coalesce(bucket, F.lit(0).cast("long")))
    # The first document of each bucket also stands, as a copy, behind the last of the bucket above; the very first one
    # behind the very last.
    firsts = docs.groupBy("none", "b").agg(F.max("doc_id").alias("top"))
    firsts = staged(firsts, "simhash-firsts")
    follow = next_lower(firsts.filter("NOT none").select(F.col("b").alias("id")))
    named = firsts.filter("NOT none").select(F.col("b").alias("lower"), "top")
    moved = follow.filter("lower IS NOT NULL").join(named, "lower").select(
        F.lit(False).alias("to_none"), F.col("id").alias("to"), F.lit(False).alias("from_none"), "top")
    session = docs.sparkSession
    some_null = not firsts.filter("none").isEmpty()
    if size[0]:
        ends = firsts.filter("NOT none").agg(F.min("b").alias("low"), F.max("top").alias("top"))
        tail = ends.select(F.lit(some_null).alias("to_none"), F.when(F.lit(some_null), F.lit(0)).otherwise(F.col("low"))
                           .cast("long").alias("to"), F.lit(False).alias("from_none"), "top")
        moved = moved.union(tail)
        if some_null:
            moved = moved.union(ends.select(F.lit(False), F.col("low"), F.lit(True), F.lit(None).cast("long")))
    elif some_null:
        moved = moved.union(session.range(1).select(F.lit(True), F.lit(0).cast("long"), F.lit(True),
                                                    F.lit(None).cast("long")))
    moved = staged(moved, "simhash-moved")
    # Ids can repeat: the copy is the first of the rows with that id, by text.
    copies = docs.join(moved.withColumnRenamed("top", "at"), F.col("doc_id").eqNullSafe(F.col("at"))
                       & (F.col("none") == F.col("from_none")))
    copies = copies.groupBy("to_none", "to", "doc_id").agg(F.min("text").alias("text"))
    rows = docs.select("none", "b", "doc_id", "text", F.lit(0).alias("copy")).union(
        copies.select("to_none", "to", "doc_id", "text", F.lit(1)))
    order = W.partitionBy("none", "b").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                      F.substring(F.coalesce("after", F.lit("")), F.lit(1), half))
    rows = rows.select("none", "b", "rn", "copy", "doc_id", F.length("text").cast("long").alias("n_chars"),
                       F.col("text").alias("own"), edited.alias("edited"))
    rows = rows.withColumn("sha", F.sha2("edited", 256))
    prints = fingerprints(rows, ["none", "b", "rn", "copy", "doc_id", "n_chars", "sha"], ["own", "edited"])
    along = W.partitionBy("none", "b").orderBy("rn")
    for w in range(2):
        prints = prints.withColumn(f"next_{w}", F.lead(f"own_{w}").over(along))
    return prints.filter("copy = 0").select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"),
        *[f"{c}_{w}" for c in ("own", "edited", "next") for w in range(2)])


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs of distinct fingerprints ``q0, q1, i0, i1`` at most ``radius`` bits apart, the equal pair included.

    ``queries`` has ``q0, q1``, ``index`` has ``i0, i1``, both distinct. Each of the ``blocks`` equal parts of the bits has a
    table; since blocks outnumber the differing bits, every pair within the radius meets in one.
    """
    if blocks <= radius or BITS % blocks or 64 % (BITS // blocks):
        raise ValueError("blocks must outnumber the radius and divide the bits of each word")
    width = BITS // blocks
    mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")

    def keyed(df: DataFrame, a: str, b: str) -> DataFrame:
        keys = []
        for k in range(blocks):
            word, shift = divmod(k * width, 64)
            keys.append(F.struct(F.lit(k).alias("table"), F.shiftrightunsigned((a, b)[word], shift).bitwiseAND(mask)
                                 .alias("value")))
        return df.select(a, b, F.explode(F.array(*keys)).alias("k")).select(a, b, "k.table", "k.value")

    apart = F.bit_count(F.col("q0").bitwiseXOR(F.col("i0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("i1")))
    met = keyed(queries, "q0", "q1").join(keyed(index, "i0", "i1"), ["table", "value"])
    return met.filter(apart <= radius).select("q0", "q1", "i0", "i1").distinct()


def document_fingerprints(docs: DataFrame, every: int = 100) -> DataFrame:
    """The fingerprints as hex text with their likeness to the edited text's and the next document's, and for ids divisible
    by ``every`` the number ``n_within`` of other rows whose fingerprint is within the radius (null for other ids)."""
    rows = staged(edited_fingerprints(docs), "simhash-prints")
    index = rows.groupBy(F.col("own_0").alias("i0"), F.col("own_1").alias("i1")).agg(F.count(F.lit(1)).alias("n"))
    asked = rows.filter(F.col("doc_id") % every == 0).select(F.col("own_0").alias("q0"), F.col("own_1").alias("q1")).distinct()
    found = within_radius(asked, index.select("i0", "i1")).join(index, ["i0", "i1"])
    found = found.groupBy("q0", "q1").agg((F.sum("n") - 1).alias("found"))
    joined = rows.join(found, (F.col("own_0") == F.col("q0")) & (F.col("own_1") == F.col("q1")), "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"),
        as_text("edited").alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("found")).alias("n_within"))
