"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame operations only.

Each document draws the key ``-ln(u) / weight`` (Efraimidis and Spirakis), ``u`` from a digest of its id. A source whose
target exceeds its size takes whole epochs first; the rest of the target goes to its documents by ascending key until the
word budget is used. The running sum is taken in two levels, bins of about ``BIN_ROWS`` keys and rows within a bin, so a
source that holds a third of all rows spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cotejo.plans.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Marks that prose hardly has; their share lowers a document's weight.
NOISE = r"[!*#$%&|<>{}^~=+_]"
CELLS = 32
BIN_ROWS = 1000


def quality_weight(text: Column, words: Column) -> Column:
    """1 for plain prose, less the more noise marks there are for each word; always positive."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * F.regexp_count(text, F.lit(NOISE)) / F.greatest(words, F.lit(1)))


def targets(sizes: DataFrame, share: float, cycle: tuple[float, ...], cap: float) -> DataFrame:
    """Adds ``target`` to a table of one row per source (``source``, ``source_size``).

    Sources by code point, null last, weigh ``cycle`` in turn and divide ``share`` of all words; none gets more than
    ``cap`` times its size, and what it leaves is divided again by weight until none is above.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), turn + 1))
    full = F.lit(float(cap)) * F.col("source_size")
    by_ratio = W.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    # The level if exactly the sources before this one were full; the true level is the largest of these.
    level = (total - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (ranked.withColumn("level", level)
            .withColumn("target", F.least(full, F.col("weight") * F.max("level").over(everything)))
            .drop("level", "weight"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5,
                cycle: tuple[float, ...] = (3.0, 1.0, 2.0), cap: float = 2.0, seed: str = "mix", digest: bool = False) -> DataFrame:
    """One row per input row: the key, ``size`` (words; 0 for a null text), ``source``, ``source_size``, ``target`` of its
    source, and ``taken``, the words the mix takes from it, repeats counted.

    ``taken`` sums to the target of each source, to the word. A null source is a source of its own, last in order; null
    keys draw like a key of their own; rows of equal key and size are interchangeable. A document without words takes 0,
    as does everything when all are empty. An empty table gives an empty one; other columns are not read. ``digest`` adds
    ``text_digest``, which tells rows of equal key, source and size apart.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), body.alias("body"))
    told = ["text_digest"] * digest
    rows = rows.withColumn("size", F.regexp_count("body", F.lit(WORD)).cast("long"))
    code = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("-")), F.col("size")))
    draw = (F.conv(F.substring(code, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))
    rows = rows.withColumns({c: F.xxhash64("body") for c in told})
    rows = staged(rows.select("key", "source", "size", *told, (
        -F.log(draw) / quality_weight(F.col("body"), F.col("size"))).alias("draw")), "mix-rows")

    steps = [F.lit((i + 1) / CELLS) for i in range(CELLS)]
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"),
        F.percentile_approx("draw", F.array(*steps), F.lit(40 * CELLS)).alias("splits"))
    sizes = staged(targets(sizes, share, cycle, cap).select(
        F.col("source").alias("of"), "source_size", "target", "splits",
        F.ceil(F.col("n") / (CELLS * BIN_ROWS)).cast("int").alias("parts"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"),
    ).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-sources")

    binned = rows.join(sizes, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    binned = binned.withColumn("cell", F.size(F.filter("splits", lambda x: x < F.col("draw"))))
    low = F.when(F.col("cell") > 0, F.try_element_at("splits", F.col("cell"))).otherwise(0.0)
    high = F.coalesce(F.try_element_at("splits", F.col("cell") + 1), low)
    inside = F.when(high > low, F.floor((F.col("draw") - low) / (high - low) * F.col("parts"))).otherwise(0)
    binned = binned.withColumn("part", F.greatest(F.lit(0), F.least(inside, F.col("parts") - 1)).cast("int")).drop("splits")

    bins = binned.groupBy("source", "cell", "part").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy("source").orderBy("cell", "part").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("of"), F.col("cell").alias("c"), F.col("part").alias("p"),
                       F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("bin_before"))
    within = W.partitionBy("source", "cell", "part").orderBy("draw", "key", "size", *told).rowsBetween(W.unboundedPreceding, -1)
    placed = binned.withColumn("row_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(bins, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("c"))
                         & (F.col("part") == F.col("p")))
    left = F.col("rest") - F.col("bin_before") - F.col("row_before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select(F.col("key").alias(key), "size", F.col("source").alias(source), "source_size", "target",
                         taken.cast("long").alias("taken"), *told)


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document appears once for each whole time the mix takes it, and once
    more if at least half of it is left over. Rows that share key, source and text appear as often as the mix takes all of
    them together, spread evenly."""
    counts = mix_sources(docs, key=key, source=source, text=text, digest=True, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    same = (counts.withColumn("times", times).groupBy(key, source, "text_digest")
            .agg(F.round(F.avg("times")).cast("int").alias("_times")).toDF("_key", "_source", "_digest", "_times"))
    met = (F.col(key).eqNullSafe(F.col("_key")) & F.col(source).eqNullSafe(F.col("_source"))
           & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_digest")))
    kept = docs.join(same.filter("_times > 0"), met)
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = f"""
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         len(regexp_extract_all(coalesce(text, ''), '{NOISE}')) AS noise FROM documents),
drawn AS (
  SELECT *, -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size), 1, 13)
                 AS BIGINT) + 0.5e0) / 4503599627370496e0)
            / (1e0 / (1e0 + 10e0 * noise / greatest(size, 1))) AS draw FROM rows_),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM drawn GROUP BY source),
weighed AS (
  SELECT *, [3e0, 1e0, 2e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS weight,
         2e0 * source_size AS full_ FROM sizes),
levels AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(full_) OVER (
               ORDER BY full_ / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_ / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (SELECT source, source_size, least(full_, weight * max(level) OVER ()) AS target FROM levels),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals),
summed AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.epochs,
         CAST(round(r.target - r.epochs * r.source_size) AS BIGINT) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM drawn d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM summed"""
