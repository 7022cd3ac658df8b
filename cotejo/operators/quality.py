"""Image-quality metrics over a table of grey pixels (image_id, stage, y, x, v).

An image is cut into tiles, each with a rim of two pixels of its neighbours, so every filter is computed inside a tile and
pixels are dealt once. Sums of whole numbers leave a tile; the metrics follow from them exactly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

METRICS = ("sharpness", "contrast", "brightness", "noise_level")
TILE = 128
#: Reach of the widest filter.
RIM = 2
#: Sum of the absolute Sobel gradients from which on a pixel lies on an edge.
EDGE = 400
_SUMS = ("n", "v", "v2", "l", "l2", "noise", "edges")


def _mirrored(low: int, high: int, first: int, last: int) -> np.ndarray:
    """Places low - RIM .. high + RIM, those beyond the image's first and last mirrored around these."""
    at = np.arange(low - RIM, high + RIM + 1)
    at = np.where(at < first, 2 * first - at, at)
    return np.where(at > last, 2 * last - at, at)


def tile_sums(y: np.ndarray, x: np.ndarray, v: np.ndarray, top: int, left: int, size: int, edge: int) -> tuple[int, ...]:
    """Sums over the pixels of one tile at (top, left), given with its rim. Missing rows and columns around it lie outside
    the image."""
    y0, x0, y1, x1 = (int(f(c)) for f in (np.min, np.max) for c in (y, x))
    bottom, right = min(y1, top + size - 1), min(x1, left + size - 1)
    if bottom < top or right < left:
        return (0,) * len(_SUMS)
    grid = np.zeros((y1 - y0 + 1, x1 - x0 + 1), np.int64)
    grid[y - y0, x - x0] = v
    p = grid[np.ix_(_mirrored(top, bottom, y0, y1) - y0, _mirrored(left, right, x0, x1) - x0)]
    core = p[2:-2, 2:-2]
    laplacian = p[1:-3, 2:-2] + p[3:-1, 2:-2] + p[2:-2, 1:-3] + p[2:-2, 3:-1] - 4 * core
    across = p[:, :-4] + 4 * p[:, 1:-3] + 6 * p[:, 2:-2] + 4 * p[:, 3:-1] + p[:, 4:]
    blur = (across[:-4] + 4 * across[1:-3] + 6 * across[2:-2] + 4 * across[3:-1] + across[4:] + 128) >> 8
    rows = p[1:-3] + 2 * p[2:-2] + p[3:-1]
    columns = p[:, 1:-3] + 2 * p[:, 2:-2] + p[:, 3:-1]
    gradient = np.abs(rows[:, 3:-1] - rows[:, 1:-3]) + np.abs(columns[3:-1] - columns[1:-3])
    return (core.size, int(core.sum()), int((core * core).sum()), int(laplacian.sum()), int((laplacian * laplacian).sum()),
            int(np.abs(core - blur).sum()), int((gradient >= edge).sum()))


def _tiles(pixels: DataFrame, size: int) -> DataFrame:
    """One row per tile: its place and the pixels in it and around it, at most (size + 4)^2."""
    def touched(c: str) -> Column:
        first, last = F.floor((F.col(c) - RIM) / size), F.floor((F.col(c) + RIM) / size)
        return F.filter(F.sequence(first, last), lambda t: t >= 0)

    dealt = pixels.withColumn("ty", F.explode(touched("y"))).withColumn("tx", F.explode(touched("x")))
    packed = F.collect_list(F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("y", "x", "v")])).alias("p")
    return dealt.groupBy("image_id", "stage", "ty", "tx").agg(packed)


def pixel_metrics(pixels: DataFrame, size: int = TILE, edge: int = EDGE) -> DataFrame:
    """Per image and stage: brightness (mean), contrast (population deviation), sharpness (variance of the 4-neighbour
    Laplacian), noise (mean distance to a 5x5 binomial blur) and edge density (share of pixels whose Sobel gradients sum to
    ``edge``). Beyond an edge the image is mirrored around its last pixels. Images are whole, at least 3 pixels wide and high,
    their values whole numbers."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for ty, tx, p in zip(batch.column("ty").to_pylist(), batch.column("tx").to_pylist(), batch.column("p")):
                y, x, v = (p.values.field(c).to_numpy() for c in ("y", "x", "v"))
                sums.append(tile_sums(y, x, v, ty * size, tx * size, size, edge))
            columns = list(zip(*sums)) or [()] * len(_SUMS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("image_id"), batch.column("stage"), *[pa.array(c, pa.int64()) for c in columns]],
                names=["image_id", "stage", *_SUMS])

    kinds = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in ("image_id", "stage"))
    sums = _tiles(pixels, size).mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} bigint" for c in _SUMS))
    total = sums.groupBy("image_id", "stage").agg(*[F.sum(c).cast("decimal(18,0)").alias(c) for c in _SUMS])

    def variance(one: str, two: str) -> Column:
        squares = F.col("n") * F.col(two) - F.col(one) * F.col(one)
        return squares.cast("double") / (F.col("n") * F.col("n")).cast("double")

    def mean(c: str) -> Column:
        return F.col(c).cast("double") / F.col("n").cast("double")

    return total.select(
        "image_id", "stage", variance("l", "l2").alias("sharpness"), F.sqrt(variance("v", "v2")).alias("contrast"),
        mean("v").alias("brightness"), mean("noise").alias("noise_level"), mean("edges").alias("edge_density"))


def compare_stages(metrics: DataFrame, before: str = "original", after: str = "processed") -> DataFrame:
    """Improvement in percent per metric; less noise is better; 0 when the original value is not positive."""
    def stage(name: str, prefix: str) -> DataFrame:
        return metrics.filter(F.col("stage") == name).select("image_id", *[F.col(m).alias(f"{prefix}_{m}") for m in METRICS])

    def gain(m: str) -> Column:
        old, new = F.col(f"old_{m}"), F.col(f"new_{m}")
        change = (old - new) if m == "noise_level" else (new - old)
        return F.when(old > 0, change / old * 100).otherwise(F.lit(0.0)).alias(f"{m}_gain")

    return stage(before, "old").join(stage(after, "new"), "image_id").select("image_id", *[gain(m) for m in METRICS])
