"""Points, rectangles, page rows and image sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def manhattan(x1, y1, x2, y2) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def within_bounds(x, y, left, top, right, bottom) -> Column:
    """Half-open on the right and bottom edges."""
    return (x >= left) & (x < right) & (y >= top) & (y < bottom)


def translate(x, y, dx, dy) -> Column:
    """The moved point, or NULL when a coordinate would turn negative."""
    return F.when((x + dx >= 0) & (y + dy >= 0), F.struct((x + dx).alias("x"), (y + dy).alias("y")))


def corners(x, y, w, h) -> Column:
    def point(px, py):
        return F.struct(px.alias("x"), py.alias("y"))

    return F.struct(
        point(x, y).alias("top_left"),
        point(x + w, y).alias("top_right"),
        point(x, y + h).alias("bottom_left"),
        point(x + w, y + h).alias("bottom_right"),
    )


def center(x, y, w, h) -> Column:
    return F.struct((x + F.floor(w / 2)).alias("x"), (y + F.floor(h / 2)).alias("y"))


def area(w, h) -> Column:
    return w * h


def contains(x, y, w, h, px, py) -> Column:
    return within_bounds(px, py, x, y, x + w, y + h)


def overlaps(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    return ~((ax + aw <= bx) | (bx + bw <= ax) | (ay + ah <= by) | (by + bh <= ay))


def row_band(y, page_height, rows: int) -> Column:
    """Row of a uniform grid, clamped to the grid. ``y`` is truncated towards zero like an integer cast."""
    raw = (y / (page_height / F.lit(float(rows)))).cast("int")
    return F.greatest(F.lit(0), F.least(raw, F.lit(rows - 1)))


def fixed_rows(page_height, header: int = 15, rows: int = 15, min_height: int = 25) -> Column:
    """Array of row spans below the header; rows thinner than ``min_height`` are dropped."""
    step = (page_height - F.lit(header)) / F.lit(float(rows))

    def edge(i):
        return (F.lit(header) + i * step).cast("int")

    spans = F.transform(
        F.sequence(F.lit(0), F.lit(rows - 1)),
        lambda i: F.struct(i.alias("row_index"), edge(i).alias("y_start"), edge(i + 1).alias("y_end")),
    )
    return F.filter(spans, lambda s: s["y_end"] - s["y_start"] >= min_height)


def crop_span(y_start, y_end, page_height, padding: int = 10) -> Column:
    return F.struct(
        F.greatest(F.lit(0), y_start - padding).alias("y_start"),
        F.least(page_height, y_end + padding).alias("y_end"),
    )


def uniform_slices(page_height, rows: int, min_height: int = 5) -> Column:
    """Equal integer slices from the top; slices of ``min_height`` or less are dropped."""
    step = F.floor(page_height / F.lit(rows)).cast("int")
    slices = F.transform(
        F.sequence(F.lit(0), F.lit(rows - 1)),
        lambda i: F.struct(
            i.alias("row_index"), (i * step).alias("y_start"),
            F.least((i + 1) * step, page_height).alias("y_end"),
        ),
    )
    return F.filter(slices, lambda s: s["y_end"] - s["y_start"] > min_height)


def size_problem(w, h, min_w: int = 100, min_h: int = 100, max_w: int = 10000, max_h: int = 10000) -> Column:
    """Reason an image size is refused, or an empty string."""
    small = F.format_string("too small: %dx%d (min %dx%d)", w, h, F.lit(min_w), F.lit(min_h))
    large = F.format_string("too large: %dx%d (max %dx%d)", w, h, F.lit(max_w), F.lit(max_h))
    return (
        F.when((w < min_w) | (h < min_h), small).when((w > max_w) | (h > max_h), large).otherwise(F.lit(""))
    )


def fitted_size(w, h, max_w: int = 4000, max_h: int = 4000) -> Column:
    """Size after shrinking to the limits, keeping the aspect ratio; unchanged when already within them."""
    # A side of length 0 sets no limit; ``least`` passes over its NULL.
    ratio = F.least(F.lit(float(max_w)) / F.nullif(w, F.lit(0)), F.lit(float(max_h)) / F.nullif(h, F.lit(0)))
    fits = (w <= max_w) & (h <= max_h)
    return F.struct(
        F.when(fits, w).otherwise((w * ratio).cast("int")).alias("w"),
        F.when(fits, h).otherwise((h * ratio).cast("int")).alias("h"),
    )
