"""Rectangle and grid arithmetic as Column -> Column expressions.

Integer results truncate toward zero, as a cast does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ROW_HEIGHT = 53
DISPLAY_BOX = 87
WEEKDAYS = ("Mo", "Di", "Mi", "Do", "Fr", "Sa")


def rounded(c: Column, places: int) -> Column:
    """Rounding in binary arithmetic: a decimal that only looks like a half isn't one."""
    return F.floor(c * 10.0**places + 0.5) / 10.0**places


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(
        x.cast("int").alias("x"), y.cast("int").alias("y"), width.cast("int").alias("width"), height.cast("int").alias("height")
    )


def scaled(r: Column, sx: Column, sy: Column) -> Column:
    """A rectangle scaled, every edge truncated on its own."""
    return rect(r["x"] * sx, r["y"] * sy, r["width"] * sx, r["height"] * sy)


def display_box(r: Column, sx: Column, sy: Column, box: int = DISPLAY_BOX) -> Column:
    """Unscaled box of fixed size centred on the rectangle; halves are floored."""
    w, h = (r["width"] / sx).cast("int"), (r["height"] / sy).cast("int")
    x = (r["x"] / sx).cast("int") - F.floor((F.lit(box) - w) / 2.0)
    y = (r["y"] / sy).cast("int") - F.floor((F.lit(box) - h) / 2.0)
    return rect(x, y, F.lit(box), F.lit(box))


def bounds(bbox: Column) -> Column:
    """Smallest upright rectangle around the corners ``[[x, y], …]``."""
    xs, ys = F.transform(bbox, lambda p: p[0]), F.transform(bbox, lambda p: p[1])
    return rect(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def grid_index(position: Column, cell: Column, count: Column) -> Column:
    """Index of the grid cell, the last one for positions beyond."""
    return F.least((position / cell).cast("int"), count - 1)


def row_of(middle: Column, offset: Column, height: Column) -> Column:
    """Row a position falls in; positions less than a row above the first are in it."""
    return ((middle + offset) / height).cast("int")


def weekday(index: Column, names: Sequence[str] = WEEKDAYS, shift: int = 3) -> Column:
    """Name of an input column, ``Col{index + shift}`` beyond the weekdays."""
    known = F.array(*[F.lit(n) for n in names])
    return F.when(index < len(names), F.element_at(known, index + 1)).otherwise(
        F.concat(F.lit("Col"), (index + shift).cast("string"))
    )


def field_class(aspect: Column, area: Column) -> Column:
    """Kind of a form field by shape; limits are strict, the first that holds counts."""
    return (
        F.when(aspect > 5, "text_line")
        .when(aspect > 2, "text_field")
        .when((aspect > 0.8) & (aspect < 1.2) & (area < 2000), "checkbox")
        .when(area > 10000, "text_area")
        .otherwise("unknown")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, rounded to four digits; a tiny term keeps zeros apart from division."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10), 4)


def strip_bounds(y: Column, height: Column, page: Column, fine: bool = True) -> tuple[Column, Column]:
    """Top and bottom of the text strip around ``y``, kept on the page.

    ``fine`` uses the exact half of the height and truncates, else the half is
    floored first.
    """
    half = height / 2.0 if fine else F.floor(height / 2.0)
    return F.greatest((y - half).cast("int"), F.lit(0)), F.least((y + half).cast("int"), page)


def inset(r: Column, width: Column, height: Column, by: int = 3) -> Column:
    """Cell rectangle clamped to the page and shrunk; null where nothing is left."""
    x1, y1 = F.greatest(r["x"], F.lit(0)) + by, F.greatest(r["y"], F.lit(0)) + by
    x2, y2 = F.least(r["x"] + r["width"], width) - by, F.least(r["y"] + r["height"], height) - by
    ok = (r["width"] > 0) & (r["height"] > 0) & (x2 > x1) & (y2 > y1)
    return F.when(ok, rect(x1, y1, x2 - x1, y2 - y1))


def half_up(c: Column) -> Column:
    """Rounding of the zone editor: halves go up."""
    return F.floor(c + 0.5).cast("int")


def to_template(r: Column, fx: Column, fy: Column) -> Column:
    """Editor zone in template coordinates; far edges are rounded from the sums, sizes on their own."""
    return F.struct(
        half_up(r["x"] * fx).alias("x_min"), half_up(r["y"] * fy).alias("y_min"),
        half_up((r["x"] + r["width"]) * fx).alias("x_max"), half_up((r["y"] + r["height"]) * fy).alias("y_max"),
        half_up(r["width"] * fx).alias("width"), half_up(r["height"] * fy).alias("height"),
    )


# Header region by rotation as shares of the page (x from, x to, y from, y to).
HEADER_REGIONS = {0: (0.0, 0.4, 0.0, 0.12), -90: (0.0, 0.12, 0.6, 1.0), 90: (0.88, 1.0, 0.0, 0.4), 180: (0.6, 1.0, 0.88, 1.0)}


def header_key(rotation: Column) -> Column:
    """Rotation to the nearest quarter turn; turns without a region are 0."""
    quarter = (F.bround(rotation / 90.0) * 90).cast("int")
    return F.when(quarter.isin(*HEADER_REGIONS), quarter).otherwise(0)


def header_bounds(rotation: Column, width: Column, height: Column) -> Column:
    """Rectangle of the header for a page of the given size and rotation, edges truncated."""
    key, out = header_key(rotation), None
    for angle, (x1, x2, y1, y2) in HEADER_REGIONS.items():
        left, top = (width * x1).cast("int"), (height * y1).cast("int")
        r = rect(left, top, (width * x2).cast("int") - left, (height * y2).cast("int") - top)
        out = F.when(key == angle, r) if out is None else out.when(key == angle, r)
    return out


def fold_angle(angle: Column) -> Column:
    """A line's angle in degrees as deviation from the nearer axis, -45 to 45."""
    a = F.pmod(angle, F.lit(180.0))
    a = F.when(a > 90, a - 180).otherwise(a)
    return F.when(a > 45, a - 90).when(a < -45, a + 90).otherwise(a)


def degrees(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.atan2(y2 - y1, x2 - x1) * (180.0 / math.pi)


def aligned(width: Column, height: Column, template_width: Column, template_height: Column, room: int = 50) -> Column:
    """Size of a page once aligned with its template: the template's where either side differs by more
    than ``room``, else its own; the score is always 1. Null template sizes leave a page as it is."""
    far = F.coalesce((F.abs(width - template_width) > room) | (F.abs(height - template_height) > room), F.lit(False))
    return F.struct(
        F.when(far, template_width).otherwise(width).alias("width"), F.when(far, template_height).otherwise(height).alias("height"),
        F.lit(1.0).alias("score"),
    )
