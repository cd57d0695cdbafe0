"""Order, code, name and Saturday zones from anchors and vertical lines.

One row a page: anchors are aggregates over detections, lines one sorted array
a page, and the geometry is column expressions on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formflow.functions import geometry as G
from formflow.functions import text as T
from formflow.operators.layout import kept_positions

# Fixed values of the form's layout.
COLUMNS, DEDUPE, ROWS_SATURDAY = 5, 15, 9


def anchors(detections: DataFrame, page: str = "page_id") -> DataFrame:
    """``(page, top, bottom, saturday)`` rectangles: the last match of the first two, the first of the third.

    ``detections``: ``page, det_idx, text, x, y, x2, y2``.
    """
    box = F.struct("x", "y", "x2", "y2")
    text = F.col("text")
    return detections.filter(text.isNotNull()).groupBy(page).agg(
        F.max_by(F.when(T.is_top_anchor(text), box), F.when(T.is_top_anchor(text), F.col("det_idx"))).alias("top"),
        F.max_by(F.when(T.is_bottom_anchor(text), box), F.when(T.is_bottom_anchor(text), F.col("det_idx"))).alias("bottom"),
        F.min_by(F.when(T.is_saturday_anchor(text), box), F.when(T.is_saturday_anchor(text), F.col("det_idx"))).alias("saturday"),
    )


def first_right_of(lines: DataFrame, anchors: DataFrame, x2: str, page: str = "page_id") -> DataFrame:
    """``(page, zone_x)``: two beyond the first line right of the anchor, else five beyond the anchor."""
    return (
        anchors.join(lines, page, "left")
        .groupBy(page, x2)
        .agg(F.coalesce(F.min(F.when(F.col("x") > F.col(x2), F.col("x"))) + 2, F.col(x2) + 5).alias("zone_x"))
        .drop(x2)
    )


def _at(array: Column, i: int) -> Column:
    return F.try_element_at(array, F.lit(i)).cast("int")


def _int(c: Column) -> Column:
    return c.cast("int")


def detect_zones(pages: DataFrame, detections: DataFrame, v_lines: DataFrame, h_lines: DataFrame, page: str = "page_id") -> DataFrame:
    """Zones of every page with the method used: ``ocr_anchors``, ``partial_ocr`` or ``line_detection``.

    ``pages``: ``page, width, height``; ``v_lines``: ``page, x``; ``h_lines``:
    ``page, y``. Both anchors give zones from cell boundaries with the Saturday
    column skipped; the top anchor alone an estimate of 52 rows; none of them
    the spacing of the lines.
    """
    sorted_of = lambda df, c, n: df.groupBy(page).agg(F.array_sort(F.collect_list(F.col(c).cast("double"))).alias(n))
    none = F.array().cast("array<double>")
    base = (
        pages.join(anchors(detections, page), page, "left")
        .join(sorted_of(v_lines, "x", "v"), page, "left")
        .join(sorted_of(h_lines, "y", "h"), page, "left")
        .withColumn("v", F.coalesce("v", none))
        .withColumn("h", F.coalesce("h", none))
    )
    w, h, top, bottom, v, hl = (F.col(c) for c in ("width", "height", "top", "bottom", "v", "h"))
    method = F.when(top.isNotNull() & bottom.isNotNull(), "ocr_anchors").when(top.isNotNull(), "partial_ocr").otherwise("line_detection")
    start = F.coalesce(_at(F.filter(v, lambda x: x > top["x2"]), 1) + 2, top["x2"] + 5)
    base = base.withColumn("method", method).withColumn("start", _int(start))
    s = F.col("start")
    base = base.withColumn("right", kept_positions(F.filter(v, lambda x: (x > s) & (x < w * 0.95)), DEDUPE))
    left_raw = F.filter(v, lambda x: x < top["x"] - 50)
    base = base.withColumn(
        "left", F.when(F.col("method") == "ocr_anchors", kept_positions(left_raw, DEDUPE)).otherwise(F.array_sort(left_raw))
    )
    r, left = F.col("right"), F.col("left")

    # Both anchors.
    col_w = F.when(F.size(r) >= 2, _at(r, 2) - _at(r, 1)).when(F.size(r) == 1, _at(r, 1) - s)
    a_x = F.when(F.size(r) >= 2, _at(r, 1) + 2).when(F.size(r) == 1, s + col_w).otherwise(s)
    a_w = F.when(F.size(r) >= 1, COLUMNS * col_w).otherwise(_int(w * 0.45))
    a_h = bottom["y2"] - top["y"]
    code_x = F.when(F.size(left) >= 1, _at(left, 1) + 2).otherwise(50)
    gap = _at(left, 2) - _at(left, 1) - 4
    code_w = F.when(F.size(left) >= 2, F.when(F.col("method") == "ocr_anchors", F.greatest(gap, F.lit(80))).otherwise(gap)).otherwise(120)
    name_x = code_x + code_w + 5
    name_x = F.when(name_x > top["x"], top["x"] - 5).otherwise(name_x)
    both = F.struct(
        G.rect(a_x, top["y"], a_w, a_h).alias("zone"), G.rect(code_x, top["y"], code_w, a_h).alias("codes"),
        G.rect(name_x, top["y"], s - 5 - name_x, a_h).alias("names"),
        F.greatest(F.lit(1), _int(a_h / G.ROW_HEIGHT)).cast("int").alias("rows"), F.lit(COLUMNS).alias("cols"),
        F.when(F.col("saturday").isNotNull(), G.rect(
            a_x + a_w + 2, F.col("saturday.y") - 5, _int(a_w / 5.0), F.lit(G.ROW_HEIGHT * ROWS_SATURDAY)
        )).alias("saturday_zone"),
    )

    # The top anchor alone.
    p_h = _int(h * 0.85) - top["y"]
    nothing = F.lit(None).cast("struct<x:int,y:int,width:int,height:int>")
    partial = F.struct(
        G.rect(s, top["y"], _int(w * 0.35), p_h).alias("zone"), G.rect(code_x, top["y"], code_w, p_h).alias("codes"),
        G.rect(name_x, top["y"], s - name_x - 5, p_h).alias("names"), F.lit(52).alias("rows"), F.lit(COLUMNS).alias("cols"),
        nothing.alias("saturday_zone"),
    )

    # Lines only.
    rv = F.filter(v, lambda x: x > w * 0.4)
    rv = F.when(F.size(rv) >= 2, rv).when(F.size(v) >= 6, F.slice(v, -6, 6)).otherwise(v)
    lv = F.filter(v, lambda x: x < w * 0.15)
    f_x = F.coalesce(_at(rv, 1), _int(w * 0.55))
    f_y = F.coalesce(_at(hl, 1), _int(h * 0.08))
    f_h = F.when(F.size(hl) > 1, _at(hl, -1) - _at(hl, 1)).otherwise(_int(h * 0.85))
    c_x = F.coalesce(_at(lv, 1) + 2, F.lit(50))
    c_w = F.when(F.size(lv) >= 2, _at(lv, 2) - _at(lv, 1) - 4).otherwise(120)
    n_x = c_x + c_w + 5
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c)).cast("int")
    lines = F.struct(
        G.rect(f_x, f_y, w - f_x - 10, f_h).alias("zone"), G.rect(c_x, f_y, c_w, f_h).alias("codes"),
        G.rect(n_x, f_y, f_x - n_x - 5, f_h).alias("names"),
        clamp(F.when(F.size(hl) > 1, F.size(hl) - 1).otherwise(52), 10, 100).alias("rows"),
        clamp(F.when(F.size(rv) > 1, F.size(rv) - 1).otherwise(5), 1, 10).alias("cols"), nothing.alias("saturday_zone"),
    )
    found = F.when(F.col("method") == "ocr_anchors", both).when(F.col("method") == "partial_ocr", partial).otherwise(lines)
    return base.select(page, "method", found.alias("z")).select(page, "method", "z.*")
