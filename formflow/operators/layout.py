"""Layout: lines, grids, columns, products, fields and boxes per page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formflow.functions import geometry as G
from formflow.session import tasks


def cluster_positions(lines: DataFrame, position: str, by: list[str], tolerance: float = 10) -> DataFrame:
    """``(by…, center)``: positions chained while the gap to the previous one is at most ``tolerance``.

    Gaps and islands: one window sort per group, spilling where a group is
    large. The centre is the mean, truncated. Null positions are left out.
    """
    w = Window.partitionBy(*by).orderBy(position)
    rows = lines.filter(F.col(position).isNotNull()).select(*by, position)
    gap = F.col(position) - F.lag(position).over(w)
    island = F.sum(F.when(gap > tolerance, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("cluster", island)
        .groupBy(*by, "cluster")
        .agg(F.avg(position).cast("int").alias("center"))
        .drop("cluster")
    )


def kept_positions(positions: Column, tolerance: float = 15) -> Column:
    """Sorted positions more than ``tolerance`` beyond the last one kept (not the previous one)."""
    kind = "array<double>"
    return F.aggregate(
        F.array_sort(positions),
        F.array().cast(kind),
        lambda kept, x: F.when(
            (F.size(kept) == 0) | (x.cast("double") - F.try_element_at(kept, F.lit(-1)) > tolerance),
            F.concat(kept, F.array(x.cast("double"))),
        ).otherwise(kept),
    )


def dedupe_last_kept(lines: DataFrame, position: str, by: list[str], tolerance: float = 15) -> DataFrame:
    """``(by…, position)`` of :func:`kept_positions` per group; a page's lines are few hundred."""
    kept = lines.groupBy(*by).agg(kept_positions(F.collect_set(F.col(position).cast("double")), tolerance).alias("_kept"))
    return kept.select(*by, F.explode("_kept").alias(position))


def spans(positions: DataFrame, position: str, by: list[str], prefix: str) -> DataFrame:
    """Neighbouring positions as ``(by…, {prefix}_idx, {prefix}_start, {prefix}_end)``."""
    w = Window.partitionBy(*by).orderBy(position)
    return (
        positions.select(*by, position)
        .distinct()
        .select(
            *by,
            (F.row_number().over(w) - 1).alias(f"{prefix}_idx"),
            F.col(position).alias(f"{prefix}_start"),
            F.lead(position).over(w).alias(f"{prefix}_end"),
        )
        .filter(F.col(f"{prefix}_end").isNotNull())
    )


def cell_grid(h: DataFrame, v: DataFrame, position: str, by: list[str], least_w: int = 30, least_h: int = 20) -> DataFrame:
    """Cells between neighbouring lines of both axes: ``(by…, row_idx, col_idx, rect, grid_row)``.

    Cells below the least size are dropped, indices stay those of the lines;
    ``grid_row`` numbers the rows that kept a cell.
    """
    rows, cols = spans(h, position, by, "row"), spans(v, position, by, "col")
    cells = rows.join(cols, by).select(
        *by, "row_idx", "col_idx",
        G.rect(F.col("col_start"), F.col("row_start"), F.col("col_end") - F.col("col_start"), F.col("row_end") - F.col("row_start")).alias("rect"),
    )
    kept = cells.filter((F.col("rect.width") >= least_w) & (F.col("rect.height") >= least_h))
    return kept.withColumn("grid_row", F.dense_rank().over(Window.partitionBy(*by).orderBy("row_idx")) - 1)


def grid_columns(cells: DataFrame, by: list[str]) -> DataFrame:
    """Columns of the first kept row from left to right: number, name, then the weekdays.

    ``(by…, index, name, type, x_start, x_end, width)``; fewer than three cells
    give none.
    """
    w = Window.partitionBy(*by).orderBy("rect.x", "col_idx")
    first = (
        cells.filter(F.col("grid_row") == 0)
        .withColumn("index", F.row_number().over(w) - 1)
        .withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
        .filter(F.col("_n") >= 3)
    )
    name = F.when(F.col("index") == 0, "product_number").when(F.col("index") == 1, "product_name").otherwise(
        G.weekday(F.col("index") - 2)
    )
    return first.select(
        *by, "index", name.alias("name"), F.when(F.col("index") < 2, "static").otherwise("input").alias("type"),
        F.col("rect.x").alias("x_start"), (F.col("rect.x") + F.col("rect.width")).alias("x_end"), F.col("rect.width").alias("width"),
    )


def header_rows(cells: DataFrame, by: list[str], height: Column, share: float = 0.15) -> DataFrame:
    """``(by…, header_rows)``: the leading rows above ``share`` of the page, at least one."""
    top = cells.groupBy(*by, "grid_row").agg(F.min("rect.y").alias("y"), F.first(height).alias("_h"))
    return top.groupBy(*by).agg(
        F.greatest(
            F.coalesce(F.min(F.when(F.col("y") >= F.col("_h") * share, F.col("grid_row"))), F.max("grid_row") + 1), F.lit(1)
        ).alias("header_rows")
    )


def product_rows(cells: DataFrame, columns: DataFrame, headers: DataFrame, by: list[str]) -> DataFrame:
    """Products of a grid: rows after the header with at least three cells.

    ``(by…, row, product_number_cell, product_name_cell, cells)``; the i-th
    input cell belongs to the i-th input column.
    """
    w = Window.partitionBy(*by, "grid_row").orderBy("rect.x", "col_idx")
    body = (
        cells.join(headers, by)
        .filter(F.col("grid_row") >= F.col("header_rows"))
        .withColumn("_i", F.row_number().over(w) - 1)
    )
    named = body.join(columns.select(*by, F.col("index").alias("_i"), "name", "type"), [*by, "_i"], "left")
    cell = lambda i: F.max(F.when(F.col("_i") == i, F.col("rect")))
    inputs = F.collect_list(F.when(F.col("type") == "input", F.struct(F.col("name"), F.col("rect"))))
    return (
        named.groupBy(*by, F.col("grid_row").alias("row"))
        .agg(
            F.count("*").alias("_n"), cell(0).alias("product_number_cell"), cell(1).alias("product_name_cell"),
            F.map_from_entries(F.array_sort(inputs)).alias("cells"),
        )
        .filter(F.col("_n") >= 3)
        .drop("_n")
    )


def label_regions(boxes: DataFrame, regions: DataFrame, page: str = "page_id", limit: int | None = None) -> DataFrame:
    """Fields with the text regions left of or above them, in region order; every box is kept.

    ``boxes``: ``page, box_idx, x, y, width, height``; ``regions``: ``page,
    region_idx, x, y``. ``limit`` keeps the first fields of a page.
    """
    r = regions.select(page, "region_idx", F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    kept = boxes if limit is None else first_of(boxes, limit, [page], ["box_idx"])
    left = (F.col("_tx") < F.col("x")) & (F.abs(F.col("_ty") - F.col("y")) < F.col("height"))
    above = (F.col("_ty") < F.col("y")) & (F.abs(F.col("_tx") - F.col("x")) < F.col("width"))
    aspect, area = F.round(F.col("width") / F.col("height"), 2), F.col("width") * F.col("height")
    return (
        kept.withColumn("type", G.field_class(aspect, area))
        .join(r, page, "left")
        .groupBy(page, "box_idx", "type")
        .agg(F.array_sort(F.collect_list(F.when(left | above, F.col("region_idx")))).alias("labels"))
        .withColumn("field_id", F.format_string("field_%03d", F.col("box_idx")))
    )


def merge_boxes(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """Greedy merge of touching boxes in detection order: ``(page, region_idx, x, y, width, height)``.

    One pass: a box grows while it scans the later unused ones, and those it
    passed before growing are not looked at again, so the result depends on the
    order and isn't the transitive closure. The boxes of a page travel as one
    row; repeated detection numbers are taken in order of their coordinates.
    """

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, boxes in zip(pdf[page], pdf["boxes"], strict=True):
                left, n = [(b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"]) for b in boxes], 0
                while left:
                    box, rest = left[0], []
                    for other in left[1:]:
                        if box[2] < other[0] or other[2] < box[0] or box[3] < other[1] or other[3] < box[1]:
                            rest.append(other)
                        else:
                            box = (min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3]))
                    out.append((key, n, box[0], box[1], box[2] - box[0], box[3] - box[1]))
                    left, n = rest, n + 1
            yield pd.DataFrame(out, columns=[page, "region_idx", "x", "y", "width", "height"])

    kind = boxes.schema[page].dataType.simpleString()
    fields = ["det_idx", "x", "y", "width", "height"]
    packed = boxes.dropna(subset=[page, *fields]).groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("boxes"))
    return packed.repartition(tasks(boxes.sparkSession)).mapInPandas(
        merge, f"{page} {kind}, region_idx int, x long, y long, width long, height long"
    )


def layout_summary(lines: DataFrame, boxes: DataFrame, regions: DataFrame, fields: DataFrame, page: str = "page_id") -> DataFrame:
    """Counts per page; pages missing in a table count 0 there. Tables are counted before they are joined."""
    parts = [(lines, "lines"), (boxes, "boxes"), (regions, "text_regions"), (fields, "fields")]
    whole = None
    for df, name in parts:
        n = df.groupBy(page).agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
        whole = n if whole is None else whole.unionByName(n)
    return whole.groupBy(page).agg(
        *[F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).alias(name) for _, name in parts]
    )


def first_of(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """First ``n`` rows of each group in order; the window group limit cuts before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def sorted_boxes(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Boxes numbered from top to bottom, then left to right."""
    w = Window.partitionBy(*by).orderBy("y", "x", "det_idx")
    return boxes.withColumn("box_idx", F.row_number().over(w) - 1)




def with_layout(pages: DataFrame, summary: DataFrame, page: str = "page_id") -> DataFrame:
    """``pages`` with their counts of :func:`layout_summary`, zeros and ``has_layout`` false where there are none."""
    counts = [c for c in summary.columns if c != page]
    joined = pages.join(summary.withColumn("has_layout", F.lit(True)), page, "left")
    return joined.fillna(0, counts).withColumn("has_layout", F.coalesce("has_layout", F.lit(False)))
