"""From detections and digit blobs to order lines.

Everything joins within one page: ``page_id`` is always an equality key, so
range conditions are residuals of hash or merge joins and no join is a cross
join. "First wins" and "last wins" rules are aggregates over explicit order
columns, which combine before the shuffle, not sorts of whole pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formflow.functions import geometry as G
from formflow.functions import text as T

ACCEPT = 0.4


def row_texts(
    detections: DataFrame,
    clean: Column,
    middle: Column,
    offset: Column,
    row_height: Column,
    rows: Column,
    order: list[str],
    page: str = "page_id",
) -> DataFrame:
    """``(page, row_idx, text)``: the first detection of each form row.

    Detections fall into rows by their middle; those outside the rows are
    dropped, those less than a row above the first belong to it. The first in
    ``order`` whose cleaned text isn't empty wins, across zones. Null texts and
    positions are left out.
    """
    return (
        detections.select(
            F.col(page), clean.alias("_text"), G.row_of(middle, offset, row_height).cast("int").alias("row_idx"),
            F.struct(*[F.col(o) for o in order]).alias("_order"), rows.alias("_rows"),
        )
        .filter(F.col("row_idx").between(0, F.col("_rows") - 1) & (F.length("_text") > 0))
        .groupBy(page, "row_idx")
        .agg(F.min_by("_text", "_order").alias("text"))
    )


def grid_cells(items: DataFrame, x: Column, y: Column, cell_w: Column, cell_h: Column, cols: Column, rows: Column) -> DataFrame:
    """``items`` with ``col_idx`` and ``row_idx``; positions left of or above the grid are dropped."""
    return (
        items.withColumn("col_idx", G.grid_index(x, cell_w, cols).cast("int"))
        .withColumn("row_idx", G.grid_index(y, cell_h, rows).cast("int"))
        .filter((F.col("col_idx") >= 0) & (F.col("row_idx") >= 0))
    )


def zone_of(items: DataFrame, zones: DataFrame, position: str, item: str, page: str = "page_id") -> DataFrame:
    """``(page, item, zone_idx)``: the first zone whose span holds the position, both ends included; else zone 0.

    ``zones`` has ``page, zone_idx, y, height``. Items of a page without zones
    get zone 0 too.
    """
    inside = F.when(F.col(position).between(F.col("_y"), F.col("_y") + F.col("_h")), F.col("_zone"))
    spans = zones.select(page, F.col("zone_idx").alias("_zone"), F.col("y").alias("_y"), F.col("height").alias("_h"))
    return (
        items.select(page, item, position)
        .join(spans, page, "left")
        .groupBy(page, item)
        .agg(F.coalesce(F.min(inside), F.lit(0)).alias("zone_idx"))
    )


def columns_of(items: DataFrame, columns: DataFrame, position: str, page: str = "page_id") -> DataFrame:
    """``items`` with every column whose span holds the position, both ends included; none drops the item.

    ``columns`` has ``page, name, x_start, x_end``.
    """
    return items.join(columns, page).filter(F.col(position).between(F.col("x_start"), F.col("x_end")))


def order_columns(zone_idx: Column, col_idx: Column) -> Column:
    """Weekday of a grid column: the first zone has the working days, others Saturday."""
    days = F.array(*[F.lit(d) for d in G.WEEKDAYS[:5]])
    return F.when(zone_idx == 0, F.element_at(days, F.least(col_idx, F.lit(4)) + 1)).otherwise(G.WEEKDAYS[5])


def blob_verdict(width: Column, height: Column, area: Column) -> Column:
    """Why a blob of the row scan is dropped, in this order, or ``passed``."""
    return (
        F.when((width < 8) | (height < 10), "too_small")
        .when((width > 80) | (height > 80), "too_large")
        .when(area < 50, "low_area")
        .otherwise("passed")
    )


#: Limits of the zone scan and of its older form: area, aspect, least width and height, most width and height.
ZONE_LIMITS = {"zone": (80, 4000, 0.15, 3.0, 6, 12, 80, 70), "older": (40, 5000, 0.1, 4.0, 4, 8, 80, 80)}


def zone_blob(width: Column, height: Column, area: Column, limits: str = "zone") -> Column:
    """Whether the zone scan keeps a blob."""
    a0, a1, r0, r1, w0, h0, w1, h1 = ZONE_LIMITS[limits]
    return (
        area.between(a0, a1)
        & (width / height).between(r0, r1)
        & (width >= w0) & (height >= h0) & (width <= w1) & (height <= h1)
    )


def blob_counters(blobs: DataFrame, by: list[str]) -> DataFrame:
    """Blobs per zone by verdict; zones keep zeros."""
    v = blob_verdict(F.col("width"), F.col("height"), F.col("area"))
    names = ("too_small", "too_large", "low_area", "passed")
    return blobs.groupBy(*by).agg(*[F.count_if(v == n).alias(n) for n in names])


def text_at(blobs: DataFrame, texts: DataFrame, kind: str, page: str = "page_id") -> DataFrame:
    """``blobs`` with the text read at their whole-number height, '' without one.

    ``texts``: ``page, blob_idx, y_center, kind, text``; equal heights share
    one slot, the last written wins.
    """
    slots = (
        texts.filter(F.col("kind") == kind)
        .groupBy(page, F.col("y_center").cast("int").alias("_slot"))
        .agg(F.max_by("text", "blob_idx").alias(kind))
    )
    keyed = blobs.withColumn("_slot", F.col("y_center").cast("int"))
    return keyed.join(slots, [page, "_slot"], "left").drop("_slot").withColumn(kind, F.coalesce(kind, F.lit("")))


def accepted(digits: DataFrame, least: float = ACCEPT) -> DataFrame:
    """Digits read with at least the given confidence; rounding comes after."""
    return digits.filter(F.col("digit").isNotNull() & (F.col("confidence") >= least))


def row_orders(blobs: DataFrame, digits: DataFrame, texts: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """Order lines of the row scan.

    ``blobs``: ``page_id, blob_idx, zone_idx, col_idx, y_center, rect`` (only
    passed ones); ``digits``: ``page_id, blob_idx, digit, confidence``.
    """
    read = accepted(digits).withColumn("confidence", G.rounded(F.col("confidence"), 3))
    lines = blobs.join(read, ["page_id", "blob_idx"])
    lines = text_at(text_at(lines, texts, "code"), texts, "name")
    box = G.display_box(F.col("rect"), sx, sy)
    return lines.select(
        "page_id", "blob_idx", "digit", "confidence",
        order_columns(F.col("zone_idx"), F.col("col_idx")).alias("column"), F.col("y_center").cast("int").alias("y_center"),
        box.alias("box"), T.product_name(F.col("name")).alias("product_name"), F.col("code").alias("product_code"),
    )


def zone_orders(cells: DataFrame, digits: DataFrame, codes: DataFrame, names: DataFrame) -> DataFrame:
    """Order lines of the zone scan: confidence as it is, rows from 1, code and name of the row or ''."""
    lines = cells.join(accepted(digits), ["page_id", "blob_idx"])
    for table, name in ((codes, "product_code"), (names, "product_name")):
        lines = lines.join(table.withColumnRenamed("text", name), ["page_id", "row_idx"], "left")
    days = F.array(*[F.lit(d) for d in G.WEEKDAYS[:5]])
    column = F.when(F.col("col_idx") < 5, F.element_at(days, F.col("col_idx") + 1)).otherwise(
        F.concat(F.lit("Col"), F.col("col_idx") + 1)
    )
    return lines.select(
        "page_id", "blob_idx", "digit", "confidence", (F.col("row_idx") + 1).alias("row"), column.alias("column"),
        F.coalesce("product_code", F.lit("")).alias("product_code"), F.coalesce("product_name", F.lit("")).alias("product_name"),
    )


def row_info(detections: DataFrame, y: Column, page: str = "page_id") -> DataFrame:
    """Code and name read in the strips around one height: ``detections`` has ``kind, det_idx, y_mid, text``.

    Codes keep their digits only; the name loses its brackets; '' where nothing is read.
    """
    top, bottom = G.strip_bounds(y, F.lit(G.ROW_HEIGHT), F.lit(2**31 - 1), fine=False)
    inside = detections.filter(F.col("y_mid").between(top, bottom))
    joined = inside.groupBy(page, "kind").agg(T.joined(F.col("text"), F.col("det_idx")).alias("text"))
    value = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("text"))), F.lit(""))
    return joined.groupBy(page).agg(
        T.digits(value("code")).alias("product_code"), T.product_name(T.collapse_spaces(value("name"))).alias("product_name")
    )


def template_cells(pages: DataFrame, definitions: DataFrame) -> DataFrame:
    """Cells of the input columns of every page's definition, column by column.

    ``pages``: ``page_id, form_type, width, height``; ``definitions``: ``form_key,
    image_width, image_height, columns ARRAY<STRUCT<name>>, products
    ARRAY<STRUCT<row, product_number, product_name, cells MAP>>``. The key is
    matched exactly, then without dashes (first in key order). Cells are scaled
    to the page. Pages without a definition keep one row with ``error`` and no
    cell.
    """
    keys = definitions.select("form_key", T.loose_key(F.col("form_key")).alias("_loose"))
    loose = keys.groupBy("_loose").agg(F.min("form_key").alias("_second"))
    named = (
        pages.withColumn("_first", T.form_key(F.col("form_type")))
        .withColumn("_loose", T.loose_key(F.col("form_type")))
        .join(keys.select(F.col("form_key").alias("_exact")), F.col("_first") == F.col("_exact"), "left")
        .join(loose, "_loose", "left")
        .withColumn("form_key", F.coalesce("_exact", "_second", "_first"))
        .drop("_first", "_loose", "_exact", "_second")
    )
    joined = named.join(definitions, "form_key", "left").withColumn(
        "error", F.when(F.col("products").isNull(), F.concat(F.lit("No definition for form type: "), F.coalesce("form_type", F.lit(""))))
    )
    cells = (
        joined.select("*", F.posexplode_outer("columns").alias("col_order", "col"))
        .withColumn("product", F.explode_outer("products"))
        .withColumn("cell", F.try_element_at(F.col("product.cells"), F.col("col.name")))
        .filter(F.col("cell").isNotNull() | F.col("error").isNotNull())
    )
    sx, sy = F.col("width") / F.col("image_width"), F.col("height") / F.col("image_height")
    return cells.select(
        "page_id", "form_key", "col_order", F.col("col.name").alias("column"), F.col("product.row").alias("row"),
        F.col("product.product_number").alias("product_number"), F.col("product.product_name").alias("product_name"),
        F.when(F.col("cell").isNotNull(), G.scaled(F.col("cell"), sx, sy)).alias("bounds"), "error",
    )


def fill_empty(rows: DataFrame, read: DataFrame, column: str, by: list[str]) -> DataFrame:
    """``rows`` with ``column`` filled from ``read`` (``by, text``) where it is null or empty, and whether it was.

    What holds a text keeps it; where nothing was read (no row, null or an empty
    text) the column stays null. Several texts under one key: the least.
    """
    texts = read.filter("text <> ''").groupBy(*by).agg(F.min("text").alias("_text"))
    own = F.nullif(F.col(column), F.lit(""))
    joined = rows.join(texts, by, "left")
    return joined.withColumn("filled", own.isNull() & F.col("_text").isNotNull()).withColumn(column, F.coalesce(own, "_text")).drop("_text")


def scan_statistics(cells: DataFrame, by: list[str]) -> DataFrame:
    """Counters of a template scan: cells that can't be cropped count in the total only.

    ``cells`` has ``croppable, empty, text``.
    """
    usable = F.col("croppable") & ~F.col("empty")
    return cells.groupBy(*by).agg(
        F.count("*").alias("total_cells"),
        F.count_if(F.col("croppable") & F.col("empty")).alias("empty_cells"),
        F.count_if(usable).alias("ocr_cells"),
        F.count_if(usable & (F.length(T.quantity(F.col("text"))) > 0)).alias("orders"),
    )


def page_routes(pages: DataFrame, form_keys: DataFrame, first: int = 20) -> DataFrame:
    """What is done with each page: ``template`` scan, ``fields`` (the first ``first`` ones) or ``none``.

    ``pages``: ``page_id, form_type, header_listed, header_exists, field_count``.
    """
    keys = form_keys.select(T.loose_key(F.col("form_key")).alias("_loose")).distinct().withColumn("_known", F.lit(True))
    routed = pages.withColumn("_loose", T.loose_key(F.col("form_type"))).join(keys, "_loose", "left")
    missing = F.col("header_listed") & ~F.col("header_exists")
    return routed.select(
        "page_id",
        F.when(missing, "none").when(F.col("_known"), "template").when(F.col("field_count") > 0, "fields").otherwise("none").alias("route"),
        F.when(~missing & F.col("_known").isNull(), F.least("field_count", F.lit(first))).otherwise(0).alias("fields_read"),
    )
