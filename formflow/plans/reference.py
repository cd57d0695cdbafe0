"""Queries of the form-intake operators on the supplied tables, with their SQL.

Detections are the text blocks of ``ocr_pages``; tables without forms stand in
where the operator needs other shapes (``embeddings`` as signatures,
``lineitem`` as pixels and blobs, ``events`` as rotations and stage results).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formflow.functions import geometry as G
from formflow.functions import text as T
from formflow.operators import emails, layout, matching, quality, scan, zones
from formflow.session import cut, table
from formflow.streaming import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, queries: dict | None = None, oracles: dict | None = None):
    """Register a query under its name, with its SQL if SQL can express it."""

    def add(f):
        (QUERIES if queries is None else queries)[f.__name__] = f
        if sql is not None:
            (ORACLES if oracles is None else oracles)[f.__name__] = (DETECTIONS + sql) if "FROM det" in sql or "JOIN det" in sql else sql
        return f

    return add


DETECTIONS = """
WITH det AS (
  SELECT DISTINCT page_id, CAST(i - 1 AS INT) AS det_idx, b.text AS text, b.confidence AS confidence,
         b.bounds.x AS x, b.bounds.y AS y, b.bounds.width AS width, b.bounds.height AS height, b.bbox AS bbox
  FROM (SELECT page_id, i, text_blocks[i] AS b FROM ocr_pages, UNNEST(range(1, len(text_blocks) + 1)) AS r(i))
  WHERE b IS NOT NULL AND b.bounds.x IS NOT NULL AND b.bounds.y IS NOT NULL
    AND b.bounds.width > 0 AND b.bounds.height > 0)
"""


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Detections as often as their page is saved, for what repeated rows don't change; nothing is moved."""
    rows = table(spark, folder, "ocr_pages").select("page_id", F.posexplode("text_blocks").alias("det_idx", "b"))
    return (
        rows.filter(F.col("b").isNotNull())
        .select("page_id", "det_idx", "b.text", "b.confidence", "b.bounds.x", "b.bounds.y", "b.bounds.width", "b.bounds.height", "b.bbox")
        .filter("x IS NOT NULL AND y IS NOT NULL AND width > 0 AND height > 0")
    )


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """Detections of every page once."""
    return blocks(spark, folder).distinct()


# ---- scans -------------------------------------------------------------------------------------------------------------


@query("""
, bins AS (
  SELECT page_id, det_idx, text, confidence, CAST(trunc((y + height / 2.0 - 150) / 53.0) AS INT) AS row_idx,
         CAST(least(trunc((x + width / 2.0) / 496.0), 4) AS INT) AS col_idx
  FROM det WHERE confidence >= 0.4 AND text IS NOT NULL),
firsts AS (
  SELECT page_id, row_idx, col_idx, arg_min(text, (det_idx, text)) AS text FROM bins
  WHERE row_idx BETWEEN 0 AND 59 AND col_idx >= 0 GROUP BY ALL)
SELECT page_id, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (regexp_extract(text, '(\\d+)', 1) <> '') AS BIGINT) AS orders,
       CAST(coalesce(sum(TRY_CAST(regexp_extract(text, '(\\d{1,9})', 1) AS BIGINT)), 0) AS BIGINT) AS quantity
FROM firsts GROUP BY page_id""")
def scan_order_lines(spark, folder):
    """Flagship: detections to order lines and their statistics per page."""
    found = blocks(spark, folder).filter("confidence >= 0.4 AND text IS NOT NULL")
    x, y = F.col("x") + F.col("width") / 2.0, F.col("y") + F.col("height") / 2.0 - 150
    cells = scan.grid_cells(found, x, y, F.lit(496.0), F.lit(53.0), F.lit(5), F.lit(1000)).filter("row_idx <= 59")
    first = cells.groupBy("page_id", "row_idx", "col_idx").agg(F.min_by("text", F.struct("det_idx", "text")).alias("text"))
    number = T.found(F.col("text"), r"(\d{1,9})")
    return first.groupBy("page_id").agg(
        F.count("*").alias("cells"), F.count(number).alias("orders"), F.coalesce(F.sum(number.cast("bigint")), F.lit(0)).alias("quantity")
    )


@query("""
, r AS (SELECT page_id, regexp_replace(text, '[^0-9\\-()]', '', 'g') AS clean, det_idx,
        CAST(trunc((y + height / 2.0 - 150) / 53.0) AS INT) AS row_idx FROM det WHERE text IS NOT NULL)
SELECT page_id, row_idx, arg_min(clean, (det_idx, clean)) AS text FROM r WHERE row_idx BETWEEN 0 AND 51 AND clean <> '' GROUP BY ALL""")
def row_codes(spark, folder):
    d = blocks(spark, folder).withColumn("clean", T.product_code(F.col("text")))
    return scan.row_texts(d, F.col("clean"), F.col("y") + F.col("height") / 2.0, F.lit(-150), F.lit(53.0), F.lit(52), ["det_idx", "clean"])


@query("""
, r AS (SELECT page_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean, det_idx,
        CAST(trunc((y + height / 2.0 - 150) / 53.0) AS INT) AS row_idx FROM det WHERE text IS NOT NULL)
SELECT page_id, row_idx, arg_min(clean, (det_idx, clean)) AS text FROM r WHERE row_idx BETWEEN 0 AND 51 AND clean <> '' GROUP BY ALL""")
def row_names(spark, folder):
    d = blocks(spark, folder).withColumn("clean", T.collapse_spaces(F.col("text")))
    return scan.row_texts(d, F.col("clean"), F.col("y") + F.col("height") / 2.0, F.lit(-150), F.lit(53.0), F.lit(52), ["det_idx", "clean"])


@query("""
SELECT page_id, det_idx, CAST(least(trunc(x / 100.0), 9) AS INT) AS col_idx, CAST(least(trunc(y / 53.0), 51) AS INT) AS row_idx
FROM det WHERE text IS NOT NULL""")
def grid_cell_assign(spark, folder):
    d = detections(spark, folder).filter("text IS NOT NULL").select("page_id", "det_idx", "x", "y")
    cells = scan.grid_cells(d, F.col("x"), F.col("y"), F.lit(100.0), F.lit(53.0), F.lit(10), F.lit(52))
    return cells.select("page_id", "det_idx", "col_idx", "row_idx")


@query("""
, z(zone_idx, zy, zh) AS (VALUES (0, 100, 300), (1, 350, 400), (2, 700, 500))
SELECT d.page_id, d.det_idx, CAST(coalesce(min(z.zone_idx) FILTER (d.y BETWEEN z.zy AND z.zy + z.zh), 0) AS INT) AS zone_idx
FROM (SELECT DISTINCT page_id, det_idx, y FROM det) d, z GROUP BY d.page_id, d.det_idx""")
def interval_zone_join(spark, folder):
    d = blocks(spark, folder).select("page_id", "det_idx", "y").distinct()
    spans = F.explode(F.array(*[F.struct(F.lit(i).alias("zone_idx"), F.lit(y).alias("y"), F.lit(h).alias("height")) for i, y, h in ((0, 100, 300), (1, 350, 400), (2, 700, 500))]))
    z = d.select("page_id").distinct().select("page_id", spans.alias("z")).select("page_id", "z.*")
    return scan.zone_of(d, z, "y", "det_idx")


@query("""
, c(name, x_start, x_end) AS (VALUES ('Mo', 0, 500), ('Di', 500, 1000), ('Mi', 1000, 1500), ('Do', 1500, 2000), ('Fr', 2000, 2480))
SELECT page_id, det_idx, name FROM (SELECT DISTINCT page_id, det_idx, x + width / 2.0 AS xm FROM det) d, c WHERE xm BETWEEN x_start AND x_end""")
def column_interval_join(spark, folder):
    d = blocks(spark, folder).select("page_id", "det_idx", (F.col("x") + F.col("width") / 2.0).alias("xm")).distinct()
    cols = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("x_start"), F.lit(b).alias("x_end")) for n, a, b in (("Mo", 0, 500), ("Di", 500, 1000), ("Mi", 1000, 1500), ("Do", 1500, 2000), ("Fr", 2000, 2480))]))
    c = d.select("page_id").distinct().select("page_id", cols.alias("c")).select("page_id", "c.*")
    return scan.columns_of(d, c, "xm").select("page_id", "det_idx", "name")


_BLOBS = "SELECT l_orderkey AS page_id, l_linenumber AS blob_idx, CAST(l_quantity * 2 AS INT) AS width, CAST(l_tax * 1000 AS INT) + 5 AS height, l_quantity * 3 AS area, l_suppkey % 3 AS zone_idx FROM lineitem"


def _blobs(spark, folder):
    """Blobs: lines of an order as the blobs of a page."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("blob_idx"), (F.col("l_quantity") * 2).cast("int").alias("width"),
        (F.round(F.col("l_tax") * 1000).cast("int") + 5).alias("height"), (F.col("l_quantity") * 3).alias("area"),
        (F.col("l_suppkey") % 3).alias("zone_idx"),
    )


@query(f"""
WITH b AS ({_BLOBS}), v AS (SELECT *, CASE WHEN width < 8 OR height < 10 THEN 'too_small' WHEN width > 80 OR height > 80 THEN 'too_large'
  WHEN area < 50 THEN 'low_area' ELSE 'passed' END AS v FROM b)
SELECT zone_idx, count(*) FILTER (v = 'too_small') AS too_small, count(*) FILTER (v = 'too_large') AS too_large,
       count(*) FILTER (v = 'low_area') AS low_area, count(*) FILTER (v = 'passed') AS passed FROM v GROUP BY zone_idx""")
def blob_counters(spark, folder):
    return scan.blob_counters(_blobs(spark, folder), ["zone_idx"])


@query(f"""
SELECT page_id, blob_idx FROM ({_BLOBS}) WHERE area BETWEEN 80 AND 4000 AND CAST(width AS DOUBLE) / height BETWEEN 0.15 AND 3.0
  AND width >= 6 AND height >= 12 AND width <= 80 AND height <= 70""")
def zone_blobs(spark, folder):
    ok = scan.zone_blob(F.col("width"), F.col("height"), F.col("area"))
    return _blobs(spark, folder).filter(ok).select("page_id", "blob_idx")


@query("""
SELECT page_id, det_idx, text, floor(confidence * 1000 + 0.5) / 1000 AS confidence FROM det WHERE text IS NOT NULL AND confidence >= 0.4""")
def confidence_filter(spark, folder):
    d = detections(spark, folder).withColumnRenamed("text", "digit")
    return scan.accepted(d).select("page_id", "det_idx", F.col("digit").alias("text"), G.rounded(F.col("confidence"), 3).alias("confidence"))


@query("""
, t AS (SELECT page_id, y AS slot, arg_max(text, (det_idx, text)) AS code FROM det WHERE text IS NOT NULL GROUP BY ALL)
SELECT d.page_id, d.det_idx, coalesce(t.code, '') AS code
FROM (SELECT DISTINCT page_id, det_idx, CAST(trunc(y + height / 2.0) AS INT) AS slot FROM det) d LEFT JOIN t USING (page_id, slot)""")
def text_at_height(spark, folder):
    """Text read at a blob's whole-number height; the last written wins."""
    d = detections(spark, folder)
    texts = d.filter("text IS NOT NULL").select(
        "page_id", F.struct("det_idx", "text").alias("blob_idx"), F.col("y").alias("y_center"), F.lit("code").alias("kind"), "text"
    )
    blobs = d.select("page_id", "det_idx", (F.col("y") + F.col("height") / 2.0).alias("y_center")).distinct()
    return scan.text_at(blobs, texts, "code").select("page_id", "det_idx", "code")


@query("""
, b AS (SELECT DISTINCT page_id, det_idx, text, confidence, x, y, width, height, y + height / 2.0 AS yc FROM det WHERE text IS NOT NULL),
s AS (SELECT page_id, CAST(trunc(yc) AS INT) AS slot, arg_max(text, (det_idx, text)) AS t FROM b GROUP BY ALL)
SELECT b.page_id, b.det_idx AS blob_idx, b.text AS digit, floor(b.confidence * 1000 + 0.5) / 1000 AS confidence, ['Mo','Di','Mi','Do','Fr'][CAST(least(trunc(b.x / 496.0), 4) AS INT) + 1] AS "column",
  CAST(trunc(b.yc) AS INT) AS y_center, CAST(b.x - floor((87 - b.width) / 2.0) AS INT) AS box_x, CAST(b.y - floor((87 - b.height) / 2.0) AS INT) AS box_y,
  regexp_replace(regexp_replace(s.t, '^\\[\\s*', ''), '^\\]\\s*', '') AS product_name, s.t AS product_code
FROM b LEFT JOIN s ON s.page_id = b.page_id AND s.slot = CAST(trunc(b.yc) AS INT) WHERE regexp_matches(b.text, '^\\d$') AND b.confidence >= 0.4""")
def row_scan_orders(spark, folder):
    """Row path end to end: blobs, digits (position and confidence of detections) and texts."""
    d = detections(spark, folder).filter("text IS NOT NULL").drop("bbox").distinct()
    # A blob is keyed by all it was read from, since repeated pages repeat its number.
    key = F.struct("det_idx", "text", "confidence", "x", "y", "width", "height").alias("blob_idx")
    blobs = d.select(
        "page_id", key, F.lit(0).alias("zone_idx"), G.grid_index(F.col("x"), F.lit(496.0), F.lit(5)).alias("col_idx"),
        (F.col("y") + F.col("height") / 2.0).alias("y_center"), G.rect(*[F.col(c) for c in ("x", "y", "width", "height")]).alias("rect"),
    )
    digits = d.select("page_id", key, T.found(F.col("text"), r"^(\d)$").alias("digit"), "confidence")
    texts = d.select(
        "page_id", F.struct("det_idx", "text").alias("blob_idx"), (F.col("y") + F.col("height") / 2.0).alias("y_center"),
        F.explode(F.array(F.lit("code"), F.lit("name"))).alias("kind"), "text",
    )
    lines = scan.row_orders(blobs, digits, texts, F.lit(1.0), F.lit(1.0))
    return lines.select(
        "page_id", F.col("blob_idx.det_idx").alias("blob_idx"), "digit", "confidence", "column", "y_center",
        F.col("box.x").alias("box_x"), F.col("box.y").alias("box_y"), "product_name", "product_code",
    )


@query("""
, c AS (SELECT page_id, confidence < 0.3 AS is_empty, width >= 30 AS ok, coalesce(text, '') AS text FROM det)
SELECT page_id, CAST(count(*) AS BIGINT) AS total_cells, CAST(count(*) FILTER (ok AND is_empty) AS BIGINT) AS empty_cells,
  CAST(count(*) FILTER (ok AND NOT is_empty) AS BIGINT) AS ocr_cells,
  CAST(count(*) FILTER (ok AND NOT is_empty AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') AS BIGINT) AS orders FROM c GROUP BY page_id""")
def scan_statistics(spark, folder):
    cells = detections(spark, folder).select(
        "page_id", (F.col("confidence") < 0.3).alias("empty"), (F.col("width") >= 30).alias("croppable"), F.coalesce("text", F.lit("")).alias("text")
    )
    return scan.scan_statistics(cells, ["page_id"])


@query("""
WITH k AS (SELECT DISTINCT replace(replace(form_type, ' ', '-'), '-', '') AS loose FROM form_types),
p AS (SELECT CAST(entry_id AS VARCHAR) || '/' || CAST(row_number() OVER (PARTITION BY entry_id ORDER BY entered_at, product_name, product_number, form_type) AS VARCHAR) AS page_id,
        form_type, product_row % 2 = 0 AS listed, product_row % 3 <> 0 AS there, CAST(product_row AS INT) AS n FROM template_entries)
SELECT page_id, CASE WHEN listed AND NOT there THEN 'none' WHEN k.loose IS NOT NULL THEN 'template' WHEN n > 0 THEN 'fields' ELSE 'none' END AS route,
  CAST(CASE WHEN NOT (listed AND NOT there) AND k.loose IS NULL THEN least(n, 20) ELSE 0 END AS INT) AS fields_read
FROM p LEFT JOIN k ON replace(replace(p.form_type, ' ', '-'), '-', '') = k.loose""")
def page_routes(spark, folder):
    """Template scan, field reading or nothing for each page."""
    w = Window.partitionBy("entry_id").orderBy(*[F.asc_nulls_last(c) for c in ("entered_at", "product_name", "product_number", "form_type")])
    pages = table(spark, folder, "template_entries").select(
        F.concat(F.col("entry_id").cast("string"), F.lit("/"), F.row_number().over(w).cast("string")).alias("page_id"), "form_type",
        (F.col("product_row") % 2 == 0).alias("header_listed"), (F.col("product_row") % 3 != 0).alias("header_exists"), F.col("product_row").alias("field_count"),
    )
    keys = table(spark, folder, "form_types").select(T.form_key(F.col("form_type")).alias("form_key"))
    return scan.page_routes(pages, keys)


# ---- layout ------------------------------------------------------------------------------------------------------------


@query("""
, p AS (SELECT DISTINCT page_id, y FROM det), g AS (SELECT page_id, y, CASE WHEN y - lag(y) OVER (PARTITION BY page_id ORDER BY y) > 10 THEN 1 ELSE 0 END AS brk FROM p),
c AS (SELECT page_id, y, sum(brk) OVER (PARTITION BY page_id ORDER BY y ROWS UNBOUNDED PRECEDING) AS cl FROM g)
SELECT page_id, CAST(trunc(avg(y)) AS INT) AS center FROM c GROUP BY page_id, cl""")
def cluster_positions(spark, folder):
    return layout.cluster_positions(blocks(spark, folder).select("page_id", "y").distinct(), "y", ["page_id"])


@query("""
WITH RECURSIVE k(p_brand, price) AS (
  SELECT p_brand, min(p_retailprice) FROM part GROUP BY p_brand
  UNION ALL
  SELECT k.p_brand, (SELECT min(p.p_retailprice) FROM part p WHERE p.p_brand = k.p_brand AND p.p_retailprice - k.price > 15) FROM k
  WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_brand = k.p_brand AND p.p_retailprice - k.price > 15))
SELECT p_brand, price FROM k""")
def dedupe_last_kept(spark, folder):
    rows = table(spark, folder, "part").select("p_brand", F.col("p_retailprice").alias("price"))
    return layout.dedupe_last_kept(rows, "price", ["p_brand"])


_GRID = """
WITH body AS (SELECT DISTINCT definition_id, CASE WHEN json_valid(body) THEN body END AS b FROM definitions),
ln AS (SELECT definition_id, 'h' AS axis, CAST(u AS INT) AS position FROM (SELECT definition_id, unnest(CAST(json_extract(b, '$.grid.horizontal_lines') AS INT[])) AS u FROM body)
       UNION SELECT definition_id, 'v', CAST(u AS INT) FROM (SELECT definition_id, unnest(CAST(json_extract(b, '$.grid.vertical_lines') AS INT[])) AS u FROM body)),
sp AS (SELECT definition_id, axis, row_number() OVER w - 1 AS idx, position AS s, lead(position) OVER w AS e FROM ln WINDOW w AS (PARTITION BY definition_id, axis ORDER BY position)),
cells AS (SELECT h.definition_id, CAST(h.idx AS INT) AS row_idx, CAST(v.idx AS INT) AS col_idx, v.s AS x, h.s AS y, v.e - v.s AS width, h.e - h.s AS height
  FROM sp h JOIN sp v ON h.definition_id = v.definition_id AND h.axis = 'h' AND v.axis = 'v' WHERE h.e IS NOT NULL AND v.e IS NOT NULL AND v.e - v.s >= 30 AND h.e - h.s >= 20),
grid AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY definition_id ORDER BY row_idx) - 1 AS INT) AS grid_row FROM cells)
"""


def _lines(spark, folder, axis):
    body = table(spark, folder, "definitions").filter(F.try_parse_json("body").isNotNull()).select("definition_id", "body").distinct()
    path = f"$.grid.{axis}_lines"
    return body.select("definition_id", F.explode(F.from_json(F.get_json_object("body", path), "array<int>")).alias("position")).distinct()


def _grid(spark, folder):
    return layout.cell_grid(_lines(spark, folder, "horizontal"), _lines(spark, folder, "vertical"), "position", ["definition_id"])


@query(_GRID + "SELECT definition_id, row_idx, col_idx, x, y, width, height, grid_row FROM grid")
def cell_grid(spark, folder):
    """Cells between the grid lines of the template definitions."""
    return _grid(spark, folder).select("definition_id", "row_idx", "col_idx", "rect.*", "grid_row")


_COLUMNS = _GRID + """
, first AS (SELECT *, row_number() OVER (PARTITION BY definition_id ORDER BY x, col_idx) - 1 AS i, count(*) OVER (PARTITION BY definition_id) AS n FROM grid WHERE grid_row = 0),
cols AS (SELECT definition_id, CAST(i AS INT) AS idx, CASE WHEN i = 0 THEN 'product_number' WHEN i = 1 THEN 'product_name' WHEN i < 8 THEN ['Mo','Di','Mi','Do','Fr','Sa'][i - 1] ELSE 'Col' || CAST(i + 1 AS VARCHAR) END AS name,
  CASE WHEN i < 2 THEN 'static' ELSE 'input' END AS type, x AS x_start, x + width AS x_end, width FROM first WHERE n >= 3)
"""


@query(_COLUMNS + "SELECT definition_id, idx AS \"index\", name, type, x_start, x_end, width FROM cols")
def grid_columns(spark, folder):
    return layout.grid_columns(_grid(spark, folder), ["definition_id"])


@query(_GRID + """
, tops AS (SELECT definition_id, grid_row, min(y) AS y FROM grid GROUP BY ALL)
SELECT definition_id, CAST(greatest(coalesce(min(grid_row) FILTER (y >= 3508 * 0.15), max(grid_row) + 1), 1) AS INT) AS header_rows FROM tops GROUP BY definition_id""")
def header_rows(spark, folder):
    return layout.header_rows(_grid(spark, folder), ["definition_id"], F.lit(3508))


@query(_COLUMNS + """
, hdr AS (SELECT definition_id, greatest(coalesce(min(grid_row) FILTER (y >= 3508 * 0.15), max(grid_row) + 1), 1) AS hr FROM grid GROUP BY definition_id),
rest AS (SELECT g.*, row_number() OVER (PARTITION BY g.definition_id, grid_row ORDER BY x, col_idx) - 1 AS i FROM grid g JOIN hdr USING (definition_id) WHERE grid_row >= hr)
SELECT b.definition_id, b.grid_row AS row, CAST(max(b.x) FILTER (i = 0) AS INT) AS number_x, CAST(max(b.x) FILTER (i = 1) AS INT) AS name_x,
  CAST(count(*) FILTER (c.type = 'input') AS BIGINT) AS inputs FROM rest b LEFT JOIN cols c ON c.definition_id = b.definition_id AND c.idx = b.i
GROUP BY b.definition_id, b.grid_row HAVING count(*) >= 3""")
def product_rows(spark, folder):
    g = cut(_grid(spark, folder))
    by = ["definition_id"]
    rows = layout.product_rows(g, layout.grid_columns(g, by), layout.header_rows(g, by, F.lit(3508)), by)
    return rows.select("definition_id", "row", F.col("product_number_cell.x").alias("number_x"), F.col("product_name_cell.x").alias("name_x"), F.size("cells").cast("bigint").alias("inputs"))


@query("""
, b AS (SELECT DISTINCT page_id, det_idx, round(width / height, 2) AS aspect, width * height AS area FROM det)
SELECT page_id, det_idx, CASE WHEN aspect > 5 THEN 'text_line' WHEN aspect > 2 THEN 'text_field' WHEN aspect > 0.8 AND aspect < 1.2 AND area < 2000 THEN 'checkbox'
  WHEN area > 10000 THEN 'text_area' ELSE 'unknown' END AS type FROM b""")
def classify_field_type(spark, folder):
    d = blocks(spark, folder)
    kind = G.field_class(F.round(F.col("width") / F.col("height"), 2), F.col("width") * F.col("height"))
    return d.select("page_id", "det_idx", kind.alias("type")).distinct()


@query("""
, b AS (SELECT page_id, min(det_idx) AS det_idx, x, y, width, height FROM det GROUP BY page_id, x, y, width, height),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY det_idx) AS rk FROM b), box AS (SELECT * FROM ranked WHERE rk <= 20)
SELECT box.page_id, box.det_idx AS box_idx, coalesce(string_agg(CAST(t.det_idx AS VARCHAR), ',' ORDER BY t.det_idx), '') AS labels
FROM box LEFT JOIN b t ON t.page_id = box.page_id AND ((t.x < box.x AND abs(t.y - box.y) < box.height) OR (t.y < box.y AND abs(t.x - box.x) < box.width))
GROUP BY box.page_id, box.det_idx""")
def label_theta_join(spark, folder):
    """First 20 fields of a page with the regions left of or above them."""
    b = blocks(spark, folder).groupBy("page_id", "x", "y", "width", "height").agg(F.min("det_idx").alias("box_idx"))
    fields = layout.label_regions(b, b.withColumnRenamed("box_idx", "region_idx"), limit=20)
    return fields.select("page_id", "box_idx", F.array_join(F.transform("labels", lambda i: i.cast("string")), ",").alias("labels"))


@query("""
, a AS (SELECT page_id, max(x + width) AS x2 FROM det WHERE det_idx = 0 GROUP BY page_id)
SELECT a.page_id, CAST(coalesce(min(d.x) FILTER (d.x > a.x2) + 2, max(a.x2) + 5) AS INT) AS zone_x FROM a LEFT JOIN det d ON d.page_id = a.page_id GROUP BY a.page_id""")
def forward_asof_line(spark, folder):
    d = blocks(spark, folder)
    a = d.filter("det_idx = 0").groupBy("page_id").agg(F.max(F.col("x") + F.col("width")).alias("x2"))
    return zones.first_right_of(d.select("page_id", "x"), a, "x2")


@query()
def detect_zones(spark, folder):
    """Zones of every page from anchors and line positions (the detections' edges stand in for lines)."""
    d = cut(blocks(spark, folder).drop("bbox").distinct())
    found = d.withColumn("x2", F.col("x") + F.col("width")).withColumn("y2", F.col("y") + F.col("height"))
    pages = d.select("page_id").distinct().withColumn("width", F.lit(2480)).withColumn("height", F.lit(3508))
    return zones.detect_zones(pages, found, d.select("page_id", "x"), d.select("page_id", "y"))


@query()
def merge_boxes(spark, folder):
    """Greedy merge of touching text boxes in detection order."""
    one = blocks(spark, folder).groupBy("page_id", "det_idx").agg(*[F.min(c).alias(c) for c in ("x", "y", "width", "height")])
    return layout.merge_boxes(one)


@query("""
, s(page_id, what, n) AS (SELECT page_id, 'lines', count(*) FROM det WHERE height < 25 GROUP BY 1 UNION ALL SELECT page_id, 'boxes', count(*) FROM det WHERE height >= 25 GROUP BY 1
  UNION ALL SELECT page_id, 'text_regions', count(*) FROM det GROUP BY 1 UNION ALL SELECT page_id, 'fields', count(*) FROM det WHERE width > 100 GROUP BY 1)
SELECT page_id, CAST(coalesce(sum(n) FILTER (what = 'lines'), 0) AS BIGINT) AS lines, CAST(coalesce(sum(n) FILTER (what = 'boxes'), 0) AS BIGINT) AS boxes,
  CAST(coalesce(sum(n) FILTER (what = 'text_regions'), 0) AS BIGINT) AS text_regions, CAST(coalesce(sum(n) FILTER (what = 'fields'), 0) AS BIGINT) AS fields FROM s GROUP BY page_id""")
def layout_summary(spark, folder):
    d = detections(spark, folder)
    return layout.layout_summary(d.filter("height < 25"), d.filter("height >= 25"), d, d.filter("width > 100"))


@query("""
SELECT page_id, det_idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y, x, det_idx, text NULLS LAST) - 1 AS INT) AS box_idx FROM det""")
def sorted_boxes(spark, folder):
    d = detections(spark, folder).withColumn("det_idx", F.struct("det_idx", F.col("text").isNull(), "text"))
    return layout.sorted_boxes(d, ["page_id"]).select("page_id", "det_idx.det_idx", "box_idx")


@query("""
, b AS (SELECT page_id, det_idx, x, y, width, height, [list_transform(bbox, lambda p: p[1]), list_transform(bbox, lambda p: p[2])] AS c FROM det WHERE bbox IS NOT NULL AND len(bbox) = 4)
SELECT DISTINCT page_id, det_idx, list_min(c[1]) AS bx, list_min(c[2]) AS by, list_max(c[1]) - list_min(c[1]) AS bw, list_max(c[2]) - list_min(c[2]) AS bh,
  CAST(trunc(x * 0.37) AS INT) AS sx, CAST(trunc(y * 0.41) AS INT) AS sy,
  CAST(CAST(trunc(x / 0.37) AS INT) - floor((87 - CAST(trunc(width / 0.37) AS INT)) / 2.0) AS INT) AS dx FROM b""")
def rectangles(spark, folder):
    """Bounds of corners, scaling and the centred display box."""
    d = blocks(spark, folder).filter("bbox IS NOT NULL AND size(bbox) = 4")
    r, b = G.rect(*[F.col(c) for c in ("x", "y", "width", "height")]), G.bounds(F.col("bbox"))
    s, v = G.scaled(r, F.lit(0.37), F.lit(0.41)), G.display_box(r, F.lit(0.37), F.lit(0.41))
    return d.select("page_id", "det_idx", b["x"].alias("bx"), b["y"].alias("by"), b["width"].alias("bw"), b["height"].alias("bh"), s["x"].alias("sx"), s["y"].alias("sy"), v["x"].alias("dx")).distinct()


@query("""
WITH p AS (SELECT DISTINCT page_id, (page_idx % 4) * 90.0 - 90 + 3 AS rotation FROM ocr_pages WHERE page_id IS NOT NULL),
k AS (SELECT page_id, rotation, CASE WHEN round(rotation / 90) * 90 IN (0, -90, 90, 180) THEN CAST(round(rotation / 90) * 90 AS INT) ELSE 0 END AS q FROM p),
e AS (SELECT page_id, CASE q WHEN 0 THEN [0.0, 0.4, 0.0, 0.12] WHEN -90 THEN [0.0, 0.12, 0.6, 1.0] WHEN 90 THEN [0.88, 1.0, 0.0, 0.4] ELSE [0.6, 1.0, 0.88, 1.0] END AS r FROM k)
SELECT page_id, CAST(trunc(2480 * r[1]) AS INT) AS x, CAST(trunc(3508 * r[3]) AS INT) AS y, CAST(trunc(2480 * r[2]) - trunc(2480 * r[1]) AS INT) AS width,
  CAST(trunc(3508 * r[4]) - trunc(3508 * r[3]) AS INT) AS height FROM e""")
def header_bounds(spark, folder):
    p = table(spark, folder, "ocr_pages").filter("page_id IS NOT NULL").select("page_id", ((F.col("page_idx") % 4) * 90.0 - 87).alias("rotation")).distinct()
    return p.select("page_id", G.header_bounds(F.col("rotation"), F.lit(2480), F.lit(3508)).alias("r")).select("page_id", "r.*")


@query("""
SELECT DISTINCT page_id, det_idx, CAST(floor(x * 0.5004 + 0.5) AS INT) AS x_min, CAST(floor((x + width) * 0.5004 + 0.5) AS INT) AS x_max, CAST(floor(width * 0.5004 + 0.5) AS INT) AS width FROM det""")
def editor_scaling(spark, folder):
    r = G.rect(*[F.col(c) for c in ("x", "y", "width", "height")])
    e = G.to_template(r, F.lit(0.5004), F.lit(0.5))
    return blocks(spark, folder).select("page_id", "det_idx", e["x_min"].alias("x_min"), e["x_max"].alias("x_max"), e["width"].alias("width")).distinct()


@query("""
SELECT DISTINCT page_id, det_idx, greatest(CAST(trunc(y - 26.5) AS INT), 0) AS top, least(CAST(trunc(y + 26.5) AS INT), 3508) AS bottom,
  CASE WHEN least(x + width, 2480) - 3 > greatest(x, 0) + 3 AND least(y + height, 3508) - 3 > greatest(y, 0) + 3 THEN least(x + width, 2480) - greatest(x, 0) - 6 END AS inner_width FROM det""")
def strips_and_insets(spark, folder):
    r = G.rect(*[F.col(c) for c in ("x", "y", "width", "height")])
    top, bottom = G.strip_bounds(F.col("y"), F.lit(53), F.lit(3508))
    return blocks(spark, folder).select("page_id", "det_idx", top.alias("top"), bottom.alias("bottom"), G.inset(r, F.lit(2480), F.lit(3508))["width"].alias("inner_width")).distinct()


# ---- matching ----------------------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT label, min(vec_id) AS template_id FROM embeddings GROUP BY label),
s AS (SELECT template_id, CAST(embedding AS DOUBLE[]) AS e FROM t JOIN embeddings ON vec_id = template_id),
c AS (SELECT p.vec_id AS page_id, s.template_id, round(list_dot_product(CAST(p.embedding AS DOUBLE[]), s.e) /
  (sqrt(list_dot_product(CAST(p.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))) * sqrt(list_dot_product(s.e, s.e)) + 1e-10), 4) AS similarity FROM embeddings p, s),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, template_id) AS rank FROM c)
SELECT page_id, template_id, similarity, CAST(rank AS INT) AS rank, rank = 1 AND similarity >= 0.85 AS is_match FROM r WHERE rank <= 5""")
def template_top5(spark, folder):
    e = table(spark, folder, "embeddings")
    t = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("t")).select(F.col("t.vec_id").alias("template_id"), F.col("t.embedding").alias("signature"))
    return matching.template_scores(e.select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("signature")), t)


@query("""
WITH t AS (SELECT DISTINCT form_type, replace(form_type, ' ', '-') AS k FROM template_entries WHERE form_type IS NOT NULL),
d AS (SELECT replace(form_type, ' ', '-') AS form_key, form_type_id AS load_order FROM form_types),
l AS (SELECT replace(form_key, '-', '') AS loose, arg_min(form_key, load_order) AS second FROM d GROUP BY 1)
SELECT t.form_type, coalesce(e.form_key, l.second, t.k) AS form_key, e.form_key IS NOT NULL OR l.second IS NOT NULL AS has_definition
FROM t LEFT JOIN (SELECT DISTINCT form_key FROM d) e ON e.form_key = t.k LEFT JOIN l ON l.loose = replace(t.k, '-', '')""")
def definition_keys(spark, folder):
    types = table(spark, folder, "template_entries").filter("form_type IS NOT NULL")
    forms = table(spark, folder, "form_types").select(T.form_key(F.col("form_type")).alias("form_key"), F.col("form_type_id").alias("load_order"))
    return matching.definition_keys(types, forms)


@query("""
SELECT form_type, max(definition_id) AS definition_id FROM (
  SELECT form_type, definition_id, rank() OVER (PARTITION BY form_type ORDER BY saved_at DESC, definition_id DESC) AS r FROM definitions WHERE form_type IS NOT NULL AND form_type <> '') WHERE r = 1 GROUP BY form_type""")
def latest_definitions(spark, folder):
    d = table(spark, folder, "definitions").select("form_type", "definition_id", "saved_at")
    return matching.latest_definitions(d, "form_type", ["saved_at", "definition_id"]).select("form_type", "definition_id")


# ---- text --------------------------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_T = _STRIP.format("t")
_FIRST = _STRIP.format(f"split_part({_T}, chr(10), 1)")


@query(rf"""
WITH v AS (SELECT DISTINCT full_text AS t FROM ocr_pages UNION SELECT DISTINCT form_type FROM template_entries),
m AS (SELECT t, coalesce(nullif(regexp_extract({_T}, 'bestellblatt\s*(\d+|[A-Za-z])', 1, 'i'), ''), nullif(regexp_extract({_T}, 'bestell?\s*blatt\s*(\d+|[A-Za-z])', 1, 'i'), ''),
  nullif(regexp_extract({_T}, 'beste\s*l+\s*b?l?att\s*(\d+|[A-Za-z])', 1, 'i'), ''), nullif(regexp_extract({_T}, 'beste\s*[iu]l?att\s*(\d+|[A-Za-z])', 1, 'i'), '')) AS s,
  nullif(regexp_extract({_T}, '[Ff]ormular\s*(\d+|[A-Za-z])', 1), '') AS f, {_FIRST} AS l FROM v)
SELECT t AS source, CASE WHEN t IS NULL OR t = '' THEN 'unknown' WHEN s IS NOT NULL THEN 'Bestellblatt ' || s WHEN f IS NOT NULL THEN 'Formular ' || f
  WHEN length(l) > 0 AND length(l) < 50 THEN l ELSE 'unknown' END AS form_type FROM m""")
def form_type_extract(spark, folder):
    v = table(spark, folder, "ocr_pages").select(F.col("full_text").alias("source")).union(table(spark, folder, "template_entries").select("form_type"))
    return v.distinct().select("source", T.form_type(F.col("source")).alias("form_type"))


def _values(spark, folder, name, column):
    return table(spark, folder, name).select(F.col(column).alias("v")).filter("v IS NOT NULL").distinct()


@query(r"""
SELECT v, CASE WHEN regexp_extract(v, '(\d+)', 1) <> '' THEN regexp_extract(v, '(\d+)', 1) ELSE trim(regexp_replace(v, '\s+', ' ', 'g')) END AS clean
FROM (SELECT DISTINCT product_number AS v FROM template_entries WHERE product_number IS NOT NULL)""")
def clean_number(spark, folder):
    return _values(spark, folder, "template_entries", "product_number").select("v", T.quantity(F.col("v")).alias("clean"))


@query(r"""
SELECT v, regexp_replace(v, '[^0-9\-()]', '', 'g') AS code, regexp_replace(v, '[^\p{Nd}]', '', 'g') AS digits
FROM (SELECT DISTINCT product_number AS v FROM template_entries WHERE product_number IS NOT NULL)""")
def clean_code(spark, folder):
    return _values(spark, folder, "template_entries", "product_number").select("v", T.product_code(F.col("v")).alias("code"), T.digits(F.col("v")).alias("digits"))


@query(r"""
SELECT v, regexp_replace(regexp_replace(v, '^\[\s*', ''), '^\]\s*', '') AS name, regexp_replace(v, '^[0-9-]+\s*', '') AS bare, trim(regexp_replace(v, '\s+', ' ', 'g')) AS spaced
FROM (SELECT DISTINCT product_name AS v FROM template_entries WHERE product_name IS NOT NULL)""")
def clean_name(spark, folder):
    c = F.col("v")
    return _values(spark, folder, "template_entries", "product_name").select("v", T.product_name(c).alias("name"), T.without_code(c).alias("bare"), T.collapse_spaces(c).alias("spaced"))


@query(r"""
SELECT v, regexp_extract(v, '^(\d{1,3}(?:-\d{1,3})?)', 1) AS code,
  CASE WHEN regexp_extract(v, '^(\d{1,3}(?:-\d{1,3})?)', 1) <> '' THEN regexp_replace(regexp_replace(v, '^(\d{1,3}(?:-\d{1,3})?)', ''), '^[\s\-.]+', '') ELSE v END AS name
FROM (SELECT DISTINCT coalesce(code || ' - ', '') || product_name AS v FROM product_list WHERE product_name IS NOT NULL)""")
def split_code_name(spark, folder):
    p = table(spark, folder, "product_list").filter("product_name IS NOT NULL")
    v = p.select(F.concat(F.coalesce(F.concat("code", F.lit(" - ")), F.lit("")), "product_name").alias("v")).distinct()
    return v.select("v", T.leading_code(F.col("v")).alias("code"), T.after_code(F.col("v")).alias("name"))


@query(r"""
SELECT v, regexp_replace(v, '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\-.]', '_', 'g') AS safe FROM (SELECT DISTINCT filename AS v FROM attachments WHERE filename IS NOT NULL)""")
def safe_filename(spark, folder):
    return _values(spark, folder, "attachments", "filename").select("v", T.safe_filename(F.col("v")).alias("safe"))


@query(r"SELECT v, regexp_replace(regexp_extract(v, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM (SELECT DISTINCT path AS v FROM emails WHERE path IS NOT NULL)")
def path_stem(spark, folder):
    return _values(spark, folder, "emails", "path").select("v", T.stem(F.col("v")).alias("stem"))


@query("""
SELECT page_id, string_agg(text, ' ' ORDER BY det_idx, text) AS joined FROM (SELECT DISTINCT page_id, det_idx, text FROM det WHERE text IS NOT NULL) GROUP BY page_id""")
def text_join(spark, folder):
    d = blocks(spark, folder).select("page_id", "det_idx", "text").filter("text IS NOT NULL").distinct()
    return d.groupBy("page_id").agg(T.joined(F.col("text"), F.col("det_idx")).alias("joined"))


@query("""
SELECT CAST(count(*) FILTER (contains(lower(text), 'monats')) AS BIGINT) AS top, CAST(count(*) FILTER (contains(text, '210') AND contains(text, '212')) AS BIGINT) AS bottom,
  CAST(count(*) FILTER (contains(lower(text), 'sandwich') AND NOT contains(lower(text), 'crustino')) AS BIGINT) AS saturday, CAST(count(*) AS BIGINT) AS texts FROM det WHERE text IS NOT NULL""")
def anchor_texts(spark, folder):
    t = F.col("text")
    return detections(spark, folder).filter(t.isNotNull()).agg(
        F.count_if(T.is_top_anchor(t)).alias("top"), F.count_if(T.is_bottom_anchor(t)).alias("bottom"), F.count_if(T.is_saturday_anchor(t)).alias("saturday"), F.count("*").alias("texts")
    )


@query("SELECT v, 'data:text/plain;base64,' || to_base64(encode(v)) AS url FROM (SELECT DISTINCT subject AS v FROM emails WHERE subject IS NOT NULL)")
def data_urls(spark, folder):
    return _values(spark, folder, "emails", "subject").select("v", T.data_url(F.encode("v", "UTF-8"), F.lit("text/plain")).alias("url"))


# ---- e-mails -----------------------------------------------------------------------------------------------------------

_PDF = "coalesce(content_type = 'application/pdf', false) OR coalesce(lower(filename) LIKE '%.pdf', false)"
_LISTED = f"""
WITH a AS (SELECT DISTINCT email_id, att_idx, filename, content_type, size_bytes FROM attachments),
l AS (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY att_idx, filename NULLS LAST, size_bytes NULLS LAST, content_type NULLS LAST) - 1 AS i FROM a WHERE {_PDF}),
r AS (SELECT email_id, CAST(i AS INT) AS "index", coalesce(nullif(filename, ''), email_id || '_attachment_' || CAST(i + 1 AS VARCHAR) || '.pdf') AS filename, coalesce(size_bytes, 0) AS size_bytes,
  CASE WHEN coalesce(size_bytes, 0) < 1048576 THEN printf('%.1f KB', round_even(coalesce(size_bytes, 0) * 10 / 1024.0, 0) / 10) ELSE printf('%.1f MB', round_even(coalesce(size_bytes, 0) * 10 / 1048576.0, 0) / 10) END AS size_readable FROM l)
"""


def _listed(spark, folder):
    a = table(spark, folder, "attachments").select("email_id", "att_idx", "filename", "content_type", "size_bytes").distinct()
    order = [F.asc_nulls_last(c) for c in ("att_idx", "filename", "size_bytes", "content_type")]
    return emails.list_attachments(a, ["email_id"], order, F.col("email_id"))


@query(_LISTED + "SELECT * FROM r")
def attachment_listing(spark, folder):
    return _listed(spark, folder)


@query(_LISTED + """SELECT * FROM r WHERE size_bytes > 0 AND EXISTS (SELECT 1 FROM emails e WHERE e.email_id = r.email_id AND e.size_bytes % 3 = r."index")""")
def selected_attachments(spark, folder):
    chosen = table(spark, folder, "emails").select("email_id", (F.col("size_bytes") % 3).cast("int").alias("index"))
    return emails.select_attachments(_listed(spark, folder), chosen, ["email_id"])


@query("""
SELECT DISTINCT email_id, CAST(size_bytes AS BIGINT) AS size_bytes, CASE WHEN size_bytes < 1048576 THEN printf('%.1f KB', round_even(size_bytes * 10 / 1024.0, 0) / 10) ELSE printf('%.1f MB', round_even(size_bytes * 10 / 1048576.0, 0) / 10) END AS readable
FROM attachments WHERE size_bytes IS NOT NULL""")
def readable_size(spark, folder):
    a = table(spark, folder, "attachments").filter("size_bytes IS NOT NULL")
    return a.select("email_id", "size_bytes", T.readable_size(F.col("size_bytes")).alias("readable")).distinct()


@query("""
SELECT mailbox, arg_max(path, (CAST(path LIKE 'inbox/%' AS INT), modification_time, path)) AS path FROM emails WHERE mailbox IS NOT NULL GROUP BY mailbox""")
def latest_file(spark, folder):
    from formflow.sources import files

    e = table(spark, folder, "emails").filter("mailbox IS NOT NULL")
    return files.latest(e, F.col("path").startswith("inbox/"), ["mailbox"])


@query("""
SELECT strftime(modification_time AT TIME ZONE 'UTC', '%Y%m%d_%H%M%S_') || substr(sha256(path || '|' || size_bytes), 1, 8) AS task_id, path FROM emails WHERE path IS NOT NULL AND size_bytes IS NOT NULL""")
def task_ids(spark, folder):
    """Replay-safe ids: time and a hash of what identifies the file."""
    e = table(spark, folder, "emails").filter("path IS NOT NULL AND size_bytes IS NOT NULL")
    return e.select(T.task_id_of(F.col("modification_time"), F.concat_ws("|", "path", F.col("size_bytes").cast("string"))).alias("task_id"), "path")


# ---- quality -----------------------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT definition_id AS doc_id, CAST(product_row AS VARCHAR) AS field, min(product_number) AS expected FROM template_entries WHERE product_row <= 12 GROUP BY ALL),
b AS (SELECT definition_id AS doc_id, CAST(product_row AS VARCHAR) AS field, max(product_number) AS actual FROM template_entries WHERE product_row >= 3 GROUP BY ALL),
c AS (SELECT doc_id, CASE WHEN b.field IS NULL THEN 'missing' WHEN a.field IS NULL THEN 'new' WHEN expected IS NOT DISTINCT FROM actual THEN 'same' ELSE 'changed' END AS state
  FROM a FULL JOIN b USING (doc_id, field))
SELECT doc_id, CASE WHEN count(*) FILTER (state <> 'new') > 0 THEN round(count(*) FILTER (state IN ('changed', 'missing')) / count(*) FILTER (state <> 'new'), 4) ELSE 0.0 END AS anomaly_score,
  CAST(count(*) FILTER (state = 'changed') AS BIGINT) AS changed_fields, CAST(count(*) FILTER (state = 'missing') AS BIGINT) AS missing_fields, CAST(count(*) FILTER (state = 'new') AS BIGINT) AS new_fields FROM c GROUP BY doc_id""")
def anomaly_full_outer(spark, folder):
    e = table(spark, folder, "template_entries")
    key = [F.col("definition_id").alias("doc_id"), F.col("product_row").cast("string").alias("field")]
    a = e.filter("product_row <= 12").groupBy(*key).agg(F.min("product_number").alias("value"))
    b = e.filter("product_row >= 3").groupBy(*key).agg(F.max("product_number").alias("value"))
    return quality.anomaly_report(quality.compare_fields(a, b))


@query("""
SELECT definition_id, product_row FROM (SELECT DISTINCT definition_id, product_row FROM template_entries WHERE product_number IS NOT NULL)
EXCEPT SELECT definition_id, product_row FROM template_entries WHERE product_name IS NOT NULL""")
def new_fields(spark, folder):
    e = table(spark, folder, "template_entries")
    key = ["definition_id", "product_row"]
    return e.filter("product_number IS NOT NULL").select(*key).distinct().join(e.filter("product_name IS NOT NULL"), key, "left_anti")


@query("""
WITH c AS (SELECT definition_id, form_type, count(*) AS uses, min(entry_id) AS f FROM template_entries WHERE form_type IS NOT NULL GROUP BY ALL)
SELECT definition_id, arg_max(form_type, (uses, -f)) AS form_type, max(uses) AS uses FROM c GROUP BY definition_id""")
def form_type_mode(spark, folder):
    return quality.first_mode(table(spark, folder, "template_entries"), "form_type", "entry_id", ["definition_id"])


@query("""
SELECT page_id, coalesce(floor(sum(CAST(round(confidence * 1000000) AS BIGINT)) / (count(confidence) * 1000000.0) * 10000 + 0.5) / 10000, 0.0) AS confidence, CAST(count(confidence) AS BIGINT) AS block_count FROM det GROUP BY page_id""")
def mean_confidence(spark, folder):
    return quality.mean_confidence(detections(spark, folder), "confidence", ["page_id"])


@query("""
WITH s AS (SELECT user_id, event_id % 4 AS o, round(sum(value), 6) AS score FROM events GROUP BY ALL)
SELECT user_id, CAST(arg_max(o, (score, -o)) * 90 AS BIGINT) AS angle, max(score) AS score FROM s GROUP BY user_id""")
def orientation_score(spark, folder):
    e = table(spark, folder, "events").filter("value IS NOT NULL").select("user_id", (F.col("event_id") % 4).alias("angle_order"), (F.col("event_id") % 4 * 90).alias("angle"), F.col("value").alias("confidence"))
    return quality.orientation(e, ["user_id"])


@query("""
WITH m AS (SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median_angle FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, median_angle, CASE WHEN abs(median_angle) BETWEEN 0.3 AND 10 THEN round(median_angle, 2) ELSE 0.0 END AS applied FROM m""")
def median_angle(spark, folder):
    return quality.median_angle(table(spark, folder, "events").filter("value IS NOT NULL"), F.col("value"), ["user_id"])


@query("SELECT CAST(r.i AS INT) AS label, CAST(count(e.label) AS BIGINT) AS n FROM range(10) AS r(i) LEFT JOIN embeddings e ON e.label = r.i GROUP BY r.i")
def class_counts(spark, folder):
    return quality.class_counts(table(spark, folder, "embeddings"), "label")


@query("""
WITH c AS (SELECT r.i AS label, count(e.label) AS n FROM range(10) AS r(i) LEFT JOIN embeddings e ON e.label = r.i GROUP BY r.i)
SELECT CAST(sum(n) AS BIGINT) AS total, min(n) AS least, max(n) AS most, CAST(count(*) FILTER (n = 0) AS BIGINT) AS missing,
  CASE WHEN min(n) = 0 THEN 'abort_missing' WHEN min(n) < 10 THEN 'abort_few' WHEN max(n) > 5 * min(n) THEN 'warn_unbalanced' ELSE 'ok' END AS verdict FROM c""")
def class_balance_gate(spark, folder):
    return quality.balance_gate(quality.class_counts(table(spark, folder, "embeddings"), "label"))


@query("SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN label = vec_id % 10 THEN 1 ELSE 0 END), 6) AS accuracy FROM embeddings GROUP BY label")
def accuracy(spark, folder):
    e = table(spark, folder, "embeddings").withColumn("guess", F.col("vec_id") % 10)
    return quality.accuracy(e, "label", "guess", ["label"])


@query("""
SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id % 97, vec_id) AS r FROM embeddings) WHERE r <= 5""")
def stratified_sample(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "label")
    return quality.stratified_sample(e, "label", 5, [F.col("vec_id") % 97, F.col("vec_id")])


@query("SELECT label, CAST(v.i AS INT) AS variant, CAST(count(*) AS BIGINT) AS n FROM embeddings, range(10) AS v(i) GROUP BY ALL")
def augmentation(spark, folder):
    return quality.augmented(table(spark, folder, "embeddings").select("label")).groupBy("label", "variant").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT l_suppkey AS cell_id, l_quantity * 5 AS v FROM lineitem)
SELECT cell_id, round(var_pop(v), 4) AS variance, round(avg(CASE WHEN v > 200 THEN 1 ELSE 0 END), 6) AS bright, round(avg(CASE WHEN v < 100 THEN 1 ELSE 0 END), 6) AS dark,
  var_pop(v) < 50 OR avg(CASE WHEN v > 200 THEN 1 ELSE 0 END) > 0.95 OR avg(CASE WHEN v < 100 THEN 1 ELSE 0 END) < 0.01 AS is_empty FROM p GROUP BY cell_id""")
def empty_cell_stats(spark, folder):
    p = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("cell_id"), (F.col("l_quantity") * 5).alias("v"))
    s = quality.intensity_stats(p, "v", ["cell_id"])
    return s.select("cell_id", F.round("variance", 4).alias("variance"), F.round("bright", 6).alias("bright"), F.round("dark", 6).alias("dark"), "is_empty")


@query("SELECT l_returnflag, CAST(floor(l_quantity * 5 / 8) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity * 5 BETWEEN 0 AND 255.999 GROUP BY ALL")
def intensity_histogram(spark, folder):
    p = table(spark, folder, "lineitem").select("l_returnflag", (F.col("l_quantity") * 5).alias("v"))
    return quality.histogram(p, "v", ["l_returnflag"])


@query("""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (ok) AS BIGINT) AS successful, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed FROM (SELECT json_valid(body) AS ok FROM definitions WHERE body IS NOT NULL)""")
def batch_summary(spark, folder):
    d = table(spark, folder, "definitions").filter("body IS NOT NULL").withColumn("ok", F.try_parse_json("body").isNotNull()).withColumn("n", F.length("body"))
    return quality.batch_summary(d, "ok", "definition_id", "n").drop("definitions")


# ---- order, sets, pipeline ---------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 20""")
def top20_fields(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return layout.first_of(rows, 20, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("""
, s AS (SELECT page_id, list_sort(list(DISTINCT x)) AS xs FROM det GROUP BY page_id)
SELECT page_id, array_to_string(CASE WHEN len(xs) >= 6 THEN xs[-6:] ELSE xs END, ',') AS last_lines FROM s""")
def last_lines(spark, folder):
    xs = blocks(spark, folder).groupBy("page_id").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    last = F.when(F.size("xs") >= 6, F.slice("xs", -6, 6)).otherwise(F.col("xs"))
    return xs.select("page_id", F.array_join(F.transform(last, lambda v: v.cast("string")), ",").alias("last_lines"))


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'code' AS kind FROM det WHERE regexp_matches(text, '\\d') UNION ALL SELECT 'name' FROM det WHERE regexp_matches(text, '[A-Za-z]')) GROUP BY kind")
def union_strips(spark, folder):
    d = detections(spark, folder)
    codes, names = d.filter(F.col("text").rlike(r"\d")), d.filter(F.col("text").rlike("[A-Za-z]"))
    return codes.select(F.lit("code").alias("kind")).unionByName(names.select(F.lit("name").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, event_id % 4 AS s, min(ts) AS finished FROM events WHERE event_id % 7 < 3 AND event_id % 4 < 3 GROUP BY ALL),
d AS (SELECT user_id, list(s) AS done, max(finished) AS last FROM r GROUP BY user_id),
w AS (SELECT t.user_id, done, last, CASE WHEN done IS NULL OR NOT list_contains(done, 0) THEN 0 WHEN NOT list_contains(done, 1) THEN 1 WHEN NOT list_contains(done, 2) THEN 2 ELSE 3 END AS wait FROM t LEFT JOIN d USING (user_id))
SELECT CAST(user_id AS VARCHAR) AS task_id, CASE WHEN wait = 3 THEN 'completed' WHEN done IS NULL THEN 'pending' ELSE 'processing' END AS status, ['opencv', 'layout', 'ml'][least(wait, 2) + 1] AS current_stage FROM w""")
def stage_progress(spark, folder):
    e = table(spark, folder, "events")
    tasks = e.select(F.col("user_id").cast("string").alias("task_id")).distinct().withColumn("eml_file", F.lit("")).withColumn("created_at", F.lit(None).cast("timestamp"))
    stage = F.element_at(F.array(F.lit("opencv"), F.lit("layout"), F.lit("ml")), (F.col("event_id") % 4 + 1).cast("int"))
    results = e.filter("event_id % 7 < 3 AND event_id % 4 < 3").select(F.col("user_id").cast("string").alias("task_id"), stage.alias("stage"), F.col("ts").alias("finished_at"))
    return pipeline.progress(tasks, results).select("task_id", "status", "current_stage")


@query("SELECT path FROM emails WHERE path NOT IN (SELECT path FROM emails WHERE path LIKE 'redelivered/%' AND path IS NOT NULL) AND path IS NOT NULL")
def unprocessed_files(spark, folder):
    e = table(spark, folder, "emails").filter("path IS NOT NULL").select("path")
    return pipeline.unprocessed(e, e.filter(F.col("path").startswith("redelivered/")).select(F.col("path").alias("eml_file")))
