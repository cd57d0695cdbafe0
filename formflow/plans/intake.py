"""Queries of the intake operators that need messages, pixels or files, with their SQL.

The tables hold no file bytes, so messages and pages are made from their rows
here and read back by the operators; the SQL says what has to come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formflow.functions import geometry as G
from formflow.functions import text as T
from formflow.operators import emails, layout, matching, pages, quality, scan, training
from formflow.plans.reference import _BLOBS, _blobs, detections, query
from formflow.session import table
from formflow.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """:func:`formflow.plans.reference.query` into this module's tables."""
    return query(sql, QUERIES, ORACLES)


# ---- e-mails -----------------------------------------------------------------------------------------------------------


def _base64(c):
    """Base64 in one line."""
    return F.regexp_replace(F.base64(c), r"\s", "")


def _header(name: str, value: str):
    """A header line with its text as one encoded word; none for a null or empty text."""
    word = _base64(F.encode(F.col(value), "UTF-8"))
    return F.when(F.length(value) > 0, F.concat(F.lit(f"{name}: =?utf-8?b?"), word, F.lit("?=\r\n"))).otherwise("")


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    """One message file per row of ``emails``, its attachments as MIME parts; ``email_id, path, content``."""
    kind = F.coalesce(F.nullif("content_type", F.lit("")), F.lit("application/octet-stream"))
    name = F.when(F.length("filename") > 0, F.concat(F.lit('; filename="=?utf-8?b?'), _base64(F.encode("filename", "UTF-8")), F.lit('?="'))).otherwise("")
    payload = F.base64(F.encode(F.repeat(F.lit("x"), (F.coalesce("size_bytes", F.lit(0)) % 100).cast("int")), "UTF-8"))
    part = F.concat(
        F.lit("--cut\r\nContent-Type: "), kind, F.lit("\r\nContent-Transfer-Encoding: base64\r\nContent-Disposition: attachment"), name,
        F.lit("\r\n\r\n"), payload, F.lit("\r\n"),
    )
    a = table(spark, folder, "attachments").select("email_id", "att_idx", "filename", "content_type", "size_bytes").distinct()
    parts = a.groupBy("email_id").agg(F.array_join(F.array_sort(F.collect_list(part)), "").alias("parts"))
    head = F.concat(*[_header(*x) for x in (("Subject", "subject"), ("From", "from_header"), ("To", "to_header"), ("Date", "date_header"), ("Message-ID", "message_id"))])
    body = F.concat(F.lit('MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="cut"\r\n\r\n'), F.coalesce("parts", F.lit("--cut\r\n\r\n")), F.lit("--cut--\r\n"))
    mails = table(spark, folder, "emails").filter("path IS NOT NULL").join(parts, "email_id", "left")
    return mails.select("email_id", "path", F.encode(F.concat(head, body), "UTF-8").alias("content"))


@register("""
SELECT path, coalesce(subject, '') AS subject, coalesce(from_header, '') AS sender, coalesce(to_header, '') AS receiver, coalesce(date_header, '') AS sent,
       coalesce(message_id, '') AS message_id FROM emails WHERE path IS NOT NULL""")
def mail_headers(spark, folder):
    """Header projection of parsed messages."""
    m = emails.parse_messages(_messages(spark, folder))
    return m.select("path", "metadata.subject", F.col("metadata.from").alias("sender"), F.col("metadata.to").alias("receiver"), F.col("metadata.date").alias("sent"), "metadata.message_id")


_PARTS = """
WITH a AS (SELECT DISTINCT email_id, att_idx, filename, content_type, size_bytes FROM attachments),
p AS (SELECT e.path, nullif(a.filename, '') AS filename, lower(coalesce(nullif(a.content_type, ''), 'application/octet-stream')) AS content_type, CAST(coalesce(a.size_bytes, 0) % 100 AS BIGINT) AS size_bytes
  FROM emails e JOIN a USING (email_id) WHERE e.path IS NOT NULL),
f AS (SELECT *, content_type = 'application/pdf' OR coalesce(lower(filename) LIKE '%.pdf', false) AS is_pdf FROM p)
"""


@register(_PARTS + "SELECT path, filename, content_type, size_bytes FROM f WHERE is_pdf")
def mail_parts(spark, folder):
    """PDF parts of parsed messages, walked in any depth."""
    rows = emails.attachment_rows(emails.parse_messages(_messages(spark, folder)), "path")
    return rows.filter(emails.is_pdf(F.col("content_type"), F.col("filename"))).select("path", "filename", "content_type", "size_bytes")


@register(_PARTS + "SELECT path, filename, is_pdf, CASE WHEN NOT is_pdf THEN 'data:image/png;base64,' || to_base64(encode(repeat('x', CAST(size_bytes AS INT)))) END AS data FROM f WHERE filename IS NOT NULL AND size_bytes > 0 AND (content_type LIKE 'image/%' OR is_pdf)")
def interactive_parts(spark, folder):
    """Named images and PDFs with a payload, images as data URLs."""
    rows = emails.attachment_rows(emails.parse_messages(_messages(spark, folder)), "path")
    return emails.interactive_attachments(rows).select("path", "filename", "is_pdf", "data")


@register(_PARTS + """, c AS (SELECT path, count(*) AS n, sum(size_bytes) AS s FROM f WHERE is_pdf GROUP BY path)
SELECT e.path, coalesce(e.subject, '') AS subject, CAST(coalesce(c.n, 0) AS INT) AS attachments, CAST(coalesce(c.s, 0) AS BIGINT) AS size_bytes FROM emails e LEFT JOIN c USING (path) WHERE e.path IS NOT NULL""")
def mail_preview(spark, folder):
    """Metadata and attachment lists of messages, nothing extracted."""
    m = emails.parse_messages(_messages(spark, folder)).withColumn("key", F.col("path"))
    total = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["size_bytes"])
    return emails.preview(m, "key").select(F.col("key").alias("path"), "metadata.subject", F.size("attachments").alias("attachments"), total.alias("size_bytes"))


@register("SELECT DISTINCT subject AS v, subject AS back FROM emails WHERE subject IS NOT NULL AND subject <> ''")
def data_url_round_trip(spark, folder):
    v = table(spark, folder, "emails").filter("subject <> ''").select(F.col("subject").alias("v")).distinct()
    return v.select("v", F.decode(T.from_data_url(T.data_url(F.encode("v", "UTF-8"), F.lit("image/png"))), "UTF-8").alias("back"))


# ---- pixels ------------------------------------------------------------------------------------------------------------

_PIXELS = """
WITH px AS (SELECT l_suppkey AS page_id, CAST(l_quantity * 5 AS INT) AS b, CAST(l_linenumber * 30 AS INT) AS g, CAST(l_orderkey % 256 AS INT) AS r,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
im AS (SELECT page_id, i // 20 AS y, i % 20 AS x, n // 20 AS h, round_even(CAST(0.114 AS DOUBLE) * b + CAST(0.587 AS DOUBLE) * g + CAST(0.299 AS DOUBLE) * r, 0) AS v FROM px WHERE i < n // 20 * 20)
"""


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page of 20 pixels in a row per supplier, from its order lines."""
    byte = lambda c: F.lpad(F.hex(c.cast("int")), 2, "0")
    pixel = F.concat(byte(F.col("l_quantity") * 5), byte(F.col("l_linenumber") * 30), byte(F.col("l_orderkey") % 256))
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("page_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", pixel.alias("p")))).alias("px")
    )  # a page's pixels
    h = F.floor(F.size("px") / 20).cast("int")
    data = F.unhex(F.array_join(F.transform(F.slice("px", F.lit(1), h * 20), lambda x: x["p"]), ""))
    image = F.struct(h.alias("height"), F.lit(20).alias("width"), F.lit(3).alias("nChannels"), data.alias("data"))
    return rows.select("page_id", image.alias("image")).filter("image.height > 0")


@register(_PIXELS + "SELECT page_id, CAST(max(h) AS INT) AS height, CAST(sum(v) AS BIGINT) AS total, CAST(min(v) AS INT) AS darkest, CAST(max(v) AS INT) AS brightest FROM im GROUP BY page_id")
def gray_pages(spark, folder):
    """Luma of colour pages."""

    def measure(page):
        from formflow.operators import kernels

        g = kernels.gray(page)
        return [(int(g.shape[0]), int(g.sum(dtype="int64")), int(g.min()), int(g.max()))]

    return pages.map_pages(_pages(spark, folder), ["page_id"], measure, "height int, total long, darkest int, brightest int")


@register(_PIXELS + """, c AS (SELECT page_id, max(h) AS h, var_pop(v) FILTER (inside) AS var, avg(CAST(v > 200 AS INT)) FILTER (inside) AS bright, avg(CAST(v < 100 AS INT)) FILTER (inside) AS dark
  FROM (SELECT *, x BETWEEN 3 AND 16 AND y BETWEEN 3 AND h - 4 AS inside FROM im) GROUP BY page_id)
SELECT page_id, 'whole' AS cell_id, h > 6 AS croppable, h > 6 AND coalesce(var < 50 OR bright > 0.95 OR dark < 0.01, false) AS empty FROM c""")
def empty_cells(spark, folder):
    """Inset crops of pages and whether they are empty."""
    p = _pages(spark, folder)
    cells = p.select("page_id", F.lit("whole").alias("cell_id"), G.rect(F.lit(0), F.lit(0), F.lit(20), F.col("image.height")).alias("bounds"))
    return pages.cell_measures(p, cells)


@register(_PIXELS + """, b AS (SELECT page_id, CAST(floor(v / 8) AS INT) AS bin, count(*) AS n FROM im GROUP BY ALL)
SELECT page_id, bin, CAST(n AS BIGINT) AS n FROM b""")
def page_histogram(spark, folder):
    """Histogram of the gray values of pages in 32 bins."""

    def bins(page):
        import numpy as np

        from formflow.operators import kernels

        n = np.histogram(kernels.gray(page), bins=32, range=(0, 256))[0]
        return [(int(k), int(n[k])) for k in np.flatnonzero(n)]

    return pages.map_pages(_pages(spark, folder), ["page_id"], bins, "bin int, n long")


@register(f"""
SELECT page_id, blob_idx FROM ({_BLOBS}) WHERE area BETWEEN 40 AND 5000 AND CAST(width AS DOUBLE) / height BETWEEN 0.1 AND 4.0
  AND width >= 4 AND height >= 8 AND width <= 80 AND height <= 80""")
def older_zone_blobs(spark, folder):
    """The older limits of the zone scan."""
    return _blobs(spark, folder).filter(scan.zone_blob(F.col("width"), F.col("height"), F.col("area"), "older")).select("page_id", "blob_idx")


@register("""
WITH p AS (SELECT l_orderkey, l_linenumber, CAST(2400 + l_suppkey % 160 AS INT) AS width, CAST(3508 - l_partkey % 60 AS INT) AS height FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(width - 2480) > 50 OR abs(height - 3508) > 50 THEN 2480 ELSE width END AS width,
  CASE WHEN abs(width - 2480) > 50 OR abs(height - 3508) > 50 THEN 3508 ELSE height END AS height, CAST(1.0 AS DOUBLE) AS score FROM p""")
def template_alignment(spark, folder):
    """Sizes of pages once aligned with their template."""
    p = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (2400 + F.col("l_suppkey") % 160).cast("int").alias("width"), (3508 - F.col("l_partkey") % 60).cast("int").alias("height")
    )
    return p.select("l_orderkey", "l_linenumber", G.aligned(F.col("width"), F.col("height"), F.lit(2480), F.lit(3508)).alias("a")).select("l_orderkey", "l_linenumber", "a.*")


# ---- scans -------------------------------------------------------------------------------------------------------------

_DEFINED = """
WITH r AS (SELECT replace(form_type, ' ', '-') AS form_key, body, saved_at, definition_id FROM definitions
  WHERE json_valid(body) AND form_type IS NOT NULL AND json_type(body, '$.products') = 'ARRAY' AND json_type(body, '$.columns.input_columns') = 'ARRAY' AND json_type(body, '$.products[0].cells') = 'OBJECT'),
d AS (SELECT form_key, arg_max(body, (saved_at, definition_id)) AS body FROM r GROUP BY form_key),
k AS (SELECT replace(form_key, '-', '') AS loose, min(form_key) AS second FROM d GROUP BY 1),
pg AS (SELECT DISTINCT coalesce(form_type, '') AS page_id, form_type, replace(form_type, ' ', '-') AS key1, replace(replace(form_type, ' ', '-'), '-', '') AS loose FROM template_entries),
nm AS (SELECT pg.page_id, pg.form_type, coalesce(e.form_key, k.second, pg.key1) AS form_key FROM pg LEFT JOIN d e ON e.form_key = pg.key1 LEFT JOIN k ON k.loose = pg.loose)
"""
_CELLS = _DEFINED + """
, co AS (SELECT form_key, body, CAST(i AS INT) AS col_order, json_extract_string(body, '$.columns.input_columns[' || i || '].name') AS col FROM d, UNNEST(range(0, CAST(json_array_length(body, '$.columns.input_columns') AS BIGINT))) AS u(i)),
ce AS (SELECT form_key, col_order, col, CASE WHEN json_type(body, '$.products[' || j || '].row') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(body, '$.products[' || j || '].row') AS INT) END AS row,
  json_extract(body, '$.products[' || j || '].cells.' || col) AS cell,
  CAST(json_extract_string(body, '$.image_dimensions.width') AS INT) AS iw, CAST(json_extract_string(body, '$.image_dimensions.height') AS INT) AS ih
  FROM co, UNNEST(range(0, CAST(json_array_length(body, '$.products') AS BIGINT))) AS u(j))
"""


def _definitions(spark: SparkSession, folder: str) -> DataFrame:
    """The last saved definition of each form key whose products, input columns and cells have the usual shape."""
    part = lambda path: F.get_json_object("body", path)
    d = table(spark, folder, "definitions").filter(
        F.try_parse_json("body").isNotNull() & F.col("form_type").isNotNull() & part("$.products").startswith("[")
        & part("$.columns.input_columns").startswith("[") & part("$.products[0].cells").startswith("{")
    ).withColumn("form_key", T.form_key(F.col("form_type")))
    last = d.groupBy("form_key").agg(F.max_by("body", F.struct("saved_at", "definition_id")).alias("body"))
    read = last.withColumn("d", F.from_json("body", files.DEFINITION))
    return read.select(
        "form_key", F.col("d.image_dimensions.width").alias("image_width"), F.col("d.image_dimensions.height").alias("image_height"),
        F.col("d.columns.input_columns").alias("columns"), "d.products",
    )


def _form_pages(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "template_entries").select("form_type").distinct()
    return p.select(F.coalesce("form_type", F.lit("")).alias("page_id"), "form_type", F.lit(1240).alias("width"), F.lit(1754).alias("height"))


@register(_CELLS + """
SELECT nm.page_id, nm.form_key, ce.col_order, ce.col AS "column", ce.row, CAST(trunc(CAST(json_extract_string(cell, '$.x') AS INT) * (CAST(1240 AS DOUBLE) / iw)) AS INT) AS x,
  CAST(trunc(CAST(json_extract_string(cell, '$.height') AS INT) * (CAST(1754 AS DOUBLE) / ih)) AS INT) AS height FROM nm JOIN ce USING (form_key) WHERE json_type(cell) = 'OBJECT'""")
def template_scan(spark, folder):
    """Cells of the definition that every form type finds, scaled to the page."""
    cells = scan.template_cells(_form_pages(spark, folder), _definitions(spark, folder)).filter("error IS NULL")
    return cells.select("page_id", "form_key", "col_order", "column", "row", "bounds.x", "bounds.height")


@register(_DEFINED + "SELECT page_id, form_key, 'No definition for form type: ' || coalesce(form_type, '') AS error FROM nm WHERE form_key IS NULL OR form_key NOT IN (SELECT form_key FROM d)")
def template_errors(spark, folder):
    """Pages without a definition keep one row with the error."""
    return scan.template_cells(_form_pages(spark, folder), _definitions(spark, folder)).filter("error IS NOT NULL").select("page_id", "form_key", "error")


@register("""
, c AS (SELECT page_id, det_idx, text, confidence, CAST(trunc(y / 53.0) AS INT) AS row_idx, CAST(trunc(x / 496.0) AS INT) AS col_idx FROM det),
t AS (SELECT page_id, row_idx, min(text) AS text FROM c WHERE text IS NOT NULL GROUP BY ALL)
SELECT c.page_id, c.det_idx AS blob_idx, c.text AS digit, confidence, row_idx + 1 AS "row", CASE WHEN col_idx < 5 THEN ['Mo','Di','Mi','Do','Fr'][col_idx + 1] ELSE 'Col' || CAST(col_idx + 1 AS VARCHAR) END AS "column",
  coalesce(k.text, '') AS product_code, coalesce(n.text, '') AS product_name
FROM (SELECT DISTINCT page_id, det_idx, text, confidence, row_idx, col_idx FROM c WHERE text IS NOT NULL AND confidence >= 0.4) c
LEFT JOIN (SELECT page_id, row_idx, text FROM t WHERE regexp_matches(text, '^[0-9]')) k USING (page_id, row_idx) LEFT JOIN (SELECT page_id, row_idx, text FROM t WHERE regexp_matches(text, '^[A-Z]')) n USING (page_id, row_idx)""")
def zone_orders(spark, folder):
    """Order lines of the zone scan with code and name of their row."""
    d = detections(spark, folder).withColumn("row_idx", (F.col("y") / 53.0).cast("int")).withColumn("col_idx", (F.col("x") / 496.0).cast("int"))
    texts = d.filter("text IS NOT NULL").groupBy("page_id", "row_idx").agg(F.min("text").alias("text"))
    # A blob is keyed by all it was read from, since repeated pages repeat its number.
    key = F.struct("det_idx", "text", "confidence", "row_idx", "col_idx").alias("blob_idx")
    cells = d.filter("text IS NOT NULL AND confidence IS NOT NULL").select("page_id", key, "row_idx", "col_idx").distinct()
    digits = d.filter("text IS NOT NULL AND confidence IS NOT NULL").select("page_id", key, F.col("text").alias("digit"), "confidence").distinct()
    lines = scan.zone_orders(cells, digits, texts.filter(F.col("text").rlike("^[0-9]")), texts.filter(F.col("text").rlike("^[A-Z]")))
    return lines.withColumn("blob_idx", F.col("blob_idx.det_idx"))


@register("""
SELECT entry_id, coalesce(nullif(product_name, ''), m.text) AS product_name, coalesce(product_name, '') = '' AND m.text IS NOT NULL AS filled
FROM (SELECT DISTINCT entry_id, product_number, product_name FROM template_entries) e LEFT JOIN (SELECT code, min(product_name) AS text FROM product_list WHERE product_name <> '' GROUP BY code) m ON m.code = e.product_number""")
def filled_products(spark, folder):
    """Product names still empty are filled from what is read for them (here: the list by number)."""
    e = table(spark, folder, "template_entries").select("entry_id", "product_number", "product_name").distinct()
    read = table(spark, folder, "product_list").groupBy(F.col("code").alias("product_number")).agg(F.min(F.nullif("product_name", F.lit(""))).alias("text"))
    return scan.fill_empty(e, read, "product_name", ["product_number"]).select("entry_id", "product_name", "filled")


# ---- layout, quality, files --------------------------------------------------------------------------------------------


@register("""
, n AS (SELECT page_id, count(*) AS n FROM det GROUP BY page_id)
SELECT p.page_id, CAST(coalesce(n.n, 0) AS BIGINT) AS text_regions, n.n IS NOT NULL AS has_layout FROM (SELECT DISTINCT page_id FROM ocr_pages WHERE page_id IS NOT NULL) p LEFT JOIN n USING (page_id)""")
def page_layout(spark, folder):
    """Pages with their layout, or without one."""
    d = detections(spark, folder)
    p = table(spark, folder, "ocr_pages").filter("page_id IS NOT NULL").select("page_id").distinct()
    return layout.with_layout(p, layout.layout_summary(d.limit(0), d.limit(0), d, d.limit(0))).select("page_id", "text_regions", "has_layout")


@register("SELECT t.entry_id, t.form_type, f.form_type_id FROM (SELECT DISTINCT entry_id, form_type FROM template_entries) t LEFT JOIN (SELECT form_type, min(form_type_id) AS form_type_id FROM form_types GROUP BY form_type) f USING (form_type)")
def registered_forms(spark, folder):
    """Form types with their entry in the registry."""
    t = table(spark, folder, "template_entries").select("entry_id", "form_type").distinct()
    return matching.registered(t, table(spark, folder, "form_types"), "form_type", "form_type_id")


@register("SELECT DISTINCT CAST(p.page_id AS VARCHAR) AS page_id, CAST(coalesce(m.rotation, 0) AS DOUBLE) AS rotation FROM ocr_pages p LEFT JOIN (SELECT page_id, min(page_idx % 4 * 90) AS rotation FROM ocr_pages WHERE page_idx > 0 GROUP BY page_id) m USING (page_id) WHERE p.page_id IS NOT NULL")
def page_rotations(spark, folder):
    """Pages with the rotation of their metadata, 0 without any."""
    p = table(spark, folder, "ocr_pages").filter("page_id IS NOT NULL")
    meta = p.filter("page_idx > 0").groupBy("page_id").agg(F.min(F.col("page_idx") % 4 * 90).alias("rotation"))
    return matching.rotations(p.select("page_id").distinct(), meta).select("page_id", "rotation")


@register("""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (ok) AS BIGINT) AS successful, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed,
  CAST(to_json(list({'name': definition_id, 'n': length(body)} ORDER BY definition_id, length(body)) FILTER (ok)) AS VARCHAR) AS definitions
FROM (SELECT definition_id, body, json_valid(body) AS ok FROM definitions WHERE body IS NOT NULL)""")
def batch_definitions(spark, folder):
    """Summary of a batch with the count of every definition."""
    d = table(spark, folder, "definitions").filter("body IS NOT NULL").withColumn("ok", F.try_parse_json("body").isNotNull()).withColumn("n", F.length("body"))
    return quality.batch_summary(d, "ok", "definition_id", "n")


@register("SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL")
def distinct_labels(spark, folder):
    return quality.labels(table(spark, folder, "embeddings"), "label")


@register("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 3")
def first_samples(spark, folder):
    """The first three samples of each label."""
    return layout.first_of(table(spark, folder, "embeddings").select("vec_id", "label"), 3, ["label"], ["vec_id"]).select("vec_id", "label")


@register("""
, t AS (SELECT page_id, det_idx, x, y, row_number() OVER (PARTITION BY page_id ORDER BY det_idx, y, x) AS r FROM (SELECT DISTINCT page_id, det_idx, x, y FROM det)),
c AS (SELECT *, CAST(least(trunc(x / 496.0), 4) AS INT) AS col_idx FROM t WHERE r <= 30),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id, col_idx ORDER BY y, det_idx, x) AS k FROM c)
SELECT page_id, det_idx, col_idx, x, y FROM o WHERE k <= 10""")
def column_heads(spark, folder):
    """Of a page's first 30 detections the first ten of each column by height."""
    d = detections(spark, folder).select("page_id", "det_idx", "x", "y").distinct()
    top = layout.first_of(d, 30, ["page_id"], ["det_idx", "y", "x"]).withColumn("col_idx", G.grid_index(F.col("x"), F.lit(496.0), F.lit(5)))
    return layout.first_of(top, 10, ["page_id", "col_idx"], ["y", "det_idx", "x"]).select("page_id", "det_idx", "col_idx", "x", "y")


@register("SELECT entry_id, CAST(product_row % 12 AS VARCHAR) AS label FROM template_entries WHERE product_row % 12 < 10 AND product_name IS NOT NULL")
def valid_samples(spark, folder):
    """Samples whose label is one digit and that have contents."""
    e = table(spark, folder, "template_entries").select("entry_id", (F.col("product_row") % 12).cast("string").alias("label"), F.col("product_name").alias("content"))
    return training.valid_samples(e).select("entry_id", "label")


@register("SELECT mailbox AS task_id, array_to_string(list_sort(list(DISTINCT path)), '|') AS files, CAST(count(DISTINCT path) AS INT) AS count FROM emails WHERE mailbox IS NOT NULL AND path IS NOT NULL GROUP BY mailbox")
def task_files(spark, folder):
    """Result files of each task with their number (mails stand in for files)."""
    f = table(spark, folder, "emails").filter("mailbox IS NOT NULL AND path IS NOT NULL").select(F.col("mailbox").alias("task_id"), "path")
    return files.task_summary(f).select("task_id", F.array_join("files", "|").alias("files"), "count")


@register("""
SELECT CAST(list_row AS INT) AS row, nullif(trim(code), '') AS code, TRY_CAST(regexp_extract(trim(code), '^(\\d+)', 1) AS INT) AS code_lo, TRY_CAST(regexp_extract(trim(code), '(\\d+)$', 1) AS INT) AS code_hi,
  trim(coalesce(product_name, '')) AS name, trim(section) AS section FROM product_list""")
def product_text(spark, folder):
    """The pipe-separated product list with its section lines, read back."""
    p = table(spark, folder, "product_list")
    row = F.concat_ws("|", F.col("list_row").cast("string"), F.coalesce("code", F.lit("")), F.coalesce("product_name", F.lit("")))
    lines = p.select((F.col("list_row") * 2).alias("line"), row.alias("value"))
    first = p.groupBy("section").agg((F.min("list_row") * 2 - 1).alias("line")).select("line", F.concat(F.lit("------ "), "section", F.lit(" ------")).alias("value"))
    return files.parse_product_list(lines.unionByName(first))
