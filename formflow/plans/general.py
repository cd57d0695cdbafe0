"""Queries of the general data problems (1, 2 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formflow.operators import instants, nested, schema_drift
from formflow.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return instants.normalize_instants(table(spark, folder, "emails"), table(spark, folder, "mailboxes"))


def p1_by_zone(spark: SparkSession, folder: str) -> DataFrame:
    """Readable and unreadable dates per zone of the mailbox."""
    emails = table(spark, folder, "emails").select("email_id", "mailbox").distinct()
    found = p1_found(spark, folder)
    return (
        emails.join(found, "email_id", "left")
        .join(table(spark, folder, "mailboxes").select("mailbox", "tz"), "mailbox", "left")
        .groupBy("tz")
        .agg(F.count("*").alias("emails"), F.count("utc_micros").alias("dated"))
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, folder, "zone_files"))


def p2_zones(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.unified_zones(table(spark, folder, "zone_files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.template_children(table(spark, folder, "definitions")).unionByName(
        nested.block_children(table(spark, folder, "ocr_pages"))
    )


def p4_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return nested.text_blocks(table(spark, folder, "ocr_pages"))


def p4_elements(spark: SparkSession, folder: str) -> DataFrame:
    """All elements with their fields as JSON text."""
    rows = nested.element_tables(table(spark, folder, "definitions"), "definition_id", "body", nested.TEMPLATE_KINDS)
    return rows.withColumn("fields", F.to_json("fields")).distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_by_zone, p2_found, p2_zones, p4_found, p4_blocks, p4_elements)}
ORACLES = {
    "p4_blocks": """
        SELECT DISTINCT page_id AS record_id, block_idx, b.text AS text, b.confidence AS confidence, b.bounds.x AS x,
               b.bounds.y AS y, b.bounds.width AS width, b.bounds.height AS height
        FROM (SELECT page_id, CAST(i - 1 AS INT) AS block_idx, text_blocks[i] AS b
              FROM ocr_pages, UNNEST(range(1, len(text_blocks) + 1)) AS r(i))
        WHERE b IS NOT NULL AND page_id IS NOT NULL""",
}
