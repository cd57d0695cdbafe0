"""Queries of the training-text problems (3, 5, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formflow.llm import canonical, contamination, mojibake, packing, stuffing
from formflow.session import cut, table


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    emails, files = table(spark, folder, "emails"), table(spark, folder, "attachments")
    none = F.lit(-1).alias("att_idx")
    return mojibake.stack_fields(
        [
            (emails, [F.col("email_id"), none], "subject", F.col("subject")),
            (emails, [F.col("email_id"), none], "from_header", F.col("from_header")),
            (files, [F.col("email_id"), F.col("att_idx")], "filename", F.col("filename")),
        ]
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.garbled_values(_fields(spark, folder), ["email_id", "att_idx", "field_name"], fallback=())


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.restored_values(_fields(spark, folder), fallback=())


def _matchers(spark: SparkSession, folder: str) -> dict:
    products = canonical.read_list(
        table(spark, folder, "product_list"), ["product_id", "product_name", "code", "code_lo", "code_hi"]
    )
    forms = canonical.read_list(table(spark, folder, "form_types"), ["form_type_id", "form_type"])
    return {
        "product_name": canonical.ListMatcher([(r[0], r[1]) for r in products if r[1]], marks=False),
        "product_number": canonical.CodeMatcher([(r[0], *r[2:]) for r in products]),
        "form_type": canonical.ListMatcher([(r[0], r[1]) for r in forms if r[1]], marks=True),
    }


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.match_fields(table(spark, folder, "template_entries"), _matchers(spark, folder))


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """How often each value without an entry was entered, by field."""
    found = canonical.matched_values(table(spark, folder, "template_entries"), _matchers(spark, folder))
    return found.filter("ref_id = 0").groupBy("field_name", "value").agg(F.count("*").alias("lines"))


def _kinds(spark: SparkSession, folder: str) -> dict[str, int]:
    rows = table(spark, folder, "containers").filter("capacity_tokens > 0").collect()  # the permitted lengths, a handful
    return {r["container_kind"]: int(r["capacity_tokens"]) for r in rows}


def p6_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in windows of each capacity on its own."""
    tokens = cut(packing.count_tokens(table(spark, folder, "documents")))
    return packing.pack_each(tokens, _kinds(spark, folder))


def p6_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in windows of all permitted capacities, optimised jointly."""
    tokens = packing.count_tokens(table(spark, folder, "documents"))
    return packing.pack(tokens, list(_kinds(spark, folder).values()))


def p6_use(spark: SparkSession, folder: str) -> DataFrame:
    """Windows, tokens and unused space of each capacity."""
    return (
        p6_windows(spark, folder)
        .groupBy("container_kind", "window_id", "capacity")
        .agg(F.sum("tokens").alias("used"))
        .groupBy("container_kind", "capacity")
        .agg(F.count("*").alias("windows"), F.sum("used").alias("tokens"))
        .withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("windows") * F.col("capacity")), 6))
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.found_pairs(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with leaks, as they are after the cut."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return contamination.without_leaks(docs, table(spark, folder, "eval_items")).filter("leaked_words > 0")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, folder, "documents"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.page_scores(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_restored, p5_found, p5_unmatched, p6_windows, p6_mixed, p6_use, p7_found, p7_clean, p8_found, p8_scores)}
ORACLES: dict[str, str] = {}
