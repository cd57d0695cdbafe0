"""Form identification: signatures, template similarity, definitions by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formflow.functions import geometry as G
from formflow.functions import text as T

#: More templates than this are not sent to every task but joined in blocks by hash.
BROADCAST_TEMPLATES = 20_000


def template_scores(
    pages: DataFrame, templates: DataFrame, top: int = 5, least: float = 0.85, page: str = "page_id", blocks: int = 16
) -> DataFrame:
    """The ``top`` most similar templates of each page by the cosine of their signatures.

    ``pages``: ``page, signature``; ``templates``: ``template_id, signature``.
    ``(page, template_id, similarity, rank, is_match)``: ties go to the lower
    id; only a best one of at least ``least`` is a match. Null signatures are
    left out. The templates are a stated list compared with all pages; they are
    counted first, broadcast up to ``BROADCAST_TEMPLATES``, else repartitioned
    into blocks that each page is sent to, with the best of every block kept.
    """
    t = templates.select("template_id", F.col("signature").alias("_t")).filter(F.col("_t").isNotNull())
    p = pages.select(page, F.col("signature").alias("_p")).filter(F.col("_p").isNotNull())
    if t.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES:
        packed = t.agg(F.collect_list(F.struct("template_id", "_t")).alias("_all"))
        pairs = p.join(F.broadcast(packed)).select(page, "_p", F.explode("_all").alias("c"))
        pairs = pairs.select(page, F.col("c.template_id").alias("template_id"), G.cosine(F.col("_p"), F.col("c._t")).alias("similarity"))
    else:
        block = F.pmod(F.hash("template_id"), F.lit(blocks))
        sent = p.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = sent.join(t.withColumn("_b", block), "_b").select(
            page, "template_id", G.cosine(F.col("_p"), F.col("_t")).alias("similarity")
        )
    w = Window.partitionBy(page).orderBy(F.desc("similarity"), "template_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.withColumn("is_match", (F.col("rank") == 1) & (F.col("similarity") >= least))


def rotations(pages: DataFrame, meta: DataFrame, page: str = "page_id") -> DataFrame:
    """Pages with the rotation of their metadata, 0 where there is none."""
    return pages.join(meta.select(page, F.col("rotation").cast("double").alias("rotation")), page, "left").fillna(0.0, ["rotation"])


def identify(pages: DataFrame, meta: DataFrame, templates: DataFrame, page: str = "page_id") -> DataFrame:
    """Identification record of each page: header rectangle and advisory best template.

    The type is read from the header later, so ``needs_ocr`` is true and
    ``form_type`` null; without templates the confidence is null.
    """
    best = template_scores(pages, templates, page=page).filter("rank = 1").select(page, "template_id", "similarity", "is_match")
    return (
        rotations(pages, meta, page)
        .withColumn("header", G.header_bounds(F.col("rotation"), F.col("width"), F.col("height")))
        .join(best, page, "left")
        .select(
            page, "rotation", "header", F.col("template_id").alias("best_template"), F.col("similarity").alias("confidence"),
            F.coalesce("is_match", F.lit(False)).alias("is_match"), F.lit(True).alias("needs_ocr"), F.lit(None).cast("string").alias("form_type"),
        )
    )


def definition_keys(types: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(form_type, form_key, has_definition)`` of each form type.

    Exact key first (spaces as dashes), else the first key, in load order, that
    agrees without dashes, else the key itself. ``definitions``: ``form_key,
    load_order``.
    """
    t = types.select("form_type").distinct().withColumn("_k", T.form_key(F.col("form_type"))).withColumn("_l", T.loose_key(F.col("form_type")))
    exact = definitions.select(F.col("form_key").alias("_exact")).distinct()
    loose = definitions.groupBy(T.loose_key(F.col("form_key")).alias("_l")).agg(F.min_by("form_key", "load_order").alias("_second"))
    return (
        t.join(exact, F.col("_k") == F.col("_exact"), "left")
        .join(loose, "_l", "left")
        .select(
            "form_type",
            F.coalesce("_exact", "_second", "_k").alias("form_key"),
            (F.col("_exact").isNotNull() | F.col("_second").isNotNull()).alias("has_definition"),
        )
    )


def latest_definitions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One definition per key, the last in order; rows without a key are left out."""
    picked = rows.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key)
    return picked.agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def registered(rows: DataFrame, registry: DataFrame, form_type: str, value: str) -> DataFrame:
    """``rows`` with the registry's ``value`` of their form type, null where it is unknown; repeated entries: the least."""
    return rows.join(registry.groupBy(form_type).agg(F.min(value).alias(value)), form_type, "left")
