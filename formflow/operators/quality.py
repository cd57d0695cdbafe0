"""Field comparison, modes, sample statistics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formflow.functions import geometry as G


def compare_fields(reference: DataFrame, extracted: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Every field of either side as ``same``, ``changed``, ``missing`` or ``new``.

    ``(doc, field, expected, actual, state)``. A null value is a value: it
    equals null only.
    """
    a = reference.select(doc, "field", F.col("value").alias("expected"), F.lit(True).alias("_a"))
    b = extracted.select(doc, "field", F.col("value").alias("actual"), F.lit(True).alias("_b"))
    state = (
        F.when(F.col("_b").isNull(), "missing")
        .when(F.col("_a").isNull(), "new")
        .when(F.col("expected").eqNullSafe(F.col("actual")), "same")
        .otherwise("changed")
    )
    return a.join(b, [doc, "field"], "full").select(doc, "field", "expected", "actual", state.alias("state"))


def anomaly_report(compared: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Counts and score per document: changed and missing fields over the reference's, 0 without reference."""
    state = F.col("state")
    known = F.count_if(state != "new")
    bad = F.count_if(state.isin("changed", "missing"))
    return compared.groupBy(doc).agg(
        F.when(known > 0, F.round(bad / known, 4)).otherwise(0.0).alias("anomaly_score"),
        F.count_if(state == "changed").alias("changed_fields"),
        F.count_if(state == "missing").alias("missing_fields"),
        F.count_if(state == "new").alias("new_fields"),
    )


def first_mode(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Most common value per group, ties to the one seen first; nulls are left out."""
    counted = (
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("uses"), F.min(order).alias("_first"))
    )
    return counted.groupBy(*by).agg(
        F.max_by(value, F.struct(F.col("uses"), -F.col("_first"))).alias(value), F.max("uses").alias("uses")
    )


def mean_confidence(df: DataFrame, confidence: str, by: list[str]) -> DataFrame:
    """Mean to four digits and number of blocks; 0.0 where no confidence is known.

    Confidences are summed as millionths, so the order of rows can't change the
    last digit.
    """
    millionths = F.sum(F.rint(F.col(confidence) * 1e6).cast("bigint"))
    mean = G.rounded(millionths / (F.count(confidence) * 1e6), 4)
    return df.groupBy(*by).agg(
        F.coalesce(F.when(F.count(confidence) > 0, mean), F.lit(0.0)).alias("confidence"), F.count(confidence).alias("block_count")
    )


def orientation(df: DataFrame, by: list[str], angle: str = "angle", confidence: str = "confidence", order: str = "angle_order") -> DataFrame:
    """Best of the tried rotations by the sum of confidences; the first tried wins ties."""
    scored = df.groupBy(*by, angle).agg(F.round(F.sum(confidence), 6).alias("score"), F.min(order).alias("_o"))
    return scored.groupBy(*by).agg(
        F.max_by(angle, F.struct(F.col("score"), -F.col("_o"))).alias(angle), F.max("score").alias("score")
    )


def median_angle(df: DataFrame, angle: Column, by: list[str], least: float = 0.3, most: float = 10.0) -> DataFrame:
    """Exact interpolated median; ``applied`` is 0 for angles too small or too large to correct."""
    m = F.percentile(angle, 0.5)
    out = df.groupBy(*by).agg(F.round(m, 6).alias("median_angle"))
    size = F.abs("median_angle")
    return out.withColumn("applied", F.when((size >= least) & (size <= most), F.round("median_angle", 2)).otherwise(0.0))


def class_counts(samples: DataFrame, label: str, classes: int = 10) -> DataFrame:
    """Samples of every class ``0 … classes - 1``, zeros included."""
    spark = samples.sparkSession
    counted = samples.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    return spark.range(classes).select(F.col("id").cast("int").alias("label")).join(counted, "label", "left").fillna(0, ["n"])


def labels(samples: DataFrame, label: str) -> DataFrame:
    """The different labels; null is none."""
    return samples.select(label).filter(F.col(label).isNotNull()).distinct()


def balance_gate(counts: DataFrame, least: int = 10, ratio: float = 5.0) -> DataFrame:
    """One row: the verdict before training.

    ``abort_missing`` if a class has no sample, ``abort_few`` if one has fewer
    than ``least``, ``warn_unbalanced`` if the largest is beyond ``ratio`` times
    the smallest, else ``ok``.
    """
    few, many = F.min("n"), F.max("n")
    verdict = (
        F.when(few == 0, "abort_missing").when(few < least, "abort_few").when(many > ratio * few, "warn_unbalanced").otherwise("ok")
    )
    return counts.agg(
        F.sum("n").alias("total"), few.alias("least"), many.alias("most"), F.count_if(F.col("n") == 0).alias("missing"), verdict.alias("verdict")
    )


def accuracy(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Share of right predictions; a null prediction is wrong."""
    right = F.coalesce((F.col(label) == F.col(predicted)).cast("int"), F.lit(0))
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


def stratified_sample(df: DataFrame, label: str, n: int, order: list[Column], replace_seed: int | None = None) -> DataFrame:
    """Up to ``n`` rows of every class without replacement.

    The order decides; with ``replace_seed`` it is random, else the given one.
    The window group limit keeps ``n`` rows a class and task before the shuffle.
    """
    by = [F.rand(replace_seed)] if replace_seed is not None else order
    w = Window.partitionBy(label).orderBy(*by)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def augmented(samples: DataFrame, factor: int = 10) -> DataFrame:
    """The sample itself (``variant`` 0) and ``factor - 1`` variants to be drawn from it."""
    return samples.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))


def batch_summary(results: DataFrame, ok: str, name: str, count: str) -> DataFrame:
    """Totals of a batch and the count of each successful definition, by name."""
    done = F.col(ok)
    return results.agg(
        F.count("*").alias("total"), F.count_if(done).alias("successful"), F.count_if(~done).alias("failed"),
        F.to_json(F.array_sort(F.collect_list(F.when(done, F.struct(F.col(name).alias("name"), F.col(count).alias("n")))))).alias("definitions"),
    )


def intensity_stats(pixels: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Population variance, bright and dark share, and whether a cell counts as empty."""
    v = F.col(value)
    return (
        pixels.groupBy(*by)
        .agg(F.var_pop(v).alias("variance"), F.avg((v > 200).cast("int")).alias("bright"), F.avg((v < 100).cast("int")).alias("dark"))
        .withColumn("is_empty", (F.col("variance") < 50) | (F.col("bright") > 0.95) | (F.col("dark") < 0.01))
    )


def histogram(pixels: DataFrame, value: str, by: list[str], bins: int = 32, top: int = 256) -> DataFrame:
    """Counts of equal bins over ``[0, top)``."""
    b = F.floor(F.col(value) / (top / bins)).cast("int")
    inside = pixels.filter((F.col(value) >= 0) & (F.col(value) < top))
    return inside.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
