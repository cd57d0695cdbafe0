"""Digit samples to a trained model: gates, mixing, augmentation, training, accuracy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formflow.operators import quality


def valid_samples(samples: DataFrame) -> DataFrame:
    """Samples whose label is one digit as text and that hold an image."""
    return samples.filter(F.col("label").cast("string").rlike("^[0-9]$") & F.col("content").isNotNull())


def variants(samples: DataFrame, factor: int = 10, seed: int = 7) -> DataFrame:
    """Each sample and ``factor - 1`` shifted and scaled copies of its 28 x 28 pixels, the same on every run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for label, pixels, v in zip(pdf["label"], pdf["pixels"], pdf["variant"], strict=True):
                a = np.asarray(pixels, dtype=np.float32).reshape(28, 28)
                if v:
                    rng = np.random.default_rng(seed * 1000 + v)
                    a = np.roll(a, tuple(rng.integers(-2, 3, 2)), axis=(0, 1))
                    a = np.clip(a * rng.uniform(0.9, 1.1), 0, 1)
                out.append((label, a.ravel().tolist(), v))
            yield pd.DataFrame(out, columns=["label", "pixels", "variant"])

    return quality.augmented(samples.select("label", "pixels"), factor).mapInPandas(
        run, "label int, pixels array<float>, variant int"
    )


def mixed(base: DataFrame, custom: DataFrame, per_class: int = 500, factor: int = 10) -> DataFrame:
    """A bounded sample of every class of the base data and the augmented own samples.

    The base sample is ordered by a hash of its pixels, so it is the same on
    every run.
    """
    first = quality.stratified_sample(base, "label", per_class, [F.xxhash64("pixels")])
    return first.select("label", "pixels").unionByName(variants(custom, factor).select("label", "pixels"))


def epochs_for(n: int) -> tuple[int, int]:
    """Passes and batch size by the number of samples."""
    return (20 if n < 100 else 10), min(32, max(1, n))


def train(samples: DataFrame, hidden: tuple[int, ...] = (64,), seed: int = 7):
    """A perceptron on ``label, pixels``; refused unless every class has ten samples."""
    gate = quality.balance_gate(quality.class_counts(samples, "label")).first()
    if gate["verdict"].startswith("abort"):
        raise ValueError(f"not enough samples: {gate['verdict']}")
    passes, _ = epochs_for(gate["total"])
    data = samples.select(F.col("label").cast("double").alias("label"), array_to_vector("pixels").alias("features"))
    return MultilayerPerceptronClassifier(layers=[784, *hidden, 10], maxIter=passes * 10, seed=seed).fit(data)


def predict(model, samples: DataFrame) -> DataFrame:
    """``samples`` with ``predicted`` and its ``confidence``."""
    from pyspark.ml.functions import vector_to_array

    data = samples.withColumn("features", array_to_vector("pixels"))
    p = vector_to_array(F.col("probability"))
    return (
        model.transform(data)
        .withColumn("predicted", F.col("prediction").cast("int"))
        .withColumn("confidence", F.array_max(p))
        .drop("features", "rawPrediction", "probability", "prediction")
    )
