"""Recognisers are supplied: text recognition, digits, QR codes and PDF rasterising.

None is bundled. A recogniser is built once per Python worker by a factory and
called with the images of a batch, so a model is loaded once and only where
tasks run. What fails on one image yields nothing for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formflow.functions import geometry as G
from formflow.functions import text as T
from formflow.operators.pages import decode

DETECTION = "det_idx int, text string, confidence double, bbox array<array<int>>"
MOST_PIXELS = 2000


class TextRecognizer(Protocol):
    def __call__(self, image: np.ndarray) -> list[tuple[list[list[float]], str, float]]:
        """``(corners, text, confidence)`` in detection order."""


class DigitRecognizer(Protocol):
    def __call__(self, pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digits and confidences of a batch of 28 x 28 glyphs."""


def detections(pages: DataFrame, key: list[str], factory: Callable[[], TextRecognizer]) -> DataFrame:
    """``(key…, det_idx, text, confidence, bbox)`` of every page.

    Pages are scaled down to 2000 pixels first; corners are scaled back and truncated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = factory()
        for pdf in batches:
            out = []
            for values in pdf.itertuples(index=False):
                *ids, h, w, n, data = values
                page = decode(h, w, n, data)
                if page is None:
                    continue
                step = max(1.0, max(page.shape[:2]) / MOST_PIXELS)
                if step > 1:
                    rows = (np.arange(int(page.shape[0] / step)) * step).astype(int)
                    cols = (np.arange(int(page.shape[1] / step)) * step).astype(int)
                    page = page[rows][:, cols]
                try:
                    found = read(page)
                except Exception:
                    continue
                for i, (corners, text, confidence) in enumerate(found):
                    box = [[int(x * step), int(y * step)] for x, y in corners]
                    out.append((*ids, i, text, round(float(confidence), 4), box))
            yield pd.DataFrame(out, columns=[*key, "det_idx", "text", "confidence", "bbox"])

    fields = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in key)
    source = pages.select(*key, "image.height", "image.width", "image.nChannels", "image.data")
    return source.mapInPandas(run, f"{fields}, {DETECTION}")


def page_texts(pages: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """OCR record of every page: blocks, joined text and mean confidence, 0.0 without a block."""
    blocks = found.select(
        *key, "det_idx", F.struct("text", F.round("confidence", 4).alias("confidence"), G.bounds(F.col("bbox")).alias("bounds"), "bbox").alias("b")
    )
    record = blocks.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("det_idx", "b"))), lambda x: x["b"]).alias("text_blocks"),
        T.joined(F.col("b.text"), F.col("det_idx"), "\n").alias("full_text"),
        F.round(F.avg("b.confidence"), 4).alias("confidence"), F.count("*").cast("int").alias("block_count"),
    )
    return pages.select(*key).join(record, key, "left").fillna({"full_text": "", "confidence": 0.0})


def first_detector(detectors: list[Callable[[np.ndarray], object]]) -> Callable[[np.ndarray], object]:
    """A cascade: the first detector that finds something."""

    def run(image: np.ndarray):
        return next((x for d in detectors if (x := d(image)) is not None), None)

    return run


def qr_orientation(detect: Callable[[np.ndarray], tuple[float, float] | None], corner: str = "top_left") -> Callable[[np.ndarray], int]:
    """Correction in degrees that puts the code's centre into the half at ``corner``, 0 without a code."""

    def run(image: np.ndarray) -> int:
        for turns in range(4):
            page = np.rot90(image, -turns)
            centre = detect(page)
            if centre is None:
                continue
            left, top = centre[0] < page.shape[1] / 2, centre[1] < page.shape[0] / 2
            if (left and top) if corner == "top_left" else (not left and not top):
                return {0: 0, 1: 90, 2: 180, 3: 270}[turns]
        return 0

    return run


def onnx_digits(path: str, providers: tuple[str, ...] = ("CPUExecutionProvider",)) -> Callable[[], DigitRecognizer]:
    """Factory of a recogniser from an ONNX file; the providers are tried in order."""

    def make() -> DigitRecognizer:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=list(providers))
        name = session.get_inputs()[0].name

        def read(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = session.run(None, {name: pixels.reshape(-1, 28, 28, 1).astype(np.float32)})[0]
            return p.argmax(axis=1), p.max(axis=1)

        return read

    return make


def read_digits(glyphs: DataFrame, key: list[str], factory: Callable[[], DigitRecognizer]) -> DataFrame:
    """``(key…, digit, confidence)`` of glyphs with ``pixels``; a glyph without pixels has a null digit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = factory()
        for pdf in batches:
            has = pdf["pixels"].notna()
            out = pdf[key].assign(digit=None, confidence=0.0)
            if has.any():
                digit, confidence = read(np.stack(pdf.loc[has, "pixels"].to_numpy()))
                out.loc[has, "digit"] = [str(int(d)) for d in digit]
                out.loc[has, "confidence"] = confidence.astype(float)
            yield out

    fields = ", ".join(f"{k} {glyphs.schema[k].dataType.simpleString()}" for k in key)
    return glyphs.select(*key, "pixels").mapInPandas(run, f"{fields}, digit string, confidence double")
