"""Pixel operators over tables of pages.

Pages are never shuffled: every operator maps a page to the few numbers that
are joined later, with small Arrow batches because a page has megabytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formflow.operators import kernels as K

RECT = "x int, y int, width int, height int"
STEPS = "struct<orientation_angle:int,deskew_angle:double,denoise:boolean,contrast:string,crop:struct<x:int,y:int,w:int,h:int>,threshold:string>"


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """Pixels of an image struct (BGR, row by row); None for an invalid one."""
    a = np.frombuffer(data or b"", dtype=np.uint8)
    if height <= 0 or width <= 0 or channels not in (1, 3, 4) or a.size != height * width * channels:
        return None
    a = a.reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a[..., :3]


def map_pages(pages: DataFrame, key: list[str], rows: Callable[[np.ndarray], list[tuple]], columns: str) -> DataFrame:
    """``(key…, columns…)``: the rows a kernel finds on each page; invalid pages give none.

    ``pages`` has ``key`` and ``image`` as the image source gives it.
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for values in pdf.itertuples(index=False):
                *ids, h, w, n, data = values
                page = decode(int(h or 0), int(w or 0), int(n or 0), data)
                if page is not None:
                    out += [(*ids, *r) for r in rows(page)]
            yield pd.DataFrame(out, columns=[*key, *names])

    schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in key) + ", " + columns
    source = pages.select(*key, "image.height", "image.width", "image.nChannels", "image.data").filter(F.col("data").isNotNull())
    return source.mapInPandas(run, schema)


def _rects(found: list[dict], *more: str) -> list[tuple]:
    return [(i, c["x"], c["y"], c["width"], c["height"], *(c[m] for m in more)) for i, c in enumerate(found)]


def page_lines(pages: DataFrame, key: list[str]) -> DataFrame:
    def rows(page: np.ndarray) -> list[tuple]:
        return [(axis, *r) for axis, found in K.layout_lines(K.gray(page)).items() for r in _rects(found)]

    return map_pages(pages, key, rows, f"axis string, det_idx int, {RECT}")


def page_boxes(pages: DataFrame, key: list[str]) -> DataFrame:
    return map_pages(
        pages, key, lambda p: _rects(K.boxes(K.gray(p)), "area", "aspect_ratio"), f"box_idx int, {RECT}, area double, aspect_ratio double"
    )


def page_regions(pages: DataFrame, key: list[str]) -> DataFrame:
    """Raw text regions in detection order; merging them is a DataFrame operator."""
    return map_pages(pages, key, lambda p: _rects(K.text_regions(K.gray(p))), f"det_idx int, {RECT}")


def grid_positions(pages: DataFrame, key: list[str]) -> DataFrame:
    def rows(page: np.ndarray) -> list[tuple]:
        return [(axis, v) for axis, found in K.template_positions(K.gray(page)).items() for v in found]

    return map_pages(pages, key, rows, "axis string, position int")


def page_blobs(pages: DataFrame, key: list[str]) -> DataFrame:
    return map_pages(pages, key, lambda p: _rects(K.row_blobs(K.gray(p)), "area"), f"blob_idx int, {RECT}, area int")


def page_signatures(pages: DataFrame, key: list[str]) -> DataFrame:
    """Signature of the upper left header region."""

    def rows(page: np.ndarray) -> list[tuple]:
        h, w = page.shape[:2]
        header = page[: int(h * 0.12), : int(w * 0.4)]
        return [(K.signature(header).tolist(),)] if header.size else []

    return map_pages(pages, key, rows, "signature array<double>")


def page_skew(pages: DataFrame, key: list[str]) -> DataFrame:
    return map_pages(pages, key, lambda p: [(float(K.skew(K.gray(p))),)], "angle double")


def normalized(pages: DataFrame, key: list[str], threshold: bool = False, orientation=None) -> DataFrame:
    """``(key…, height, width, data, original_height, original_width, steps)`` of the document pipeline."""

    def rows(page: np.ndarray) -> list[tuple]:
        h, w = page.shape[:2]
        out, steps = K.processed(page, threshold, orientation)
        return [(out.shape[0], out.shape[1], out.tobytes(), h, w, steps)]

    columns = f"height int, width int, data binary, original_height int, original_width int, steps {STEPS}"
    return map_pages(pages, key, rows, columns)


def cell_measures(pages: DataFrame, cells: DataFrame, page: str = "page_id") -> DataFrame:
    """Cells with ``croppable, empty``: rectangles travel to their page, pixels stay.

    ``cells``: ``page, cell_id, bounds``. All rectangles of a page are one row.
    """
    packed = cells.groupBy(page).agg(F.collect_list(F.struct("cell_id", "bounds")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for pid, h, w, n, data, items in pdf.itertuples(index=False):
                image = decode(h, w, n, data)
                for c in items:
                    b = c["bounds"]
                    cut = None
                    if image is not None and b is not None and b["width"] > 0 and b["height"] > 0:
                        x0, y0 = max(b["x"], 0) + 3, max(b["y"], 0) + 3
                        x1, y1 = min(b["x"] + b["width"], w) - 3, min(b["y"] + b["height"], h) - 3
                        cut = image[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else None
                    ok = cut is not None and cut.size > 0
                    out.append((pid, c["cell_id"], ok, bool(K.is_empty(cut)) if ok else False))
            yield pd.DataFrame(out, columns=[page, "cell_id", "croppable", "empty"])

    kind = pages.schema[page].dataType.simpleString()
    cell_kind = cells.schema["cell_id"].dataType.simpleString()
    joined = pages.join(packed, page).select(page, "image.height", "image.width", "image.nChannels", "image.data", "cells")
    return joined.mapInPandas(run, f"{page} {kind}, cell_id {cell_kind}, croppable boolean, empty boolean")


def digit_pixels(samples: DataFrame, key: list[str]) -> DataFrame:
    """28 x 28 pixels of digit images; blank ones give no row."""

    def rows(page: np.ndarray) -> list[tuple]:
        d = K.digit28(K.gray(page))
        return [] if d is None else [(d.ravel().tolist(),)]

    return map_pages(samples, key, rows, "pixels array<float>")
