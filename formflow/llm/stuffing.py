"""Keyword-stuffed and link-list pages by the coherence of neighbouring words.

Two passes over the texts. The first counts words, neighbouring words
(collocations) and the separators around words over the whole corpus; the
second scores every word of a page against these counts, the page's own share
taken out. Copies of a text are counted once, so a page is never explained by
its own copies, however many rows they fill:

* **word salad**: the mean pointwise mutual information of neighbouring words
  is low, they hardly ever stand together elsewhere; words that occur elsewhere
  but never together count as unrelated however rare they are, while a word
  that occurs nowhere else tells nothing;
* **repeated collocations**: a pair of neighbours occurs in the page far more
  often than its rate in the corpus explains;
* **lists**: the same for the pair of separators a word stands between, which
  is what links, tags, bread crumbs and catalogue lines repeat while their
  words vary.

A word counts as stuffed where the mean over its surroundings passes one of
the thresholds; a page is reported if the greater part of its words is. A list
inside a page of sentences therefore doesn't make a case.

The counts live in count-min sketches of a fixed size (parameters), so what is
gathered and broadcast doesn't grow with the corpus: tasks fill sketches, which
are merged chunk by chunk in rounds of at most ``FAN_IN`` blobs a group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formflow.llm.words import Cache, composed
from formflow.session import cut, spread

TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]|_")
CHUNK = 1 << 16
FAN_IN = 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MARK, _NUMBER, _WORD = np.uint64(0), np.uint64(1), np.uint64(2)


@dataclass(frozen=True)
class Shape:
    """Sizes of the sketches: log2 of the buckets of a row, and rows."""

    words: int = 19
    pairs: int = 21
    separators: int = 14
    rows: int = 2

    def parts(self) -> list[tuple[str, int]]:
        return [("words", self.words), ("pairs", self.pairs), ("separators", self.separators)]

    def size(self) -> int:
        return sum(self.rows << bits for _, bits in self.parts())


def _code(token: str) -> int:
    if token[0].isdigit():
        return 5 << 2 | 1
    h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) >> 2 << 2
    return h | (2 if token[0].isalpha() else 0)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (a >> np.uint64(31))) * _M1 + b
        return (h ^ (h >> np.uint64(29))) * _M2


class Page:
    """Words of a batch of texts, one after the other, with their neighbours."""

    def __init__(self, texts: list[str], codes: Cache) -> None:
        get = codes.__getitem__
        newline = get("\n")
        flat: list[int] = [newline]
        ends = []
        for t in texts:
            flat.extend(map(get, TOKEN.findall(composed(t))))
            flat.append(newline)
            ends.append(len(flat))
        code = np.array(flat, dtype=np.uint64)
        kind = code & np.uint64(3)
        at = np.flatnonzero(kind > 0)
        self.word = code[at]
        self.doc = np.searchsorted(np.array(ends), at, side="right")
        sign = np.where(kind > 0, kind, code)  # words and numbers are alike as neighbours
        self.between = _mix(sign[at - 1], sign[at + 1])
        follows = np.zeros(len(at), dtype=bool)
        if len(at) > 1:
            follows[:-1] = self.doc[1:] == self.doc[:-1]
        self.follows = follows  # has a next word in its text
        following = np.empty_like(self.word)
        if len(at):
            following[:-1] = self.word[1:]
            following[-1] = 0
        self.following = following
        self.pair = _mix(self.word, following)
        self.starts = np.searchsorted(self.doc, np.arange(len(texts)))
        self.stops = np.searchsorted(self.doc, np.arange(len(texts)), side="right")


def _bucket(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h + np.uint64(row + 1) * _M2) * _M1 >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """Count-min sketches of words, pairs and separators in one array."""

    def __init__(self, shape: Shape, counts: np.ndarray | None = None) -> None:
        self.shape = shape
        self.counts = np.zeros(shape.size(), dtype=np.int64) if counts is None else counts
        self.at, start = {}, 0
        for name, bits in shape.parts():
            for row in range(shape.rows):
                self.at[name, row] = (start, bits)
                start += 1 << bits

    def add(self, name: str, h: np.ndarray) -> None:
        for row in range(self.shape.rows):
            start, bits = self.at[name, row]
            np.add.at(self.counts, start + _bucket(h, row, bits), 1)

    def get(self, name: str, h: np.ndarray) -> np.ndarray:
        found = None
        for row in range(self.shape.rows):
            start, bits = self.at[name, row]
            n = self.counts[start + _bucket(h, row, bits)]
            found = n if found is None else np.minimum(found, n)
        return found

    def floor(self, name: str) -> float:
        """What collisions alone make of an item that never occurred: the mean of ``get``."""
        rows = [self.counts[start : start + (1 << bits)] for start, bits in (self.at[name, r] for r in range(self.shape.rows))]
        levels = np.unique(np.concatenate(rows))
        levels = levels[levels > 0]
        above = np.ones(len(levels))
        for row in rows:  # the share of buckets that hold a level or more
            above *= 1 - np.searchsorted(np.sort(row), levels) / len(row)
        return float((np.diff(levels, prepend=0) * above).sum())

    def total(self) -> int:
        start, bits = self.at["words", 0]
        return int(self.counts[start : start + (1 << bits)].sum())

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        for chunk in range(-(-len(self.counts) // CHUNK)):
            part = self.counts[chunk * CHUNK : (chunk + 1) * CHUNK]
            where = np.flatnonzero(part)
            if len(where):
                yield chunk, where.astype(np.uint16).tobytes() + part[where].astype("<i8").tobytes()


def _pour(counts: np.ndarray, blob: bytes) -> None:
    n = len(blob) // 10
    where = np.frombuffer(blob, dtype=np.uint16, count=n)
    counts[where] += np.frombuffer(blob, dtype="<i8", offset=2 * n, count=n)


def _pages(batches: Iterator[pd.DataFrame], codes: Cache, most_chars: int = 2_000_000):
    """Batches of texts of a bounded size; a longer text is a batch of its own."""
    for pdf in batches:
        keys, texts, size = [], [], 0
        for k, t in zip(pdf["doc_id"], pdf["text"], strict=True):
            keys.append(k)
            texts.append(t)
            size += len(t)
            if size >= most_chars:
                yield keys, Page(texts, codes)
                keys, texts, size = [], [], 0
        if keys:
            yield keys, Page(texts, codes)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row of all that the counts can't tell apart: texts that are equal but
    for case, the digits of numbers and the width of spaces.

    Copies meet within a task before anything is moved, so a large group is no hot key.
    """
    seen = F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "0"), r"[ \t\r\f\x0B]+", " ")
    return docs.withColumn("digest", F.md5(seen)).dropDuplicates(["digest"]).drop("digest")


def corpus_counts(docs: DataFrame, shape: Shape) -> Sketch:
    """The sketch of all distinct texts of ``docs`` (``doc_id, text``)."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, codes = Sketch(shape), Cache(_code)
        for _, page in _pages(batches, codes):
            sketch.add("words", page.word)
            sketch.add("pairs", page.pair[page.follows])
            sketch.add("separators", page.between)
        rows = list(sketch.blobs())
        yield pd.DataFrame({"chunk": [c for c, _ in rows], "blob": [b for _, b in rows]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(CHUNK, dtype=np.int64)
        for blob in pdf["blob"]:
            _pour(counts, blob)
        where = np.flatnonzero(counts)
        blob = where.astype(np.uint16).tobytes() + counts[where].astype("<i8").tobytes()
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [int(pdf["part"].iloc[0])], "blob": [blob]})

    blobs = distinct_texts(docs).mapInPandas(fill, "chunk int, blob binary").withColumn("part", F.spark_partition_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # those of the distinct texts, or more
    while True:
        groups = max(1, -(-parts // FAN_IN))
        blobs = blobs.withColumn("part", (F.col("part") % groups).cast("int"))
        blobs = blobs.groupBy("chunk", "part").applyInPandas(merge, "chunk int, part int, blob binary")
        if groups == 1:
            break
        parts = groups
    whole = np.zeros(shape.size(), dtype=np.int64)
    for row in blobs.select("chunk", "blob").collect():  # the sketch: of a fixed size
        _pour(whole[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK], row["blob"])
    return Sketch(shape, whole)


def _own(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often each item occurs in its own text."""
    _, inverse, n = np.unique(_mix(h, doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    return n[inverse]


def _around(values: np.ndarray, page: Page, reach: int) -> np.ndarray:
    """Mean over the words up to ``reach`` away in the same text."""
    c = np.concatenate([[0.0], np.cumsum(values)])
    k = np.arange(len(values))
    lo = np.maximum(page.starts[page.doc], k - reach)
    hi = np.minimum(page.stops[page.doc], k + reach + 1)
    return (c[hi] - c[lo]) / (hi - lo)


def page_scores(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shape: Shape | None = None,
    reach: int = 15,
    least_pmi: float = 1.5,
    most_repeated: float = 0.2,
    most_listed: float = 0.2,
    excess: float = 24.0,
    listed_excess: float = 4.0,
) -> DataFrame:
    """``(doc_id, words, mean_pmi, stuffed_share)`` of every row with a text.

    ``excess`` and ``listed_excess``: how many times its rate in the other texts
    a pair of words or of separators may have before the rest counts as
    repetition; the former is large because a rate over all languages
    understates what is usual in one. Null and empty texts and null ids
    give no row; texts of fewer than three words have a share of 0; repeated
    rows give repeated rows, each judged as if its text stood there once.
    """
    shape = shape or Shape()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(
        F.col("doc_id").isNotNull() & (F.length("text") > 0)
    )
    source = spread(source)
    sketch = corpus_counts(source, shape)
    total = max(1, sketch.total())
    no_pair, no_word = sketch.floor("pairs"), sketch.floor("words")
    kind = "<i4" if total < 2**31 else "<i8"
    shared = docs.sparkSession.sparkContext.broadcast(sketch.counts.astype(kind))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, codes = Sketch(shape, shared.value), Cache(_code)
        for keys, page in _pages(batches, codes):
            n = len(page.word)
            if n == 0:
                yield pd.DataFrame({"doc_id": keys, "words": 0, "mean_pmi": None, "stuffed_share": 0.0})
                continue
            length = (page.stops - page.starts)[page.doc]
            tf = _own(page.doc, page.pair)
            others = np.maximum(sketch.get("pairs", page.pair) - tf - no_pair, 0)
            a = np.maximum(sketch.get("words", page.word), 1)
            b = np.maximum(sketch.get("words", page.following), 1)
            pmi = np.log((others + 0.1) * total / (a * b.astype(np.float64)))
            known = a - length - no_word >= 0.5  # occurs elsewhere, for no page holds a word more often than its length
            rest = np.flatnonzero(~known)
            known[rest] = a[rest] - _own(page.doc[rest], page.word[rest]) - no_word >= 0.5
            apart = (others < 0.5) & known & np.append(known[1:], False)
            pmi[apart] = np.minimum(pmi[apart], 0.0)
            repeated = np.maximum(0.0, 1 - (1 + excess * length * others / total) / tf)
            last = np.flatnonzero(~page.follows)
            before = np.maximum(last - 1, 0)
            pmi[last], repeated[last] = pmi[before], repeated[before]
            lone = last[(last == 0) | (page.doc[before] != page.doc[last])]
            pmi[lone], repeated[lone] = math.log(total), 0.0
            tf = _own(page.doc, page.between)
            others = np.maximum(sketch.get("separators", page.between) - tf, 0)
            listed = np.maximum(0.0, 1 - (2 + listed_excess * length * others / total) / tf)
            stuffed = (
                (_around(np.minimum(pmi, 6.0), page, reach) < least_pmi)
                | (_around(repeated, page, reach) > most_repeated)
                | (_around(listed, page, reach) > most_listed)
            )
            c = np.concatenate([[0], np.cumsum(stuffed)])
            m = np.concatenate([[0.0], np.cumsum(np.minimum(pmi, 6.0))])
            words = page.stops - page.starts
            share = np.where(words > 2, (c[page.stops] - c[page.starts]) / np.maximum(words, 1), 0.0)
            mean = (m[page.stops] - m[page.starts]) / np.maximum(words, 1)
            yield pd.DataFrame({"doc_id": keys, "words": words, "mean_pmi": mean, "stuffed_share": share})

    return source.mapInPandas(score, f"doc_id {id_type}, words int, mean_pmi double, stuffed_share double")


def stuffed_pages(docs: DataFrame, least_share: float = 0.45, **kw) -> DataFrame:
    """Distinct ``doc_id`` of the pages that are for the greater part stuffed."""
    return page_scores(docs, **kw).filter(F.col("stuffed_share") > least_share).select("doc_id").distinct()


def without_stuffing(docs: DataFrame, least_share: float = 0.45, doc_id: str = "doc_id", **kw) -> DataFrame:
    """The rows whose page isn't stuffed; rows without text or id stay."""
    bad = cut(stuffed_pages(docs, least_share, doc_id=doc_id, **kw))
    return docs.join(bad, docs[doc_id] == bad["doc_id"], "left_anti")
