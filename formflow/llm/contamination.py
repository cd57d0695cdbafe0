"""Held-out passages leaking into training text.

The held-out items are a small, fixed side: their normalised n-grams form a
hash set that every task gets (in blocks of bounded size, so any number of
items works). Documents are scanned once: words are mapped to the items'
vocabulary, windows of n known words are hashed and probed, and documents with
hits are verified by a banded local alignment against the items hit.

Held-out items are often written to a pattern, and documents may share the
pattern without sharing the content. N-grams that stand in many different
contexts among the items are therefore no seeds, and a verified region must
agree in its information: words are weighted by their surprise given the word
before them in the items, so that the filled-in words of a pattern carry the
weight and its fixed words hardly any.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formflow.llm.words import WORD, Cache, composed, plain, spelled, visible, words_of
from formflow.session import spread

_MIX = np.uint64(0x9E3779B97F4A7C15)


class ItemIndex:
    """Seeds, vocabulary and word weights of one block of items."""

    def __init__(self, items: list[tuple[int, str]], n: int, contexts: int, everyone: list[list[str]]) -> None:
        self.n = n
        self.words = {i: words_of(t) for i, t in items}
        vocabulary = sorted({w for ws in self.words.values() for w in ws})
        self.ids = {w: k + 1 for k, w in enumerate(vocabulary)}
        pairs, firsts = Counter(), Counter()
        around: dict[tuple[str, ...], set] = defaultdict(set)
        for ws in everyone:
            for k, w in enumerate(ws):
                before = ws[k - 1] if k else ""
                pairs[before, w] += 1
                firsts[before] += 1
            for k in range(len(ws) - n + 1):
                around[tuple(ws[k : k + n])].add((tuple(ws[max(0, k - 3) : k]), tuple(ws[k + n : k + n + 3])))
        self.weights = {
            i: [math.log(firsts[ws[k - 1] if k else ""] / pairs[ws[k - 1] if k else "", w]) for k, w in enumerate(ws)]
            for i, ws in self.words.items()
        }
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, ws in self.words.items():
            ids = np.array([self.ids[w] for w in ws], dtype=np.uint64)
            for k, h in enumerate(gram_hashes(ids, n).tolist()):
                if len(around[tuple(ws[k : k + n])]) <= contexts:
                    self.seeds[h].append((i, k))
        self.seeds = dict(self.seeds)
        self.hashes = np.array(sorted(self.seeds), dtype=np.uint64)


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of ``n`` ids."""
    if len(ids) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(ids) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ (h >> np.uint64(29))) * _MIX + ids[k : k + m]
    return h


def alike(a: str, b: str) -> bool:
    """Equal, or longer words that differ by one edit or swap; numbers must be equal."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1 or a.isdigit() or b.isdigit():
        return False
    i, short = 0, min(len(a), len(b))
    while i < short and a[i] == b[i]:
        i += 1
    return (
        a[i + 1 :] == b[i + 1 :]
        or a[i:] == b[i + 1 :]
        or a[i + 1 :] == b[i:]
        or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    )


def align(doc: list[str], item: list[str], weights: list[float], shift: int, band: int, miss: float, gap: float):
    """Best local alignment near the diagonal ``doc index = item index + shift``.

    Returns ``(doc from, doc to, item from, item to, share of weight matched)``.
    """
    width = 2 * band + 1
    prev: list[tuple] = [(0.0, -1, -1, 0.0, 0.0)] * (width + 1)
    best = (0.0, 0, 0, 0, 0, 0.0, 0.0)
    for j, word in enumerate(item):
        row: list[tuple] = []
        w = weights[j]
        left = (0.0, -1, -1, 0.0, 0.0)
        for b in range(width):
            i = j + shift + b - band
            if not 0 <= i < len(doc):
                left = (0.0, -1, -1, 0.0, 0.0)
                row.append(left)
                continue
            same = alike(doc[i], word)
            diagonal, up = prev[b], prev[b + 1]
            score = diagonal[0] + (1.0 if same else miss)
            if diagonal[0] > 0:
                cell = (score, diagonal[1], diagonal[2], diagonal[3] + (w if same else 0.0), diagonal[4] + w)
            else:
                cell = (score, i, j, w if same else 0.0, w)
            if up[0] + gap > cell[0]:  # an item word is missing in the document
                cell = (up[0] + gap, up[1], up[2], up[3], up[4] + w)
            if left[0] + gap > cell[0]:  # the document has a word more
                cell = (left[0] + gap, *left[1:])
            if cell[0] <= 0:
                cell = (0.0, -1, -1, 0.0, 0.0)
            elif cell[0] > best[0]:
                best = (cell[0], cell[1], i + 1, cell[2], j + 1, cell[3], cell[4])
            row.append(cell)
            left = cell
        row.append((0.0, -1, -1, 0.0, 0.0))
        prev = row
    _, i0, i1, j0, j1, matched, total = best
    return i0, i1, j0, j1, matched / total if total > 0 else 1.0


def verify(doc: list[str], hits: list[tuple[int, int, int]], index: ItemIndex, p: dict) -> list[tuple[int, int, int]]:
    """Verified leaks ``(item, from word, to word)`` of one document.

    ``hits`` are ``(document position, item, item position)``. Hits of one item
    are chained along the diagonal; every chain is aligned.
    """
    by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at, i, k in hits:
        by_item[i].append((at, k))
    found = []
    for i, places in by_item.items():
        item = index.words[i]
        chains: list[list[tuple[int, int]]] = []
        for at, k in sorted(places):
            for c in reversed(chains):
                if abs((at - k) - (c[-1][0] - c[-1][1])) <= p["band"] and at - c[-1][0] <= len(item):
                    c.append((at, k))
                    break
            else:
                chains.append([(at, k)])
        for c in chains:
            if len(c) < p["least_hits"]:
                continue
            shift = sorted(at - k for at, k in c)[len(c) // 2]
            i0, i1, j0, j1, share = align(doc, item, index.weights[i], shift, p["band"], p["miss"], p["gap"])
            if j1 - j0 >= p["least_words"] and share >= p["least_share"]:
                found.append((i, i0, i1))
    return found


def _blocks(items, item_id: str, item_text: str, n: int, contexts: int, block_words: int, words_total: int) -> list[ItemIndex]:
    """The held-out items, read to the driver, as indexes of a bounded number of words."""
    rows = (
        items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
        .filter(F.col("i").isNotNull() & F.col("t").isNotNull())
        .distinct()
    )
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > 6 * words_total:
        raise ValueError(f"held-out texts of {size} characters are not a side to broadcast")
    held = sorted((int(r["i"]), r["t"]) for r in rows.collect())
    everyone = [words_of(t) for t in dict.fromkeys(t for _, t in held)]
    blocks, at = [], 0
    while at < len(held):
        end, words = at, 0
        while end < len(held) and (words == 0 or words < block_words):
            words += len(held[end][1]) // 5
            end += 1
        blocks.append(ItemIndex(held[at:end], n, contexts, everyone))
        at = end
    return blocks


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least_words: int = 20,
    n: int = 4,
    contexts: int = 2,
    least_hits: int = 1,
    least_share: float = 0.75,
    band: int = 8,
    miss: float = -2.0,
    gap: float = -1.5,
    block_words: int = 1_000_000,
    words_total: int = 50_000_000,
    most_chars: int = 2_000_000,
) -> DataFrame:
    """Leaked spans ``(doc_id, item_id, word_from, word_to)``.

    A leak is a stretch of at least ``least_words`` words of an item found in a
    document with small alterations: local alignment in words, of whose
    information at least ``least_share`` agrees. All items that hold the
    passage are reported. Null or empty texts and ids have no leaks; repeated
    rows give repeated leaks; an empty side gives none. Word numbers count the
    words of the normalised text.

    ``items`` is the held-out side and has to be small: it is read to the
    driver, and more than ``words_total`` words are refused. Tasks get it in
    blocks of ``block_words`` words, one scan of the documents for each;
    ``most_chars`` bounds the text that is looked through at a time.
    """
    blocks = _blocks(items, item_id, item_text, n, contexts, block_words, words_total)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, word_from int, word_to int"
    settings = {"least_words": least_words, "least_hits": least_hits, "least_share": least_share, "band": band,
                "miss": miss, "gap": gap}
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(
        F.col("doc_id").isNotNull() & (F.length("text") > 0)
    )
    source = spread(source)
    spark, result = docs.sparkSession, None
    for block in blocks:
        part = source.mapInPandas(_scanner(spark, block, settings, most_chars), schema)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], schema) if result is None else result


def _batches(pdf: pd.DataFrame, column: str, most_chars: int) -> Iterator[pd.DataFrame]:
    """Parts of a batch whose texts hold ``most_chars`` characters at most; a longer text is a part of its own."""
    sizes = pdf[column].str.len().fillna(0).to_numpy(dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // most_chars
    for _, rows in pdf.groupby(part, sort=True):
        yield rows


class Search:
    """Finds the leaks of one block of items in lists of texts."""

    def __init__(self, index: ItemIndex, settings: dict) -> None:
        self.index, self.settings = index, settings
        self.ids = Cache(lambda w: index.ids.get(plain(w), 0))

    def spans(self, texts: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """Position of a text -> its leaks ``(item, from word, to word)``."""
        index, get, n = self.index, self.ids.__getitem__, self.index.n
        flat: list[int] = []
        bounds = [0]
        for t in texts:
            flat.extend(map(get, spelled(composed(t))))
            flat.append(0)
            bounds.append(len(flat))
        known = np.array(flat, dtype=np.uint64)
        if len(known) < n or not len(index.hashes):
            return {}
        ok = known[: len(known) - n + 1] > 0
        for k in range(1, n):
            ok &= known[k : len(known) - n + 1 + k] > 0
        spots = np.flatnonzero(ok)
        if not len(spots):
            return {}
        h = gram_hashes(known, n)[spots]
        at = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
        hit = index.hashes[at] == h
        spots, h = spots[hit], h[hit]
        owner = np.searchsorted(np.array(bounds), spots, side="right") - 1
        by_doc: dict[int, list] = defaultdict(list)
        for d, s, x in zip(owner.tolist(), spots.tolist(), h.tolist(), strict=True):
            by_doc[d] += [(s - bounds[d], i, k) for i, k in index.seeds[x]]
        found = {d: verify(words_of(texts[d]), hits, index, self.settings) for d, hits in by_doc.items()}
        return {d: spans for d, spans in found.items() if spans}


def _scanner(spark, index: ItemIndex, settings: dict, most_chars: int):
    shared = spark.sparkContext.broadcast(index)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(shared.value, settings)
        for whole in batches:
            for pdf in _batches(whole, "text", most_chars):
                keys = pdf["doc_id"].tolist()
                found = [(keys[d], *s) for d, spans in search.spans(pdf["text"].tolist()).items() for s in spans]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "word_from", "word_to"])

    return scan


def found_pairs(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Distinct ``(doc_id, item_id)`` of :func:`leaks`."""
    return leaks(docs, items, **kw).select("doc_id", "item_id").distinct()


def cut_spans(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the words of the spans, and how many these are."""
    t = visible(text)  # word numbers were counted on the visible text
    marks = [m.span() for m in WORD.finditer(t.replace("_", " "))]
    cutting = np.zeros(len(marks), dtype=bool)
    for a, b in spans:
        cutting[a:b] = True
    kept, pos = [], 0
    runs = np.flatnonzero(np.diff(np.concatenate([[0], cutting.astype(np.int8), [0]])))
    for a, b in runs.reshape(-1, 2):
        kept.append(t[pos : marks[a][0]])
        pos = marks[b - 1][1]
    kept.append(t[pos:])
    return "".join(kept), int(cutting.sum())


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 4,
    contexts: int = 2,
    block_words: int = 1_000_000,
    words_total: int = 50_000_000,
    most_chars: int = 2_000_000,
    **settings,
) -> DataFrame:
    """The documents with leaked spans cut out where they are found, in one scan.

    All columns of ``docs``, the text cleaned, and ``leaked_words`` (0 where
    nothing was cut; it replaces a column of that name). All blocks of items are
    with every task, so the held-out side is bounded by ``words_total`` words.
    Rows are cut each by itself, repeated ones too; null and empty texts stay.
    Other settings as in :func:`leaks`.
    """
    settings = {"least_words": 20, "least_hits": 1, "least_share": 0.75, "band": 8, "miss": -2.0, "gap": -1.5} | settings
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(b) for b in _blocks(items, item_id, item_text, n, contexts, block_words, words_total)]
    free = next(name for k in range(len(docs.columns) + 1) if (name := f"_leak{k}") not in docs.columns)

    @F.pandas_udf("text string, leaked_words int")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        searches = [Search(b.value, settings) for b in shared]
        for series in batches:
            out = []
            for pdf in _batches(series.to_frame("t").reset_index(drop=True), "t", most_chars):
                texts = [t or "" for t in pdf["t"]]
                spans: dict[int, list] = defaultdict(list)
                for search in searches:
                    for d, found in search.spans(texts).items():
                        spans[d] += [(a, b) for _, a, b in found]
                out += [cut_spans(t, spans[d]) if d in spans else (t, 0) for d, t in enumerate(pdf["t"])]
            yield pd.DataFrame(out, columns=["text", "leaked_words"])

    rest = [c for c in docs.columns if c not in (text, "leaked_words")]
    found = spread(docs).withColumn(free, clean(F.col(text)))
    picked = found.select(*rest, F.col(f"{free}.text").alias(text), F.col(f"{free}.leaked_words").alias("leaked_words"))
    return picked.select(*docs.columns, *([] if "leaked_words" in docs.columns else ["leaked_words"]))
