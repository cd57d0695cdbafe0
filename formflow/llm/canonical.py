"""Freely entered values to the entries of a reference list.

Values are deduplicated first; every distinct value is normalised and scored
once. The reference list is small (a parameter bounds it) and every task gets
an inverted index of it: character n-gram -> words of the list, weighted by
rarity. Runs of a value's pieces retrieve candidate words through shared n-grams
only and are scored by the weighted cosine. An entry scores what the weaker of
its words scores, less for letters of the value that no word explains. The best
entry is accepted above a threshold and by a margin over the next one; one that
isn't told from the next is rejected. An exact check of edits follows, which can
only refuse what was accepted.

Which words join others is learnt from the list: words that stand only inside
entries and in so many of them that they hardly tell entries apart. Order
doesn't matter; single letters or numbers ("form B", "sheet 3") have to agree
exactly, for a similar number is another entry. Codes are compared as numbers
and ranges for the same reason.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formflow.llm.words import Cache
from formflow.session import tasks

# Characters and pairs that recognition confuses, folded on both sides.
CONFUSED = (("ae", "a"), ("oe", "o"), ("ue", "u"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("li", "u"), ("vv", "w"))
CONFUSED_ONE = str.maketrans("01|!5cqfi", "olllsegtl")


def unify(text: str) -> str:
    """Compatible, composed, lower-case text without soft hyphens and accents."""
    text = unicodedata.normalize("NFKC", text).replace("\xad", "").replace("​", "").lower().replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def fold(word: str) -> str:
    """A word with characters that are often confused levelled."""
    for pair, one in CONFUSED:
        word = word.replace(pair, one)
    return word.translate(CONFUSED_ONE)


def grams(word: str, closed: bool = True) -> Counter:
    """Pairs and triples of characters; ``closed`` marks the end of the word."""
    w = f"^{word}$" if closed else f"^{word}"
    return Counter([w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)])


def edits(a: str, b: str, most: int | None = None) -> int:
    """Insertions, deletions, replacements and swaps of neighbours; beyond ``most`` some number above it."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = least = i
        row = [i]
        for j, y in enumerate(b, 1):
            cost = one[j - 1] if x == y else 1 + min(one[j - 1], one[j], left)
            if x != y and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and two[j - 2] + 1 < cost:
                cost = two[j - 2] + 1
            row.append(cost)
            left = cost
            if cost < least:
                least = cost
        if most is not None and least > most:
            return most + 1
        two, one = one, row
    return one[-1]


class WordIndex:
    """Inverted n-gram index of a vocabulary.

    ``unseen``: weight of an n-gram that no word has, as a share of the rarest
    one's; it is evidence of a slip rather than of another word. ``least``: lower
    cosines aren't returned.
    """

    def __init__(self, words: list[str], room: float = 0.42, unseen: float = 0.3, least: float = 0.0) -> None:
        self.room, self.least = room, least
        self.words = sorted(set(words))
        self.written = [unify(w) for w in self.words]
        self.folded = [fold(w) for w in self.written]
        # No longer word passes the check of edits: folding at most halves it, an abbreviation may have a third of edits.
        size = max((len(w) for w in (*self.written, *self.folded)), default=0)
        self.longest = max(3 * (size + 1), math.ceil(size / (0.95 - room)))
        in_words = Counter(g for f in self.folded for g in set(grams(f)))
        self.default = unseen * math.log(1 + len(self.words))
        self.idf = {g: math.log(1 + len(self.words) / n) for g, n in in_words.items()}
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.norms = []
        self.starts: dict[int, tuple[dict, list[float]]] = {}
        for k, f in enumerate(self.folded):
            vector = self.weigh(grams(f))
            self.norms.append(math.sqrt(sum(x * x for x in vector.values())) or 1.0)
            for g, x in vector.items():
                self.postings[g].append((k, x))
        self.cache = Cache(self._scores, 200_000)

    def weigh(self, counts: Counter) -> dict[str, float]:
        return {g: n * self.idf.get(g, self.default) for g, n in counts.items()}

    def scores(self, word: str, cut: bool) -> list[tuple[float, int]]:
        """``(cosine, word)`` of all words that share an n-gram, best first; ``cut`` marks an abbreviation."""
        return self.cache[word, cut]

    def _scores(self, key: tuple[str, bool]) -> list[tuple[float, int]]:
        word, cut = key
        f = fold(word)
        if not f:
            return []
        found = self._cosines(self.weigh(grams(f)), self.postings, self.norms)
        if cut and len(f) >= 3:
            part = self.weigh(grams(f, closed=False))
            for n in (len(f), len(f) + 1):
                for k, s in self._cosines(part, *self._starts(n)).items():
                    found[k] = max(found.get(k, 0.0), 0.98 * s)
        return sorted(((s, k) for k, s in found.items() if s >= self.least), key=lambda x: (-x[0], x[1]))

    @staticmethod
    def _cosines(vector: dict[str, float], postings: dict, norms: list[float]) -> dict[int, float]:
        norm = math.sqrt(sum(x * x for x in vector.values())) or 1.0
        dots: dict[int, float] = defaultdict(float)
        for g, x in vector.items():
            for k, y in postings.get(g, ()):
                dots[k] += x * y
        return {k: s / (norm * norms[k]) for k, s in dots.items()}

    def _starts(self, n: int) -> tuple[dict, list[float]]:
        """The index of the words' first ``n`` characters."""
        if n not in self.starts:
            postings, norms = defaultdict(list), []
            for k, f in enumerate(self.folded):
                vector = self.weigh(grams(f[:n], closed=False))
                norms.append(math.sqrt(sum(x * x for x in vector.values())) or 1.0)
                for g, x in vector.items():
                    postings[g].append((k, x))
            self.starts[n] = dict(postings), norms
        return self.starts[n]

    def near(self, seen: str, k: int, cut: bool) -> bool:
        """Exact check of an accepted word: its edits, or those of an abbreviation."""
        f, word, written = fold(seen), self.folded[k], self.written[k]
        most, more = int(self.room * max(len(f), len(word))), int((self.room + 0.05) * max(len(seen), len(written)))
        if edits(f, word, most) <= most and edits(seen, written, more) <= more:
            return True
        few = len(f) // 3 + (len(f) > 3)
        return cut and len(f) >= 3 and any(edits(f, word[:n], few) <= few for n in (len(f), len(f) + 1))


def pieces(text: str, camel: bool) -> tuple[list[tuple[str, bool]], str]:
    """``([(piece, abbreviated)], mark)`` of a value or entry.

    The mark is a lone number or single letter, the last one where there are
    several; remarks in brackets, amounts and version marks are left out.
    """
    text = unicodedata.normalize("NFKC", text).replace("\xad", "")
    text = re.sub(r"\([^)]*\)|(?i:\bv\d\b)", " ", text)
    text = re.sub(r"(?<=[^\W\d_])(?=\d+\W*$)", " ", text)
    if camel:
        text = re.sub(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ])", " ", text)
    text = re.sub(r"\b\d+[^\W\d_]{1,3}\b", " ", unify(text))
    chunks, mark = [], ""
    for m in re.finditer(r"([^\W_]+)(\.?)", text):
        word, dot = m.group(1), bool(m.group(2))
        if word.isdigit() or len(word) == 1:
            mark = word.lstrip("0") or "0"
        else:
            chunks.append((word, dot))
    return chunks, mark


class ListMatcher:
    """The entries of a list by their significant words.

    ``threshold``: least score of an entry; ``margin``: least distance of the
    best entry from the next; ``least_bits``: words inside entries that tell
    fewer bits about which entry is meant only join others; ``marks``: whether
    lone numbers and letters belong to the entries; ``clear``: cosine from which
    a piece is a word by itself.
    """

    def __init__(
        self,
        entries: list[tuple[int, str]],
        marks: bool,
        threshold: float = 0.4,
        margin: float = 0.05,
        least_bits: float = 3.5,
        unseen: float = 0.3,
        clear: float = 0.8,
    ) -> None:
        self.marks, self.threshold, self.margin, self.clear = marks, threshold, margin, clear
        self.literal = {text for _, text in entries}
        read = {text: pieces(text, marks) for _, text in entries}
        rims = {w for chunks, _ in read.values() for w, _ in (chunks[:1] + chunks[-1:])}
        inside = Counter(w for chunks, _ in read.values() for w in {w for w, _ in chunks} - rims)
        self.joiners = {w for w, n in inside.items() if math.log2(len(read) / n) <= least_bits}
        self.by_words: dict[tuple, int] = {}
        slots: dict[int, list[list[str]]] = {}
        for ref, text in sorted(entries, reverse=True):
            chunks, mark = read[text]
            words = tuple(w for w, _ in chunks if w not in self.joiners)
            if not words:
                continue
            self.by_words[words, mark if marks else ""] = ref
            for k, w in enumerate(words):
                slots.setdefault(len(words), [[] for _ in words])[k].append(w)
        reach = max(0.0, threshold - margin)
        self.indexes = {n: [WordIndex(ws, unseen=unseen, least=reach) for ws in lists] for n, lists in slots.items()}
        self.joining = WordIndex(sorted(self.joiners), unseen=unseen)

    def match(self, value: str) -> int:
        """The entry meant, or 0."""
        ranked = self.ranked(value)
        if not ranked:
            return 0
        score, ref, words = ranked[0]
        if score < self.threshold or (len(ranked) > 1 and score - ranked[1][0] < self.margin):
            return 0
        return ref if all(index.near(seen, k, cut) for index, k, seen, cut in words) else 0

    def ranked(self, value: str) -> list[tuple[float, int, list]]:
        """``(score, entry, its words as read)`` of all entries in reach of the threshold, best first."""
        chunks, mark = pieces(value, self.marks)
        weights = [self._weight(w) for w, _ in chunks]
        best: dict[int, tuple[float, float, list]] = {}  # of two readings alike in the weaker word, the better in all
        for n, indexes in self.indexes.items():
            longest = max(x.longest for x in indexes)
            reach = max(0.0, self.threshold - self.margin)
            # More letters than these leave too many unexplained for any entry to reach the threshold.
            if not chunks or sum(weights) * reach**2 > n * longest:
                continue
            runs = self._runs(chunks, indexes, longest)
            for score, total, spans, words in self._readings(runs, indexes, 0, [], []):
                taken = {i for a, b in spans for i in range(a, b)}
                explained = sum(len(chunks[i][0]) for i in taken)
                rest = sum(w for i, w in enumerate(weights) if i not in taken)
                score *= math.sqrt(explained / (explained + rest))
                ref = self.by_words.get((tuple(x.words[k] for x, k, _, _ in words), mark if self.marks else ""), 0)
                if ref and (score, total) > best.get(ref, (0.0, 0.0))[:2]:
                    best[ref] = (score, total, words)
        return sorted(((s, ref, words) for ref, (s, _, words) in best.items()), key=lambda x: (-x[0], x[1]))

    def _weight(self, word: str) -> float:
        """Letters that count as unexplained where no word takes a piece: none of a joining word, half of a short one."""
        if word in self.joiners or any(s >= 0.5 for s, _ in self.joining.scores(word, False)[:1]):
            return 0.0
        return len(word) * (0.5 if len(word) < 4 else 1.0)

    def _runs(self, chunks, indexes, longest: int) -> list[list[tuple]]:
        """For every slot ``(score, from, to, word, seen, abbreviated)`` of the runs of pieces that resemble a word.

        Several pieces are one word only if they spell it; a joining word neither begins nor ends such a
        run, and a piece that is a word by itself is no part of one.
        """
        runs: list[list[tuple]] = [[] for _ in indexes]
        whole = set()  # pieces that are words by themselves
        for i, (word, dot) in enumerate(chunks):
            for slot, index in enumerate(indexes):
                found = index.scores(word, dot)
                runs[slot] += [(s, i, i + 1, k, word, dot) for s, k in found]
                if (found and found[0][0] >= self.clear) or len(word) > longest:
                    whole.add(i)
        for a in range(len(chunks)):
            if a in whole or chunks[a][0] in self.joiners:
                continue
            seen = chunks[a][0]
            for b in range(a + 1, len(chunks)):
                seen += chunks[b][0]
                if len(seen) > longest or b in whole:
                    break
                if chunks[b][0] in self.joiners:
                    continue
                dot = chunks[b][1]
                for slot, index in enumerate(indexes):
                    runs[slot] += [(s, a, b + 1, k, seen, dot) for s, k in index.scores(seen, dot) if index.near(seen, k, dot)]
        return runs

    def _readings(self, runs, indexes, slot: int, spans: list, words: list, score: float = 1.0, total: float = 0.0):
        """``(score of the weakest word, of all, spans, words)`` of all choices of disjoint runs, one a slot."""
        if slot == len(runs):
            yield score, total, spans, words
            return
        for s, a, b, k, seen, cut in runs[slot]:
            if all(b <= x or y <= a for x, y in spans):
                yield from self._readings(
                    runs, indexes, slot + 1, [*spans, (a, b)], [*words, (indexes[slot], k, seen, cut)], min(score, s), total + s
                )


class CodeMatcher:
    """Codes that are numbers or ranges of numbers."""

    def __init__(self, entries: list[tuple[int, str, int | None, int | None]]) -> None:
        self.literal = {code for _, code, _, _ in entries if code is not None}
        self.ranges = {}
        for ref, code, lo, hi in sorted(entries, key=lambda e: -e[0]):
            if code is not None and lo is not None and hi is not None:
                self.ranges[int(lo), int(hi)] = ref
        self.sorted = sorted((lo, hi, ref) for (lo, hi), ref in self.ranges.items())

    def match(self, value: str) -> int:
        text = unify(value)
        text = re.sub(r"^[^\d]*?(?:art|nr|no|prod|code|pos|artikel|number|nummer)\b[-.\s]*(?:nr|no)?[.:\s]*", "", text)
        text = re.sub(r"(?<![a-km-np-z])o(?![a-km-np-z])|(?<=\d)o|o(?=\d)", "0", text)
        text = re.sub(r"(?<![a-km-z])[li|](?![a-km-z])|(?<=\d)[li|]|[li|](?=\d)", "1", text)
        text = text.replace("bis", "-")
        if re.search(r"[a-z]", text):
            return 0
        numbers = [int(x) for x in re.findall(r"\d+", text)]
        if len(numbers) == 2 and re.search(r"\d\s*[-–—‑−/]\s*\d", text):
            return self.ranges.get((numbers[0], numbers[1]), 0)
        if len(numbers) != 1:
            return 0
        n = numbers[0]
        exact = self.ranges.get((n, n))
        if exact:
            return exact
        inside = [(hi - lo, ref) for lo, hi, ref in self.sorted if lo <= n <= hi]
        return min(inside)[1] if inside else 0


def matched_values(entries: DataFrame, matchers: dict[str, object], entry_id: str = "entry_id") -> DataFrame:
    """Distinct ``(entry_id, field_name, value, ref_id)`` of the values that are no literal entry.

    ``matchers`` maps a column to its matcher. Null and blank values are no
    cases; ``ref_id`` is 0 where the list holds no such thing. Lines saved
    several times count once; null ids are left out; other columns aren't read.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in matchers])
    whole = (
        entries.filter(F.col(entry_id).isNotNull())
        .select(F.col(entry_id).alias("entry_id"), F.explode(fields).alias("f"))
        .select("entry_id", "f.field_name", "f.value")
        .filter(F.length("value") > 0)
    )
    shared = entries.sparkSession.sparkContext.broadcast(matchers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_field = shared.value
        for pdf in batches:
            rows = []
            for name, value in zip(pdf["field_name"], pdf["value"], strict=True):
                matcher = by_field[name]
                if value.strip() and value not in matcher.literal:
                    rows.append((name, value, matcher.match(value)))
            yield pd.DataFrame(rows, columns=["field_name", "value", "ref_id"])

    values = whole.select("field_name", "value").distinct().repartition(tasks(entries.sparkSession))
    matched = values.mapInPandas(run, "field_name string, value string, ref_id long")
    return whole.join(matched, ["field_name", "value"]).select("entry_id", "field_name", "value", "ref_id").distinct()


def match_fields(entries: DataFrame, matchers: dict[str, object], entry_id: str = "entry_id") -> DataFrame:
    """Distinct ``(entry_id, field_name, ref_id)`` of :func:`matched_values`."""
    found = matched_values(entries, matchers, entry_id)
    return found.select(F.col("entry_id").alias(entry_id), "field_name", "ref_id").distinct()


def read_list(df: DataFrame, columns: list[str], most: int = 1_000_000) -> list[tuple]:
    """The rows of a reference list; more than ``most`` are refused, for every task gets them."""
    rows = df.select(*columns).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries are no list to broadcast")
    return [tuple(r) for r in rows]
