"""Text decoded with the wrong character encoding: find it and restore it.

The unit is the token (a run of letters), not the whole value: values share
tokens, so a garbled token nearly always has a clean twin elsewhere.

1. Tokens with characters beyond ASCII are counted once over all rows; values
   that hold words of other alphabets are counted as wholes too.
2. A token's key is the token with every non-ASCII run replaced by a mark.
   Tokens of one key are near-twins; each key has one representative, the
   variant most likely clean, so joining needs no pairs within a key.
3. Garbled and clean runs of twins are aligned, and the transformation
   (bytes of one encoding read as another, once or repeatedly) that turns one
   into the other is inferred. Transformations with enough support are learned.
4. Learned transformations, and only these, are undone on the tokens without a
   twin. Where the result proves itself (bytes that form well-formed UTF-8) that
   settles it; otherwise the result has to be a token that is much more usual.

Replacement characters and stray control characters mark text that was lost;
it is restored only through a twin.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formflow.session import cut, tasks

# Single-byte encodings that programs confuse.
ENCODINGS = (
    "cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "iso8859-2", "cp1251", "cp1253", "iso8859-7",
    "cp1254", "iso8859-15", "cp852", "koi8-r", "cp1257",
)
NON_ASCII = re.compile(r"[^\x00-\x7f]+")
WORD = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
MARK = "□"
LOST = "�"


@lru_cache(maxsize=None)
def table(encoding: str) -> tuple[list[str], dict[str, int]]:
    """Characters by byte and bytes by character; undefined bytes stand for themselves."""
    chars = [bytes([b]).decode(encoding, "replace") for b in range(256)]
    chars = [chr(b) if c == LOST else c for b, c in enumerate(chars)]
    return chars, {c: b for b, c in enumerate(chars) if b > 127}


def to_bytes(run: str, encoding: str) -> bytes | None:
    if encoding == "utf-8":
        return run.encode("utf-8", "surrogatepass")
    codes = table(encoding)[1]
    try:
        return bytes([codes[c] for c in run])
    except KeyError:
        return None


def from_bytes(data: bytes, encoding: str) -> str | None:
    if encoding == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    chars = table(encoding)[0]
    return "".join(chars[b] for b in data)


def garble(run: str, true: str, wrong: str) -> str | None:
    """What ``run``, written as ``true``, looks like when read as ``wrong``."""
    data = to_bytes(run, true)
    return None if data is None else from_bytes(data, wrong)


def undo(run: str, true: str, wrong: str) -> str | None:
    return garble(run, wrong, true)


def plausible(text: str) -> bool:
    """Only characters that restored text is made of: letters of European
    scripts, their combining marks, punctuation and common signs."""
    for c in text:
        o = ord(c)
        if not (
            o < 0x80 or 0xA0 <= o <= 0x17F or 0x218 <= o <= 0x21B or 0x300 <= o <= 0x36F or 0x370 <= o <= 0x52F
            or 0x1E00 <= o <= 0x1FFF or 0x2010 <= o <= 0x205E or 0x20A0 <= o <= 0x20BF or 0x2100 <= o <= 0x214F
            or 0x2190 <= o <= 0x21FF or 0x2200 <= o <= 0x22FF or o == 0xFEFF
        ):
            return False
    return True


def proven(text: str) -> bool:
    """Whether text read as UTF-8 proves itself: European text does, and text of
    any script of assigned characters with three continuation bytes beyond the
    European ones, or two letters of one script. Fewer stand in clean text too
    ("café…»" has two)."""
    if plausible(text):
        return True
    other = [c for c in text if not plausible(c)]
    if not all(unicodedata.category(c)[0] in "LMNPSZ" or unicodedata.category(c) == "Cf" for c in other):
        return False
    if sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in other) > 2:
        return True
    letters = {unicodedata.name(c, "").split(" ")[0] for c in other if c.isalpha()}
    return len(other) == len(text) == 2 and all(c.isalpha() for c in other) and len(letters) == 1


def stray(token: str) -> bool:
    """Characters that only wrong decoding leaves behind."""
    return LOST in token or "ï¿½" in token or any("\x80" <= c <= "\x9f" for c in token)


def names_of(true: str, wrong: str, times: int) -> str:
    return f"{true}>{wrong}" + (f"*{times}" if times > 1 else "")


def explain(clean: str, dirty: str) -> tuple[str, bool] | None:
    """The transformation that turns all runs of ``clean`` into those of ``dirty``.

    ``(name, exact)``; not exact where characters of the garbled form were
    dropped on the way, which leaves part of it in order.
    """
    pairs = list(zip(NON_ASCII.findall(clean), NON_ASCII.findall(dirty), strict=True))
    changed = [(c, d) for c, d in pairs if c != d]
    if not changed:
        return None
    near = None
    for wrong in ENCODINGS:
        forms = [c for c, _ in changed]
        for times in (1, 2, 3):
            forms = [garble(f, "utf-8", wrong) for f in forms]
            if all(f == d for f, (_, d) in zip(forms, changed, strict=True)):
                return names_of("utf-8", wrong, times), True
            if near is None and all(dropped(f, d) for f, (_, d) in zip(forms, changed, strict=True)):
                near = names_of("utf-8", wrong, times)
    for true in ENCODINGS:
        for wrong in ENCODINGS:
            if true != wrong and all(garble(c, true, wrong) == d for c, d in changed):
                return names_of(true, wrong, 1), True
    # Repeated reading with different wrong encodings.
    layers = [d for _, d in changed]
    for depth in range(3):
        step = next(
            (x for w in ENCODINGS if None not in (x := [undo(d, "utf-8", w) for d in layers]) and x != layers), None
        )
        if step is None:
            break
        layers = step
        if depth and all(x == c for x, (c, _) in zip(layers, changed, strict=True)):
            return names_of("utf-8", "mixed", depth + 1), True
    return (near, False) if near else None


def dropped(full: str, seen: str) -> bool:
    """``seen`` is ``full`` with some characters missing, at least half kept."""
    if not (len(full) // 2 <= len(seen) < len(full)) or not seen:
        return False
    it = iter(full)
    return all(c in it for c in seen)


def restored_runs(token: str, wrongs: tuple[str, ...]) -> str | None:
    """The token with its runs read as UTF-8 again, as often as that works."""
    changed = False

    def fix(m: re.Match) -> str:
        nonlocal changed
        run = m.group()
        for _ in range(4):
            better = None
            for w in wrongs:
                x = undo(run, "utf-8", w)
                if x is not None and x != run and len(x) < len(run) and (plausible_step(x) or proven(x)):
                    better = x
                    break
            if better is None:
                break
            run = better
        if run != m.group() and proven(run):
            changed = True
            return run
        return m.group()

    out = NON_ASCII.sub(fix, token)
    return out if changed else None


@lru_cache(maxsize=1)
def known_characters() -> frozenset[str]:
    return frozenset(c for e in ENCODINGS for c in table(e)[0])


def plausible_step(text: str) -> bool:
    """What may stand between two readings: anything some encoding yields."""
    return plausible("".join(c for c in text if c not in known_characters()))


#: Everything in ASCII that is no letter separates tokens.
SEPARATORS = "[\\x00-@\\[-`{-\\x7f]+"


def _tokens(values: DataFrame, column: str) -> DataFrame:
    """``(…, token)``: runs of letters with characters beyond ASCII among them."""
    return values.withColumn("token", F.explode(F.split(column, SEPARATORS))).filter(
        F.col("token").rlike("[^\\x00-\\x7f]")
    )


def character_use(counted: DataFrame) -> dict[str, int]:
    """How often each character beyond ASCII stands alone between others; as many entries as there are characters."""
    rows = (
        counted.select("n", F.explode("runs").alias("c")).filter(F.length("c") == 1).groupBy("c").agg(F.sum("n").alias("n")).collect()
    )
    return {r["c"]: int(r["n"]) for r in rows}


def _phrase(value: Column) -> Column:
    """A whole value that holds a word without any ASCII letter, digits levelled; else null.

    Such a word alone has nothing in common with its garbled forms; what twins
    have in common here is the rest of the value.
    """
    edge = "[\\x00-@\\[-`{-\\x7f]"
    return F.when(value.rlike(f"(^|{edge})[^\\x00-\\x7f]{{2,}}($|{edge})"), F.regexp_replace(value, "[0-9]+", "0"))


def learn(
    values: DataFrame,
    column: str = "value",
    least_support: int = 3,
    least_ratio: float = 3.0,
    fallback: tuple[str, ...] = ENCODINGS,
) -> tuple[DataFrame, list[str]]:
    """``(token, restored, way)`` of all garbled tokens, and the learned transformations.

    ``way``: ``twin`` (explained by a clean twin), ``learned`` (a learned
    reading of UTF-8 undone), ``lost`` (stray characters), ``usual`` (a learned
    single-byte reading undone, whose result is much more usual) or
    ``fallback``. ``restored`` is null where the original can't be told.
    ``least_support``: different clean tokens that a transformation has to
    explain, or one of as many different characters; ``least_ratio``: how much more usual a restored token has to be
    that doesn't prove itself; ``fallback``: encodings to be tried for UTF-8
    though nothing was learned of them, for tables too small to learn from (the
    registered queries give none). An empty table learns nothing.
    """
    spark = values.sparkSession
    # A word is counted as a token; a whole value with words of other alphabets twice as a phrase, from which is only learnt:
    # single bytes keep the length (kind 1), UTF-8 read wrongly doesn't (kind 2).
    item = lambda t, kind: F.struct(t.alias("token"), F.lit(kind).alias("kind"))
    items = F.concat(
        F.transform(F.split(column, SEPARATORS), lambda t: item(t, 0)),
        F.array(item(F.col("phrase"), 1), item(F.col("phrase"), 2)),
    )
    runs_marked, each_marked = (F.regexp_replace("token", f"[^\\x00-\\x7f]{more}", MARK) for more in ("+", ""))
    counted = cut(
        values.select(column, _phrase(F.col(column)).alias("phrase"))
        .select(F.explode(items).alias("t"))
        .select("t.*")
        .filter(F.col("token").rlike("[^\\x00-\\x7f]"))
        .groupBy("token", "kind")
        .agg(F.count("*").alias("n"))
        .withColumn("runs", F.expr(r"regexp_extract_all(token, '([^\\x00-\\x7f]+)', 1)"))
        # Fewer than two letters in common make no twins; such tokens are their own key, so none of these is hot.
        .withColumn(
            "key",
            F.when(F.col("kind") == 1, each_marked)
            .when((F.col("kind") == 2) | runs_marked.rlike("[A-Za-z].*[A-Za-z]"), runs_marked)
            .otherwise(F.col("token")),
        )
    )
    characters = spark.sparkContext.broadcast(character_use(counted))

    @F.pandas_udf("double")
    def usage(tokens: pd.Series, n: pd.Series) -> pd.Series:
        known = characters.value.get
        rarest = [min((known(c, 1) for c in t if c > "\x7f"), default=1) for t in tokens]
        return 2 * np.log(n) + np.log(rarest)

    keyed = counted.withColumn("use", usage("token", "n"))
    best = F.struct(
        (~F.col("token").rlike("[\\x80-\\x9f\\ufffd]|ï¿½")).alias("sound"),
        (-F.length(F.array_join("runs", ""))).alias("short"), F.col("use"), F.col("token"),
    )
    twins = (
        keyed.groupBy("key", "kind")
        .agg(F.max(best).alias("best"))
        .filter("best.sound")
        .select("key", "kind", F.col("best.token").alias("clean"), F.col("best.use").alias("clean_use"))
    )
    pairs = keyed.join(twins, ["key", "kind"], "left").select("token", "kind", "n", "use", "clean", "clean_use").repartition(tasks(spark))

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for token, kind, n, use, clean, usual in zip(
                *(pdf[c] for c in ("token", "kind", "n", "use", "clean", "clean_use")), strict=True
            ):
                lost = stray(token)
                how = explain(clean, token) if clean and clean != token else None
                name, exact = how or ("lost" if lost and clean and clean != token else "", True)
                sure = bool(name) and (lost or (name.startswith("utf-8") and len(clean) < len(token)))
                rows.append((token, kind, n, clean if name else None, name, exact, sure, bool(name) and usual > use))
            yield pd.DataFrame(rows, columns=["token", "kind", "n", "clean", "how", "exact", "sure", "usual"])

    told = "token string, kind int, n long, clean string, how string, exact boolean, sure boolean, usual boolean"
    explained = cut(pairs.mapInPandas(infer, told))
    words = F.when(F.col("kind") > 0, F.split("clean", SEPARATORS)).otherwise(F.array("clean"))
    # Of phrases, words of other alphabets count; one of many different characters is as good as that many words.
    characters_of = F.size(F.array_distinct(F.split("clean", "")))
    support = (
        explained.filter("exact AND how NOT IN ('', 'lost') AND (sure OR usual)")
        .filter("kind = 0 OR (how LIKE 'utf-8%') = (kind = 2)")
        .select("how", "kind", F.explode(words).alias("clean"))
        .filter((F.col("kind") == 0) | F.col("clean").rlike(r"^[\p{L}&&[^\p{IsLatin}]]{2,}$"))
        .groupBy("how", "clean")
        .agg(F.max("kind").alias("kind"))
        .groupBy("how")
        .agg(F.sum(F.when((F.col("kind") > 0) & (characters_of >= least_support), least_support).otherwise(1)).alias("n"))
        .collect()  # a row a transformation of a fixed list
    )
    learned = sorted(r["how"] for r in support if r["n"] >= least_support)
    single = [h for h in learned if not h.startswith("utf-8")]
    multi = tuple(dict.fromkeys(w for h in learned if h.startswith("utf-8") and (w := h[6:].split("*")[0]) in ENCODINGS))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for token, n, clean, how, sure, usual in zip(
                *(pdf[c] for c in ("token", "n", "clean", "how", "sure", "usual")), strict=True
            ):
                if sure or (usual and how in single):
                    rows.append((token, n, clean, "", "twin"))
                    continue
                lost, fixed = stray(token), restored_runs(token, multi)
                way = "learned"
                if fixed is None and fallback:
                    fixed, way = restored_runs(token, fallback), "fallback"
                if fixed is not None or lost:
                    whole = fixed is not None and not stray(fixed)
                    rows.append((token, n, fixed if whole else None, "", way if fixed is not None else "lost"))
                    continue
                for true, wrong in (h.split(">") for h in single):
                    back = NON_ASCII.sub(lambda m: undo(m.group(), true, wrong) or LOST, token)
                    if back != token and LOST not in back and plausible(back) and not stray(back):
                        rows.append((token, n, back, back.lower(), "usual"))
            yield pd.DataFrame(rows, columns=["token", "n", "restored", "word", "way"])

    tried = explained.filter("kind = 0").mapInPandas(apply, "token string, n long, restored string, word string, way string")
    done = tried.filter("way <> 'usual'").select("token", "restored", "way")
    words = counted.filter("kind = 0").groupBy(F.lower("token").alias("word")).agg(F.sum("n").alias("m"))
    likely = (
        tried.filter("way = 'usual'")
        .join(words, "word")
        .filter(F.col("m") >= least_ratio * F.col("n"))
        .groupBy("token", "way")
        .agg(F.max_by("restored", F.struct("m", "restored")).alias("restored"))
        .select("token", "restored", "way")
    )
    return done.unionByName(likely), learned


def stack_fields(parts: list[tuple[DataFrame, list[Column], str, Column]]) -> DataFrame:
    """``(keys…, field_name, value)`` rows of several columns of several tables."""
    whole = None
    for df, keys, name, value in parts:
        rows = df.select(*keys, F.lit(name).alias("field_name"), value.alias("value")).filter(
            F.col("value").rlike("[^\\x00-\\x7f]")
        )
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def garbled_values(values: DataFrame, keys: list[str], **kw) -> DataFrame:
    """Distinct ``keys`` of the values that hold a garbled token.

    Null and empty values, and values of ASCII characters only, are no cases;
    correct text in any script or normal form isn't one either. Values repeated
    under one key count once.
    """
    garbled, _ = learn(values, **kw)
    return _tokens(values, "value").join(garbled.select("token"), "token", "left_semi").select(*keys).distinct()


def restored_values(values: DataFrame, **kw) -> DataFrame:
    """``(value, restored, complete)`` of every distinct garbled value.

    Tokens are exchanged where their original is known; ``complete`` is false
    where one could not be told and stays as it is.
    """
    garbled, _ = learn(values, **kw)
    distinct = values.select("value").distinct()
    hit = _tokens(distinct, "value").join(garbled, "token").groupBy("value").agg(
        F.collect_set(F.struct("token", "restored")).alias("swaps")
    )

    @F.pandas_udf("restored string, complete boolean")
    def swap(texts: pd.Series, swaps: pd.Series) -> pd.DataFrame:
        rows = []
        for text, pairs in zip(texts, swaps, strict=True):
            known = {p["token"]: p["restored"] for p in pairs}
            complete = all(r is not None for r in known.values())
            rows.append((WORD.sub(lambda m, k=known: k.get(m.group()) or m.group(), text), complete))
        return pd.DataFrame(rows, columns=["restored", "complete"])

    return hit.withColumn("r", swap("value", "swaps")).select("value", "r.restored", "r.complete")
