"""Schema drift between versions of JSON files.

Three steps:

1. **Profile.** Every version's body becomes one profile per path (keys from
   the top, array positions left out): the JSON types seen there, a digest of
   all its values in document order exactly as written, type marks included,
   and a sketch of the values, their least hashes.
2. **Match.** Between neighbouring versions of one set, lost and new paths
   under the same parent form a bipartite graph, weighed by the similarity of
   names and of values. Its maximum-weight matching gives the pairs; a pair of
   equal values that is the only one of both its ends is a rename, with
   ``prefer_similar`` every pair of at least that likeness.
3. **Unify.** Renames seen anywhere link key names into classes; the most used
   name of a class names the column of the consistent table.

Neighbouring versions are found without gathering a set in one task: rows are
range-partitioned by (set, version), each task pairs the rows it streams over,
and only the first and last row of every task meet in a second, tiny step. A
set holding a third of all rows is therefore spread over many tasks.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formflow.session import cut, spread

ZONES = "set_id string, version_no int, zone_kind string, zone_idx int, fields map<string,string>"
CHANGES = "set_id string, version_no int, change_kind string, field_path string, old_path string"
#: Least hashes kept of the values of a path.
SKETCH = 16


class Number(str):
    """A JSON number as written."""

    __slots__ = ("kind",)


def _number(kind: str):
    def make(text: str) -> Number:
        n = Number(text)
        n.kind = kind
        return n

    return make


def _no_constant(text: str):
    raise ValueError(text)


def parse_as_written(body: str | None):
    """The JSON value with numbers kept as written; ValueError if invalid."""
    if body is None:
        raise ValueError("null")
    try:
        return json.loads(
            body, parse_int=_number("integer"), parse_float=_number("number"), parse_constant=_no_constant
        )
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def type_of(value) -> str:
    """JSON type; numbers with a decimal point or exponent are ``number``."""
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, Number):
        return value.kind
    if isinstance(value, bool):
        return "boolean"
    return "string"


def as_written(value) -> str:
    """Canonical text: key order and layout left out, values and types kept."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{as_written(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(as_written, value)) + "]"
    if isinstance(value, Number):
        return str(value)
    return json.dumps(value)


class Values:
    """The values of one path in document order. What a comparison doesn't ask for isn't made."""

    def __init__(self, k: int) -> None:
        self.nodes, self.k = [], k

    @cached_property
    def types(self) -> tuple[str, ...]:
        return tuple(sorted({type_of(x) for x in self.nodes}))

    @cached_property
    def sketch(self) -> tuple[str, frozenset[int]]:
        """A digest of the values in order, exact, and the ``k`` least hashes of the different values."""
        digest, least = hashlib.blake2b(digest_size=16), set()
        for node in self.nodes:
            data = as_written(node).encode("utf-8", "surrogatepass")
            digest.update(data + b"\x00")
            if self.k:
                least.add(zlib.crc32(data))
                if len(least) > 8 * self.k:
                    least = set(sorted(least)[: self.k])
        return digest.hexdigest(), frozenset(sorted(least)[: self.k])

    digest = property(lambda self: self.sketch[0])
    least = property(lambda self: self.sketch[1])


def profile(value, k: int = 0) -> dict[tuple[str, ...], Values]:
    """Path -> its values (types, digest, their ``k`` least hashes). A value null is absent.

    An array's elements stand under the array's own path; the types of a path
    are those of the values its key holds.
    """
    values: dict[tuple[str, ...], Values] = {}
    todo = [((), value)]
    # document order of the elements of one path: parents are popped in order
    while todo:
        path, node = todo.pop()
        if isinstance(node, list):
            todo.extend((path, x) for x in reversed(node))
        elif isinstance(node, dict):
            for key in sorted(node, reverse=True):
                if node[key] is not None:
                    at = (*path, key)
                    todo.append((at, node[key]))
                    if at not in values:
                        values[at] = Values(k)
                    values[at].nodes.append(node[key])
    return values


def assignment(weights: list[list[float]]) -> list[int]:
    """The maximum-weight bipartite matching: for every row its column, or -1 where no positive weight is left.

    Shortest augmenting paths with potentials, one row after the other.
    """
    rows, columns = len(weights), len(weights[0]) if weights else 0
    n = max(rows, columns)
    cost = [[-(weights[i][j] if i < rows and j < columns else 0.0) for j in range(n)] for i in range(n)]
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n):
        owner[n], j0 = i, n
        least, way, done = [math.inf] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while True:
            done[j0] = True
            i0, delta, j1 = owner[j0], math.inf, -1
            for j in range(n):
                if not done[j]:
                    reduced = cost[i0][j] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == n:
                break
        while j0 != n:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    found = [-1] * rows
    for j in range(columns):
        if owner[j] < rows and weights[owner[j]][j] > 0:
            found[owner[j]] = j
    return found


@lru_cache(maxsize=100_000)
def names_alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def likeness(p: tuple, q: tuple, old: Values, new: Values) -> float:
    """Geometric mean of the similarity of two keys' names and of their values; 0 where no type is common."""
    if set(old.types).isdisjoint(new.types):
        return 0.0
    if old.digest == new.digest:
        alike = 1.0
    else:
        common = len(old.least & new.least)
        alike = common / (len(old.least) + len(new.least) - common) if common else 0.0
    return math.sqrt(names_alike(p[-1], q[-1]) * alike) if alike else 0.0


def linked(old: dict, new: dict, lost: list[tuple], fresh: list[tuple]) -> list[tuple[list[tuple], list[tuple]]]:
    """Lost and new paths in groups between which no value is common: a matching is one of each group."""
    root: dict = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for side, paths in ((old, lost), (new, fresh)):
        for p in paths:
            for mark in (side[p].digest, *side[p].least):
                root[find(mark)] = find(p)
    groups: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
    for i, paths in enumerate((lost, fresh)):
        for p in paths:
            groups[find(p)][i].append(p)
    return [g for g in groups.values() if g[0] and g[1]]


def matched(old: dict, new: dict, lost: list[tuple], fresh: list[tuple], prefer_similar: float | None = None) -> dict[tuple, tuple]:
    """The pairs of one parent's lost and new paths: the maximum-weight matching by :func:`likeness`.

    A sole edge of equal values, the only such one of both its ends, weighs 3
    more: all others of its ends weigh 1 at most, at most two of them can stand in
    its place, so every maximum-weight matching holds it and they need no weight.
    Without ``prefer_similar`` only such pairs are reported; groups without any
    are left out.
    """
    pairs = {}
    for some, others in linked(old, new, lost, fresh):
        gone, born = Counter(old[p].digest for p in some), Counter(new[q].digest for q in others)
        sole = {d for d, n in gone.items() if n == born[d] == 1}
        if prefer_similar is None and not sole:
            continue

        def weight(p: tuple, q: tuple) -> float:
            a, b = old[p], new[q]
            if a.digest in sole or b.digest in sole:  # noqa: B023
                return 3.0 + likeness(p, q, a, b) if a.digest == b.digest else 0.0
            like = likeness(p, q, a, b)
            return like if like >= (prefer_similar or 0.0) else 0.0

        for p, j in zip(some, assignment([[weight(p, q) for q in others] for p in some]), strict=True):
            if j >= 0 and (prefer_similar is not None or old[p].digest == new[others[j]].digest in sole):
                pairs[p] = others[j]
    return pairs


def compare(old: dict, new: dict, prefer_similar: float | None = None) -> list[tuple[str, str, str]]:
    """Changes ``(kind, path after the change, old path)`` between two profiles.

    Lost and new paths under one parent are a bipartite graph, paired by
    :func:`matched`. A pair of equal values that is the only one of both its ends
    is a rename; ``prefer_similar`` adds the other pairs of at least that likeness.
    """
    gone, born = [p for p in old if p not in new], [p for p in new if p not in old]
    top_gone = [p for p in gone if p[:-1] in new or len(p) == 1]
    top_born = [p for p in born if p[:-1] in old or len(p) == 1]

    sides: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
    for i, paths in enumerate((top_gone, top_born)):
        for p in sorted(paths):
            sides[p[:-1]][i].append(p)
    renames: dict[tuple, tuple] = {}
    for lost, fresh in sides.values():
        if lost and fresh:
            renames |= matched(old, new, lost, fresh, prefer_similar)

    changes = [("renamed", ".".join(q), ".".join(p)) for p, q in renames.items()]
    named = set(renames.values())
    changes += [("removed", ".".join(p), "") for p in top_gone if p not in renames]
    changes += [("added", ".".join(q), "") for q in top_born if q not in named]
    changes += [("retyped", ".".join(p), "") for p in old if p in new and old[p].types != new[p].types]
    return changes


def _bodies(df: DataFrame, set_id: str, version: str, body: str) -> DataFrame:
    """One valid body per (set, version): the least text among repeated saves."""

    def valid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for text in pdf["body"]:
                try:
                    parse_as_written(text)
                    keep.append(True)
                except ValueError:
                    keep.append(False)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    rows = df.select(
        F.col(set_id).cast("string").alias("set_id"),
        F.col(version).cast("int").alias("version_no"),
        F.col(body).alias("body"),
    ).filter(F.col("set_id").isNotNull() & F.col("version_no").isNotNull() & F.col("body").isNotNull())
    return spread(rows).mapInPandas(valid, rows.schema).groupBy("set_id", "version_no").agg(F.min("body").alias("body"))


def schema_changes(
    df: DataFrame,
    set_id: str = "zone_set",
    version: str = "version_no",
    body: str = "body",
    prefer_similar: float | None = None,
) -> DataFrame:
    """Changes of every version against the previous existing one of its set.

    Columns ``set_id, version_no, change_kind, field_path, old_path`` under the
    given names. Rows with a null key or a body that is no valid JSON are no
    versions; a version saved several times counts once; the first version of
    a set and an empty table report nothing. Other columns are not read.
    """
    changes = _neighbours(_bodies(df, set_id, version, body), prefer_similar)
    return changes.withColumnRenamed("set_id", set_id).withColumnRenamed("version_no", version)


def _neighbours(bodies: DataFrame, prefer_similar: float | None) -> DataFrame:
    """The changes between neighbouring versions of ``(set_id, version_no, body)``.

    Bodies are moved rather than their profiles: digests don't compress.
    """
    rows = cut(bodies.repartitionByRange("set_id", "version_no").sortWithinPartitions("set_id", "version_no"))
    read = lambda text: profile(parse_as_written(text), SKETCH)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, last = None, None
        for pdf in batches:
            out = []
            for s, v, text in zip(pdf["set_id"], pdf["version_no"], pdf["body"], strict=True):
                now = read(text)
                if before == s:
                    out += [(s, v, *c) for c in compare(last, now, prefer_similar)]
                before, last = s, now
            yield pd.DataFrame(out, columns=["set_id", "version_no", "change_kind", "field_path", "old_path"])

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = final = None
        for pdf in batches:
            if len(pdf):
                first = pdf.iloc[[0]] if first is None else first
                final = pdf.iloc[[-1]]
        if first is not None:
            yield first.assign(side="first")
            yield final.assign(side="last")

    inside = rows.mapInPandas(pairs, CHANGES)
    # Two rows a task: the pairs that a task border separates.
    rims = rows.mapInPandas(edges, "set_id string, version_no int, body string, side string")
    w = Window.partitionBy("set_id").orderBy("version_no", F.when(F.col("side") == "first", 0).otherwise(1))
    across = (
        rims.withColumn("prev", F.lag(F.struct("body", "side")).over(w))
        .filter((F.col("side") == "first") & (F.col("prev.side") == "last"))
        .select("set_id", "version_no", "body", F.col("prev.body").alias("prev"))
    )

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, v, b, a in zip(pdf["set_id"], pdf["version_no"], pdf["body"], pdf["prev"], strict=True):
                out += [(s, v, *c) for c in compare(read(a), read(b), prefer_similar)]
            yield pd.DataFrame(out, columns=["set_id", "version_no", "change_kind", "field_path", "old_path"])

    return inside.unionByName(across.mapInPandas(joined, CHANGES))


def rename_classes(changes: DataFrame, least: int = 1) -> DataFrame:
    """``(a, b, n, moves)``: how often two key names replaced each other, by leaf name, and
    how often the rarer one of them came or went at all. Links seen less than ``least`` times are left out.
    """
    leaf = lambda c: F.element_at(F.split(c, r"\."), -1)
    moved = changes.filter("change_kind IN ('renamed', 'added', 'removed')")
    names = F.when(F.col("change_kind") == "renamed", F.array("old_path", "field_path")).otherwise(F.array("field_path"))
    moves = moved.select(F.explode(names).alias("p")).groupBy(leaf(F.col("p")).alias("k")).agg(F.count("*").alias("m"))
    links = (
        changes.filter(F.col("change_kind") == "renamed")
        .select(leaf(F.col("old_path")).alias("a"), leaf(F.col("field_path")).alias("b"))
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= least)
    )
    of = lambda side: moves.select(F.col("k").alias(side), F.col("m").alias(f"m_{side}"))
    return links.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n", F.least("m_a", "m_b").alias("moves"))


def unified_names(
    links: list[tuple], used: dict[str, int], least: int = 2, least_share: float = 0.1
) -> dict[str, str]:
    """Key name -> name of its class, from links ``(a, b, n, moves)`` seen at least ``least`` times.

    A class is named after its most used member (ties: the least text). A link
    counts only if it is at least ``least_share`` of the times that the rarer of
    its names came or went: equal values make chance renames, and their number
    grows with the data, but not their share. Links without ``moves`` are taken.
    """
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b, n, *moves in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        if n < least or (moves and n < least_share * moves[0]):
            continue
        ra, rb = find(a), find(b)
        if ra == rb:
            continue
        if (used.get(ra, 0), rb) < (used.get(rb, 0), ra):
            ra, rb = rb, ra
        root[rb] = ra
    return {x: find(x) for x in {*used, *(k for a, b, *_ in links for k in (a, b))}}


def zones_of(top: object) -> list[tuple[str, int, dict[str, str]]]:
    """``(kind, index, fields)`` of all zones of a body, wherever they stand.

    Plain fields of the body itself make a row of the kind "". A zone given as an
    array has its positions as names, a plain item among zones the name "value".
    """
    out: list[tuple[str, int, dict[str, str]]] = []
    inner = lambda x: isinstance(x, dict) or (isinstance(x, list) and any(isinstance(y, dict | list) for y in x))

    def zone(kind: str, i: int, item: object) -> None:
        if isinstance(item, list) and not inner(item):
            item = {str(n): y for n, y in enumerate(item)}
        if isinstance(item, list):
            for n, y in enumerate(item):
                zone(kind, n, y)
            return
        if not isinstance(item, dict):
            if item is not None:
                out.append((kind, i, {"value": str(item)}))
            return
        # A size nested one level deeper belongs to the zone, unless its names are taken.
        flat = {k: x for k, x in item.items() if kind and isinstance(x, dict) and not any(isinstance(y, dict | list) for y in x.values())}
        taken = Counter([k for k, x in item.items() if not inner(x)] + [n for x in flat.values() for n in x])
        fields, below = {}, []
        for k, x in item.items():
            if k in flat and all(taken[n] == 1 for n in x):
                fields |= {n: str(y) for n, y in x.items() if y is not None}
            elif inner(x):
                below.append((k, x))
            elif x is not None and (kind or x != []):
                fields[k] = str(x)
        if fields or (kind and not below):
            out.append((kind, i, fields))
        for k, x in below:
            for n, y in enumerate(x if isinstance(x, list) else [x]):
                zone(k, n, y)

    zone("", 0, top)
    return out


def unified_zones(
    df: DataFrame, set_id: str = "zone_set", version: str = "version_no", body: str = "body", least: int = 2,
    prefer_similar: float = 0.8, most_links: int = 20_000,
) -> DataFrame:
    """All zones of all versions as one table with the columns of their classes.

    Zones are read wherever they stand; the plain fields of a body itself are in
    ``extra`` of a row of its own whose ``zone_kind`` is empty.

    ``(zone_set, version_no, zone_kind, zone_idx, x, y, width, height, extra)``;
    sizes nested one level deeper count for the zone, numbers given as text
    ("689px") are read as numbers, other fields stay in the map ``extra``.
    Renames that equal values don't settle are matched by ``prefer_similar``;
    more than ``most_links`` pairs of renamed names are refused.
    Bodies that are no valid JSON are no versions; an empty table gives none.
    """
    bodies = cut(_bodies(df, set_id, version, body))
    changes = cut(_neighbours(bodies, prefer_similar))

    def zones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, v, b in zip(pdf["set_id"], pdf["version_no"], pdf["body"], strict=True):
                out += [(s, v, *z) for z in zones_of(parse_as_written(b))]
            yield pd.DataFrame(out, columns=["set_id", "version_no", "zone_kind", "zone_idx", "fields"])

    flat = cut(bodies.mapInPandas(zones, ZONES))
    # Of the data's key names only those that were renamed come to the driver.
    links = [tuple(r) for r in rename_classes(changes, least).select("a", "b", "n", "moves").limit(most_links + 1).collect()]
    if len(links) > most_links:
        raise ValueError(f"more than {most_links} pairs of renamed keys are no schema")
    linked = sorted({k for a, b, *_ in links for k in (a, b)})
    keys = F.array_append(F.map_keys("fields"), F.col("zone_kind"))
    used = flat.select(F.explode(keys).alias("k")).filter(F.col("k").isin(linked)).groupBy("k").count()
    names = unified_names(links, {r["k"]: r["count"] for r in used.collect()}, least)
    pairs = [F.lit(x) for kv in sorted(names.items()) for x in kv] or [F.lit(""), F.lit("")]
    unify = F.create_map(*pairs)
    fields = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(F.map_keys("fields"), lambda k: F.coalesce(unify[k], k))),
            lambda u: F.struct(
                u.alias("key"),
                F.element_at(
                    F.filter(F.map_entries("fields"), lambda e: F.coalesce(unify[e["key"]], e["key"]) == u), 1
                )["value"].alias("value"),
            ),
        )
    )
    number = lambda k: F.regexp_extract(F.try_element_at("f", F.lit(k)), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    main = [names.get(k, k) for k in ("x", "y", "width", "height")]
    return flat.withColumn("f", fields).select(
        F.col("set_id").alias(set_id),
        F.col("version_no").alias(version),
        F.coalesce(unify[F.col("zone_kind")], F.col("zone_kind")).alias("zone_kind"),
        "zone_idx",
        *[number(u).alias(k) for k, u in zip(("x", "y", "width", "height"), main, strict=True)],
        F.map_filter("f", lambda k, _: ~k.isin(*main)).alias("extra"),
    )
