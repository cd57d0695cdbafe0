"""Deeply nested records to related flat tables.

1. **Triples.** Each record is read as a stream of (path, ordinals, value): the
   path holds the keys from the top and a mark for every array passed, the
   ordinals are the positions in those arrays. The text is read token by token;
   no tree of it is built.
2. **Repeated ancestors.** The record's paths are grouped by the ancestors that
   repeat: arrays, and objects whose members are alike (their own members share
   a key), which are arrays by name. A name on the caller's list marks its path
   as repeated even where the record holds a single element.
3. **Pivot.** Every element of a group becomes one row of its table, its leaves
   the fields, linked to the element around it. A record sits in one input row,
   so all this happens where it is read: no triple is shuffled.

Text that itself holds a JSON document (a template saved as a string inside
another) is read as part of the record. Columns that are nested by type have
their paths in the schema; their repeated ancestors are found there and
exploded without any text (:func:`flat_tables`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formflow.session import spread

KEYS = "record_id string, child_kind string, parent_kind string, parent_key string, child_key string"
ELEMENTS = f"{KEYS}, fields map<string,string>"
#: Template definitions: names of repeated ancestors, the kind of their elements, the field that is an element's key.
TEMPLATE_KINDS = {"columns": ("column", "index"), "products": ("product", "row"), "cells": ("cell", "name")}

#: A record nested more deeply is read as no valid JSON, as parsers with a recursion limit do.
MOST_DEEP = 1000
#: Stands in a path for the elements of an array.
EACH = None
_GAP = r"[ \t\n\r]*"
_TEXT = r'"([^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*)"'
_VALUE = re.compile(
    _GAP + "(?:" + _TEXT + r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)"
    rf"|(\{{{_GAP}\}})|(\[{_GAP}\])|(\{{)|(\[))"
)
_KEY = re.compile(_GAP + _TEXT + _GAP + ":")
_NEXT = re.compile(_GAP + "(?:," + _GAP + _TEXT + _GAP + r":|([,}\]]))")
_END = re.compile(_GAP + r"\Z")
# A plain value in a container with what follows it: the most frequent case in one match.
_LEAF = re.compile(
    _GAP + "(?:" + _TEXT + r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))"
    + _GAP + "(?:," + _GAP + _TEXT + _GAP + r":|([,}\]]))"
)
_LITERALS = {"true": True, "false": False, "null": None}

Triple = tuple[tuple, tuple[int, ...], object]


class RepeatedKey(Exception):
    """An object names a key twice; the last value counts, which a stream can't know."""


def _plain(raw: str) -> str:
    return json.loads(f'"{raw}"') if "\\" in raw else raw


def stream(text: str, path: tuple = (), at: tuple[int, ...] = ()) -> Iterator[Triple]:
    """The triples of a JSON text in document order; ValueError where it ends to be valid.

    Nulls and empty objects and arrays are leaves too, so positions are kept.
    """
    keys, spots = list(path), list(at)
    frames: list[set | None] = []  # open containers: the keys seen of an object, nothing of an array
    pos = 0

    def key() -> int:
        m = _KEY.match(text, pos)
        if m is None:
            raise ValueError(f"no key at {pos}")
        name = _plain(m[1])
        if name in frames[-1]:
            raise RepeatedKey(name)
        frames[-1].add(name)
        keys.append(name)
        return m.end()

    leaf, value_at, next_at = _LEAF.match, _VALUE.match, _NEXT.match
    while True:
        m = leaf(text, pos) if frames else None
        if m is not None:
            raw, number, word, name, mark = m.groups()
            if raw is not None:
                if "\\" in raw or raw.lstrip()[:1] in ("{", "["):
                    yield from embedded(_plain(raw), tuple(keys), tuple(spots))
                else:
                    yield tuple(keys), tuple(spots), raw
            elif number is not None:
                yield tuple(keys), tuple(spots), int(number) if number.lstrip("-").isdigit() else float(number)
            else:
                yield tuple(keys), tuple(spots), _LITERALS[word]
            pos = m.end()
        else:
            m = value_at(text, pos)
            if m is None:
                raise ValueError(f"no value at {pos}")
            pos, kind = m.end(), m.lastindex
            if kind > 5:
                if len(frames) == MOST_DEEP:
                    raise ValueError("nested too deeply")
                frames.append(set() if kind == 6 else None)
                if kind == 6:
                    pos = key()
                else:
                    keys.append(EACH)
                    spots.append(0)
                continue
            if kind == 1:
                yield from embedded(_plain(m[1]), tuple(keys), tuple(spots))
            elif kind == 2:
                yield tuple(keys), tuple(spots), int(m[2]) if m[2].lstrip("-").isdigit() else float(m[2])
            else:
                yield tuple(keys), tuple(spots), _LITERALS[m[3]] if kind == 3 else {} if kind == 4 else []
            name = mark = None
        while True:
            if name is None and mark is None:
                if not frames:
                    if _END.match(text, pos) is None:
                        raise ValueError(f"more text at {pos}")
                    return
                m = next_at(text, pos)
                if m is None:
                    raise ValueError(f"no end of a value at {pos}")
                pos, name, mark = m.end(), m[1], m[2]
            seen = frames[-1]
            if mark is None:  # a comma and the next key
                if seen is None:
                    raise ValueError(f"key in an array at {pos}")
                name = _plain(name)
                if name in seen:
                    raise RepeatedKey(name)
                seen.add(name)
                keys[-1] = name
                break
            if mark == ",":
                if seen is not None:
                    raise ValueError(f"no key at {pos}")
                spots[-1] += 1
                break
            if (seen is None) != (mark == "]"):
                raise ValueError(f"wrong bracket at {pos}")
            frames.pop()
            keys.pop()
            if seen is None:
                spots.pop()
            name = mark = None


def embedded(value: str, path: tuple, at: tuple[int, ...]) -> list[Triple]:
    """The triples of a document inside a text, or the text as a leaf."""
    if value.lstrip()[:1] in ("{", "["):
        try:
            return list(stream(value, path, at))
        except (ValueError, RecursionError):
            pass
    return [(path, at, value)]


def walk(value, path: tuple = (), at: tuple[int, ...] = ()) -> Iterator[Triple]:
    """The triples of a value that was read already."""
    stack = [(path, at, value)]
    while stack:
        path, at, node = stack.pop()
        if isinstance(node, dict) and node:
            stack.extend(((*path, k), at, node[k]) for k in reversed(node))
        elif isinstance(node, list) and node:
            stack.extend(((*path, EACH), (*at, i), node[i]) for i in range(len(node) - 1, -1, -1))
        elif isinstance(node, str) and node.lstrip()[:1] in ("{", "["):
            try:
                stack.append((path, at, read_json(node)))
            except ValueError:
                yield path, at, node
        else:
            yield path, at, node


def _no_constant(text: str):
    raise ValueError(text)


def read_json(text: str):
    """The parsed value, or ValueError where the text is no valid JSON."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def record_triples(text: str | None) -> list[Triple]:
    """The triples of a record; ValueError where it is null or no valid JSON."""
    if text is None:
        raise ValueError("null")
    try:
        return list(stream(text))
    except RepeatedKey:
        return list(walk(read_json(text)))


def text_of(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value) if isinstance(value, dict | list) else str(value)


def flatten_records(df: DataFrame, record_id: str, body: str) -> DataFrame:
    """Path-value-ordinal triples ``(record_id, path, ordinals, value)``.

    ``path`` is the keys joined by dots. Bodies that are no valid JSON yield
    nothing; a null value keeps its place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, text in zip(pdf["record_id"], pdf["body"], strict=True):
                try:
                    found = record_triples(text)
                except ValueError:
                    continue
                rows = [(rid, ".".join(k for k in p if k is not EACH), list(at), text_of(v)) for p, at, v in found]
                yield pd.DataFrame(rows, columns=["record_id", "path", "ordinals", "value"])

    return df.select(F.col(record_id).alias("record_id"), F.col(body).alias("body")).mapInPandas(
        run, "record_id string, path string, ordinals array<int>, value string"
    )


def _is_empty(value) -> bool:
    return isinstance(value, dict | list)


class Groups:
    """The repeated ancestors of one record, found from its triples.

    ``kinds`` maps names of repeated ancestors to (kind of the elements, field
    that is their key); only these groups are kept and such a name counts as
    repeated with a single element too. Without it every group is kept.
    """

    def __init__(self, rows: list[Triple], kinds: dict[str, tuple[str, str]] | None) -> None:
        self.kinds = kinds
        shapes: dict[tuple, int] = {}
        for path, _, value in rows:
            if shapes.get(path, -1) < 2:
                rank = 0 if value is None else 1 if _is_empty(value) else 2
                if shapes.get(path, -1) < rank:
                    shapes[path] = rank
        members: dict[tuple, dict[str, list]] = {}
        for path, rank in shapes.items():
            for i, key in enumerate(path):
                if key is EACH:
                    continue
                j = i + 1
                while j < len(path) and path[j] is EACH:
                    j += 1
                # what the member holds: keys of its elements, whether a container, whether a plain value
                held = members.setdefault(path[:i], {}).setdefault(key, [set(), False, False])
                if j < len(path):
                    held[0].add(path[j])
                held[1] |= j > i + 1 or j < len(path) or rank == 1
                held[2] |= j == i + 1 == len(path) and rank == 2
        #: Objects that hold their elements by name.
        self.by_name = {p for p, held in members.items() if self._alike(p, held)}
        plain = {p for p, rank in shapes.items() if rank == 2 and p and p[-1] is not EACH and p[:-1] in self.by_name}
        #: Instances of such paths that hold plain values are one element themselves.
        self.single = {
            (path[:-1], at) for path, at, value in rows if path in plain and value is not None and not _is_empty(value)
        } if plain else set()
        self.plans: dict[tuple, tuple] = {}
        self.prefixes: dict[tuple, int] = {}

    def named(self, path: tuple) -> bool:
        return self.kinds is None or (len(path) > 0 and path[-1] in self.kinds)

    def _alike(self, path: tuple, held: dict[str, list]) -> bool:
        if (path and path[-1] is EACH) or not self.named(path):
            return False
        containers = [keys for keys, container, _ in held.values() if container]
        keyed = [keys for keys in containers if keys]
        if len(containers) < (2 if self.kinds is None else 1):
            return False
        return bool(set.intersection(*keyed)) if keyed else self.kinds is not None

    def plan(self, path: tuple, at: tuple[int, ...]) -> tuple:
        """``(number of the element's path, length of it, of its ordinals, name of the group, name of the element)``
        of every element around a leaf, from the outside in; and the name of the leaf, if it passes no array."""
        if not self.single and path in self.plans:
            return self.plans[path]
        number = self.prefixes.setdefault
        chain = tuple((number(path[:n], len(self.prefixes)), n, *rest) for n, *rest in self._elements(path, at))
        below = path[chain[-1][1] :] if chain else ()
        plan = self.plans[path] = chain, None if EACH in below else ".".join(below) or "@"
        return plan

    def _elements(self, path: tuple, at: tuple[int, ...]):
        n, taken, passed = len(path), -1, 0
        for e in range(n):
            if e and path[e - 1] is EACH:
                passed += 1
                continue
            here = path[:e]
            if e == taken or not self.named(here):
                continue
            group = here[-1] if here else ""
            j = e
            if path[e] is EACH:
                while j < n and path[j] is EACH:
                    j += 1
                yield j, passed + j - e, group, None
            elif here in self.by_name and (here, at[:passed]) not in self.single:
                j = taken = e + 1
                while j < n and path[j] is EACH:
                    j += 1
                yield j, passed + j - taken, group, path[e] if j == taken else None
            elif self.kinds is not None:
                yield e, passed, group, None


def pivoted(
    rows: list[Triple], kinds: dict[str, tuple[str, str]] | None = None, keys_only: bool = False
) -> list[tuple]:
    """Elements ``(kind, parent kind, parent key, own key, fields)`` of a record's triples.

    An element's key is its key field, else its name; without ``kinds`` its name
    or position. ``fields`` are the leaves by path below the element, groups
    inside it left out; the leaf of a plain element is named ``@``; with
    ``keys_only`` only key fields are kept. Null elements are no elements but
    keep their position.
    """
    groups = Groups(rows, kinds)
    found: dict[tuple, list] = {}
    get, plan = found.get, groups.plan
    wanted = {key for _, key in kinds.values()} if keys_only and kinds else None
    for path, at, value in rows:
        chain, field = plan(path, at)
        if not chain:
            continue
        number, n, m, _, name = chain[-1]
        # A null, or an array without elements, is no element of its own; nor is an object of nulls one by its name alone.
        if (value is None or value == []) and (n == len(path) or (value is None and name is None and path[n - 1] is not EACH)):
            chain, value = chain[:-1], None
            if not chain:
                continue
            number, n, m, _, name = chain[-1]
        element = get((number, at[:m]))
        if element is None:
            for number, n, m, group, name in chain:
                outer, element = element, get((number, at[:m]))
                if element is None:
                    element = found[number, at[:m]] = [group, outer, name, at[m - 1] if m else 0, {}]
        if value is None or _is_empty(value):
            continue
        if field is None:
            if wanted is not None:
                continue
            spots = iter(at[m:])
            field = ".".join(str(next(spots)) if k is EACH else k for k in path[n:])
        if wanted is None or field in wanted:
            element[4][field] = text_of(value)

    def kind_of(e: list) -> str:
        return e[0] if kinds is None else kinds[e[0]][0]

    def key_of(e: list) -> str | None:
        if kinds is None:
            return e[2] if e[2] is not None else str(e[3])
        return e[4].get(kinds[e[0]][1], e[2])

    return [
        (kind_of(e), kind_of(e[1]) if e[1] else "", key_of(e[1]) if e[1] else "", key_of(e), e[4]) for e in found.values()
    ]


def element_tables(
    df: DataFrame, record_id: str, body: str, kinds: dict[str, tuple[str, str]] | None = None, keys_only: bool = False
) -> DataFrame:
    """One row per element of every group, linked to its parent element.

    Columns ``record_id, child_kind, parent_kind, parent_key, child_key,
    fields``. Records whose body is null or no valid JSON, and null ids, give
    no rows; repeated records give repeated rows. ``kinds`` as in
    :class:`Groups`; other columns aren't read. ``keys_only``: without ``fields``.
    """
    columns = ["record_id", "child_kind", "parent_kind", "parent_key", "child_key"] + ([] if keys_only else ["fields"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, text in zip(pdf["record_id"], pdf["body"], strict=True):
                try:
                    found = record_triples(text)
                except ValueError:
                    continue
                rows += [(rid, *e[: len(columns) - 1]) for e in pivoted(found, kinds, keys_only)]
            yield pd.DataFrame(rows, columns=columns)

    rows = df.select(F.col(record_id).cast("string").alias("record_id"), F.col(body).alias("body"))
    return spread(rows.filter(F.col("record_id").isNotNull() & F.col("body").isNotNull())).mapInPandas(
        run, KEYS if keys_only else ELEMENTS
    )


def template_children(df: DataFrame, record_id: str = "definition_id", body: str = "body") -> DataFrame:
    """Columns, products and cells of template definitions, with parent keys.

    ``(record_id, child_kind, parent_key, child_key)``, distinct. Only cells
    have a parent key (their product's row). Elements without a key are left
    out.
    """
    return (
        element_tables(df, record_id, body, TEMPLATE_KINDS, keys_only=True)
        .select(
            "record_id",
            "child_kind",
            F.when(F.col("child_kind") == "cell", F.coalesce("parent_key", F.lit(""))).otherwise("").alias("parent_key"),
            "child_key",
        )
        .filter(F.col("child_key").isNotNull())
        .distinct()
    )


def repeated_columns(schema: T.StructType) -> dict[str, T.DataType]:
    """Path -> element type of the repeated ancestors of a schema, outer ones first.

    Arrays directly in arrays belong to one ancestor; keys are joined by dots.
    """
    found: dict[str, T.DataType] = {}

    def visit(path: str, kind: T.DataType) -> None:
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            while isinstance(inner, T.ArrayType):
                inner = inner.elementType
            found[path] = inner
            kind = inner
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                visit(f"{path}.{f.name}" if path else f.name, f.dataType)

    visit("", schema)
    return found


def flat_tables(df: DataFrame, record_id: str, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """One table per repeated ancestor of the schema, by its path.

    ``record_id``, ``position_0`` ... (positions in all arrays passed, the
    parent's first: the link to its table), and the plain leaves of an element,
    nested names joined by an underscore (``value`` for plain elements). Null
    elements give no row but keep their position; null or empty arrays and null
    ids give none; null parts stay null; repeated records give repeated rows.
    ``columns``: those read, else all.
    """
    schema = T.StructType([f for f in df.schema.fields if columns is None or f.name in columns])
    ancestors = repeated_columns(schema)
    tables = {}
    for path, kind in ancestors.items():
        rows = df.filter(F.col(record_id).isNotNull()).select(F.col(record_id).cast("string").alias("record_id"), path.split(".")[0])
        at, done, element = [], "", None
        keys = path.split(".")
        for i, key in enumerate(keys):
            done = f"{done}.{key}" if done else key
            element = F.col(f"`{key}`") if i == 0 else element[key]
            if done not in ancestors:
                continue
            depth = _depth(schema, done)
            for _ in range(depth):
                spot = f"position_{len(at)}"
                rows = rows.select("record_id", *at, F.posexplode(element).alias(spot, "_e")).filter(F.col("_e").isNotNull())
                at.append(spot)
                element = F.col("_e")
        leaves = _leaves(kind) if isinstance(kind, T.StructType) else []
        picked = [_at(F.col("_e"), p).alias("_".join(p)) for p in leaves] if leaves else [F.col("_e").alias("value")]
        tables[path] = rows.select("record_id", *at, *picked)
    return tables


def _depth(schema: T.DataType, path: str) -> int:
    """Arrays in arrays at a repeated ancestor."""
    kind = schema
    for key in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        kind = kind[key].dataType
    n = 0
    while isinstance(kind, T.ArrayType):
        n, kind = n + 1, kind.elementType
    return n


def _leaves(kind: T.StructType) -> list[tuple[str, ...]]:
    out = []
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            out += [(f.name, *p) for p in _leaves(f.dataType)]
        elif not isinstance(f.dataType, T.ArrayType):
            out.append((f.name,))
    return out


def _at(element, path: tuple[str, ...]):
    for key in path:
        element = element[key]
    return element


def text_blocks(df: DataFrame, record_id: str = "page_id", blocks: str = "text_blocks") -> DataFrame:
    """One row per block of an OCR page, keyed by its position from 0.

    ``(record_id, block_idx, text, confidence, x, y, width, height)``, distinct;
    rows as in :func:`flat_tables`.
    """
    rows = flat_tables(df, record_id, [blocks])[blocks]
    sizes = [F.col(f"bounds_{c}").alias(c) for c in ("x", "y", "width", "height")]
    return rows.select("record_id", F.col("position_0").alias("block_idx"), "text", "confidence", *sizes).distinct()


def block_children(df: DataFrame, record_id: str = "page_id", blocks: str = "text_blocks") -> DataFrame:
    """The blocks of :func:`text_blocks` in the columns of :func:`template_children`."""
    rows = flat_tables(df, record_id, [blocks])[blocks]
    return rows.select(
        "record_id", F.lit("block").alias("child_kind"), F.lit("").alias("parent_key"), F.col("position_0").cast("string").alias("child_key")
    ).distinct()
