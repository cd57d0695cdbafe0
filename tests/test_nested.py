import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formflow.operators import nested

SCHEMA = "definition_id string, body string, record_id string, fields int"


def children(spark, *bodies):
    rows = [(f"d{i}", b if b is None or isinstance(b, str) else json.dumps(b), "x", 1) for i, b in enumerate(bodies)]
    out = nested.template_children(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r.child_kind, r.parent_key, r.child_key) for r in out)


CELL = {"x": 1, "y": 2, "width": 3, "height": 4}
PRODUCT = {"row": 4, "product_number": "", "product_number_cell": CELL, "cells": {"Mo": CELL, "Di": CELL, "Zus": None}}
COLUMNS = {
    "product_number": {"index": 0}, "product_name": {"index": 1},
    "input_columns": [{"index": 2, "name": "Mo"}, None, {"index": 3, "name": "Di"}],
}
WANT = [("cell", "4", "Di"), ("cell", "4", "Mo"), ("product", "", "4")]


@pytest.mark.parametrize(
    "body",
    [
        {"products": [PRODUCT]},
        {"products": [None, PRODUCT]},
        {"products": [[PRODUCT], []]},
        {"products": PRODUCT},
        {"products": {"4": {k: v for k, v in PRODUCT.items() if k != "row"}}},
        {"products": json.dumps([PRODUCT])},
        {"definition": {"products": [PRODUCT]}},
        {"payload": {"items": [{"products": [PRODUCT]}]}},
        {"products": [{**PRODUCT, "row": "4", "cells": [{"name": "Mo", **CELL}, None, {"name": "Di", "rect": CELL}]}]},
    ],
)
def test_products_wherever_they_stand(spark, body):
    assert children(spark, body) == WANT


def test_columns(spark):
    want = [("column", "", str(i)) for i in range(4)]
    assert children(spark, {"columns": COLUMNS}) == want
    flat = [{"index": 0}, {"index": 1}, {"index": 2, "name": "Mo"}, {"index": 3, "name": "Di"}]
    assert children(spark, {"definition": {"columns": flat}}) == want


def test_nothing_to_report(spark):
    assert children(spark, None, "", "{", "[]", "null", "NaN", {"products": None, "columns": {}}, {"products": [{"cells": None}]}) == []
    assert children(spark, "[" * 100_000) == []
    deep = {"products": [PRODUCT]}
    for _ in range(200):
        deep = {"a": [deep]}
    assert children(spark, deep) == WANT
    assert nested.template_children(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_records_count_once(spark):
    assert children(spark, {"products": [PRODUCT]}, {"products": [PRODUCT]}) == sorted(WANT * 2)  # two ids
    rows = [("same", json.dumps({"products": [PRODUCT]}), "", 0)] * 3
    assert nested.template_children(spark.createDataFrame(rows, SCHEMA)).count() == 3


E = nested.EACH


def test_triples_round_trip():
    value = {"a": [{"b": 1, "c": None}, {"b": "x"}], "d": {"e": [[1, 2], []]}}
    want = [
        (("a", E, "b"), (0,), 1), (("a", E, "c"), (0,), None), (("a", E, "b"), (1,), "x"),
        (("d", "e", E, E), (0, 0), 1), (("d", "e", E, E), (0, 1), 2), (("d", "e", E), (1,), []),
    ]
    assert list(nested.stream(json.dumps(value))) == want == list(nested.walk(value))


@given(
    st.recursive(
        st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(),
        lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3),
        max_leaves=12,
    ),
    st.booleans(),
    st.sampled_from([None, 1]),
)
@settings(max_examples=200, deadline=None)
def test_stream_reads_what_a_parser_reads(value, ascii, indent):
    text = json.dumps(value, ensure_ascii=ascii, indent=indent)
    assert nested.record_triples(text) == list(nested.walk(json.loads(text)))


@given(st.text(alphabet='{}[],:"\\a1-.e \n\tnulltrue', max_size=12))
@settings(max_examples=500, deadline=None)
def test_stream_refuses_what_a_parser_refuses(text):
    def tried(f):
        try:
            return f(text)
        except ValueError:
            return "no JSON"

    assert tried(nested.record_triples) == tried(lambda t: list(nested.walk(nested.read_json(t))))


def test_repeated_keys_count_by_the_last():
    assert nested.record_triples('{"a": 1, "b": 2, "a": {"c": 3}}') == [(("a", "c"), (), 3), (("b",), (), 2)]


def test_groups_of_unknown_names():
    """Arrays and objects of like members repeat, whatever their names."""
    body = {"crates": {"left": {"jars": [{"g": 1}, None, {"g": 2}]}, "right": {"jars": []}}, "size": {"w": 1, "h": {"cm": 2}}}
    got = sorted((k, up, parent, own, tuple(f.items())) for k, up, parent, own, f in nested.pivoted(list(nested.walk(body))))
    assert got == [
        ("crates", "", "", "left", ()), ("crates", "", "", "right", ()),
        ("jars", "crates", "left", "0", (("g", "1"),)), ("jars", "crates", "left", "2", (("g", "2"),)),
    ]


def test_every_element_comes_from_triples(spark, monkeypatch):
    """Without the triple reader there is no element."""
    assert children(spark, {"products": [PRODUCT]}) == WANT
    seen = []
    real = nested.stream
    monkeypatch.setattr(nested, "stream", lambda *a: seen.append(a) or real(*a))
    body = json.dumps({"products": [PRODUCT], "columns": COLUMNS})
    rows = nested.pivoted(nested.record_triples(body), nested.TEMPLATE_KINDS)
    assert len(seen) == 1 and len(rows) == 7
    assert nested.pivoted([], nested.TEMPLATE_KINDS) == []


def test_flat_tables_of_typed_columns(spark):
    kind = "array<struct<t:string,box:struct<x:int,y:int>,marks:array<array<int>>>>"
    rows = [("p", [("a", (1, None), [[7], None, [8, 9]]), None, (None, None, [])]), ("q", None), (None, [("z", None, None)])]
    tables = nested.flat_tables(spark.createDataFrame(rows, f"id string, blocks {kind}"), "id")
    assert list(tables) == ["blocks", "blocks.marks"]
    assert sorted(map(tuple, tables["blocks"].collect()), key=str) == [("p", 0, "a", 1, None), ("p", 2, None, None, None)]
    assert sorted(map(tuple, tables["blocks.marks"].collect())) == [("p", 0, 0, 0, 7), ("p", 0, 2, 0, 8), ("p", 0, 2, 1, 9)]


def test_triple_table(spark):
    rows = [("d", json.dumps({"a": [1, True, 1.5]}), "", 0), ("e", "{", "", 0), (None, "1", "", 0)]
    got = nested.flatten_records(spark.createDataFrame(rows, SCHEMA), "definition_id", "body").collect()
    assert [(r.record_id, r.path, r.ordinals, r.value) for r in got] == [
        ("d", "a", [0], "1"), ("d", "a", [1], "true"), ("d", "a", [2], "1.5"), (None, "", [], "1"),
    ]


def test_blocks(spark):
    block = "struct<text:string,confidence:double,bounds:struct<x:int,y:int,width:int,height:int>,bbox:array<array<int>>>"
    b = ("t", 0.5, (1, 2, 3, 4), [[1, 2]])
    rows = [("p", [b, None, (None, None, None, None)]), ("p", [b, None, (None, None, None, None)]), ("q", None), ("r", []), (None, [b])]
    df = spark.createDataFrame(rows, f"page_id string, text_blocks array<{block}>")
    assert sorted((r.record_id, r.child_key) for r in nested.block_children(df).collect()) == [("p", "0"), ("p", "2")]
    flat = {r.block_idx: r for r in nested.text_blocks(df).collect()}
    assert flat[0].width == 3 and flat[2].text is None and flat[2].x is None and len(flat) == 2
