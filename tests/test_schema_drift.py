import itertools
import random
import json

from pyspark.sql import functions as F

from formflow.operators import schema_drift
from formflow.operators.schema_drift import assignment, compare, parse_as_written, profile, schema_changes, unified_names, unified_zones

SCHEMA = "zone_set string, version_no int, body string, file_id bigint, set_id string"


def changes(a, b, **kw):
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    return sorted(compare(profile(parse_as_written(text(a))), profile(parse_as_written(text(b))), **kw))


def test_kinds():
    assert changes({"a": 1}, {"a": 1}) == []
    assert changes({"a": 1}, {"b": 1}) == [("renamed", "b", "a")]
    assert changes({"a": 1}, {"b": 2}) == [("added", "b", ""), ("removed", "a", "")]
    assert changes({"a": 1}, {"a": "1"}) == [("retyped", "a", "")]
    assert changes('{"a": 1}', '{"a": 1.0}') == [("retyped", "a", "")]
    assert changes('{"a": 1.0}', '{"b": 1.00}') == [("added", "b", ""), ("removed", "a", "")]
    assert changes({"a": 1, "b": None}, {"a": 1}) == []
    assert changes({"a": 1}, {"a": None}) == [("removed", "a", "")]


def test_renames_need_a_single_partner():
    assert changes({"a": 1, "b": 1}, {"c": 1}) == [("added", "c", ""), ("removed", "a", ""), ("removed", "b", "")]
    assert changes({"a": 1}, {"c": 1, "d": 1}) == [("added", "c", ""), ("added", "d", ""), ("removed", "a", "")]
    assert changes({"width": 1, "z": 1}, {"widths": 1, "q": 1}, prefer_similar=0.5) == [
        ("added", "q", ""), ("removed", "z", ""), ("renamed", "widths", "width"),
    ]


def test_arrays_and_nesting():
    a = {"zones": [{"x": 1, "y": 2}, {"x": 3}]}
    assert changes(a, {"zones": [{"left": 1, "y": 2}, {"left": 3}]}) == [("renamed", "zones.left", "zones.x")]
    assert changes(a, {"zones": [{"left": 3, "y": 2}, {"left": 1}]}) == [("added", "zones.left", ""), ("removed", "zones.x", "")]
    # A renamed parent hides what is below; a retyped one doesn't.
    assert changes(a, {"areas": a["zones"]}) == [("renamed", "areas", "zones")]
    assert changes({"z": [{"x": 1}]}, {"z": {"x": "1"}}) == [("retyped", "z", ""), ("retyped", "z.x", "")]
    assert changes({"z": {"x": 1, "y": {"k": 1}}}, {"z": {"x": 1}}) == [("removed", "z.y", "")]


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_versions(spark):
    body = lambda **kw: json.dumps(kw)
    data = [
        ("s", 5, body(c=1), 1, "x"), ("s", 1, body(a=1), 2, "x"), ("s", 2, body(b=1), 3, "x"), ("s", 2, '{ "b":1 }', 4, None),
        ("s", 3, "{broken", 5, None), ("s", 4, None, 6, None), (None, 1, body(a=1), 7, None), ("s", None, body(a=1), 8, None), ("t", 1, body(a=1), 9, None),
    ]
    got = sorted(tuple(r) for r in schema_changes(rows(spark, data)).collect())
    assert got == [("s", 2, "renamed", "b", "a"), ("s", 5, "renamed", "c", "b")]
    assert schema_changes(rows(spark, [])).count() == 0


def test_hot_set_over_many_tasks(spark):
    """One set holds all versions; every neighbouring pair must be found whatever the task borders."""
    data = [("hot", v, json.dumps({f"k{v % 2}": v, "same": 1}), v, "") for v in range(1, 400)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = schema_changes(rows(spark, data)).groupBy("version_no").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted(r[0] for r in got) == list(range(2, 400))
    assert {r[1] for r in got} == {2}


def test_unified_table(spark):
    first = {"orders": [{"x": 1, "y": 2, "width": 3, "height": 4}], "names": {"x": 5, "y": 6, "width": "7px", "height": 8}}
    second = {"zones": [{"left": 1, "y": 2, "width": 3, "height": 4}], "names": {"left": 5, "y": 6, "size": {"width": 7, "height": 8}}}
    middle = {"orders": [{"left": 1, "y": 2, "width": 3, "height": 4}], "names": {"left": 5, "y": 6, "width": "7px", "height": 8}}
    data = []
    for s in ("a", "b", "c"):
        data += [(s, 1, json.dumps(first), 1, ""), (s, 2, json.dumps(middle), 2, ""), (s, 3, json.dumps(second), 3, "")]
    got = unified_zones(rows(spark, data)).filter(F.col("zone_set") == "b").orderBy("version_no", "zone_kind").collect()
    assert [(r.version_no, r.zone_kind, r.x, r.y, r.width, r.height) for r in got] == [
        (v, k, *box) for v in (1, 2, 3) for k, box in (("names", (5, 6, 7, 8)), ("orders", (1, 2, 3, 4)))
    ]


def test_all_of_a_body_is_in_the_unified_table(spark):
    body = {
        "dpi": 300, "editor": "kim", "zones": [{"x": 1, "size": {"width": 3}}, [5, 6]],
        "page": {"header": {"x": 7, "y": 8}, "footer": {"x": 9, "y": 10}, "cells": [{"x": 11, "y": 12}]},
    }
    got = unified_zones(rows(spark, [("s", 1, json.dumps(body), 1, "")])).collect()
    assert sorted((r.zone_kind, r.zone_idx, r.x, r.y, r.width, tuple(sorted(r.extra.items()))) for r in got) == [
        ("", 0, None, None, None, (("dpi", "300"), ("editor", "kim"))), ("cells", 0, 11, 12, None, ()), ("footer", 0, 9, 10, None, ()),
        ("header", 0, 7, 8, None, ()), ("zones", 0, 1, None, 3, ()), ("zones", 1, None, None, None, (("0", "5"), ("1", "6"))),
    ]


def test_classes_keep_rare_links_apart():
    assert unified_names([("x", "y", 1)], {"x": 9, "y": 9}) == {"x": "x", "y": "y"}
    assert unified_names([("w", "width", 5), ("width", "zone_width", 3)], {"w": 1, "width": 9, "zone_width": 2}) == {
        "w": "width", "width": "width", "zone_width": "width",
    }


def test_chance_renames_link_no_classes():
    """Equal values by chance grow with the data; their share of a name's moves doesn't."""
    true, chance = ("w", "width", 400, 900), ("editor", "rotation", 30, 5000)
    got = unified_names([true, chance], {"w": 3, "width": 9, "editor": 5, "rotation": 4})
    assert got == {"w": "width", "width": "width", "editor": "editor", "rotation": "rotation"}


def test_assignment_is_the_best_matching():
    rng = random.Random(2)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        w = [[rng.choice([0.0, rng.random()]) for _ in range(m)] for _ in range(n)]
        found = assignment(w)
        assert len({j for j in found if j >= 0}) == sum(j >= 0 for j in found)
        best = max(sum(w[i][j] for i, j in enumerate(p) if j < m) for p in itertools.permutations(range(max(n, m)), n))
        assert abs(sum(w[i][j] for i, j in enumerate(found) if j >= 0) - best) < 1e-9
    assert assignment([]) == [] and assignment([[0.0]]) == [-1]


def test_matching_is_not_greedy():
    """The most similar pair alone would leave the other without a partner."""
    old, new = {"height": 1, "heigh": 1}, {"height_px": 1, "heights": 1}
    got = changes(old, new, prefer_similar=0.7)
    assert [kind for kind, _, _ in got] == ["renamed", "renamed"]


def test_values_that_changed_a_little():
    old = {"zones": [{"x": i} for i in range(100)]}
    new = {"zones": [{"xs": i + (i == 50)} for i in range(100)]}
    assert sorted(compare(profile(parse_as_written(json.dumps(old)), 16), profile(parse_as_written(json.dumps(new)), 16), 0.7)) == [("renamed", "zones.xs", "zones.x")]
    assert ("removed", "zones.x", "") in changes(old, new)


def test_renames_come_through_the_matching(monkeypatch):
    """Without ``prefer_similar`` too: names and values weigh the edges, the matching pairs them, the rule reports."""
    old = {"zones": [{"top": i, "left": i % 7, "edges": i % 3} for i in range(9)]}
    new = {"zones": [{"tops": i + (i == 5), "y": i} for i in range(9)]}
    read = lambda x: profile(parse_as_written(json.dumps(x)), schema_drift.SKETCH)
    solved = []
    monkeypatch.setattr(schema_drift, "assignment", lambda w: solved.append((w, assignment(w))) or solved[-1][1])
    want = [("added", "zones.tops", ""), ("removed", "zones.edges", ""), ("removed", "zones.left", ""), ("renamed", "zones.y", "zones.top")]
    assert sorted(compare(read(old), read(new))) == want
    (((edges, left, top), pairs),) = solved
    assert 0 < edges[0] < left[0] < 1 and top[1] >= 3  # equal values, though "tops" is the nearer name
    assert pairs == [-1, 0, 1]  # "left" is matched as well, but its values aren't those of "tops"
    monkeypatch.setattr(schema_drift, "assignment", lambda w: [-1] * len(w))
    assert not [c for c in compare(read(old), read(new)) if c[0] == "renamed"]


def test_renames_by_brute_force():
    """The rule of TESTDATA.md stated pair by pair, on fields that share values."""
    rng = random.Random(5)
    for _ in range(400):
        names = rng.sample(["x", "X", "left", "lefts", "top", "tops", "w", "width"], 8)
        n = rng.randrange(1, 4)
        make = lambda keys: {k: [rng.choice([1, 2, "2"]) for _ in range(n)] for k in keys}  # noqa: B023, E731
        old, new = make(names[: rng.randrange(1, 5)]), make(names[4 : rng.randrange(5, 9)])
        body = lambda cols: {"z": [{k: v[i] for k, v in cols.items()} for i in range(n)]}  # noqa: B023, E731
        pairs = [(p, q) for p in old for q in new if json.dumps(old[p]) == json.dumps(new[q])]
        want = {(p, q) for p, q in pairs if sum(p == a for a, _ in pairs) == 1 == sum(q == b for _, b in pairs)}
        for k in (0, schema_drift.SKETCH):
            read = lambda x: profile(parse_as_written(json.dumps(x)), k)  # noqa: B023, E731
            got = compare(read(body(old)), read(body(new)))
            assert {(p[2:], q[2:]) for kind, q, p in got if kind == "renamed"} == want
            assert len(got) == len(old) + len(new) - len(want)
