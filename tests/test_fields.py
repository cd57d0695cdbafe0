from pyspark.sql import functions as F

from formflow.functions import geometry as G
from formflow.operators import layout, matching, quality, scan


def test_fill_empty(spark):
    rows = spark.createDataFrame([(1, "a", "kept", "x"), (2, "a", "", "x"), (3, "b", None, "x"), (4, None, None, "x")], "id int, code string, name string, text string")
    read = spark.createDataFrame([("a", "z"), ("a", "read"), ("a", None), ("b", "")], "code string, text string")
    got = {r.id: (r["name"], r.filled) for r in scan.fill_empty(rows, read, "name", ["code"]).collect()}
    assert got == {1: ("kept", False), 2: ("read", True), 3: (None, False), 4: (None, False)}
    assert scan.fill_empty(rows.limit(0), read, "name", ["code"]).count() == 0


def test_alignment(spark):
    rows = [(2480, 3508, 2480, 3508), (2430, 3508, 2480, 3508), (2429, 3508, 2480, 3508), (2480, 3559, 2480, 3508), (10, 10, None, None)]
    df = spark.createDataFrame(rows, "w int, h int, tw int, th int")
    a = df.select(G.aligned(*map(F.col, ("w", "h", "tw", "th"))).alias("a")).select("a.*").collect()
    assert [tuple(r) for r in a] == [(2480, 3508, 1.0), (2430, 3508, 1.0), (2480, 3508, 1.0), (2480, 3508, 1.0), (10, 10, 1.0)]


def test_pages_without_layout(spark):
    pages = spark.createDataFrame([("p",), ("q",), (None,)], "page_id string")
    summary = spark.createDataFrame([("p", 3)], "page_id string, lines bigint")
    got = sorted(map(tuple, layout.with_layout(pages, summary).collect()), key=str)
    assert got == [("p", 3, True), ("q", 0, False), (None, 0, False)]


def test_registry_and_labels(spark):
    forms = spark.createDataFrame([("A", 2), ("A", 1), ("B", None)], "form_type string, id int")
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None)], "k int, form_type string")
    assert {r.k: r.id for r in matching.registered(rows, forms, "form_type", "id").collect()} == {1: 1, 2: None, 3: None, 4: None}
    assert [r.form_type for r in quality.labels(forms.limit(0), "form_type").collect()] == []
    assert sorted(r.form_type for r in quality.labels(rows, "form_type").collect()) == ["A", "B", "C"]
