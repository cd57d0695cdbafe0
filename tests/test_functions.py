"""Column functions against plain statements of their rules."""

import math
import re

import pytest
from pyspark.sql import functions as F

from formflow.functions import geometry as G
from formflow.functions import text as T


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


FORMS = {
    "Bestellblatt 7": "Bestellblatt 7", "BESTELLBLATT a": "Bestellblatt a", "Bestell blatt 2": "Bestellblatt 2",
    "Beste ulatt 3": "Bestellblatt 3", "Formular B": "Formular B", "formular b": "Formular b", "FORMULAR B": "FORMULAR B",
    "x" * 49: "x" * 49, "x" * 50: "unknown", "": "unknown", "  \n": "unknown", "\n erste Zeile \nzweite": "erste Zeile", None: "unknown",
}


def test_form_type(spark):
    assert dict(zip(FORMS, column(spark, list(FORMS), T.form_type), strict=True)) == FORMS


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (T.quantity, {"3": "3", "5 x": "5", "a7b9": "7", "abc": "abc", "  ": "", " a \n b ": "a b", None: ""}),
        (T.product_name, {"[ abc": "abc", "][ abc": "[ abc", "[] abc": "abc", "abc": "abc", None: None}),
        (T.without_code, {"12-3 abc": "abc", "abc": "abc", "12": ""}),
        (T.product_code, {"(210-212)": "(210-212)", "No. 31": "31", "1 - 12": "1-12", "": ""}),
        (T.digits, {"No. 31": "31", "x٣7": "٣7", "²": ""}),
        (T.leading_code, {"30 Abc": "30", "1-12 - Abc": "1-12", "1234 Abc": "123", "Abc": ""}),
        (T.after_code, {"30 Abc": "Abc", "1-12 - Abc": "Abc", "1234 Abc": "4 Abc", "Abc": "Abc", "12": ""}),
        (T.collapse_spaces, {" a \t b\n": "a b", "": "", None: None}),
        (T.safe_filename, {"a b/ü(1).pdf": "a_b_ü_1_.pdf"}),
        (T.stem, {"a/b.c/x.y.eml": "x.y", "x": "x", ".hidden": ".hidden", "a/": ""}),
        (T.loose_key, {"X 1": "X1", "X-1": "X1", "X1": "X1"}),
    ],
)
def test_cleaning(spark, make, cases):
    assert dict(zip(cases, column(spark, list(cases), make), strict=True)) == cases


def test_sizes(spark):
    sizes = [0, 1, 1023, 16640, 1048575, 1048576, 5_000_000, None]
    want = [None if s is None else f"{s / 1024:.1f} KB" if s < 1048576 else f"{s / 1048576:.1f} MB" for s in sizes]
    assert column(spark, sizes, T.readable_size, "bigint") == want


def test_data_urls(spark):
    df = spark.createDataFrame([(bytearray(b"abc" * 100),), (None,)], "p binary").select(T.data_url(F.col("p"), F.lit("image/png")).alias("u"))
    back = df.select(T.from_data_url(F.col("u"))).collect()
    assert [r[0] and bytes(r[0]) for r in back] == [b"abc" * 100, None]
    assert column(spark, ["data:text/plain;base64,YQ==", "data:image/png;base64,%%%", "x"], T.from_data_url) == [None] * 3


def test_display_box_floors(spark):
    rects = [(100, 100, w, h) for w in (10, 86, 87, 88, 200) for h in (11, 87)]
    df = spark.createDataFrame(rects, "x int, y int, width int, height int")
    r = G.rect(*[F.col(c) for c in df.columns])
    got = [tuple(x[0]) for x in df.select(G.display_box(r, F.lit(0.5), F.lit(1.0))).collect()]
    assert got == [(int(x / 0.5) - (87 - int(w / 0.5)) // 2, y - (87 - h) // 2, 87, 87) for x, y, w, h in rects]


def test_rows_truncate(spark):
    got = column(spark, [-60.0, -53.0, -52.0, -1.0, 0.0, 52.9, 53.0, None], lambda c: G.row_of(c, F.lit(0), F.lit(53.0)), "double")
    assert got == [-1, -1, 0, 0, 0, 0, 1, None]


def test_weekdays(spark):
    assert column(spark, [0, 5, 6, 7], lambda c: G.weekday(c), "int") == ["Mo", "Sa", "Col9", "Col10"]


def test_field_class_limits(spark):
    cases = [(5.01, 1, "text_line"), (5.0, 1, "text_field"), (2.0, 1, "unknown"), (1.0, 1999, "checkbox"), (1.0, 2000, "unknown"), (0.8, 1, "unknown"), (1.5, 10001, "text_area"), (1.5, 10000, "unknown")]
    df = spark.createDataFrame([(a, float(b)) for a, b, _ in cases], "a double, b double")
    assert [r[0] for r in df.select(G.field_class(F.col("a"), F.col("b"))).collect()] == [c for *_, c in cases]


def test_cosine(spark):
    pairs = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [-1.0, -1.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(G.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, -1.0]
    assert df.filter(G.cosine(F.col("a"), F.col("b")) != G.cosine(F.col("b"), F.col("a"))).count() == 0


def test_header_keys(spark):
    turns = [0.0, 3.0, 44.0, 46.0, 90.0, -90.0, 134.0, 180.0, 270.0, -180.0]
    want = [k if (k := int(round(t / 90) * 90)) in (0, -90, 90, 180) else 0 for t in turns]
    assert column(spark, turns, G.header_key, "double") == want


def test_fold_angle(spark):
    angles = [0.0, 1.5, -1.5, 89.0, 91.0, -89.0, 178.0, -178.0]
    assert column(spark, angles, G.fold_angle, "double") == [0.0, 1.5, -1.5, -1.0, 1.0, 1.0, -2.0, 2.0]


def test_patterns_are_regular():
    for p in (*T.SHEET_PATTERNS, T.FORM_PATTERN, T.LEADING_CODE):
        re.compile(p)
    assert math.isclose(G.ROW_HEIGHT, 53)
