from pyspark.sql import functions as F

from formflow.operators import matching, quality


def fields(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, field string, value string")


def test_anomaly(spark):
    ref = fields(spark, [("a", "x", "1"), ("a", "y", "2"), ("a", "z", None), ("b", "x", "1"), ("d", "x", "1")])
    ext = fields(spark, [("a", "x", "1"), ("a", "y", "3"), ("a", "z", None), ("a", "n", "9"), ("c", "x", "1"), ("d", "x", None)])
    got = {r.doc_id: tuple(r)[1:] for r in quality.anomaly_report(quality.compare_fields(ref, ext)).collect()}
    assert got == {"a": (0.3333, 1, 0, 1), "b": (1.0, 0, 1, 0), "c": (0.0, 0, 0, 1), "d": (1.0, 1, 0, 0)}
    assert quality.anomaly_report(quality.compare_fields(ref.limit(0), ext.limit(0))).count() == 0


def test_mode_prefers_first_seen(spark):
    df = spark.createDataFrame([("p", 3, "b"), ("p", 1, "a"), ("p", 2, "b"), ("p", 4, "a"), ("q", 1, None), ("q", 2, "z")], "p string, i int, v string")
    assert {r.p: r.v for r in quality.first_mode(df, "v", "i", ["p"]).collect()} == {"p": "a", "q": "z"}


def test_gate(spark):
    def verdict(counts):
        rows = [(d,) for d, n in enumerate(counts) for _ in range(n)]
        return quality.balance_gate(quality.class_counts(spark.createDataFrame(rows, "label int"), "label")).collect()[0].verdict

    assert verdict([10] * 10) == "ok"
    assert verdict([0] + [10] * 9) == "abort_missing"
    assert verdict([9] + [10] * 9) == "abort_few"
    assert verdict([50] + [10] * 9) == "ok"
    assert verdict([51] + [10] * 9) == "warn_unbalanced"


def test_templates(spark):
    t = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "template_id int, signature array<double>")
    p = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 0.0]), ("c", None)], "page_id string, signature array<double>")
    got = [tuple(r) for r in matching.template_scores(p, t, top=2).orderBy("page_id", "rank").collect()]
    assert got == [("a", 1, 1.0, 1, True), ("a", 2, 1.0, 2, False), ("b", 1, 0.0, 1, False), ("b", 2, 0.0, 2, False)]
    old, matching.BROADCAST_TEMPLATES = matching.BROADCAST_TEMPLATES, 1
    try:
        blocks = [tuple(r) for r in matching.template_scores(p, t, top=2, blocks=3).orderBy("page_id", "rank").collect()]
    finally:
        matching.BROADCAST_TEMPLATES = old
    assert blocks == got


def test_identification_without_templates(spark):
    p = spark.createDataFrame([("a", [1.0], 1000, 2000)], "page_id string, signature array<double>, width int, height int")
    t = spark.createDataFrame([], "template_id int, signature array<double>")
    m = spark.createDataFrame([("a", 90.0)], "page_id string, rotation double")
    r = matching.identify(p, m, t).collect()[0]
    assert r.confidence is None and r.needs_ocr and r.form_type is None and tuple(r.header) == (880, 0, 120, 800)


def test_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 0.1), ("c", 45.0)], "p string, v double")
    got = {r.p: (r.median_angle, r.applied) for r in quality.median_angle(df, F.col("v"), ["p"]).collect()}
    assert got == {"a": (1.5, 1.5), "b": (0.1, 0.0), "c": (45.0, 0.0)}
