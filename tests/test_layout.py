"""Order-dependent folds and grids against short statements of the rule."""

import random

from pyspark.sql import functions as F

from formflow.operators import layout, scan, zones

BOX = "page_id string, det_idx int, x int, y int, width int, height int"


def test_clusters(spark):
    rng = random.Random(1)
    pages = {f"p{i}": [rng.randrange(0, 400) for _ in range(rng.randrange(1, 40))] for i in range(20)}
    df = spark.createDataFrame([(p, y) for p, ys in pages.items() for y in ys] + [("p0", None)], "p string, y int")

    def rule(ys):
        groups, last = [], None
        for y in sorted(ys):
            if last is None or y - last > 10:
                groups.append([])
            groups[-1].append(y)
            last = y
        return [int(sum(g) / len(g)) for g in groups]

    got = {}
    for r in layout.cluster_positions(df, "y", ["p"]).collect():
        got.setdefault(r.p, []).append(r.center)
    assert {p: sorted(v) for p, v in got.items()} == {p: rule(v) for p, v in pages.items()}
    assert layout.cluster_positions(df.limit(0), "y", ["p"]).count() == 0


def test_last_kept(spark):
    rng = random.Random(2)
    pages = {f"p{i}": [rng.randrange(0, 300) for _ in range(30)] for i in range(10)} | {"q": [0, 10, 20, 30, 31, 60]}
    df = spark.createDataFrame([(p, x) for p, xs in pages.items() for x in xs], "p string, x int")

    def rule(xs):
        kept = []
        for x in sorted(xs):
            if not kept or x - kept[-1] > 15:
                kept.append(x)
        return kept

    got = {}
    for r in layout.dedupe_last_kept(df, "x", ["p"]).collect():
        got.setdefault(r.p, []).append(int(r.x))
    assert {p: sorted(v) for p, v in got.items()} == {p: rule(v) for p, v in pages.items()}
    assert sorted(got["q"]) == [0, 20, 60]


def test_merge_is_the_greedy_pass(spark):
    rng = random.Random(3)
    pages = {f"p{k}": [(rng.randrange(300), rng.randrange(300), rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(25)] for k in range(8)}
    pages["chain"] = [(0, 0, 10, 10), (30, 0, 10, 10), (10, 0, 20, 10), (100, 100, 5, 5), (105, 105, 5, 5)]

    def rule(boxes):
        out, used = [], set()
        for i, (x, y, w, h) in enumerate(boxes):
            if i in used:
                continue
            a = [x, y, x + w, y + h]
            for j in range(i + 1, len(boxes)):
                if j in used:
                    continue
                u, v, s, t = boxes[j]
                b = [u, v, u + s, v + t]
                if b[0] <= a[2] and a[0] <= b[2] and b[1] <= a[3] and a[1] <= b[3]:
                    a = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                    used.add(j)
            out.append((a[0], a[1], a[2] - a[0], a[3] - a[1]))
        return out

    rows = [(p, i, *b) for p, bs in pages.items() for i, b in enumerate(bs)] + [("p0", None, 1, 1, 1, 1)]
    rng.shuffle(rows)
    got = {}
    for r in layout.merge_boxes(spark.createDataFrame(rows, BOX)).orderBy("page_id", "region_idx").collect():
        got.setdefault(r.page_id, []).append((r.x, r.y, r.width, r.height))
    assert got == {p: rule(bs) for p, bs in pages.items()}
    assert layout.merge_boxes(spark.createDataFrame([], BOX)).count() == 0


def grid(spark, hs, vs):
    h = spark.createDataFrame([("d", y) for y in hs], "d string, p int")
    v = spark.createDataFrame([("d", x) for x in vs], "d string, p int")
    return layout.cell_grid(h, v, "p", ["d"])


def test_grid_keeps_indices(spark):
    cells = grid(spark, [0, 10, 60, 120, 139], [0, 100, 129, 200, 300]).collect()
    assert sorted({r.row_idx for r in cells}) == [1, 2] and sorted({r.col_idx for r in cells}) == [0, 2, 3]
    assert sorted({(r.row_idx, r.grid_row) for r in cells}) == [(1, 0), (2, 1)]
    assert sum(r.rect.width * r.rect.height for r in cells) == (100 + 71 + 100) * (50 + 60)


def test_columns_and_products(spark):
    cells = grid(spark, [0, 60, 120, 180, 240], [0, 50, 150, 200, 250, 300, 350, 400, 450, 500, 550])
    cols = layout.grid_columns(cells, ["d"])
    assert [r.name for r in cols.orderBy("index").collect()] == ["product_number", "product_name", "Mo", "Di", "Mi", "Do", "Fr", "Sa", "Col9", "Col10"]
    headers = layout.header_rows(cells, ["d"], F.lit(500))
    assert headers.collect()[0].header_rows == 2
    rows = layout.product_rows(cells, cols, headers, ["d"]).orderBy("row").collect()
    assert [r.row for r in rows] == [2, 3] and rows[0].cells["Sa"].x == 400 and rows[0].product_name_cell.width == 100
    narrow = grid(spark, [0, 60, 120], [0, 50, 150])
    assert layout.grid_columns(narrow, ["d"]).count() == 0
    assert layout.header_rows(grid(spark, [300, 360, 420], [0, 50]), ["d"], F.lit(500)).collect()[0].header_rows == 1


def test_row_texts_first_wins(spark):
    rows = [("p", 0, 5, 30.0, "12"), ("p", 1, 0, 40.0, "13"), ("p", 0, 1, 80.0, ""), ("p", 0, 2, 85.0, "9"), ("p", 0, 9, -40.0, "7"), ("p", 0, 9, -60.0, "8"), ("p", 0, 0, 999.0, "1"), ("p", 0, 0, 30.0, None)]
    df = spark.createDataFrame(rows, "page_id string, zone_idx int, det_idx int, m double, t string")
    got = scan.row_texts(df, F.col("t"), F.col("m"), F.lit(0), F.lit(53.0), F.lit(10), ["zone_idx", "det_idx"])
    assert {r.row_idx: r.text for r in got.collect()} == {0: "12", 1: "9"}


def test_zone_containment(spark):
    items = spark.createDataFrame([("p", 1, 10.0), ("p", 2, 20.0), ("p", 3, 99.0), ("q", 4, 1.0)], "page_id string, i int, y_mid double")
    z = spark.createDataFrame([("p", 0, 0, 10), ("p", 1, 10, 10), ("p", 2, 5, 30)], "page_id string, zone_idx int, y int, height int")
    assert {r.i: r.zone_idx for r in scan.zone_of(items, z, "y_mid", "i").collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_blob_rules(spark):
    cases = [(7, 9, 1, "too_small"), (8, 10, 49, "low_area"), (8, 10, 50, "passed"), (80, 80, 50, "passed"), (81, 80, 50, "too_large"), (7, 81, 1, "too_small")]
    df = spark.createDataFrame([c[:3] for c in cases], "w int, h int, a int")
    assert [r[0] for r in df.select(scan.blob_verdict(F.col("w"), F.col("h"), F.col("a"))).collect()] == [c[3] for c in cases]


def template(spark):
    cell = lambda x: {"x": x, "y": 0, "width": 10, "height": 10}
    rect = "struct<x:int,y:int,width:int,height:int>"
    rows = [("X-1", 100, 100, [("Mo",), ("Di",)], [(1, "", "", {"Mo": cell(1), "Di": cell(2)}), (2, "", "", {"Di": cell(3)})])]
    return spark.createDataFrame(rows, f"form_key string, image_width int, image_height int, columns array<struct<name:string>>, products array<struct<row:int,product_number:string,product_name:string,cells:map<string,{rect}>>>")


def test_template_scan(spark):
    pages = spark.createDataFrame([("a", "X 1", 200, 300), ("b", "X1", 100, 100), ("c", "Y", 1, 1), ("d", None, 1, 1)], "page_id string, form_type string, width int, height int")
    got = scan.template_cells(pages, template(spark)).collect()
    a = sorted((r.col_order, r.row, r.bounds.x, r.bounds.height) for r in got if r.page_id == "a")
    assert a == [(0, 1, 2, 30), (1, 1, 4, 30), (1, 2, 6, 30)]
    assert sum(r.page_id == "b" for r in got) == 3
    assert [(r.page_id, r.error is not None, r.bounds) for r in got if r.page_id in "cd"] == [("c", True, None), ("d", True, None)] or sorted(r.page_id for r in got if r.error) == ["c", "d"]


def test_zone_detection(spark):
    pages = spark.createDataFrame([("both", 1000, 2000), ("top", 1000, 2000), ("none", 1000, 2000), ("bare", 1000, 2000)], "page_id string, width int, height int")
    det = "page_id string, det_idx int, text string, x int, y int, x2 int, y2 int"
    rows = [
        ("both", 0, "Monats-Salat", 200, 100, 300, 140), ("both", 1, "MONATSSALAT", 210, 110, 310, 150), ("both", 2, "(210-212)", 900, 1300, 950, 1340),
        ("both", 3, "Sandwich Crustino", 1, 900, 2, 910), ("both", 4, "Sandwich", 1, 1000, 2, 1010), ("both", 5, "sandwich", 1, 1100, 2, 1110), ("both", 6, None, 0, 0, 1, 1),
        ("top", 0, "monats", 200, 100, 300, 140), ("none", 0, "x", 0, 0, 1, 1),
    ]
    v = [("both", x) for x in (20, 25, 120, 350, 410, 415, 500, 590, 990)] + [("top", 330), ("none", 50), ("none", 100), ("none", 450), ("none", 600), ("none", 700)]
    h = [("none", y) for y in range(100, 1300, 100)]
    got = zones.detect_zones(
        pages, spark.createDataFrame(rows, det), spark.createDataFrame(v, "page_id string, x int"), spark.createDataFrame(h, "page_id string, y int")
    )
    r = {x.page_id: x for x in got.collect()}
    b = r["both"]
    # The cell ends at 350; kept lines right of it 410, 500, 590; the Saturday column is skipped.
    assert b.method == "ocr_anchors" and tuple(b.zone) == (412, 110, 5 * 90, 1230) and b.rows == 1230 // 53 and b.cols == 5
    assert tuple(b.codes) == (22, 110, 96, 1230) and tuple(b.names) == (123, 110, 347 - 123, 1230)
    assert tuple(b.saturday_zone) == (412 + 450 + 2, 995, 90, 53 * 9)
    t = r["top"]
    assert t.method == "partial_ocr" and tuple(t.zone) == (332, 100, 350, 1600) and (t.rows, t.cols) == (52, 5)
    n = r["none"]
    assert n.method == "line_detection" and tuple(n.zone) == (450, 100, 540, 1100) and (n.rows, n.cols) == (11, 2)
    assert tuple(n.codes) == (52, 100, 46, 1100)
    e = r["bare"]
    assert tuple(e.zone) == (550, 160, 440, 1700) and (e.rows, e.cols) == (52, 5) and tuple(e.codes) == (50, 160, 120, 1700)
