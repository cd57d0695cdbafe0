"""Kernels on drawn pages with known lines, boxes and blobs."""

import struct
import zlib

import numpy as np
import pytest

from formflow.operators import kernels as K
from formflow.operators import pages as P
from formflow.operators import recognize as R
from formflow.sources import files


def png(page: np.ndarray) -> bytes:
    h, w = page.shape[:2]
    color = 2 if page.ndim == 3 else 0
    data = page[..., ::-1] if page.ndim == 3 else page
    raw = b"".join(b"\0" + data[y].tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def form(w=400, h=300, hs=(50, 100, 150, 200), vs=(40, 120, 200, 320), thick=2):
    page = np.full((h, w), 255, np.uint8)
    for y in hs:
        page[y : y + thick, vs[0] : vs[-1] + thick] = 0
    for x in vs:
        page[hs[0] : hs[-1] + thick, x : x + thick] = 0
    return page


def test_otsu_splits_two_levels():
    page = np.full((10, 10), 200, np.uint8)
    page[:3] = 20
    assert 20 <= K.otsu(page) < 200 and K.ink(page).sum() == 30
    assert not K.ink(np.full((5, 5), 255, np.uint8)).any()


def test_components_match_flood_fill():
    rng = np.random.default_rng(0)
    for density in (0.1, 0.4, 0.6):
        m = rng.random((40, 50)) < density
        seen, want = np.zeros_like(m), []
        for y, x in zip(*np.nonzero(m), strict=True):
            if seen[y, x]:
                continue
            todo, cells = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                cells.append((a, b))
                for c in range(max(a - 1, 0), min(a + 2, 40)):
                    for d in range(max(b - 1, 0), min(b + 2, 50)):
                        if m[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
            ys, xs = zip(*cells, strict=True)
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
        got = [(c["x"], c["y"], c["width"], c["height"], c["area"]) for c in K.components(m)]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("w", "h"), [(3, 1), (1, 4), (5, 5), (2, 2)])
def test_morphology_is_dual_and_ordered(w, h):
    m = np.random.default_rng(1).random((30, 30)) < 0.7
    o, c = K.opened(m, w, h), K.closed(m, w, h)
    assert not (o & ~m).any()
    assert (K.opened(o, w, h) == o).all()
    assert K.dilate(m, w, h).sum() >= m.sum() >= K.erode(m, w, h).sum()
    assert c.shape == m.shape


def test_lines_and_grid():
    found = K.layout_lines(form())
    assert [c["y"] for c in found["horizontal"]] == [50, 100, 150, 200]
    assert sorted(c["x"] for c in found["vertical"]) == [40, 120, 200, 320]
    pos = K.template_positions(form())
    assert pos["horizontal"] == [51, 101, 151, 201] and pos["vertical"] == [41, 121, 201, 321]
    assert K.zone_lines(form()) == [40, 120, 200, 320]
    short = np.full((100, 200), 255, np.uint8)
    short[50, 20:70] = 0  # 50 pixels are not longer than 50
    assert K.lines(K.ink(short), "horizontal", 20, 2, 50) == []
    short[50, 20:71] = 0
    assert len(K.lines(K.ink(short), "horizontal", 20, 2, 50)) == 1
    assert K.layout_lines(short)["horizontal"] == []  # opened twice, lines under 79 pixels vanish


def test_blobs_without_grid():
    page = form()
    page[70:90, 60:72] = 0
    page[120:140, 140:155] = 0
    assert [(b["x"], b["y"], b["width"], b["height"]) for b in K.row_blobs(page)] == [(60, 70, 12, 20), (140, 120, 15, 20)]


def test_crop_and_threshold():
    page = np.full((100, 100), 255, np.uint8)
    assert K.crop(page)[1] == {"x": 0, "y": 0, "w": 100, "h": 100}
    page[40:50, 5:20] = 0
    assert K.crop(page)[1] == {"x": 0, "y": 30, "w": 30, "h": 30}
    assert set(np.unique(K.local_threshold(page))) <= {0, 255}


def test_skew_reads_all_ink():
    y, x = np.mgrid[-250:250, -250:250]
    page = np.where((np.random.default_rng(3).random(y.shape) < 0.5) & (y * y + x * x < 240 * 240), 0, 255).astype(np.uint8)
    ys, xs = np.nonzero(K.ink(page))
    assert len(ys) > 50_000
    scores = {}
    for a in np.arange(-15, 15.125, 0.25):
        rows = np.rint(ys * np.cos(np.radians(a)) - xs * np.sin(np.radians(a))).astype(int)
        scores[float(a)] = (np.bincount(rows - rows.min()).astype(float) ** 2).sum()
    assert scores[K.skew(page)] == max(scores.values())


def test_deskew_turns_back():
    page = form(600, 400)
    tilted = K.rotated(page, 4, False, 255)
    angle = K.skew(tilted)
    assert abs(abs(angle) - 4) <= 0.5
    upright, used = K.deskewed(tilted, 0.5, 15, False, None)
    assert used != 0 and abs(K.skew(upright)) <= 0.5
    assert K.deskewed(page, 0.5, 15, False, None)[1] == 0.0
    assert K.deskewed(K.rotated(page, 20, True, 255), 0.3, 10, True, 255)[1] == 0.0


def test_empty_cells_and_digits():
    white, cell = np.full((40, 40), 255, np.uint8), np.full((40, 40), 255, np.uint8)
    cell[5:35, 15:25] = 0
    assert K.is_empty(white) and not K.is_empty(cell)
    assert K.digit28(white) is None
    d = K.digit28(cell)
    assert d.shape == (28, 28) and 0 <= d.min() and d.max() == 1 and d[:4].sum() == 0


def test_signature_and_contrast():
    s = K.signature(form())
    assert len(s) == 51 and abs(np.linalg.norm(s[:32]) - 1) < 1e-9 and 0 <= s[32] <= 1
    flat = np.full((64, 64), 100, np.uint8)
    assert K.equalized(flat).std() == 0
    assert abs(int(K.denoised(flat).mean()) - 100) <= 1
    out, steps = K.processed(form(120, 90, (20, 60), (20, 100)), threshold=True)
    assert steps["threshold"] == "adaptive" and steps["denoise"] and out.ndim == 2


def test_page_tables(spark, tmp_path):
    color = np.repeat(form()[..., None], 3, axis=2)
    (tmp_path / "page_1.png").write_bytes(png(form()))
    (tmp_path / "page_2.png").write_bytes(png(color))
    (tmp_path / "broken.png").write_bytes(b"no image")
    images = files.images(spark, str(tmp_path))
    assert sorted(r.name for r in images.select("name").collect()) == ["page_1", "page_2"]
    lines = P.page_lines(images, ["name"]).groupBy("name", "axis").count().collect()
    assert {(r.name, r.axis): r["count"] for r in lines} == {(f"page_{i}", a): 4 for i in (1, 2) for a in ("horizontal", "vertical")}
    assert P.page_signatures(images, ["name"]).count() == 2
    assert P.grid_positions(images, ["name"]).count() == 16
    cells = images.selectExpr("name", "explode(array(1, 2, 3)) AS cell_id").selectExpr(
        "name", "cell_id", "named_struct('x', case cell_id when 3 then 500 else 45 end, 'y', 55, 'width', case cell_id when 2 then 0 else 60 end, 'height', 40) AS bounds"
    )
    got = {(r.name, r.cell_id): (r.croppable, r.empty) for r in P.cell_measures(images, cells, "name").collect()}
    assert got[("page_1", 1)] == (True, True) and got[("page_1", 2)] == (False, False) and got[("page_2", 3)] == (False, False)


def test_recognisers(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(png(form()))
    images = files.images(spark, str(tmp_path))
    fake = lambda: lambda page: [([[1, 2], [11, 2], [11, 9], [1, 9]], "abc", 0.98765), ([[0, 0], [1, 0], [1, 1], [0, 1]], "x", 0.5)]
    found = R.detections(images, ["name"], fake)
    r = R.page_texts(images, found, ["name"]).collect()[0]
    assert r.full_text == "abc\nx" and r.block_count == 2 and r.text_blocks[0].bounds.width == 10 and r.confidence == 0.7439
    none = R.page_texts(images, R.detections(images, ["name"], lambda: lambda page: []), ["name"]).collect()[0]
    assert none.confidence == 0.0 and none.block_count is None

    def broken(page):
        raise RuntimeError

    assert R.detections(images, ["name"], lambda: broken).count() == 0
    glyphs = spark.createDataFrame([(1, [0.0] * 783 + [1.0]), (2, None)], "id int, pixels array<float>")
    read = R.read_digits(glyphs, ["id"], lambda: lambda p: (np.full(len(p), 7), np.full(len(p), 0.9)))
    assert {r.id: (r.digit, r.confidence) for r in read.collect()} == {1: ("7", 0.9), 2: (None, 0.0)}


def test_qr_orientation():
    page = np.zeros((20, 10), np.uint8)
    page[1, 8] = 9  # the code stands top right

    def detect(p):
        ys, xs = np.nonzero(p == 9)
        return (float(xs[0]), float(ys[0])) if len(xs) else None

    turn = R.qr_orientation(detect)(page)
    ys, xs = np.nonzero(np.rot90(page, -turn // 90) == 9)
    fixed = np.rot90(page, -turn // 90)
    assert xs[0] < fixed.shape[1] / 2 and ys[0] < fixed.shape[0] / 2
    assert R.qr_orientation(detect)(np.zeros((4, 4))) == 0
    assert R.first_detector([lambda p: None, detect])(page) == (8.0, 1.0)
