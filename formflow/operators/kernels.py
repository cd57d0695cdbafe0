"""Pixel kernels on NumPy arrays of one page: gray uint8, or height x width x 3 in BGR order.

No imaging library is needed. Areas count pixels of a connected component and
corners its extreme points, so these two differ slightly from contour based
figures; everything else is defined exactly here.
"""

from __future__ import annotations

import math

import numpy as np


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of a BGR page; a gray page is returned as it is."""
    if image.ndim == 2:
        return image
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    return np.clip(np.rint(0.114 * b + 0.587 * g + 0.299 * r), 0, 255).astype(np.uint8)


def otsu(page: np.ndarray) -> int:
    """Threshold of the largest variance between the classes; 0 for a flat page."""
    counts = np.bincount(page.ravel(), minlength=256).astype(np.float64)
    total = counts.sum()
    if total == 0:
        return 0
    below = np.cumsum(counts)
    moment = np.cumsum(counts * np.arange(256))
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = moment / below - (moment[-1] - moment) / above
        between = np.nan_to_num(below * above * gap * gap)
    return int(np.argmax(between))


def ink(page: np.ndarray) -> np.ndarray:
    """Dark pixels by the Otsu threshold."""
    return page <= otsu(page) if page.size and page.min() != page.max() else np.zeros(page.shape, dtype=bool)


def _sums(mask: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Number of set pixels in each window of ``n`` along an axis, same shape, centred."""
    left = n // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (left + 1, n - left - 1)
    c = np.cumsum(np.pad(mask.astype(np.int32), pad), axis=axis)
    hi = np.take(c, np.arange(n, c.shape[axis]), axis=axis)
    lo = np.take(c, np.arange(0, c.shape[axis] - n), axis=axis)
    return hi - lo


def erode(mask: np.ndarray, w: int, h: int) -> np.ndarray:
    """Erosion by a rectangle; pixels beyond the page count as set."""
    out = mask
    for n, axis in ((w, 1), (h, 0)):
        if n > 1:
            out = ~(_sums(~out, n, axis) > 0)
    return out


def dilate(mask: np.ndarray, w: int, h: int) -> np.ndarray:
    out = mask
    for n, axis in ((w, 1), (h, 0)):
        if n > 1:
            flipped = np.flip(out, axis)
            out = np.flip(_sums(flipped, n, axis) > 0, axis)
    return out


def opened(mask: np.ndarray, w: int, h: int, times: int = 1) -> np.ndarray:
    """Opening by a rectangle, ``times`` erosions followed by as many dilations."""
    for _ in range(times):
        mask = erode(mask, w, h)
    for _ in range(times):
        mask = dilate(mask, w, h)
    return mask


def closed(mask: np.ndarray, w: int, h: int) -> np.ndarray:
    return erode(dilate(mask, w, h), w, h)


def components(mask: np.ndarray) -> list[dict[str, int]]:
    """Bounding boxes and pixel counts of the 8-connected components, top left first.

    Runs of each line are joined with overlapping runs of the line before by
    union-find.
    """
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    edge = np.diff(padded, axis=1)
    ys, starts = np.nonzero(edge == 1)
    _, ends = np.nonzero(edge == -1)
    if len(ys) == 0:
        return []
    parent = np.arange(len(ys))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ys, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(ys))])
    out = []
    for r in np.unique(roots):
        mine = roots == r
        x0, x1, y0, y1 = starts[mine].min(), ends[mine].max(), ys[mine].min(), ys[mine].max() + 1
        out.append({"x": int(x0), "y": int(y0), "width": int(x1 - x0), "height": int(y1 - y0), "area": int((ends - starts)[mine].sum())})
    return sorted(out, key=lambda c: (c["y"], c["x"]))


def lines(mask: np.ndarray, axis: str, kernel: int, times: int, least: float) -> list[dict[str, int]]:
    """Straight lines longer than ``least`` along ``horizontal`` or ``vertical``."""
    w, h = (kernel, 1) if axis == "horizontal" else (1, kernel)
    side = "width" if axis == "horizontal" else "height"
    return [c for c in components(opened(mask, w, h, times)) if c[side] > least]


def layout_lines(page: np.ndarray) -> dict[str, list[dict[str, int]]]:
    """Lines of the layout analysis: kernels of 40, opened twice, longer than 50."""
    m = ink(page)
    return {a: lines(m, a, 40, 2, 50) for a in ("horizontal", "vertical")}


def template_positions(page: np.ndarray, least: int = 50) -> dict[str, list[int]]:
    """Centres of a template's grid lines by the local threshold."""
    m = local_ink(page, 15, 2)
    out = {}
    for axis, at, side, dim in (("horizontal", "y", "height", page.shape[1]), ("vertical", "x", "width", page.shape[0])):
        found = lines(m, axis, max(dim // 30, 40), 2, least)
        out[axis] = sorted(c[at] + c[side] // 2 for c in found)
    return out


def zone_lines(page: np.ndarray) -> list[int]:
    """Left edges of vertical lines higher than 15 % of the page."""
    return sorted(c["x"] for c in lines(ink(page), "vertical", 20, 1, page.shape[0] * 0.15))


def blur(page: np.ndarray, size: int) -> np.ndarray:
    """Gaussian mean of ``size`` pixels with the customary sigma, edges repeated."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = page.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size // 2)
        p = np.pad(out, pad, mode="edge")
        n = out.shape[axis]
        out = sum(w * np.take(p, np.arange(i, i + n), axis=axis) for i, w in enumerate(k))
    return out


def local_ink(page: np.ndarray, size: int = 11, c: float = 2) -> np.ndarray:
    """Pixels darker than the Gaussian mean around them by more than ``c``."""
    return page <= np.rint(blur(page, size)) - c


def local_threshold(page: np.ndarray, size: int = 11, c: float = 2) -> np.ndarray:
    """Black and white page of :func:`local_ink`."""
    return np.where(local_ink(page, size, c), 0, 255).astype(np.uint8)


def crop(page: np.ndarray, padding: int = 10) -> tuple[np.ndarray, dict[str, int]]:
    """The page around its ink with a margin; the whole page where there is none."""
    m = ink(gray(page))
    h, w = m.shape
    if not m.any():
        return page, {"x": 0, "y": 0, "w": w, "h": h}
    ys, xs = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
    x0, y0 = max(0, xs[0] - padding), max(0, ys[0] - padding)
    x1, y1 = min(w, xs[-1] + 1 + padding), min(h, ys[-1] + 1 + padding)
    return page[y0:y1, x0:x1], {"x": int(x0), "y": int(y0), "w": int(x1 - x0), "h": int(y1 - y0)}


def equalized(page: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast limited adaptive equalisation on ``tiles`` x ``tiles``, blended between tile centres."""
    h, w = page.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(page, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th, tw) else "edge")
    maps = np.empty((tiles, tiles, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(n - limit, 0).sum()
            n = np.minimum(n, limit) + over // 256
            maps[i, j] = np.cumsum(n) * 255.0 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, tiles - 1), np.clip(np.floor(x).astype(int), 0, tiles - 1)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], page]
    mixed = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def denoised(page: np.ndarray, strength: float = 10, patch: int = 7, window: int = 21) -> np.ndarray:
    """Non-local means: pixels averaged by the likeness of the patches around them."""
    r, half = window // 2, patch // 2
    f = page.astype(np.float64)
    p = np.pad(f, r, mode="reflect" if min(page.shape) > r else "edge")
    h, w = page.shape
    weight, total = np.zeros_like(f), np.zeros_like(f)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            other = p[r + dy : r + dy + h, r + dx : r + dx + w]
            d = _box((f - other) ** 2, half)
            k = np.exp(-d / (strength * strength))
            weight += k
            total += k * other
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def _box(a: np.ndarray, half: int) -> np.ndarray:
    n = 2 * half + 1
    p = np.pad(a, half, mode="edge")
    c = np.pad(np.cumsum(np.cumsum(p, 0), 1), ((1, 0), (1, 0)))
    return (c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]) / (n * n)


def rotated(page: np.ndarray, degrees: float, grow: bool, fill: int | None) -> np.ndarray:
    """Rotation about the centre, bilinear; ``grow`` enlarges the canvas, ``fill`` None repeats the edge."""
    h, w = page.shape[:2]
    a = math.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    nw, nh = (int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))) if grow else (w, h)
    y, x = np.mgrid[0:nh, 0:nw]
    u, v = x - nw / 2, y - nh / 2
    sx, sy = c * u - s * v + w / 2, s * u + c * v + h / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        value = page[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)].astype(np.float64)
        if fill is not None:
            outside = (yy < 0) | (yy >= h) | (xx < 0) | (xx >= w)
            value[outside] = fill
        return value

    if page.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def skew(page: np.ndarray, most: float = 15.0, step: float = 0.25) -> float:
    """Angle that makes the rows of ink sharpest: projection profiles over ``-most … most``."""
    ys, xs = np.nonzero(ink(page))
    if len(ys) < 5:
        return 0.0
    ys, xs = ys.astype(np.float64), xs.astype(np.float64)
    best = (-1.0, 0.0)
    for angle in np.arange(-most, most + step / 2, step):
        t = math.radians(angle)
        rows = np.rint(ys * math.cos(t) - xs * math.sin(t)).astype(int)
        n = np.bincount(rows - rows.min())
        score = float((n.astype(np.float64) ** 2).sum())
        if score > best[0] + 1e-9 or (abs(score - best[0]) <= 1e-9 and abs(angle) < abs(best[1])):
            best = (score, float(angle))
    return best[1]


def deskewed(page: np.ndarray, least: float, most: float, grow: bool, fill: int | None) -> tuple[np.ndarray, float]:
    """The page turned upright and the angle; angles too small or too large aren't corrected."""
    angle = skew(gray(page), min(most + 10, 30))
    if abs(angle) < least or abs(angle) > most:
        return page, 0.0
    return rotated(page, angle, grow, fill), round(angle, 2)


def digit28(page: np.ndarray) -> np.ndarray | None:
    """A glyph as 28 x 28 floats in [0, 1]: ink centred at 20 x 20 with a margin of 4; None if blank."""
    m = ink(page)
    if not m.any():
        return None
    ys, xs = np.flatnonzero(m.any(axis=1)), np.flatnonzero(m.any(axis=0))
    glyph = np.where(m[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1], 255, 0)
    pad = max(glyph.shape) // 4
    glyph = np.pad(glyph, pad)
    h, w = glyph.shape
    side = max(h, w)
    square = np.zeros((side, side))
    top, left = (side - h) // 2, (side - w) // 2
    square[top : top + h, left : left + w] = glyph
    return np.pad(area_resized(square, 20, 20), 4).astype(np.float32) / 255


def area_resized(page: np.ndarray, w: int, h: int) -> np.ndarray:
    """Resize by the mean over the area each new pixel covers."""
    return _weights(page.shape[0], h) @ page.astype(np.float64) @ _weights(page.shape[1], w).T


def _weights(old: int, new: int) -> np.ndarray:
    lo, hi = np.arange(new) * old / new, (np.arange(new) + 1) * old / new
    k = np.arange(old)
    cover = np.clip(np.minimum(hi[:, None], k + 1) - np.maximum(lo[:, None], k), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def cell_stats(cell: np.ndarray) -> dict[str, float]:
    """Population variance and bright and dark share of a cell."""
    g = gray(cell).astype(np.float64)
    return {"variance": float(g.var()), "bright": float((g > 200).mean()), "dark": float((g < 100).mean())}


def is_empty(cell: np.ndarray, variance: float = 50, bright: float = 0.95, dark: float = 0.01) -> bool:
    s = cell_stats(cell)
    return s["variance"] < variance or s["bright"] > bright or s["dark"] < dark


def signature(region: np.ndarray) -> np.ndarray:
    """51 numbers of a header: 32 histogram bins of length 1, share of edges, means of a 3 x 6 grid."""
    g = np.rint(area_resized(gray(region), 200, 60))
    hist = np.histogram(g, bins=32, range=(0, 256))[0].astype(np.float64)
    norm = np.linalg.norm(hist)
    gy, gx = np.gradient(g)
    edges = float((np.hypot(gx, gy) > 50).mean())
    cells = [g[i * 20 : i * 20 + 20, j * 33 : j * 33 + 33].mean() / 255 for i in range(3) for j in range(6)]
    return np.concatenate([hist / norm if norm else hist, [edges], cells])


def row_blobs(zone: np.ndarray) -> list[dict[str, int]]:
    """Connected blobs of an orders zone with the grid lines taken out."""
    m = ink(zone)
    grid = opened(m, 40, 1, 2) | opened(m, 1, 40, 2)
    return components(closed(m & ~dilate(grid, 3, 3), 2, 2))


def boxes(page: np.ndarray) -> list[dict[str, float]]:
    """Framed boxes: components of edges of at least 500 pixels, aspect between 0.1 and 10."""
    g = page.astype(np.float64)
    gy, gx = np.gradient(g)
    found = components(dilate(np.hypot(gx, gy) > 50, 5, 5))
    out = []
    for c in found:
        area, aspect = c["width"] * c["height"], round(c["width"] / c["height"], 2)
        if area >= 500 and 0.1 < c["width"] / c["height"] < 10:
            out.append({**c, "area": float(area), "aspect_ratio": aspect})
    return sorted(out, key=lambda c: (c["y"], c["x"]))


def text_regions(page: np.ndarray) -> list[dict[str, int]]:
    """Stable dark regions wider than 10 and higher than 5."""
    return [c for c in components(dilate(ink(page), 3, 1)) if c["width"] > 10 and c["height"] > 5]


def processed(page: np.ndarray, threshold: bool = False, orientation=None) -> tuple[np.ndarray, dict]:
    """The document pipeline with its steps: orientation, deskew, denoise, contrast, crop and threshold.

    ``orientation(page) -> degrees`` is supplied where a decoder is at hand.
    """
    turn = orientation(page) if orientation else 0
    if turn:
        page = np.rot90(page, -turn // 90)
    page, angle = deskewed(page, 0.5, 15.0, False, None)
    page = equalized(denoised(gray(page)))
    page, box = crop(page)
    if threshold:
        page = local_threshold(page)
    return page, {
        "orientation_angle": int(turn), "deskew_angle": float(angle), "denoise": True, "contrast": "CLAHE", "crop": box,
        "threshold": "adaptive" if threshold else None,
    }
