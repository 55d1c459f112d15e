"""Image edits and comparison, many images at once."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.functions import images


def _luma(p, q):
    """By how much p is brighter than q, both over white."""
    one, other = ((c[:3] if c[3] == 255 else [255.0 + (v - 255.0) * (c[3] / 255.0) for v in c[:3]]) for c in (p, q))
    y = [v[0] * 0.29889531 + v[1] * 0.58662247 + v[2] * 0.11448223 for v in (one, other)]
    i = [v[0] * 0.59597799 - v[1] * 0.27417610 - v[2] * 0.32180189 for v in (one, other)]
    q = [v[0] * 0.21147017 - v[1] * 0.52261711 + v[2] * 0.31114694 for v in (one, other)]
    y, i, q = y[0] - y[1], i[0] - i[1], q[0] - q[1]
    return y, 0.5053 * y * y + 0.299 * i * i + 0.1957 * q * q


def _one_by_one(a, b, threshold=0.1):
    """Where images differ, pixel by pixel."""
    h, w = len(a), len(a[0])

    def near(x, y):
        return [(i, j) for i in range(max(0, x - 1), min(w, x + 2)) for j in range(max(0, y - 1), min(h, y + 2)) if (i, j) != (x, y)]

    def border(x, y):
        return int(x in (0, w - 1) or y in (0, h - 1))

    def flat(p, x, y):
        return border(x, y) + sum(p[j][i] == p[y][x] for i, j in near(x, y)) > 2

    def edge(p, q, x, y):
        equal, least, most, first, last = border(x, y), 0.0, 0.0, None, None
        for i, j in near(x, y):
            d = 0.0 if p[y][x] == p[j][i] else _luma(p[y][x], p[j][i])[0]
            if d == 0:
                equal += 1
            elif d < least:
                least, first = d, (i, j)
            elif d > most:
                most, last = d, (i, j)
        return equal <= 2 and first is not None and last is not None and any(flat(p, *c) and flat(q, *c) for c in (first, last))

    return [[a[y][x] != b[y][x] and _luma(a[y][x], b[y][x])[1] > 35215.0 * threshold * threshold and not edge(a, b, x, y) and not edge(b, a, x, y) for x in range(w)] for y in range(h)]


def _pair(g):
    h, w, k = (int(v) for v in g.integers((1, 1, 2), (9, 9, 6)))
    palette = g.integers(0, 256, (k, 4)).astype(np.uint8)
    palette[:, 3] = np.where(g.random(k) < 0.6, 255, palette[:, 3])
    a = palette[np.sort(g.integers(0, k, (h, w)), int(g.integers(0, 2)))]
    b = np.where(g.random((h, w, 1)) < 0.25, palette[0], a) if g.random() < 0.7 else palette[g.integers(0, k, (h, w))]
    return a, b


def test_differing_is_the_loop_over_pixels():
    g, edges = np.random.default_rng(2), 0
    for _ in range(400):
        a, b = _pair(g)
        want = _one_by_one(a.tolist(), b.tolist())
        assert images.differing(a, b).tolist() == want
        edges += int(images.differing(a, b, include_aa=True).sum() - np.sum(want))
        assert images.differing(np.stack([b, a, a]), np.stack([b, b, a]))[1].tolist() == want
    assert edges > 50


def test_images_of_many_sizes(spark):
    """Rows of any sizes, in any order, and nulls; edits of a stack are those of its images."""
    g = np.random.default_rng(4)
    pairs = [_pair(g) for _ in range(60)]
    rows = [(i, images.raster(a), images.raster(b)) if i % 7 else (i, None, images.raster(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"id int, a {images.RASTER}, b {images.RASTER}").repartition(2)
    a = F.col("a")
    edits = [images.resize(a, 5, 3), images.crop(a, 1, 0, 3, 2), images.flip(a, True, False), images.rotate(a, 90), images.greyscale(a), images.invert(a), images.brightness(a, 0.2), images.contrast(images.flip(a, False, True), -0.3)]
    got = {r.id: r for r in df.select("id", F.array(*edits).alias("e"), images.count_diff(a, F.col("b")).alias("n"), images.count_diff(a, a).alias("same")).collect()}
    grey = np.array([0.2126, 0.7152, 0.0722])
    for i, (p, q) in enumerate(pairs):
        if i % 7 == 0:
            assert (got[i].n, got[i].same, set(got[i].e)) == (None, None, {None})
            continue
        c = p[..., :3].astype(float)
        colours = [np.repeat((c @ grey)[..., None], 3, 2), 255 - c, c + 255 * 0.2, ((c[::-1] / 255 - 0.5) * 0.7**2 + 0.5) * 255]
        want = [images.resized(p, 5, 3), p[:2, 1:4], p[:, ::-1], np.rot90(p, -1)] + [np.dstack([np.clip(np.round(v), 0, 255).astype(np.uint8), x[..., 3]]) for v, x in zip(colours, [p, p, p, p[::-1]], strict=True)]
        assert [(e.width, e.height, bytes(e.rgba)) for e in got[i].e] == [(w.shape[1], w.shape[0], w.tobytes()) for w in want]
        assert (got[i].n, got[i].same) == (int(np.sum(_one_by_one(p.tolist(), q.tolist()))), 0)


def test_count_diff_in_time_and_checked():
    """20,000 pairs without equal pixels; pixel by pixel these took minutes."""
    a = np.random.default_rng(1).integers(0, 256, (20_000, 8, 8, 4), np.uint8)
    b = a.copy()
    b[..., :3] = 255 - b[..., :3]
    b[5] = a[5]
    one, other = images._rasters(a), images._rasters(b)
    began = time.process_time()
    n = images.counted(one, other, 0.1, False).to_pylist()
    assert time.process_time() - began < 15 and n[5] == 0
    assert n[:4] == [int(np.sum(_one_by_one(a[i].tolist(), b[i].tolist()))) for i in range(4)]
    assert images.counted(one[4:6], other[4:6], 0.1, False).to_pylist() == n[4:6]
    with pytest.raises(ValueError, match="sizes do not match"):
        images.counted(one[:1], images._rasters(a[:1, :4]), 0.1, False)
    with pytest.raises(ValueError, match="need 256 bytes, got 3"):
        images.counted(pa.array([{"width": 8, "height": 8, "rgba": b"abc"}], one.type), one[:1], 0.1, False)
