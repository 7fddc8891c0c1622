"""Nearest and overlap joins against brute force; one group holds a third of the rows, in clusters and far apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import match as M

INF = float("inf")


@pytest.mark.parametrize("inv", [None, (0.5, 0.25, 5.0)])
def test_nearest(spark, inv):
    g = np.random.default_rng(7)
    spots = lambda n: np.where(g.random((n, 1)) < 0.5, g.normal(size=(n, 2)) * 0.01 + g.integers(0, 3, (n, 1)) * 40, g.uniform(-1e3, 1e3, (n, 2)))
    group = lambda n: np.where(np.arange(n) % 3 == 0, 0, g.integers(1, 40, n))
    p, s, gp, gs = spots(600), spots(450), group(600), group(450)
    s[:20] = s[20:40]  # ties
    gs[:20] = gs[20:40]
    metric = (lambda x, y: F.round(F.sqrt(x * x + y * y), 6)) if inv is None else (lambda x, y: F.round(M.mahalanobis(x, y, inv), 6))
    a, b, c = inv or (1.0, 0.0, 1.0)
    points = [(int(k), i, float(x), float(y)) for i, (k, (x, y)) in enumerate(zip(gp, p))] + [(0, 9000, None, 1.0), (0, 9001, INF, 1.0), (99, 9002, 1.0, 1.0), (98, 9003, 5.0, 5.0)]
    sites = [(int(k), i, float(x), float(y)) for i, (k, (x, y)) in enumerate(zip(gs, s))] + [(0, 9000, None, 1.0), (98, 7, 1.0, 2.0)]
    want = {}
    for k, i, x, y in points:
        if x is not None and x != INF:
            far = [(round(float(np.sqrt(a * (x - u) ** 2 + 2 * b * (x - u) * (y - v) + c * (y - v) ** 2)), 6), j) for o, j, u, v in sites if o == k and u is not None]
            if far:
                want[k, i] = min(far)
    dp, ds = spark.createDataFrame(points, "g int, point_id int, px double, py double"), spark.createDataFrame(sites, "g int, site_id int, sx double, sy double")
    got = {(r.g, r.point_id): (r.dist, r.site_id) for r in M.nearest(dp, ds, ["g"], metric, M.mahalanobis_least(inv) if inv else 1.0).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-6 for k in want)
    assert M.nearest(dp.limit(0), ds, ["g"], metric).count() == 0 and M.nearest(dp, ds.limit(0), ["g"], metric).count() == 0


def test_mahalanobis_needs_a_positive_form():
    with pytest.raises(ValueError):
        M.mahalanobis_least((1.0, 2.0, 1.0))


def test_overlapping_boxes(spark):
    g = np.random.default_rng(3)
    n = 500
    size = 2.0 ** g.integers(-6, 9, n) * g.uniform(0.5, 1, n)
    img, x, y = np.where(np.arange(n) % 3 == 0, 0, g.integers(1, 9, n)), g.uniform(-300, 300, n), g.uniform(-300, 300, n)
    box = np.stack([x, y, x + size, y + size * g.uniform(0.1, 1, n)], 1)
    box[:40] = np.round(box[:40] / 16) * 16  # sides on the lines of grids, some without area
    rows = [(int(i), k, *map(float, b)) for k, (i, b) in enumerate(zip(img, box))] + [(0, 900, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "img_id int, box_id int, x1 double, y1 double, x2 double, y2 double")
    got = [(r.abox_id, r.bbox_id) for r in M.pairwise(df, df).collect()]
    want = {(i, j) for i in range(n) for j in range(n) if img[i] == img[j] and min(box[i, 2], box[j, 2]) > max(box[i, 0], box[j, 0]) and min(box[i, 3], box[j, 3]) > max(box[i, 1], box[j, 1])}
    assert len(got) == len(set(got)) and set(got) == want
    assert M.pairwise(df, df.limit(0)).count() == 0


def test_nearest_takes_the_way_down_by_tiles(spark):
    """every point went down the pyramid by itself, so the first join had 64 rows a point."""
    g = np.random.default_rng(2)
    p, s = g.uniform(0, 100, (3000, 2)), g.uniform(0, 100, (300, 2))
    dp = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(p)], "g int, point_id int, px double, py double")
    ds = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(s)], "g int, site_id int, sx double, sy double")
    seen = []
    metric = lambda dx, dy: seen.append((dx._jc.toString(), dy._jc.toString())) or F.sqrt(dx * dx + dy * dy)
    got = {r.point_id: r.site_id for r in M.nearest(dp, ds, ["g"], metric).collect()}
    assert got == {i: int(np.argmin(((s - q) ** 2).sum(1))) for i, q in enumerate(p)}
    # a point's own place (px, py without a number) is compared with sites only, never with the boxes on the way
    assert sum("px1" not in a and "px2" not in a for a, _ in seen) == 1


def test_mahalanobis_axes_are_below_the_distance():
    wx, wy = M.mahalanobis_axes((0.5, 0.25, 5.0))
    for t in np.linspace(0, 2 * np.pi, 99):
        x, y = np.cos(t), np.sin(t)
        assert np.hypot(wx * x, wy * y) <= np.sqrt(0.5 * x * x + 0.5 * x * y + 5 * y * y) + 1e-12
