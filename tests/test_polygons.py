"""Overlaps of quadrilaterals, locality-aware suppression and the adaptive assignment against plain loops."""

import math
import statistics

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import match as M
from gridloom.operators import polygons as P


def area(p):
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(p, p[1:] + p[:1])) / 2


def common(p, q):
    """Area that two convex polygons share, by cutting one at each side of the other."""
    p, q = (x if area(x) > 0 else x[::-1] for x in (p, q))
    for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1]):
        left = lambda c: (bx - ax) * (c[1] - ay) - (by - ay) * (c[0] - ax)  # noqa: B023, E731
        out = []
        for c, d in zip(p, p[1:] + p[:1]):
            u, v = left(c), left(d)
            if u >= 0:
                out.append(c)
            if (u > 0 > v) or (u < 0 < v):
                out.append((c[0] + (d[0] - c[0]) * u / (u - v), c[1] + (d[1] - c[1]) * u / (u - v)))
        p = out
        if not p:
            return 0.0
    return area(p)


def iou(a, b):
    p, q = ([(x[k], x[k + 1]) for k in (0, 2, 4, 6)] for x in (a, b))
    i = common(p, q)
    return i / (abs(area(p)) + abs(area(q)) - i)


def turned(r, n, spread):
    out = []
    for _ in range(n):
        cx, cy, w, h, t = *r.uniform(0, spread, 2), *r.uniform(2, 9, 2), r.uniform(0, 7)
        c, s = math.cos(t), math.sin(t)
        q = [(cx + u * w * c - v * h * s, cy + u * w * s + v * h * c) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        out.append([z for p in (q if r.random() < 0.5 else q[::-1]) for z in p])
    return np.array(out)


def test_overlaps_of_convex_ones():
    r = np.random.default_rng(1)
    a, b = turned(r, 400, 12), turned(r, 400, 12)
    b[:40] = a[:40]  # the same
    b[40:60] = np.roll(a[40:60], 2, 1)  # from another corner
    b[60:80] = a[60:80] + 1000.0  # far away
    assert np.allclose(P.overlaps(a, b), [iou(x, y) for x, y in zip(a.tolist(), b.tolist())], atol=1e-9)
    assert np.allclose(P.overlaps(a[:60], b[:60]), 1) and (P.overlaps(a[60:80], b[60:80]) == 0).all()
    side = np.array([[0.0, 0, 2, 0, 2, 2, 0, 2]])
    assert P.overlaps(side, side + [[2, 0] * 4])[0] == 0 and abs(P.overlaps(side, side + [[1, 0] * 4])[0] - 1 / 3) < 1e-12


def test_inward_corners_and_what_does_not_count():
    arrow = [0.0, 0, 4, 0, 1, 1, 0, 4]  # an inward corner at (1, 1)
    square = [0.0, 0, 4, 0, 4, 4, 0, 4]
    crossed, flat, lost = [0.0, 0, 4, 4, 4, 0, 0, 4], [0.0, 0, 1, 1, 2, 2, 3, 3], [0.0, 0, 4, 0, math.nan, 4, 0, 4]
    assert P.areas(np.array([arrow, arrow[6:] + arrow[:6], square, crossed, flat, lost])).tolist() == [4, 4, 16, 0, 0, 0]
    for k in range(0, 8, 2):
        turn = arrow[k:] + arrow[:k]
        assert abs(P.overlaps(np.array([turn]), np.array([square]))[0] - 4 / 16) < 1e-12 and abs(P.overlaps(np.array([square]), np.array([turn]))[0] - 4 / 16) < 1e-12
    assert (P.overlaps(np.array([crossed, flat, lost]), np.array([square] * 3)) == 0).all()
    corner = [1.0, 1, 4, 1, 4, 4, 1, 4]  # in the arrow's notch
    assert P.overlaps(np.array([arrow]), np.array([corner]))[0] < 1e-12


def loop_nms(rows, threshold):
    kept = []
    for i, q, s in sorted(rows, key=lambda x: (min(x[1][1::2]), min(x[1][::2]), x[0])):
        if kept and iou(kept[-1][1], q) > threshold:
            j, p, t = kept[-1]
            kept[-1] = (j, [(u * t + v * s) / (t + s) for u, v in zip(p, q)], t + s)
        else:
            kept.append((i, q, s))
    out = []
    for row in sorted(kept, key=lambda x: (-x[2], x[0])):
        if all(iou(row[1], o[1]) <= threshold for o in out):
            out.append(row)
    return out


def test_locality_suppression(spark):
    r = np.random.default_rng(2)
    quads, rows = turned(r, 240, 30).tolist(), []
    for i, q in enumerate(quads):
        rows.append((int(i % 5 // 2), int(i % 2), i, q, float(r.uniform(0.1, 1))))
    odd = [(0, 0, 900, None, 0.5), (0, 0, 901, [1.0] * 6, 0.5), (0, 0, 902, [1.0] * 7 + [math.inf], 0.5), (9, 0, 903, quads[0], None)]
    df = spark.createDataFrame(rows + odd, "img_id int, cls int, box_id long, quad array<double>, score double").withColumn("more", F.lit(1))
    got = {(q.img_id, q.cls, q.box_id): (q.quad, q.score) for q in P.locality_nms_quads(df, 0.2).collect()}
    want = {}
    for g in {x[:2] for x in rows}:
        want |= {(*g, i): (q, s) for i, q, s in loop_nms([x[2:] for x in rows if x[:2] == g], 0.2)}
    assert got.keys() == want.keys() and len(got) < 240
    assert all(np.allclose(got[k][0], want[k][0]) and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert P.locality_nms_quads(df.limit(0), 0.2).count() == 0


def test_adaptive_assignment(spark):
    """Nearest two of each level, strictly above the threshold; an anchor claimed twice goes to the truth it overlaps most."""
    r = np.random.default_rng(3)
    box = lambda n, w: [(*(round(float(v), 2) for v in r.uniform(0, 20, 2)), *(round(float(v), 2) for v in r.uniform(*w, 2))) for _ in range(n)]
    t = [(int(i % 3), i, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(box(24, (8, 14)))]
    a = [(int(i % 3), i, x, y, x + w, y + h, int(i % 4)) for i, (x, y, w, h) in enumerate(box(150, (4, 12)))]
    share = lambda p, q: (lambda i: round(i / max((p[4] - p[2]) * (p[5] - p[3]) + (q[4] - q[2]) * (q[5] - q[3]) - i, 1e-6), 6))(max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3])))
    claims = {}
    for p in t:
        mid = lambda b: ((b[2] + b[4]) / 2, (b[3] + b[5]) / 2)
        near = [q for lv in range(4) for q in sorted((q for q in a if q[0] == p[0] and q[6] == lv), key=lambda q: (round(math.dist(mid(p), mid(q)), 6), q[1]))[:2]]  # noqa: B023
        over = [share(p, q) for q in near]
        for q, o in zip(near, over):
            if o > round(statistics.mean(over) + statistics.stdev(over), 6) and p[2] < mid(q)[0] < p[4] and p[3] < mid(q)[1] < p[5]:
                claims.setdefault((q[0], q[1]), []).append(p)
    want = {k: (v[0] if len(v) == 1 else min((p for p in t if p[0] == k[0]), key=lambda p: (-share(p, a[k[1]]), p[1])))[1] for k, v in claims.items()}  # noqa: B023
    cols = "img_id int, box_id long, x1 double, y1 double, x2 double, y2 double"
    got = M.atss(spark.createDataFrame(t, cols), spark.createDataFrame(a, cols + ", level int"), 2, "level").collect()
    assert {(q.img_id, q.bbox_id): q.abox_id for q in got} == want and len(got) == len(want) > 5
    assert any(len(v) > 1 for v in claims.values())
