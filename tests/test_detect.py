"""Suppression of many groups at once against plain loops, and its number of steps."""

import numpy as np
import pytest

from gridloom.operators import detect as D
from gridloom.operators import polygons as P

SCHEMA = "img_id long, cls int, box_id long, x1 double, y1 double, x2 double, y2 double, score double"


def drawn(n):
    g = np.random.default_rng(5)
    at = g.integers(0, 12, (n, 2)).astype(float)
    img = np.where(np.arange(n) % 3 == 0, 0, g.integers(1, 60, n))  # one image has a third of the boxes
    rows = [(int(i), int(c), k, *map(float, (x, y, x + w, y + 4, s))) for k, (i, c, (x, y), w, s) in enumerate(zip(img, g.integers(0, 2, n), at, g.uniform(3, 9, n), g.integers(1, 9, n) / 8))]
    return rows + [(None, 1, 9000, 0.0, 0.0, 4.0, 4.0, 0.5), (None, 1, 9001, 0.0, 0.0, 4.0, 4.0, 0.75), (70, None, 9002, 0.0, 0.0, 4.0, 4.0, None)]


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


def strongest(b):
    return (b[5] is None, -(b[5] or 0), b[0])


def hard(boxes):
    kept = []
    for b in sorted(boxes, key=strongest):
        if all(iou(b[1:], k[1:]) <= 0.3 for k in kept):
            kept.append(b)
    return kept


def soft(boxes):
    left, kept = list(boxes), []
    while left:
        left.sort(key=strongest)
        k, *left = left
        kept.append(k)
        left = [b for b in ([*b[:5], b[5] * np.exp(-(iou(k[1:], b[1:]) ** 2) / 0.5)] for b in left) if b[5] >= 0.001]
    return kept


def local(boxes):
    kept = []
    for b in sorted(map(list, boxes), key=lambda b: (b[2], b[1], b[0])):
        if kept and iou(kept[-1][1:], b[1:]) > 0.3:
            k = kept[-1]
            total = k[5] + b[5]
            kept[-1] = [k[0], *((u * k[5] + v * b[5]) / total for u, v in zip(k[1:5], b[1:5])), total]
        else:
            kept.append(b)
    return hard(kept)


@pytest.mark.parametrize("run, plain", [(lambda d: D.nms(d, 0.3), hard), (lambda d: D.soft_nms(d, "gaussian"), soft), (lambda d: D.locality_nms(d, 0.3), local)])
def test_suppression(spark, run, plain, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 50)  # several parts, and groups larger than one
    rows, groups = drawn(600), {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r[2:])
    want = {(*k, b[0]): b[5] for k, v in groups.items() for b in plain(v)}
    got = {(r.img_id, r.cls, r.box_id): r.score for r in run(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == want.keys()
    assert all((want[k] is None and (got[k] is None or got[k] != got[k])) or abs(got[k] - want[k]) < 1e-9 for k in want)
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_share_their_steps():
    """The number of calls grows with the largest group, not with the number of groups."""
    g = np.random.default_rng(2)
    group = np.sort(g.integers(0, 4000, 12000))
    quads = g.integers(0, 9, (12000, 1, 2)) + np.array([[0, 0], [6, 1], [6, 5], [0, 5]])
    quads, score, calls = quads.reshape(-1, 8).astype(float), g.uniform(0, 1, 12000), []

    def seen(i, j):
        calls.append(len(i))
        return P.overlaps(quads[i], quads[j])

    largest = np.bincount(group).max()
    D.greedy(group, seen, 0.3)
    assert len(calls) <= largest
    calls.clear()
    kept = D.merge_along(group, seen, lambda i, j: None, 0.3)
    assert len(calls) <= largest and len(kept) == len(P.merged(group, quads.copy(), np.zeros(12000), 0.3))
