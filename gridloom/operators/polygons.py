"""Quadrilaterals: areas, overlaps and locality-aware suppression, vectorised over pairs.

A quadrilateral is eight numbers, x and y of its corners in turn, in either direction. It counts if it has an area and its sides
don't cross; one that doesn't count overlaps nothing. It is cut into two triangles at its inward corner, if it has one, so corners
may point inwards; triangles are clipped half-plane by half-plane.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.detect import greedy, merge_along, per_group


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def _shoelace(p: np.ndarray) -> np.ndarray:
    """Signed areas of polygons (..., corners, 2), measured from their first corner."""
    p = p - p[..., :1, :]
    q = np.roll(p, -1, -2)
    return (p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]).sum(-1) / 2


def _clip(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Convex polygons (n, m, 2), cut by the half-planes left of a to b (n, 2): (n, as many corners as the largest has, 2); the last
    corner is repeated where fewer are left, and all are a where none is."""
    side = _cross(a[:, None], b[:, None], p)
    q, there = np.roll(p, -1, 1), np.roll(side, -1, 1)
    here, after = side >= 0, there >= 0
    gap = side - there
    at = p + (q - p) * (side / np.where(gap == 0, 1, gap))[..., None]
    valid = np.empty((len(p), 2 * p.shape[1]), bool)  # in turn: the corner itself, where its side crosses the line
    valid[:, ::2], valid[:, 1::2] = here, here != after
    both = np.empty((*valid.shape, 2))
    both[:, ::2], both[:, 1::2] = p, at
    place, n = np.cumsum(valid, 1), valid.sum(1)
    row, col = np.nonzero(valid)
    out = np.empty((len(p), max(int(n.max(initial=0)), 1), 2))
    final = both[np.arange(len(p)), valid.shape[1] - 1 - valid[:, ::-1].argmax(1)]
    out[:] = np.where((n > 0)[:, None], final, a)[:, None]
    out[row, place[row, col] - 1] = both[row, col]
    return out


def _triangles(quads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2, 3, 2) triangles, corners anticlockwise, and the areas (n): 0 for a quadrilateral that doesn't count."""
    p = quads.reshape(-1, 4, 2).astype(float)
    p = np.where((_shoelace(p) < 0)[:, None, None], p[:, ::-1], p)
    area = _shoelace(p)
    turn = _cross(np.roll(p, 1, 1), p, np.roll(p, -1, 1))
    inward = turn.argmin(1)  # the cut starts there
    p = np.take_along_axis(p, ((inward[:, None] + np.arange(4)) % 4)[..., None], 1)
    pair = p[:, [[0, 1, 2], [0, 2, 3]]]
    fine = np.isfinite(area) & (area > 0) & (_shoelace(pair) >= 0).all(1)
    return np.where(fine[:, None, None, None], pair, 0.0), np.where(fine, area, 0.0)


def areas(quads: np.ndarray) -> np.ndarray:
    """Areas of quadrilaterals (n, 8)."""
    return _triangles(quads)[1]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each quadrilateral of a (n, 8) and the one of b (n, 8) in its row."""
    near = np.ones(len(a), bool)  # those whose bounding boxes have a common area
    for k in (0, 1):
        near &= np.minimum(a[:, k::2].max(1), b[:, k::2].max(1)) > np.maximum(a[:, k::2].min(1), b[:, k::2].min(1))
    out = np.zeros(len(a))
    if not near.any():
        return out
    (s, area_a), (t, area_b) = _triangles(a[near]), _triangles(b[near])
    both = np.zeros(len(s))
    for i in range(2):
        for j in range(2):
            part = s[:, i]
            for k in range(3):
                part = _clip(part, t[:, j, k], t[:, j, (k + 1) % 3])
            both += np.maximum(_shoelace(part), 0)
    both = np.where((area_a > 0) & (area_b > 0), both, 0.0)
    union = area_a + area_b - both
    out[near] = np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)
    return out


def quad_overlap(a: str, b: str):
    """Column: intersection over union of two columns of eight numbers; 0 with a null or another number of them."""

    @F.pandas_udf("double")
    def found(x: pd.Series, y: pd.Series) -> pd.Series:
        whole = np.array([u is not None and v is not None and len(u) == len(v) == 8 for u, v in zip(x, y)], bool)
        out = np.zeros(len(x))
        if whole.any():
            out[whole] = overlaps(np.stack(x[whole].tolist()).astype(float), np.stack(y[whole].tolist()).astype(float))
        return pd.Series(out)

    return found.asNondeterministic()(a, b)  # so that a filter on it isn't pushed below, which would work it out twice


def merged(group: np.ndarray, quads: np.ndarray, score: np.ndarray, threshold: float) -> np.ndarray:
    """Places kept by one pass in the order given, group by group: a quadrilateral that overlaps the one before by more than threshold is
    averaged into it, by score (in place); their scores add up."""

    def blend(i: np.ndarray, j: np.ndarray) -> None:
        total, (a, b) = score[i] + score[j], (score[i], score[j])
        mean = (quads[i] * a[:, None] + quads[j] * b[:, None]) / np.where(total == 0, 1, total)[:, None]
        quads[i] = np.where(total[:, None] == 0, quads[i], mean)
        score[i] = total

    return merge_along(group, lambda i, j: overlaps(quads[i], quads[j]), blend, threshold)


def locality_nms_quads(quads: DataFrame, threshold: float) -> DataFrame:
    """img_id, cls, box_id, quad, score: the quadrilaterals of an image and class, in reading order (topmost corner, leftmost corner, id),
    are merged into their predecessor while they overlap, then suppressed. Rows with a null, a value that isn't finite or other than
    eight numbers are left out.

    One image and class is one group (as many as a detector gives for an image); many groups are worked on at once."""

    def work(group: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        ids, x, s = columns
        order = np.lexsort((ids, x[:, ::2].min(1), x[:, 1::2].min(1), group))
        group, ids, x, s = group[order], ids[order], x[order], s[order]
        kept = merged(group, x, s, threshold)
        kept = kept[np.lexsort((ids[kept], -s[kept], group[kept]))]
        kept = kept[greedy(group[kept], lambda i, j: overlaps(x[kept[i]], x[kept[j]]), threshold)]
        return order[kept], [ids[kept], x[kept], s[kept]]

    finite = F.forall("quad", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & (F.size("quad") == 8)
    whole = quads.where(finite & (F.abs("score") < float("inf")) & F.col("box_id").isNotNull())
    return per_group(whole, {"box_id": "long", "quad": "array<double>", "score": "double"}, work)
