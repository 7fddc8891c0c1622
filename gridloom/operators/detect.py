"""Detection post-processing and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.numeric import sigmoid


def score(obj: Column, cls: Column) -> Column:
    return sigmoid(obj) * sigmoid(cls)


def decode(gx: Column, gy: Column, tx: Column, ty: Column, tw: Column, th: Column, stride: float, aw: float, ah: float) -> list[Column]:
    """Corner columns of a box given by grid place, offsets and log sizes."""
    cx, cy = (sigmoid(tx) + gx) * stride, (sigmoid(ty) + gy) * stride
    w, h = F.exp(tw) * aw, F.exp(th) * ah
    return [(cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2")]


def anchor_grid(one: DataFrame, strides: list[int], size: int) -> DataFrame:
    """Cell centres for each stride over a size by size image."""
    g = one.select(F.explode(F.array(*map(F.lit, strides))).alias("stride"))
    n = (F.lit(size) / F.col("stride")).cast("int")
    g = g.withColumn("gy", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("gx", F.explode(F.sequence(F.lit(0), n - 1)))
    return g.select("stride", "gy", "gx", ((F.col("gx") + 0.5) * F.col("stride")).alias("cx"), ((F.col("gy") + 0.5) * F.col("stride")).alias("cy"))


FIELDS = ("box_id", "x1", "y1", "x2", "y2", "score")

#: Boxes that are worked on at once in a task, but for a group that has more.
CHUNK = 1 << 17


def _iou(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """IoU of each box of i and the one of j in its place; rows of x: x1, y1, x2, y2, score."""
    a, b = x[:4, i], x[:4, j]
    w = np.maximum(0, np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]))
    h = np.maximum(0, np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]))
    area = (b[2] - b[0]) * (b[3] - b[1])
    return w * h / np.maximum((a[2] - a[0]) * (a[3] - a[1]) + area - w * h, 1e-12)


def first_places(group: np.ndarray) -> np.ndarray:
    """Where each group of a sorted array of them begins."""
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)


def greedy(group: np.ndarray, overlap: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> np.ndarray:
    """Places kept, of rows that are sorted by group and strength: those that overlap no kept one of their group by more than threshold.

    A round keeps the strongest row of every group that is left and drops what it overlaps, so all groups are worked on at once."""
    left, kept = np.arange(len(group)), []
    while len(left):
        first = first_places(group[left])
        n = np.diff(np.r_[first, len(left)])
        kept.append(left[first])
        lead, rest = np.repeat(left[first], n), np.ones(len(left), bool)
        rest[first] = False
        lead, left = lead[rest], left[rest]
        left = left[overlap(lead, left) <= threshold]
    return np.sort(np.concatenate(kept)) if kept else left


def merge_along(group: np.ndarray, overlap: Callable[[np.ndarray, np.ndarray], np.ndarray], blend: Callable[[np.ndarray, np.ndarray], None], threshold: float) -> np.ndarray:
    """Places kept, of rows that are sorted by group and reading order: a row that overlaps the kept one before it by more than threshold
    is blended into it. Step k takes the k-th row of every group."""
    start = first_places(group)
    n = np.diff(np.r_[start, len(group)])
    order = np.argsort(-n, kind="stable")
    start, n, keep = start[order], n[order], np.ones(len(group), bool)
    last = start.copy()
    for k in range(1, int(n[0]) if len(n) else 0):
        m = np.searchsorted(-n, -k)  # the groups with more than k rows come first
        i, j = last[:m], start[:m] + k
        near = overlap(i, j) > threshold
        blend(i[near], j[near])
        keep[j[near]] = False
        last[:m] = np.where(near, i, j)
    return np.flatnonzero(keep)


def per_group(boxes: DataFrame, fields: dict[str, str], work: Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """img_id, cls and the fields (name: type) of what work leaves: work(group, columns) has the rows of whole images and classes, many at
    once, sorted by group (a number), and gives back places of rows and their columns.

    One image and class is one group (as many boxes as a detector gives for an image); groups cross to Python as Arrow lists."""

    def column(c: pa.Array) -> np.ndarray:
        if pa.types.is_list(c.type):
            return column(c.flatten()).reshape(len(c), -1)
        return c.to_numpy(zero_copy_only=False) if pa.types.is_floating(c.type) else c.to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("g").value_lengths().to_numpy(zero_copy_only=False))
            at = 0
            while at < len(ends):
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
                part = batch.slice(at, to - at)
                group = np.repeat(np.arange(at, to), np.diff(np.r_[base, ends[at:to]]))
                places, done = work(group, [column(c) for c in part.column("g").flatten().flatten()])
                owner = pa.array(group[places])
                values = [pa.array(v) if v.ndim == 1 else pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.ravel()) for v in done]
                yield pa.RecordBatch.from_arrays([batch.column(k).take(owner) for k in (0, 1)] + values, ["img_id", "cls", *fields])
                at = to

    g = boxes.groupBy("img_id", "cls").agg(F.collect_list(F.struct(*(F.col(c).cast(k).alias(c) for c, k in fields.items()))).alias("g"))
    kinds = ", ".join(f"{c} {k}" for c, k in [*((c, boxes.schema[c].dataType.simpleString()) for c in ("img_id", "cls")), *fields.items()])
    return g.mapInArrow(run, kinds)


def _per_group(boxes: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """work(group, ids, x) gives the places of the boxes that stay, and their corners and scores."""

    def run(group: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        ids = columns[0]
        places, x = work(group, ids, np.stack(columns[1:]))
        return places, [ids[places], *x]

    return per_group(boxes, {c: "long" if c == "box_id" else "double" for c in FIELDS}, run)


def _greedy(group: np.ndarray, ids: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    order = np.lexsort((ids, -x[4], group))
    return order[greedy(group[order], lambda i, j: _iou(x, order[i], order[j]), threshold)]


def nms(boxes: DataFrame, threshold: float) -> DataFrame:
    """Greedy: by descending score (ties to the smaller box_id), keep a box if its IoU with all kept ones is at most threshold."""

    def work(group: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = _greedy(group, ids, x, threshold)
        return kept, x[:, kept]

    return _per_group(boxes, work)


def soft_nms(boxes: DataFrame, how: str, sigma: float = 0.5, threshold: float = 0.3, least: float = 0.001) -> DataFrame:
    """Scores decay by overlap with stronger boxes: linear, gaussian or hard; boxes under ``least`` go."""

    def decay(o: np.ndarray) -> np.ndarray:
        if how == "gaussian":
            return np.exp(-(o * o) / sigma)
        return np.where(o > threshold, 1 - o if how == "linear" else 0.0, 1.0)

    def work(group: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, kept = np.arange(len(group)), []
        while len(left):  # a round takes the strongest box of every group that is left
            first = first_places(group[left])
            n = np.diff(np.r_[first, len(left)])
            rank = np.where(np.isnan(x[4, left]), -np.inf, x[4, left])
            best = rank == np.repeat(np.maximum.reduceat(rank, first), n)
            best &= ids[left] == np.repeat(np.minimum.reduceat(np.where(best, ids[left], np.iinfo(np.int64).max), first), n)
            top = np.minimum.reduceat(np.where(best, np.arange(len(left)), len(left)), first)
            kept.append(left[top])
            lead, rest = np.repeat(left[top], n), np.ones(len(left), bool)
            rest[top] = False
            lead, left = lead[rest], left[rest]
            x[4, left] *= decay(_iou(x, lead, left))
            left = left[x[4, left] >= least]
        places = np.concatenate(kept) if kept else left
        return places, x[:, places]

    return _per_group(boxes, work)


def locality_nms(boxes: DataFrame, threshold: float) -> DataFrame:
    """Boxes in reading order are merged into their predecessor, weighted by score, while they overlap; then greedy NMS."""

    def work(group: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, x[0], x[1], group))
        x = x[:, order]

        def blend(i: np.ndarray, j: np.ndarray) -> None:
            total = x[4, i] + x[4, j]
            x[:4, i] = np.where(total == 0, x[:4, i], (x[:4, i] * x[4, i] + x[:4, j] * x[4, j]) / np.where(total == 0, 1, total))
            x[4, i] = total

        kept = merge_along(group[order], lambda i, j: _iou(x, i, j), blend, threshold)
        kept = kept[_greedy(group[order][kept], ids[order][kept], x[:, kept], threshold)]
        return order[kept], x[:, kept]

    return _per_group(boxes, work)


def average_precision(hits: DataFrame, truths: DataFrame, by: str) -> DataFrame:
    """hits: by, score, id, hit (0/1). Area under the precision envelope by recall, per class; truths: by, n."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "id")
    h = hits.withColumn("tp", F.sum("hit").over(w)).withColumn("pos", F.row_number().over(w)).join(truths, by)
    h = h.withColumn("precision", F.col("tp") / F.col("pos")).withColumn("recall", F.col("tp") / F.col("n"))
    back = Window.partitionBy(by).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("envelope", F.max("precision").over(back))
    step = F.col("recall") - F.coalesce(F.lag("recall").over(Window.partitionBy(by).orderBy("pos")), F.lit(0.0))
    return h.withColumn("part", step * F.col("envelope")).groupBy(by).agg(F.sum("part").alias("ap"))


def eleven_point(hits: DataFrame, truths: DataFrame, by: str) -> DataFrame:
    """The older form of average precision: the mean of the best precision at recall 0, 0.1, ..., 1 or more."""
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "id")
    h = hits.withColumn("tp", F.sum("hit").over(w)).withColumn("pos", F.row_number().over(w)).join(truths, by)
    h = h.select(by, (F.col("tp") / F.col("pos")).alias("precision"), (F.col("tp") * 10).alias("reached"), "n")
    at = h.withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.col("reached") / F.col("n")).cast("int"))))
    return at.groupBy(by, "level").agg(F.max("precision").alias("best")).groupBy(by).agg((F.sum("best") / 11).alias("ap"))


def mean_average_precision(hits: DataFrame, truths: DataFrame, by: str, at: list[float]) -> DataFrame:
    """hits with an overlap instead of hit: average precision per class at each threshold of the overlap, and their mean (one row)."""
    each = [average_precision(hits.withColumn("hit", (F.col("overlap") >= t).cast("int")), truths, by).withColumn("at", F.lit(t)) for t in at]
    return reduce(lambda a, b: a.union(b), each).agg(F.avg("ap").alias("map"), F.count(F.lit(1)).alias("n"))
