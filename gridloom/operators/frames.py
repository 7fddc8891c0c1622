"""Comparison of two arrays, scaling and layout of frames, overlays, switches and per-row errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.cells import KEY


def diff_cells(pairs: DataFrame, tolerance: float) -> DataFrame:
    """pairs: img_id, y, x, a, b. The cells whose absolute difference, in doubles, is over the tolerance, with it."""
    d = F.abs(F.col("a").cast("double") - F.col("b").cast("double"))
    return pairs.withColumn("diff", d).where(F.col("diff") > tolerance).select("img_id", "y", "x", "a", "b", "diff")


def seeded_sample(rows: DataFrame, by: str, key: list[str], n: int, seed: int) -> DataFrame:
    """n rows of each group, drawn by a hash of their key and the seed, so that reruns agree."""
    draw = F.md5(F.concat_ws("/", F.lit(seed).cast("string"), *(F.col(k).cast("string") for k in [by, *key])))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(draw))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def unit_scaled(cells: DataFrame, eps: float = 1e-9) -> DataFrame:
    """(v - min) / (max - min + eps) for each image."""
    ends = cells.groupBy("img_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return cells.join(ends, "img_id").select(*KEY, ((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo") + eps)).alias("v"))


def standardised(cells: DataFrame, mean: list[float], std: list[float]) -> DataFrame:
    """(v - mean) / std with one mean and deviation per channel."""
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("c") + 1)
    return cells.withColumn("v", (F.col("v") - of(mean)) / of(std))


def channel_spread(planes: DataFrame) -> DataFrame:
    """planes: img_id, c0, c1, c2. Mean of the variances of the three differences between channels."""
    pairs = (("c0", "c1"), ("c1", "c2"), ("c2", "c0"))
    return planes.groupBy("img_id").agg((sum((F.var_pop(F.col(a) - F.col(b)) for a, b in pairs[1:]), F.var_pop(F.col("c0") - F.col("c1"))) / 3).alias("variance"))


def planar(cells: DataFrame, channels: int) -> DataFrame:
    """Place of each cell in channel-by-channel order (c, y, x) beside its place in cell-by-cell order (y, x, c)."""
    size = cells.groupBy("img_id").agg((F.max("y") + 1).cast("long").alias("h"), (F.max("x") + 1).cast("long").alias("w"))
    hwc = (F.col("y") * F.col("w") + F.col("x")) * channels + F.col("c")
    chw = (F.col("c") * F.col("h") + F.col("y")) * F.col("w") + F.col("x")
    return cells.join(size, "img_id").select("img_id", hwc.alias("hwc"), chw.alias("chw"), "v")


def overlay(cells: DataFrame, boxes: DataFrame, alpha: float) -> DataFrame:
    """Alpha blend of the value of the topmost box (img_id, box_id, x1, y1, x2, y2, fill; largest id) over each cell it covers.

    Boxes are cut to rows and joined by (image, row), so a cell meets only the boxes of its row."""
    spans = boxes.select("img_id", "box_id", "x1", "x2", "fill", F.explode(F.sequence("y1", "y2")).alias("y"))
    rows = cells.groupBy("img_id", "c", "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("row"))
    tops = spans.groupBy("img_id", "y").agg(F.sort_array(F.collect_list(F.struct("box_id", "x1", "x2", "fill")), asc=False).alias("over"))

    def blended(r: Column) -> Column:
        hit = F.get(F.filter("over", lambda b: (b["x1"] <= r["x"]) & (b["x2"] >= r["x"])), F.lit(0))
        return F.struct(r["x"].alias("x"), F.coalesce(r["v"] * (1 - alpha) + hit["fill"] * alpha, r["v"].cast("double")).alias("v"))

    met = rows.join(tops, ["img_id", "y"], "left")
    return met.select("img_id", "y", "c", F.explode(F.transform("row", blended)).alias("o")).select("img_id", "y", F.col("o.x").alias("x"), "c", F.col("o.v").alias("v"))


def split_rows(rows: DataFrame, key: str, share: int = 4, seed: int = 0) -> DataFrame:
    """part: test for about one row in ``share``, drawn by a hash of the key, train for the others."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("part", F.when(draw % share == 0, "test").otherwise("train"))


def switched(rows: DataFrame, switches: DataFrame, ability: str) -> DataFrame:
    """Rows whose ability is switched on. switches: ability, enabled; abilities that aren't listed are off."""
    return rows.join(switches.where("enabled").select(F.col("ability").alias(ability)).distinct(), ability, "left_semi")


def isolated(rows: DataFrame, **rules: Callable[[], Column]) -> DataFrame:
    """Each rule's value and, where it has none, its name in ``failed``: one rule's failure leaves the row and the other values."""
    out = rows.select("*", *(r().alias(n) for n, r in rules.items()))
    return out.withColumn("failed", F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in rules))))
