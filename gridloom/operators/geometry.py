"""Re-indexing and resampling of cells: flips, rotations, borders, resizes, gathers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.cells import border_index, from_rows, shape, to_rows, with_shape


def _moved(cells: DataFrame, y: Column, x: Column) -> DataFrame:
    return with_shape(cells).select("img_id", y.cast("int").alias("y"), x.cast("int").alias("x"), "c", "v")


def flip(cells: DataFrame, how: str) -> DataFrame:
    return _moved(cells, F.col("h") - 1 - F.col("y") if how in ("VERTICAL", "BOTH") else F.col("y"), F.col("w") - 1 - F.col("x") if how in ("HORIZONTAL", "BOTH") else F.col("x"))


def rotate(cells: DataFrame, angle: int) -> DataFrame:
    """90 is clockwise, 270 counter-clockwise."""
    return _moved(cells, *{90: (F.col("x"), F.col("h") - 1 - F.col("y")), 180: (F.col("h") - 1 - F.col("y"), F.col("w") - 1 - F.col("x")), 270: (F.col("w") - 1 - F.col("x"), F.col("y"))}[angle])


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select("img_id", F.col("x").alias("y"), F.col("y").alias("x"), "c", "v")


def grid(sizes: DataFrame, h: Column, w: Column) -> DataFrame:
    """All places (y, x) of an h by w array for each row of sizes."""
    return sizes.withColumn("y", F.explode(F.sequence(F.lit(0), h.cast("int") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), w.cast("int") - 1)))


def channels(cells: DataFrame) -> DataFrame:
    return cells.select("img_id", "c").distinct()


def gather(places: DataFrame, cells: DataFrame) -> DataFrame:
    """places (img_id, c, y, x, sy, sx): v of the source cell; null where there is none."""
    src = cells.select("img_id", "c", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return places.join(src, ["img_id", "c", "sy", "sx"], "left").select("img_id", "y", "x", "c", "v")


def make_border(cells: DataFrame, top: int, bottom: int, left: int, right: int, border: str, value: float = 0) -> DataFrame:
    g = grid(shape(cells).join(channels(cells), "img_id"), F.col("h") + top + bottom, F.col("w") + left + right)
    g = g.withColumn("sy", border_index(F.col("y") - top, F.col("h"), border)).withColumn("sx", border_index(F.col("x") - left, F.col("w"), border))
    out = gather(g, cells)
    return out.withColumn("v", F.coalesce("v", F.lit(value))) if border == "CONSTANT" else out


def resize_nearest(cells: DataFrame, oh: int, ow: int) -> DataFrame:
    g = grid(shape(cells).join(channels(cells), "img_id"), F.lit(oh), F.lit(ow))
    sy = F.least(F.floor(F.col("y") * (F.col("h").cast("double") / oh)), F.col("h") - 1).cast("int")
    sx = F.least(F.floor(F.col("x") * (F.col("w").cast("double") / ow)), F.col("w") - 1).cast("int")
    return gather(g.withColumn("sy", sy).withColumn("sx", sx), cells)


def _resampled(cells: DataFrame, oh: int, ow: int, taps: tuple[int, ...], weight: Callable[[Column, int], Column]) -> DataFrame:
    """Pixel-centre mapping, clamped at the edges: cells weighted by weight(fraction, tap) down and across.

    An output row gets the few source rows it needs as arrays, by (image, row); it is blended down and then resampled across in
    expressions over arrays, so cells are never joined one by one."""
    rows = to_rows(cells)
    sizes = cells.groupBy("img_id", "c").agg((F.max("y") + 1).alias("h"))
    fy = (F.col("y") + 0.5) * F.col("h") / oh - 0.5
    want = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(oh - 1)))).withColumn("fy", fy)
    down = F.array(*(F.struct(F.lit(t).alias("t"), F.least(F.greatest(F.floor("fy") + t, F.lit(0)), F.col("h") - 1).cast("int").alias("s"), weight(F.col("fy") - F.floor("fy"), t).alias("k")) for t in taps))
    want = want.withColumn("d", F.explode(down)).select("img_id", "c", "y", "d.t", "d.k", F.col("d.s").alias("sy"))
    met = want.join(rows.select("img_id", "c", F.col("y").alias("sy"), "row"), ["img_id", "c", "sy"])
    met = met.groupBy("img_id", "c", "y").agg(F.sort_array(F.collect_list(F.struct("t", "k", "row"))).alias("m"))
    at = lambda n, x: F.get(F.get("m", F.lit(n))["row"], x) * F.get("m", F.lit(n))["k"]
    blend = F.transform(F.sequence(F.lit(0), F.size(F.get("m", F.lit(0))["row"]) - 1), lambda x: sum((at(n, x) for n in range(1, len(taps))), at(0, x)))
    met = met.select("img_id", "c", "y", F.explode(F.array(blend)).alias("b"))  # worked out once a row

    def across(x: Column) -> Column:
        fx = (x + 0.5) * F.size("b") / ow - 0.5
        one = lambda t: F.get("b", F.least(F.greatest(F.floor(fx) + t, F.lit(0)), F.size("b") - 1).cast("int")) * weight(fx - F.floor(fx), t)
        return sum((one(t) for t in taps[1:]), one(taps[0]))

    return from_rows(met.select("img_id", "c", "y", F.transform(F.sequence(F.lit(0), F.lit(ow - 1)), across).alias("row")))


def resize_linear(cells: DataFrame, oh: int, ow: int) -> DataFrame:
    return _resampled(cells, oh, ow, (0, 1), lambda d, t: d if t else 1 - d)


def _cubic(x: Column) -> Column:
    """Cubic weight with a = -0.75."""
    a = F.abs(x)
    return F.when(a <= 1, 1 - 2.25 * a * a + 1.25 * a * a * a).when(a < 2, 3 - 6 * a + 3.75 * a * a - 0.75 * a * a * a).otherwise(0.0)


def resize_cubic(cells: DataFrame, oh: int, ow: int) -> DataFrame:
    return _resampled(cells, oh, ow, (-1, 0, 1, 2), lambda d, t: _cubic(d - t))


def resize_area(cells: DataFrame, factor: int) -> DataFrame:
    """Block means for a whole factor of reduction."""
    return cells.groupBy("img_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x"), "c").agg(F.avg("v").alias("v"))


def resize_area_to(cells: DataFrame, oh: int, ow: int) -> DataFrame:
    """Means over the source area of each output cell, cells on its rim counted by the part that it covers. An image that isn't
    larger than the output in both directions is resized linearly instead.

    Source rows go, by (image, row), to the few output rows they lie in, and are gathered across in expressions over arrays."""
    sizes = shape(cells)
    large = sizes.where((F.col("h") >= oh) & (F.col("w") >= ow)).select("img_id")
    rows = to_rows(cells.join(large, "img_id", "left_semi")).join(sizes, "img_id")
    step = F.col("h") / F.lit(float(oh))
    to = F.sequence(F.floor(F.col("y") / step).cast("int"), F.least(F.ceil((F.col("y") + 1) / step).cast("int") - 1, F.lit(oh - 1)))
    sent = rows.withColumn("o", F.explode(to)).withColumn("k", F.least(F.col("y") + 1.0, (F.col("o") + 1) * step) - F.greatest(F.col("y") + 0.0, F.col("o") * step))
    met = sent.where("k > 1e-9").groupBy("img_id", "c", "o", "h", "w").agg(F.collect_list(F.struct("k", "row")).alias("m"))
    down = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda x: F.aggregate("m", F.lit(0.0), lambda t, r: t + r["k"] * F.get(r["row"], x)))
    met = met.select("img_id", "c", F.col("o").alias("y"), "h", "w", F.explode(F.array(down)).alias("b"))
    wide = F.col("w") / F.lit(float(ow))

    def across(x: Column) -> Column:
        first, last = F.floor(x * wide).cast("int"), F.least(F.ceil((x + 1) * wide).cast("int") - 1, F.col("w") - 1)
        part = lambda t, s: t + F.get("b", s) * F.greatest(F.least(s + 1.0, (x + 1) * wide) - F.greatest(s + 0.0, x * wide), F.lit(0.0))
        return F.aggregate(F.sequence(first, last), F.lit(0.0), part) / (F.col("h") / F.lit(float(oh)) * wide)

    out = from_rows(met.select("img_id", "c", "y", F.transform(F.sequence(F.lit(0), F.lit(ow - 1)), across).alias("row")))
    return out.unionByName(resize_linear(cells.join(large, "img_id", "left_anti"), oh, ow))


def remap_linear(places: DataFrame, cells: DataFrame) -> DataFrame:
    """places (img_id, c, y, x, my, mx): bilinear gather at (my, mx), weights in 32nds rounded half to even; outside is 0.

    The places of one output row that fall between the same two source rows go together (at most a row's width) and meet those
    two as arrays."""
    fy, fx = F.bround(F.col("my") * 32, 0), F.bround(F.col("mx") * 32, 0)
    p = places.withColumn("iy", F.floor(fy / 32).cast("int")).withColumn("ix", F.floor(fx / 32).cast("int"))
    p = p.withColumn("dy", fy / 32 - F.col("iy")).withColumn("dx", fx / 32 - F.col("ix"))
    held = p.groupBy("img_id", "c", "y", "iy").agg(F.collect_list(F.struct("x", "ix", "dy", "dx")).alias("at"))
    rows = to_rows(cells)
    two = rows.select("img_id", "c", F.col("y").alias("iy"), F.col("row").alias("upper"), F.lit(None).cast("array<double>").alias("lower"))
    two = two.unionByName(rows.select("img_id", "c", (F.col("y") - 1).alias("iy"), F.lit(None).cast("array<double>").alias("upper"), F.col("row").alias("lower")))
    two = two.groupBy("img_id", "c", "iy").agg(F.first("upper", True).alias("upper"), F.first("lower", True).alias("lower"))
    met = held.join(two, ["img_id", "c", "iy"], "left")

    def blend(a: Column) -> Column:
        cell = lambda row, i: F.coalesce(F.when(i >= 0, F.get(row, i)), F.lit(0.0))
        ends = lambda row: cell(row, a["ix"]) * (1 - a["dx"]) + cell(row, a["ix"] + 1) * a["dx"]
        return F.struct(a["x"].alias("x"), (ends("upper") * (1 - a["dy"]) + ends("lower") * a["dy"]).alias("v"))

    return met.select("img_id", "y", "c", F.explode(F.transform("at", blend)).alias("o")).select("img_id", "y", F.col("o.x").alias("x"), "c", F.col("o.v").alias("v"))


def remap_nearest(places: DataFrame, cells: DataFrame, border: str, value: float = 0) -> DataFrame:
    """places (img_id, c, y, x, my, mx): the cell nearest to (my, mx) (halves go up), beyond the edges by the border rule."""
    p = places.join(shape(cells).select("img_id", F.col("h").alias("sh"), F.col("w").alias("sw")), "img_id")
    near = lambda m, n: border_index(F.floor(F.col(m) + 0.5).cast("int"), F.col(n), border)
    out = gather(p.withColumn("sy", near("my", "sh")).withColumn("sx", near("mx", "sw")), cells)
    return out.withColumn("v", F.coalesce("v", F.lit(value))) if border == "CONSTANT" else out


def upsample_nearest(cells: DataFrame, factor: int) -> DataFrame:
    """Every cell as a block of factor by factor cells."""
    k = F.sequence(F.lit(0), F.lit(factor - 1))
    out = cells.withColumn("a", F.explode(k)).withColumn("b", F.explode(k))
    return out.select("img_id", (F.col("y") * factor + F.col("a")).alias("y"), (F.col("x") * factor + F.col("b")).alias("x"), "c", "v")


def warp(cells: DataFrame, m: list[list[float]]) -> DataFrame:
    """Gather through a 2x3 (affine) or 3x3 (perspective) matrix that maps output to source places."""
    g = grid(shape(cells).join(channels(cells), "img_id"), F.col("h"), F.col("w"))
    mx, my = (F.lit(m[k][0]) * F.col("x") + F.lit(m[k][1]) * F.col("y") + F.lit(m[k][2]) for k in (0, 1))
    if len(m) == 3:
        d = F.lit(m[2][0]) * F.col("x") + F.lit(m[2][1]) * F.col("y") + F.lit(m[2][2])
        mx, my = mx / d, my / d
    return remap_linear(g.withColumn("mx", mx).withColumn("my", my), cells)


def crop(cells: DataFrame, y0: int, x0: int, h: int, w: int, step: int = 1) -> DataFrame:
    part = cells.where((F.col("y") >= y0) & (F.col("y") < y0 + h) & (F.col("x") >= x0) & (F.col("x") < x0 + w) & ((F.col("y") - y0) % step == 0) & ((F.col("x") - x0) % step == 0))
    return part.select("img_id", F.floor((F.col("y") - y0) / step).cast("int").alias("y"), F.floor((F.col("x") - x0) / step).cast("int").alias("x"), "c", "v")


def spiral(cells: DataFrame) -> DataFrame:
    """pos: clockwise spiral order from the top left corner."""
    c = with_shape(cells)
    r = F.least(F.col("y"), F.col("x"), F.col("h") - 1 - F.col("y"), F.col("w") - 1 - F.col("x"))
    c = c.withColumn("r", r).withColumn("ih", F.col("h") - 2 * F.col("r")).withColumn("iw", F.col("w") - 2 * F.col("r"))
    before = F.col("h") * F.col("w") - F.col("ih") * F.col("iw")
    ry, rx = F.col("y") - F.col("r"), F.col("x") - F.col("r")
    ih, iw = F.col("ih"), F.col("iw")
    along = F.when(ry == 0, rx).when(rx == iw - 1, iw - 1 + ry).when(ry == ih - 1, iw - 1 + ih - 1 + (iw - 1 - rx)).otherwise(2 * (iw - 1) + ih - 1 + (ih - 1 - ry))
    return c.select("img_id", (before + along).cast("int").alias("pos"), "v")
