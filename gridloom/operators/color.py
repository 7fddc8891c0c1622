"""Colour conversion of pixels held as one column per channel (b, g, r or y, u, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import sat
from gridloom.operators.cells import neighbourhood


def gray(b: Column, g: Column, r: Column) -> Column:
    """Fixed-point luma with weights 0.114, 0.587, 0.299 in 15 bits, rounded."""
    return F.shiftright(b * 3735 + g * 19235 + r * 9798 + (1 << 14), 15)


def yuv_to_rgb(y: Column, u: Column, v: Column, full: bool = False) -> tuple[Column, Column, Column]:
    """Limited range (1.164, 1.596, -0.813, -0.391, 2.018) or full range (1.0, 1.403, -0.714, -0.343, 1.770)."""
    ky, rv, gv, gu, bu = (1.0, 1.403, -0.714, -0.343, 1.770) if full else (1.164, 1.596, -0.813, -0.391, 2.018)
    l = F.lit(ky) * (y if full else F.greatest(y - 16, F.lit(0)))  # noqa: E741
    return sat(l + F.lit(rv) * (v - 128), "U8"), sat(l + F.lit(gv) * (v - 128) + F.lit(gu) * (u - 128), "U8"), sat(l + F.lit(bu) * (u - 128), "U8")


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Full range: luma 0.299, 0.587, 0.114; chroma differences scaled by 0.564 and 0.713 around 128."""
    y = F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b
    return sat(y, "U8"), sat(F.lit(0.564) * (b - y) + 128, "U8"), sat(F.lit(0.713) * (r - y) + 128, "U8")


def subsample(px: DataFrame, *names: str) -> DataFrame:
    """2 by 2 means of chroma planes, rounded half to even."""
    at = [F.floor(F.col("y_") / 2).cast("int").alias("y"), F.floor(F.col("x_") / 2).cast("int").alias("x")]
    g = px.withColumnRenamed("y", "y_").withColumnRenamed("x", "x_").groupBy("img_id", *at)
    return g.agg(*(F.bround(F.avg(n), 0).cast("int").alias(n) for n in names))


#: Row and column of the blue cell in the 2 by 2 tile of each mosaic; red is diagonal to it.
BLUE = {"BG": (0, 0), "GB": (0, 1), "GR": (1, 0), "RG": (1, 1)}


def bayer(cells: DataFrame, tile: str = "BG") -> DataFrame:
    """img_id, y, x, b, g, r of a mosaic (named by the first two cells of its first row), bilinear with rounding."""

    def value(at):
        o = at(0, 0)
        h = F.shiftright(at(0, -1) + at(0, 1) + 1, 1)
        v = F.shiftright(at(-1, 0) + at(1, 0) + 1, 1)
        d = F.shiftright(at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1) + 2, 2)
        p = F.shiftright(at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) + 2, 2)
        return F.struct(o.alias("o"), h.alias("h"), v.alias("v"), d.alias("d"), p.alias("p"))

    got = neighbourhood(cells, 3, "REFLECT_101", value)
    ey, ex = F.col("y") % 2 == BLUE[tile][0], F.col("x") % 2 == BLUE[tile][1]
    o, h, v, d, p = (F.col(f"v.{k}") for k in "ohvdp")
    b = F.when(ey & ex, o).when(ey, h).when(ex, v).otherwise(d)
    r = F.when(~ey & ~ex, o).when(~ey, h).when(~ex, v).otherwise(d)
    g = F.when(ey == ex, p).otherwise(o)
    return got.select("img_id", "y", "x", b.alias("b"), g.alias("g"), r.alias("r"))


def split_yuv(cells: DataFrame, layout: str, h: int, w: int) -> DataFrame:
    """img_id, y, x, luma, u, v of frames whose cells are the bytes as stored, in rows of w (packed layouts: of 2 w) bytes.

    NV12, NV21: rows of interleaved chroma under the luma; YU12, YV12: one chroma plane after the other; YUYV, YVYU, UYVY:
    packed, chroma shared by two pixels. Each byte knows its pixel from its own place, so chroma is one aggregate and one
    join on (img_id, cy, cx). Cells outside the frame are left out, and so are pixels without both chroma values. h and w are even.
    """
    y, x = F.col("y"), F.col("x")
    half = lambda e: F.floor(e / 2).cast("int")
    if layout in ("YUYV", "YVYU", "UYVY"):
        frame = cells.where((y < h) & (x < 2 * w))
        is_luma = x % 2 == (1 if layout == "UYVY" else 0)
        luma = frame.where(is_luma).select("img_id", "y", half(x).alias("x"), "v", y.alias("cy"), F.floor(x / 4).cast("int").alias("cx"))
        place = frame.where(~is_luma).select("img_id", y.alias("cy"), F.floor(x / 4).cast("int").alias("cx"), (x % 4 < 2).alias("first"), "v")
    else:
        luma = cells.where((y < h) & (x < w)).select("img_id", "y", "x", "v", half(y).alias("cy"), half(x).alias("cx"))
        chroma = cells.where((y >= h) & (y < h + h // 2) & (x < w))
        if layout in ("NV12", "NV21"):
            place = chroma.select("img_id", (y - h).alias("cy"), half(x).alias("cx"), (x % 2 == 0).alias("first"), "v")
        else:
            size = (h // 2) * (w // 2)
            k = (y - h) * w + x
            at = k % size
            place = chroma.select("img_id", F.floor(at / (w // 2)).cast("int").alias("cy"), (at % (w // 2)).cast("int").alias("cx"), (k < size).alias("first"), "v")
    u_first = layout in ("NV12", "YU12", "YUYV", "UYVY")
    is_u = F.col("first") if u_first else ~F.col("first")
    pairs = place.groupBy("img_id", "cy", "cx").agg(F.max(F.when(is_u, F.col("v"))).alias("u"), F.max(F.when(~is_u, F.col("v"))).alias("cv"), F.count_if(is_u).alias("nu"), F.count_if(~is_u).alias("nv"))
    pairs = pairs.where("nu > 0 and nv > 0")  # a frame that is cut off may have but one of the planes
    return luma.join(pairs, ["img_id", "cy", "cx"]).select("img_id", "y", "x", F.col("v").alias("luma"), "u", F.col("cv").alias("v"))


def store_yuv(px: DataFrame, layout: str, h: int, w: int) -> DataFrame:
    """Frames of NV12, NV21, YU12 or YV12 as cells, as ``split_yuv`` reads them, from px (img_id, y, x, luma, u, v); chroma
    is the mean of 2 by 2 pixels. Pixels outside h by w are left out."""
    px = px.where((F.col("y") < h) & (F.col("x") < w))
    one, two = ("u", "v") if layout in ("NV12", "YU12") else ("v", "u")
    y, x, size = F.col("y"), F.col("x"), (h // 2) * (w // 2)
    if layout in ("NV12", "NV21"):
        places = ((y + h, 2 * x, one), (y + h, 2 * x + 1, two))
    else:
        k = y * (w // 2) + x
        places = ((F.floor(k / w).cast("int") + h, k % w, one), (F.floor((k + size) / w).cast("int") + h, (k + size) % w, two))
    cell = F.explode(F.array(*(F.struct(a.alias("y"), b.alias("x"), F.col(n).alias("v")) for a, b, n in places)))
    chroma = subsample(px.select("img_id", "y", "x", "u", "v"), "u", "v").select("img_id", cell.alias("s"))
    stored = px.select("img_id", "y", "x", F.col("luma").alias("v")).unionByName(chroma.select("img_id", "s.y", "s.x", "s.v"))
    return stored.select("img_id", "y", "x", F.lit(0).alias("c"), "v")


def rgb_to_p010(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """10-bit channels to 10-bit luma and chroma around 512, each in the upper bits of 16."""
    ten = lambda e: (F.least(F.greatest(F.bround(e, 0), F.lit(0)), F.lit(1023)) * 64).cast("int")
    y = F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b
    u = F.lit(-0.1687) * r + F.lit(-0.3313) * g + F.lit(0.5) * b + 512
    v = F.lit(0.5) * r + F.lit(-0.4187) * g + F.lit(-0.0813) * b + 512
    return ten(y), ten(u), ten(v)
