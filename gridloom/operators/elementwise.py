"""Cell-wise projections: arithmetic of aligned arrays, thresholds, conversions, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.numeric import sat
from gridloom.operators.cells import KEY
from gridloom.operators.reduce import histogram


def aligned(one: DataFrame, two: DataFrame) -> DataFrame:
    """Equi-join of two arrays on their cells: KEY, a, b."""
    return one.select(*KEY, F.col("v").alias("a")).join(two.select(*KEY, F.col("v").alias("b")), KEY)


def arithmetic(pairs: DataFrame, op: str, kind: str) -> DataFrame:
    """Saturating add, sub, mul or div; division by zero gives 0."""
    a, b = F.col("a"), F.col("b")
    value = {"add": a + b, "sub": a - b, "mul": a * b, "div": F.when(b == 0, 0.0).otherwise(a.cast("double") / F.nullif(b, F.lit(0)))}[op]
    return pairs.select(*KEY, sat(value, kind).alias("v"))


def scalar_divide(cells: DataFrame, scalar: float, kind: str) -> DataFrame:
    v = F.col("v")
    return cells.select(*KEY, sat(F.when(v == 0, 0.0).otherwise(F.lit(scalar) / F.nullif(v, F.lit(0))), kind).alias("v"))


def cell_min_max(pairs: DataFrame) -> DataFrame:
    return pairs.select(*KEY, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def convert_to(cells: DataFrame, kind: str, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """sat(v * alpha + beta); a plain saturating cast where alpha and beta do nothing."""
    v = F.col("v")
    plain = abs(alpha - 1) < 1e-12 and abs(beta) < 1e-12
    return cells.withColumn("v", sat(v if plain else v * alpha + beta, kind))


def normalize(cells: DataFrame, alpha: float, beta: float, how: str) -> DataFrame:
    """MINMAX to [min, max] of alpha and beta, or to norm alpha (INF, L1, L2), per image; the statistics are joined, not collected."""
    v = F.col("v")
    if how == "MINMAX":
        s = cells.groupBy("img_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        scale = F.when(F.col("hi") - F.col("lo") <= 1.1920929e-07, 0.0).otherwise((max(alpha, beta) - min(alpha, beta)) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)))
        shift = F.lit(float(min(alpha, beta))) - F.col("lo") * scale
    else:
        norm = {"INF": F.max(F.abs(v)), "L1": F.sum(F.abs(v)), "L2": F.sqrt(F.sum(v * v))}[how]
        s = cells.groupBy("img_id").agg(norm.cast("double").alias("norm"))
        scale = F.when(F.col("norm") <= 2.220446049250313e-16, 0.0).otherwise(alpha / F.nullif(F.col("norm"), F.lit(0)))
        shift = F.lit(0.0)
    return cells.join(s, "img_id").select(*KEY, (v * scale + shift).alias("v"))


def mul_spectrums(pairs: DataFrame, conj: bool) -> DataFrame:
    """Product of complex cells (are, aim) and (bre, bim), optionally with the conjugate of b."""
    s = -1 if conj else 1
    re = F.col("are") * F.col("bre") - F.col("aim") * F.col("bim") * s
    im = F.col("are") * F.col("bim") * s + F.col("aim") * F.col("bre")
    return pairs.withColumns({"re": re, "im": im}).drop("are", "aim", "bre", "bim")


def split(cells: DataFrame, channels: int) -> DataFrame:
    return cells.groupBy("img_id", "y", "x").pivot("c", list(range(channels))).agg(F.first("v")).select(
        "img_id", "y", "x", *(F.col(str(k)).alias(f"c{k}") for k in range(channels))
    )


def merge(planes: DataFrame, channels: int) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(k).alias("c"), F.col(f"c{k}").alias("v")) for k in range(channels)))
    return planes.select("img_id", "y", "x", F.explode(pairs).alias("p")).select("img_id", "y", "x", "p.c", "p.v")


def threshold(v: Column, t: float, top: int, how: str) -> Column:
    return {
        "BINARY": F.when(v > t, top).otherwise(0),
        "BINARY_INV": F.when(v > t, 0).otherwise(top),
        "TRUNC": F.least(v, F.lit(t)),
        "TOZERO": F.when(v > t, v).otherwise(0),
        "TOZERO_INV": F.when(v > t, 0).otherwise(v),
    }[how]


def otsu(cells: DataFrame) -> DataFrame:
    """img_id, threshold: the lowest bin with the largest between-class variance."""
    h = histogram(cells, "v", 256, 0, 256, "img_id")
    every, run = Window.partitionBy("img_id"), Window.partitionBy("img_id").orderBy("bin")
    n, b = F.col("n").cast("double"), F.col("bin")
    h = h.withColumns({"tot": F.sum(n).over(every), "w": F.sum(n).over(run), "s": F.sum(n * b).over(run), "all": F.sum(n * b).over(every)})
    w0 = F.col("w") / F.col("tot")
    m0 = F.col("s") / F.nullif(F.col("w"), F.lit(0.0))
    m1 = (F.col("all") - F.col("s")) / F.nullif(F.col("tot") - F.col("w"), F.lit(0.0))
    between = F.when((w0 < 1e-6) | (w0 > 1 - 1e-6), 0.0).otherwise(F.round(w0 * (1 - w0) * (m0 - m1) * (m0 - m1), 6))
    best = h.withColumn("var", between).groupBy("img_id").agg(F.min(F.struct((-F.col("var")).alias("k"), "bin")).alias("m"))
    return best.select("img_id", F.col("m.bin").alias("threshold"))


def triangle(cells: DataFrame) -> DataFrame:
    """img_id, threshold: the bin farthest from the chord between the histogram's peak and its far tail, less one.

    The tail is the last empty side of the occupied range; a peak right of the middle flips the histogram.
    """
    h = histogram(cells, "v", 256, 0, 256, "img_id")
    s = h.groupBy("img_id").agg(
        F.min(F.when(F.col("n") > 0, F.col("bin"))).alias("l"), F.max(F.when(F.col("n") > 0, F.col("bin"))).alias("r"),
        F.min(F.struct((-F.col("n")).alias("k"), "bin")).alias("m"),
    ).select("img_id", F.greatest(F.col("l") - 1, F.lit(0)).alias("l"), F.least(F.col("r") + 1, F.lit(255)).alias("r"), F.col("m.bin").alias("p"), (-F.col("m.k")).alias("top"))
    flip = (F.col("p") - F.col("l")) < (F.col("r") - F.col("p"))
    s = s.withColumn("flip", flip)
    s = s.withColumns({"left": F.when(F.col("flip"), 255 - F.col("r")).otherwise(F.col("l")), "peak": F.when(F.col("flip"), 255 - F.col("p")).otherwise(F.col("p"))})
    j = h.join(s, "img_id").withColumn("i", F.when(F.col("flip"), 255 - F.col("bin")).otherwise(F.col("bin")))
    d = F.col("top") * F.col("i") + (F.col("left") - F.col("peak")) * F.col("n")
    far = j.where((F.col("i") > F.col("left")) & (F.col("i") <= F.col("peak"))).withColumn("d", d).groupBy("img_id").agg(
        F.min(F.struct((-F.col("d")).alias("k"), "i")).alias("m"), F.first("flip").alias("flip")
    )
    t = F.col("m.i") - 1
    return far.select("img_id", F.when(F.col("flip"), 255 - t).otherwise(t).alias("threshold"))


def mipi_pack(cells: DataFrame) -> DataFrame:
    """Four 10-bit values to five bytes: the high 8 bits of each, then the low 2 bits of all."""
    g = cells.groupBy("img_id", "y", "c", F.floor(F.col("x") / 4).cast("int").alias("g")).agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("m"))
    v = [F.col("m")[k]["v"] for k in range(4)]
    low = v[0].bitwiseAND(3) + F.shiftleft(v[1].bitwiseAND(3), 2) + F.shiftleft(v[2].bitwiseAND(3), 4) + F.shiftleft(v[3].bitwiseAND(3), 6)
    packed = F.array(*(F.shiftright(k, 2) for k in v), low)
    return g.where("size(m) = 4").select("img_id", "y", "c", "g", F.posexplode(packed).alias("k", "v")).select("img_id", "y", (F.col("g") * 5 + F.col("k")).alias("x"), "c", "v")


def mipi_unpack(cells: DataFrame) -> DataFrame:
    g = cells.groupBy("img_id", "y", "c", F.floor(F.col("x") / 5).cast("int").alias("g")).agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("m"))
    low = F.col("m")[4]["v"]
    out = F.array(*(F.shiftleft(F.col("m")[k]["v"], 2) + F.shiftright(low, 2 * k).bitwiseAND(3) for k in range(4)))
    return g.where("size(m) = 5").select("img_id", "y", "c", "g", F.posexplode(out).alias("k", "v")).select("img_id", "y", (F.col("g") * 4 + F.col("k")).alias("x"), "c", "v")


def softmax(df: DataFrame, v: str, *by: str) -> DataFrame:
    w = Window.partitionBy(*by)
    e = F.exp(F.col(v) - F.max(v).over(w))
    return df.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")
