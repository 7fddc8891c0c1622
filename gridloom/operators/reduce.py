"""Reductions over cells: partial sums in the tasks, one row an image or channel out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("img_id", "c").agg(F.sum("v").alias("sum_v"))


def means(cells: DataFrame) -> DataFrame:
    return cells.groupBy("img_id", "c").agg(F.avg("v").alias("mean_v"))


def mean_std_dev(cells: DataFrame, *by: str) -> DataFrame:
    """Count, mean, population standard deviation, min and max."""
    return cells.groupBy(*by).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v")
    )


def min_max_loc(cells: DataFrame) -> DataFrame:
    """Min and max of each image with the first position in row-major order."""
    at = F.struct("y", "x", "c")
    return cells.groupBy("img_id").agg(
        F.min(F.struct(F.col("v").alias("v"), at.alias("at"))).alias("lo"), F.min(F.struct((-F.col("v")).alias("v"), at.alias("at"))).alias("hi")
    ).select(
        "img_id", F.col("lo.v").alias("min_v"), F.col("lo.at.y").alias("min_y"), F.col("lo.at.x").alias("min_x"),
        (-F.col("hi.v")).alias("max_v"), F.col("hi.at.y").alias("max_y"), F.col("hi.at.x").alias("max_x"),
    )


def norms(cells: DataFrame) -> DataFrame:
    """INF, L1, L2 and squared L2 over all channels of an image."""
    sq = F.sum(F.col("v") * F.col("v"))
    return cells.groupBy("img_id").agg(
        F.max(F.abs(F.col("v"))).alias("norm_inf"), F.sum(F.abs(F.col("v"))).alias("norm_l1"), F.sqrt(sq).alias("norm_l2"), sq.alias("norm_l2sqr")
    )


def psnr(pairs: DataFrame, peak: float = 255.0, eps: float = 2.220446049250313e-16) -> DataFrame:
    """pairs: img_id, a, b."""
    d = F.col("a") - F.col("b")
    return pairs.groupBy("img_id").agg((20 * F.log10(F.lit(peak) / (F.sqrt(F.avg(d * d)) + eps))).alias("psnr"))


def histogram(values: DataFrame, col: str, bins: int, lo: float, hi: float, *by: str, mask=None) -> DataFrame:
    """Count per bin, floor((v - lo) * bins / (hi - lo)) for lo <= v < hi; empty bins have count 0."""
    if mask is not None:
        values = values.where(mask)
    v = F.col(col)
    got = values.where((v >= lo) & (v < hi)).groupBy(*by, F.floor((v - lo) * bins / (hi - lo)).cast("int").alias("bin")).count()
    grid = values.select(*by).distinct() if by else values.sparkSession.range(1).select()
    grid = grid.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(got, [*by, "bin"], "left").select(*by, "bin", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def equalise_table(cells: DataFrame) -> DataFrame:
    """img_id, bin, new: the first occupied bin goes to 0, others to round(cum * 255 / (total - first))."""
    h = histogram(cells, "v", 256, 0, 256, "img_id")
    w = Window.partitionBy("img_id").orderBy("bin")
    every = Window.partitionBy("img_id")
    h = h.withColumn("first", F.min(F.when(F.col("n") > 0, F.col("bin"))).over(every)).withColumn("total", F.sum("n").over(every))
    h = h.withColumn("nf", F.max(F.when(F.col("bin") == F.col("first"), F.col("n"))).over(every)).withColumn("cum", F.sum("n").over(w) - F.col("nf"))
    scaled = F.bround(F.col("cum") * 255.0 / (F.col("total") - F.col("nf")), 0)
    new = F.when(F.col("bin") <= F.col("first"), 0).when(F.col("total") == F.col("nf"), F.col("bin")).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)))
    return h.select("img_id", "bin", new.cast("int").alias("new"))


def equalise(cells: DataFrame) -> DataFrame:
    t = equalise_table(cells).withColumnRenamed("bin", "v")
    return cells.join(t, ["img_id", "v"]).select("img_id", "y", "x", "c", F.col("new").alias("v"))


def cdf_map(values: DataFrame, col: str, bins: int, *by: str) -> DataFrame:
    """Range, histogram, probability and running probability of a column per group: bin, n, pdf, cdf."""
    lim = values.groupBy(*by).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    v = values.join(lim, [*by]) if by else values.crossJoin(F.broadcast(lim))  # one row
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(col) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    h = v.groupBy(*by, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every, run = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin")
    return h.withColumn("pdf", F.col("n") / F.sum("n").over(every)).withColumn("cdf", F.sum("n").over(run) / F.sum("n").over(every))


def integral(cells: DataFrame) -> DataFrame:
    """Running sums of v and v squared over the rectangle from the origin; same size as the input."""
    along = Window.partitionBy("img_id", "c", "y").orderBy("x")
    down = Window.partitionBy("img_id", "c", "x").orderBy("y")
    r = cells.withColumn("s", F.sum(F.col("v").cast("long")).over(along)).withColumn("q", F.sum(F.col("v").cast("long") * F.col("v")).over(along))
    return r.select("img_id", "y", "x", "c", F.sum("s").over(down).alias("s"), F.sum("q").over(down).alias("sq"))


def covariance(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"), F.covar_samp(a, b).alias("cov_ab"))


def majority(df: DataFrame, col: str, *by: str) -> DataFrame:
    """The value that more than half of a group's rows have, if there is one."""
    n = df.groupBy(*by, col).count()
    w = Window.partitionBy(*by).orderBy(F.col("count").desc(), F.col(col))
    top = n.withColumn("all", F.sum("count").over(Window.partitionBy(*by))).withColumn("pos", F.row_number().over(w)).where("pos = 1")
    return top.select(*by, F.when(F.col("count") * 2 > F.col("all"), F.col(col)).alias("majority"), F.col("count").alias("n"))


def diff_stats(pairs: DataFrame, tolerance: float) -> DataFrame:
    """pairs: img_id, a, b. Cells whose absolute difference is over the tolerance: count and share in per cent."""
    over = (F.abs(F.col("a") - F.col("b")) > tolerance).cast("long")
    return pairs.groupBy("img_id").agg(F.count("*").alias("n"), F.sum(over).alias("n_diff"), (F.sum(over) * 100 / F.count("*")).alias("pct_diff"))


def perf_records(df: DataFrame, tag: str, value: str) -> DataFrame:
    return df.groupBy(tag).agg(F.min(value).alias("min_ms"), F.max(value).alias("max_ms"), F.avg(value).alias("avg_ms"), F.count("*").alias("n"))


def clahe(cells: DataFrame, clip: float = 40.0, tiles: tuple[int, int] = (8, 8)) -> DataFrame:
    """Tile-wise clipped equalisation with bilinear blending of the four nearest tiles (U8; sizes divisible by tiles).

    Each tile's histogram is clipped at max(clip * area / 256, 1), the excess spread evenly over all bins (the
    remainder one each over bins at an even stride), and its running sum scaled to 255.
    """
    ty, tx = tiles
    s = cells.join(cells.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")), "img_id")
    s = s.withColumn("th", F.ceil(F.col("h") / ty).cast("int")).withColumn("tw", F.ceil(F.col("w") / tx).cast("int"))
    t = s.withColumn("ti", F.floor(F.col("y") / F.col("th")).cast("int")).withColumn("tj", F.floor(F.col("x") / F.col("tw")).cast("int"))
    h = t.groupBy("img_id", "ti", "tj", F.col("v").alias("bin")).agg(F.count("*").alias("n"), F.first("th").alias("th"), F.first("tw").alias("tw"))
    grid = h.groupBy("img_id", "ti", "tj").agg(F.first("th").alias("th"), F.first("tw").alias("tw")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(255))))
    h = grid.join(h.drop("th", "tw"), ["img_id", "ti", "tj", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = Window.partitionBy("img_id", "ti", "tj")
    limit = F.greatest(F.floor(F.lit(clip) * F.sum("n").over(every) / 256), F.lit(1))
    h = h.withColumn("area", F.sum("n").over(every)).withColumn("limit", limit)
    h = h.withColumn("excess", F.sum(F.greatest(F.col("n") - F.col("limit"), F.lit(0))).over(every))
    rest = F.pmod(F.col("excess"), F.lit(256))
    step = F.greatest(F.floor(F.lit(256) / F.greatest(rest, F.lit(1))), F.lit(1))
    extra = F.when((rest > 0) & (F.pmod(F.col("bin"), step) == 0) & (F.floor(F.col("bin") / step) < rest), 1).otherwise(0)
    h = h.withColumn("m", F.least("n", "limit") + F.floor(F.col("excess") / 256) + extra)
    lut = h.select("img_id", "ti", "tj", "bin", F.least(F.bround(F.sum("m").over(every.orderBy("bin")) * 255.0 / F.col("area"), 0), F.lit(255.0)).alias("l"))
    top = s.withColumn("fy", F.col("y") / F.col("th") - 0.5).withColumn("fx", F.col("x") / F.col("tw") - 0.5)
    top = top.withColumn("i0", F.floor("fy").cast("int")).withColumn("j0", F.floor("fx").cast("int"))
    top = top.withColumn("wy", F.col("fy") - F.col("i0")).withColumn("wx", F.col("fx") - F.col("j0"))
    parts = F.array(*(
        F.struct(
            F.least(F.greatest(F.col("i0") + a, F.lit(0)), F.ceil(F.col("h") / F.col("th")).cast("int") - 1).alias("ti"),
            F.least(F.greatest(F.col("j0") + b, F.lit(0)), F.ceil(F.col("w") / F.col("tw")).cast("int") - 1).alias("tj"),
            ((F.col("wy") if a else 1 - F.col("wy")) * (F.col("wx") if b else 1 - F.col("wx"))).alias("k"),
        )
        for a in (0, 1) for b in (0, 1)
    ))
    four = top.select("img_id", "y", "x", "c", F.col("v").alias("bin"), F.explode(parts).alias("p")).select("img_id", "y", "x", "c", "bin", "p.ti", "p.tj", "p.k")
    return four.join(lut, ["img_id", "ti", "tj", "bin"]).groupBy("img_id", "y", "x", "c").agg(F.bround(F.sum(F.col("l") * F.col("k")), 0).cast("int").alias("v"))
