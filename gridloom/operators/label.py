"""Connected components of cells, boundaries and line votes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.cells import KEY, neighbourhood
from gridloom.operators.neighbour import corner_products


def label_components(cells: DataFrame, connectivity: int, written) -> DataFrame:
    """img_id, y, x, label of the non-zero cells: the smallest place of the component (y * 2^31 + x).

    Rows are cut to runs of non-zero cells first, so the iteration works on runs: each round every run takes the smallest
    label of the runs it touches and then follows its label once. ``written`` cuts the lineage of a table (for instance a
    Parquet table in the shared folder); the loop asks only whether a label changed. No side of a join is bounded, and a written table is
    far smaller than its rows, so all of them are merge joins: none goes through the driver.
    """
    on = cells.where("v <> 0")
    w = Window.partitionBy("img_id", "y").orderBy("x")
    on = on.withColumn("g", F.col("x") - F.row_number().over(w))
    runs = on.groupBy("img_id", "y", "g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    runs = written(runs.select("img_id", "y", "a", "b", (F.col("y").cast("long") * (1 << 31) + F.col("a")).alias("id")))
    reach = 1 if connectivity == 8 else 0
    up = runs.select("img_id", (F.col("y") + 1).alias("y"), F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("id").alias("uid"))
    touch = runs.join(up.hint("merge"), ["img_id", "y"]).where((F.col("ua") <= F.col("b") + reach) & (F.col("ub") >= F.col("a") - reach)).select("img_id", "id", "uid")
    edges = written(touch.union(touch.select("img_id", F.col("uid").alias("id"), F.col("id").alias("uid"))))
    labels = written(runs.select("img_id", "id", F.col("id").alias("label")))
    while True:
        near = edges.join(labels.select("img_id", F.col("id").alias("uid"), F.col("label").alias("l")).hint("merge"), ["img_id", "uid"]).groupBy("img_id", "id").agg(F.min("l").alias("l"))
        step = labels.join(near.hint("merge"), ["img_id", "id"], "left").select("img_id", "id", F.least("label", F.coalesce("l", "label")).alias("new"), "label")
        jump = labels.select("img_id", F.col("id").alias("new"), F.col("label").alias("far"))
        step = written(step.join(jump.hint("merge"), ["img_id", "new"], "left").select("img_id", "id", F.least("new", "far").alias("new"), "label"))
        if step.where("new <> label").isEmpty():
            break
        labels = step.select("img_id", "id", F.col("new").alias("label"))
    out = runs.join(labels.hint("merge"), ["img_id", "id"])
    return out.select("img_id", "y", F.explode(F.sequence("a", "b")).alias("x"), "label")


def boundary(cells: DataFrame) -> DataFrame:
    """Non-zero cells with a zero or outside cell beside them (4 neighbours)."""
    value = lambda at: (at(0, 0) != 0) & (F.least(*(F.abs(at(a, b)) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))) == 0)
    return neighbourhood(cells, 3, "CONSTANT", value).where("v").select("img_id", "y", "x")


def canny(cells: DataFrame, low: float, high: float, written) -> DataFrame:
    """img_id, y, x of edges: the L1 gradient is no smaller than that of both neighbours along its direction (in steps of 45
    degrees) and over ``low``, and such cells touch (8 neighbours, over any way) one over ``high``."""
    g = corner_products(cells, "REPLICATE")
    dx, dy = F.col("dx"), F.col("dy")
    steep, flat = F.abs(dy) > 2.414213562373095 * F.abs(dx), F.abs(dy) < 0.41421356237309503 * F.abs(dx)
    g = g.withColumn("v", F.struct((F.abs(dx) + F.abs(dy)).alias("m"), F.when(flat, 0).when(steep, 1).when(dx * dy > 0, 2).otherwise(3).alias("d")))

    def value(at):
        m = lambda a, b: at(a, b)["m"]
        o = at(0, 0)
        side = lambda a, b: F.greatest(m(a, b), m(-a, -b))
        most = F.when(o["d"] == 0, side(0, 1)).when(o["d"] == 1, side(1, 0)).when(o["d"] == 2, side(1, 1)).otherwise(side(1, -1))
        return F.when((o["m"] >= most) & (o["m"] > low), o["m"]).otherwise(0.0)

    peaks = neighbourhood(g.select(*KEY, "v"), 3, "REPLICATE", value)
    thin = written(peaks.where("v > 0"))
    named = label_components(thin, 8, written).join(thin.select("img_id", "y", "x", "v").hint("merge"), ["img_id", "y", "x"])
    strong = named.where(F.col("v") > high).select("img_id", "label").distinct()
    return named.join(strong.hint("merge"), ["img_id", "label"], "left_semi").select("img_id", "y", "x")


def hough_lines(cells: DataFrame, angles: int, least: int) -> DataFrame:
    """img_id, rho, theta, votes of the non-zero cells: local maxima over the four neighbours with ``least`` votes or more."""
    e = cells.where("v <> 0").withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))))
    t = F.col("theta") * (math.pi / angles)
    rho = F.bround(F.round(F.col("x") * F.cos(t) + F.col("y") * F.sin(t), 6), 0).cast("int")
    n = e.groupBy("img_id", rho.alias("rho"), "theta").agg(F.count("*").alias("votes"))
    by_rho, by_theta = Window.partitionBy("img_id", "theta").orderBy("rho").rangeBetween(-1, 1), Window.partitionBy("img_id", "rho").orderBy("theta").rangeBetween(-1, 1)
    n = n.withColumn("m1", F.max("votes").over(by_rho)).withColumn("m2", F.max("votes").over(by_theta))
    return n.where((F.col("votes") >= least) & (F.col("votes") == F.col("m1")) & (F.col("votes") == F.col("m2"))).select("img_id", "rho", "theta", "votes")


def hough_segments(cells: DataFrame, angles: int, least: int, length: float, gap: float) -> DataFrame:
    """img_id, rho, theta, n, y1, x1, y2, x2 of segments: cells that voted for a peak of ``hough_lines``, cut where two
    neighbours along the line are more than ``gap`` apart, ``length`` long or more.

    Every cell votes, where the usual method draws a sample, so reruns agree. A window holds the cells of one line.
    """
    e = cells.where("v <> 0").select("img_id", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("theta"))
    t = F.col("theta") * (math.pi / angles)
    e = e.withColumn("rho", F.bround(F.round(F.col("x") * F.cos(t) + F.col("y") * F.sin(t), 6), 0).cast("int"))
    on = e.join(hough_lines(cells, angles, least).select("img_id", "rho", "theta"), ["img_id", "rho", "theta"])
    on = on.withColumn("s", F.round(F.col("y") * F.cos(t) - F.col("x") * F.sin(t), 6))
    line = Window.partitionBy("img_id", "rho", "theta").orderBy("s", "y", "x")
    new = F.coalesce(F.col("s") - F.lag("s").over(line) > gap, F.lit(False)).cast("int")
    on = on.withColumn("new", new).withColumn("part", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    ends = on.groupBy("img_id", "rho", "theta", "part").agg(F.count("*").alias("n"), F.min(F.struct("s", "y", "x")).alias("a"), F.max(F.struct("s", "y", "x")).alias("b"))
    long = ends.where(F.col("b.s") - F.col("a.s") >= length)
    return long.select("img_id", "rho", "theta", "n", F.col("a.y").alias("y1"), F.col("a.x").alias("x1"), F.col("b.y").alias("y2"), F.col("b.x").alias("x2"))


def hough_circles(cells: DataFrame, edge: float, low: int, high: int, least: int) -> DataFrame:
    """img_id, y, x, radius, votes of circles: a cell with a gradient of ``edge`` or more votes for the centres that lie at
    each radius of low..high on both sides along its gradient; a centre is a local maximum over its four neighbours with
    ``least`` votes or more, and has the radius with most of them (ties: the smaller)."""
    g = corner_products(cells, "REPLICATE").withColumn("m", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where((F.col("m") > 0) & (F.col("m") >= edge))
    reach = F.array(*(F.lit(k) for k in range(-high, high + 1) if abs(k) >= low))
    g = g.select("img_id", "y", "x", "dx", "dy", "m", F.explode(reach).alias("k"))
    cy, cx = (F.floor(F.col(p) + F.col("k") * F.col(d) / F.col("m") + 0.5).cast("int") for p, d in (("y", "dy"), ("x", "dx")))
    by_radius = g.groupBy("img_id", cy.alias("y"), cx.alias("x"), F.abs("k").alias("radius")).agg(F.count("*").alias("n"))
    n = by_radius.groupBy("img_id", "y", "x").agg(F.sum("n").alias("votes"), F.min(F.struct((-F.col("n")).alias("n"), "radius"))["radius"].alias("radius"))
    along = lambda a, b: F.max("votes").over(Window.partitionBy("img_id", a).orderBy(b).rangeBetween(-1, 1))
    n = n.withColumn("m1", along("y", "x")).withColumn("m2", along("x", "y"))
    return n.where((F.col("votes") >= least) & (F.col("votes") == F.col("m1")) & (F.col("votes") == F.col("m2"))).select("img_id", "y", "x", "radius", "votes")
