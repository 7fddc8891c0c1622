"""Join-shaped operators: nearest matches, box overlaps, assignment, box and vector geometry.

Points within a radius and points in boxes are matched through a grid, nearest points through a pyramid of grids, overlapping boxes
through a grid for each size of box; all are joined by cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_area(p: str) -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def intersection(p: str, q: str) -> Column:
    w = F.least(f"{p}x2", f"{q}x2") - F.greatest(f"{p}x1", f"{q}x1")
    h = F.least(f"{p}y2", f"{q}y2") - F.greatest(f"{p}y1", f"{q}y1")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(p: str, q: str, eps: float = 1e-6) -> Column:
    i = intersection(p, q)
    return i / F.greatest(box_area(p) + box_area(q) - i, F.lit(eps))


def iof(p: str, q: str, eps: float = 1e-6) -> Column:
    """Intersection over the first box."""
    return intersection(p, q) / F.greatest(box_area(p), F.lit(eps))


def prefixed(df: DataFrame, p: str, *keep: str) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(p + c) for c in df.columns if c not in keep))


def _level(w: Column, h: Column) -> Column:
    """The grid of a box: the power of two that isn't below its longer side, so that it touches four cells at most."""
    return F.ceil(F.log2(F.greatest(w.cast("double"), h.cast("double"), F.lit(2.0**-40)))).cast("int")


def _posted(boxes: DataFrame, levels: DataFrame, p: str) -> DataFrame:
    """Rows of boxes (columns p*) under (level, gx, gy) in their own grid and in all coarser ones of levels (one row: levels)."""
    x1, y1, x2, y2 = (F.col(p + c) for c in ("x1", "y1", "x2", "y2"))
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level").cast("double")))
    out = boxes.withColumn(f"{p}level", _level(x2 - x1, y2 - y1)).join(F.broadcast(levels), on=None)
    out = out.withColumn("level", F.explode(F.filter("levels", lambda v: v >= F.col(f"{p}level")))).drop("levels")
    out = out.withColumns({f"{p}gx": cell(x1), f"{p}gy": cell(y1)})
    return out.withColumn("gx", F.explode(F.sequence(f"{p}gx", cell(x2)))).withColumn("gy", F.explode(F.sequence(f"{p}gy", cell(y2))))


#: Boxes of an image, in either table, that are compared with each other without a grid.
FEW = 32


def overlapping(boxes: DataFrame, others: DataFrame, by: str = "img_id") -> DataFrame:
    """Pairs of boxes of one image with a common area: columns by, a*, b*.

    The boxes of an image that has few are compared with each other, FEW at most, so that work and rows grow with the number of boxes; those of
    other images meet in grids. Boxes without area, or with null sides, have no pairs.
    """
    a, b = prefixed(boxes, "a", by), prefixed(others, "b", by)
    sound = lambda p: (F.col(f"{p}x2") > F.col(f"{p}x1")) & (F.col(f"{p}y2") > F.col(f"{p}y1"))
    a, b = a.where(sound("a") & F.col(by).isNotNull()), b.where(sound("b") & F.col(by).isNotNull())
    sized = lambda df: df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    sa, sb = sized(a), sized(b)
    few = sa.where(F.col("n") <= FEW).drop("n").join(sb.where(F.col("n") <= FEW).drop("n"), by).where(intersection("a", "b") > 0)
    # an image with more on one side only goes through the grid as well, both sides of it
    many = sa.where(F.col("n") > FEW).select(by).union(sb.where(F.col("n") > FEW).select(by)).distinct()
    return few.unionByName(_gridded(a.join(many, by, "left_semi"), b.join(many, by, "left_semi"), by))


def _gridded(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """``overlapping`` for images with any number of boxes (columns by, a* and by, b*).

    A box lies in a grid of its own size (a power of two) and visits all coarser grids that occur, four cells each at most. Boxes of a
    grid meet the others and the visitors of their cells, so boxes meet only if they are near each other on the scale of the
    larger one, and a pair is reported in its first common cell alone.
    """
    sizes = lambda df, p: df.select(_level(F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1")).alias("level"))
    levels = sizes(a, "a").union(sizes(b, "b")).agg(F.collect_set("level").alias("levels"))  # no more than exponents of a double
    pa, pb = _posted(a, levels, "a"), _posted(b, levels, "b")
    keys = [by, "level", "gx", "gy"]
    met = pa.where("level = alevel").join(pb, keys).unionByName(pa.where("level > alevel").join(pb.where("level = blevel"), keys))
    first = (F.col("gx") == F.greatest("agx", "bgx")) & (F.col("gy") == F.greatest("agy", "bgy"))
    return met.where(first & (intersection("a", "b") > 0)).drop("level", "gx", "gy", *(p + c for p in "ab" for c in ("level", "gx", "gy")))


def pairwise(boxes: DataFrame, others: DataFrame, by: str = "img_id") -> DataFrame:
    """Boxes of one image that overlap, with iou and iof: columns by, a*, b*."""
    return overlapping(boxes, others, by).withColumn("iou", iou("a", "b")).withColumn("iof", iof("a", "b"))


#: Halvings of an axis from the extent of the sites to a leaf cell, and halvings of one step down.
DEPTH, STEP = 12, 3


#: Points that share the way down the pyramid.
TILE = 64


def nearest(points: DataFrame, sites: DataFrame, by: list[str], metric, least: float | tuple[float, float] = 1.0, slack: float = 1e-6) -> DataFrame:
    """For each point the nearest site of its group, ties to the smaller site_id: by, point_id, site_id, dist.

    points: by, point_id, px, py; sites: by, site_id, sx, sy. metric(dx, dy) is a distance that is convex in (dx, dy) and at least ``least``
    times the Euclidean one (a pair: at least the Euclidean one after scaling dx and dy by them); distances closer than ``slack`` may tie (metrics
    are rounded).

    Sites lie in the leaf cells of a pyramid of grids over their group, whose cells hold the tight boxes of their sites. Points lie in tiles, the
    largest cells of the same grids with at most TILE of them (or leaf cells), and tiles with their tight boxes go
    down the pyramid: at each step a tile meets the children of the cells it kept, and keeps those whose box isn't farther than
    the farthest corners of some other one. So it sees a handful of cells a step, however its group is filled, and its points only those
    sites that lie in the last cells. Points in a group without sites have no row; neither have points and sites with null or
    non-finite coordinates.
    """
    finite = lambda *cs: F.abs(sum((F.col(c).cast("double") for c in cs), F.lit(0.0))) < float("inf")
    points, sites = points.where(finite("px", "py")), sites.where(finite("sx", "sy"))
    extent = sites.groupBy(*by).agg(F.min("sx").alias("x0"), F.max("sx").alias("x9"), F.min("sy").alias("y0"), F.max("sy").alias("y9"))
    place = lambda c, lo, hi: F.floor((F.col(c) - F.col(lo)) / F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)).otherwise(1.0) * 2.0**DEPTH)
    cell = lambda c, lo, hi: F.least(F.greatest(place(c, lo, hi), F.lit(0)), F.lit(2**DEPTH - 1)).cast("int")
    placed = sites.join(extent, by).select(*by, "site_id", "sx", "sy", cell("sx", "x0", "x9").alias("cx"), cell("sy", "y0", "y9").alias("cy"))
    dealt = points.join(extent, by).select(*by, "point_id", "px", "py", cell("px", "x0", "x9").alias("tx"), cell("py", "y0", "y9").alias("ty"))
    # tiles: the level at which a leaf's points have few enough beside them
    leaves = dealt.groupBy(*by, "tx", "ty").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}{k}") for c in ("px", "py") for f, k in ((F.min, 1), (F.max, 2))))
    leaves = leaves.withColumn("level", F.lit(0))
    for shift in range(STEP, DEPTH + 1, STEP):
        held = leaves.groupBy(*by, F.shiftright("tx", shift).alias("ux"), F.shiftright("ty", shift).alias("uy")).agg(F.sum("n").alias("held")).where(F.col("held") <= TILE)
        above = [*by, "ux", "uy"]
        leaves = leaves.withColumns({"ux": F.shiftright("tx", shift), "uy": F.shiftright("ty", shift)}).join(held, above, "left")
        leaves = leaves.withColumn("level", F.when(F.col("held").isNotNull(), F.lit(shift)).otherwise(F.col("level"))).drop("ux", "uy", "held")
    tile = [*by, "level", "ux", "uy"]
    under = leaves.withColumns({"ux": F.expr("shiftright(tx, level)"), "uy": F.expr("shiftright(ty, level)")})
    tiles = under.groupBy(*tile).agg(*(f(f"{c}{k}").alias(f"{c}{k}") for c in ("px", "py") for f, k in ((F.min, 1), (F.max, 2))))
    at = tiles.withColumns({"gx": F.lit(0), "gy": F.lit(0)})
    wx, wy = least if isinstance(least, tuple) else (least, least)
    out = lambda p, s: F.greatest(F.col(f"{s}1") - F.col(f"{p}2"), F.col(f"{p}1") - F.col(f"{s}2"), F.lit(0.0))
    ends = lambda p, s: (F.col(f"{p}1") - F.col(f"{s}2"), F.col(f"{p}2") - F.col(f"{s}1"))
    box = ["px1", "px2", "py1", "py2"]
    for shift in range(DEPTH - STEP, -1, -STEP):
        up = lambda c: F.shiftright(c, shift)  # noqa: E731, B023
        boxes = placed.groupBy(*by, up("cx").alias("kx"), up("cy").alias("ky")).agg(*(f(c).alias(f"{c}{k}") for c in ("sx", "sy") for f, k in ((F.min, 1), (F.max, 2))))
        boxes = boxes.withColumns({"gx": F.shiftright("kx", STEP), "gy": F.shiftright("ky", STEP)})
        low = F.hypot(wx * out("px", "sx"), wy * out("py", "sy"))
        high = F.greatest(*(metric(dx, dy) for dx in ends("px", "sx") for dy in ends("py", "sy")))
        met = at.join(boxes, [*by, "gx", "gy"]).select(*tile, *box, F.col("kx").alias("gx"), F.col("ky").alias("gy"), low.alias("low"), high.alias("high"))
        bound = F.min("high").over(Window.partitionBy(*tile))  # a few cells of one tile
        at = met.withColumn("bound", bound).where(F.col("low") <= F.col("bound") + slack).drop("low", "high", "bound")
    found = at.select(*tile, "gx", "gy").join(placed.withColumnsRenamed({"cx": "gx", "cy": "gy"}), [*by, "gx", "gy"]).select(*tile, "site_id", "sx", "sy")
    own = dealt.join(under.select(*tile, "tx", "ty"), [*by, "tx", "ty"]).select(*tile, "point_id", "px", "py")
    j = own.join(found, tile).withColumn("dist", metric(F.col("px") - F.col("sx"), F.col("py") - F.col("sy")))
    return j.groupBy(*by, "point_id").agg(F.min(F.struct("dist", "site_id")).alias("m")).select(*by, "point_id", F.col("m.site_id").alias("site_id"), F.col("m.dist").alias("dist"))


def mahalanobis(dx: Column, dy: Column, inv: tuple[float, float, float]) -> Column:
    """sqrt of the quadratic form with the inverse covariance (xx, xy, yy)."""
    return F.sqrt(dx * dx * inv[0] + 2 * dx * dy * inv[1] + dy * dy * inv[2])


def mahalanobis_least(inv: tuple[float, float, float]) -> float:
    """The smallest Mahalanobis distance of two points with a Euclidean distance of 1: the root of the form's lower eigenvalue."""
    xx, xy, yy = inv
    low = (xx + yy) / 2 - (((xx - yy) / 2) ** 2 + xy * xy) ** 0.5
    if low <= 0:
        raise ValueError("the inverse covariance isn't positive definite")
    return low**0.5


def mahalanobis_axes(inv: tuple[float, float, float]) -> tuple[float, float]:
    """Scales of dx and dy after which the Euclidean distance isn't above the Mahalanobis distance: the mixed term takes at most its
    share of the other two."""
    mahalanobis_least(inv)  # refuses forms that aren't positive definite
    xx, xy, yy = inv
    rest = 1 - abs(xy) / (xx * yy) ** 0.5
    return (rest * xx) ** 0.5, (rest * yy) ** 0.5


#: Rows of a cell that stay together where two tables meet by cell.
BLOCK = 2000


def _dealt(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables of an equi-join by keys (cells of a grid), evenly spread: the rows of a cell are dealt into blocks of about BLOCK by a hash of the
    row, and each block of a meets each of b as a key of its own (keys, a_, b_), in partitions that aren't coalesced by their size (few rows give
    many pairs)."""
    blocks = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
    cells = blocks(a, "na_").join(blocks(b, "nb_"), keys)
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*df.columns), F.col(f"n{own}_")).cast("int")
        # by merge: Spark takes df to be as small as before its rows were copied to their cells, and would broadcast it
        out = df.hint("merge").join(cells, keys).withColumn(f"{own}_", at).withColumn(f"{other}_", F.explode(F.sequence(F.lit(0), F.col(f"n{other}_") - 1)))
        return out.drop("na_", "nb_").repartition(parts, *keys, "a_", "b_")

    return dealt(a, "a", "b"), dealt(b, "b", "a")


def _met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The inner equi-join by keys, dealt."""
    pa, pb = _dealt(a, b, keys)
    return pa.join(pb, [*keys, "a_", "b_"]).drop("a_", "b_")


#: Columns and rows of a grid to a radius, and differences of rows (up or down) that are matched together.
COLUMNS, ROWS, APART = 2, 5, 2


def within(points: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """Pairs (point_id, site_id, dist) of points and sites no farther than radius apart, through a grid; those with null or non-finite coordinates have none.

    The pairs may take far more room than the tables, so they come in an order that a file holds in few bytes: pairs whose grid rows are about as far
    apart are made in tasks of their own, in a task by the difference of their columns, and a cell's points meet the sites of another cell in one order. So a
    point's id and a cell's list of sites recur, and where coordinates have few decimals, few different distances occur in one part of a file.
    """
    wide, high = (radius * (1 + 1e-6) / n for n in (COLUMNS, ROWS))  # a little more, so that rounding puts no pair farther apart than that
    cell = lambda c, pitch: F.floor(F.col(c) / pitch + 0.5)
    finite = lambda x, y: F.abs(F.col(x).cast("double")) + F.abs(F.col(y).cast("double")) < float("inf")
    p = points.where(finite("px", "py")).select("point_id", "px", "py", cell("px", wide).alias("gx"), cell("py", high).alias("gy"))
    s = sites.where(finite("sx", "sy")).select("site_id", "sx", "sy", cell("sx", wide).alias("ux"), cell("sy", high).alias("uy"))
    d = F.sqrt((F.col("px") - F.col("sx")) * (F.col("px") - F.col("sx")) + (F.col("py") - F.col("sy")) * (F.col("py") - F.col("sy")))
    keys = ["gx", "gy", "a_", "b_"]
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    held = lambda df, by, name, *cols: df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    def ring(offs: list[int]) -> DataFrame:
        at = s.withColumn("off", each(offs)).withColumn("col", each(range(-COLUMNS, COLUMNS + 1)))
        at = at.withColumns({"gx": F.col("ux") - F.col("col"), "gy": F.col("uy") - F.col("off")}).drop("ux", "uy")
        dp, ds = _dealt(p, at, ["gx", "gy"])
        j = held(ds, [*keys, "off", "col"], "sites", "sx", "sy", "site_id").join(held(dp, keys, "points", "px", "py", "point_id"), keys)
        j = j.sortWithinPartitions(F.abs("off"), "off", F.abs("col"), "col", *keys)
        j = j.select("sites", F.inline("points")).select("point_id", "px", "py", F.inline("sites"))
        return j.withColumn("dist", d).where(F.col("dist") <= radius).select("point_id", "site_id", "dist")

    return reduce(DataFrame.union, (ring([k for k in range(-ROWS, ROWS + 1) if abs(k) // APART == n]) for n in range(ROWS // APART + 1)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, pitch: float, eps: float = 1e-9) -> DataFrame:
    """Pairs (point_id, box_id) whose point is farther than eps inside the box, through a grid."""
    p = points.select("point_id", "px", "py", F.floor(F.col("px") / pitch).alias("gx"), F.floor(F.col("py") / pitch).alias("gy"))
    b = boxes.select("box_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(F.floor(F.col("x1") / pitch), F.floor(F.col("x2") / pitch))).alias("gx"))
    b = b.withColumn("gy", F.explode(F.sequence(F.floor(F.col("y1") / pitch), F.floor(F.col("y2") / pitch))))
    inside = F.least(F.col("px") - F.col("x1"), F.col("x2") - F.col("px"), F.col("py") - F.col("y1"), F.col("y2") - F.col("py")) > eps
    return _met(p, b, ["gx", "gy"]).where(inside).select("point_id", "box_id")


def best_of(pairs: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return pairs.withColumn("pos_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("pos_ = 1").drop("pos_")


def cosine(a: str, b: str) -> Column:
    """Cosine with 1e-6 added to each squared norm."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / (F.sqrt(dot(a, a) + 1e-6) * F.sqrt(dot(b, b) + 1e-6))


def topk_candidates(cand: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return cand.withColumn("rank", rank).where(F.col("rank") <= k)


#: Partitions of assignments, if fewer are set: few boxes give many pairs.
DEALT = 200


def atss(truths: DataFrame, anchors: DataFrame, k: int, level: str | None = None) -> DataFrame:
    """Adaptive assignment: img_id, abox_id, bbox_id, iou. truths and anchors: img_id, box_id (unique in an image), x1, y1, x2, y2; ``level`` names a
    column of the anchors. The k anchors of an image, on each level, whose centres are nearest to a truth's (ties to the smaller id) are its
    candidates; those of them that overlap it by more than the mean plus the deviation of all its candidates and have their centre inside it are its
    own. An anchor that several truths claim goes to the truth of the image that it overlaps most (ties to the smaller id).

    Images are dealt to all shuffle partitions, DEALT at least, which aren't coalesced by their size. Of a pair only what ranks it is
    sorted, and an anchor meets all truths of its image again only if several claim it."""
    parts = max(DEALT, int(truths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = prefixed(truths, "a", "img_id").repartition(parts, "img_id")
    b = prefixed(anchors, "b", "img_id")
    mid = lambda p, d: (F.col(f"{p}{d}1") + F.col(f"{p}{d}2")) / 2
    far = F.round(F.hypot(mid("a", "x") - mid("b", "x"), mid("a", "y") - mid("b", "y")), 6)
    share = F.round(iou("a", "b"), 6)
    inside = F.least(*(side for d in ("x", "y") for side in (mid("b", d) - F.col(f"a{d}1"), F.col(f"a{d}2") - mid("b", d)))) > 0
    one, anchor = ["img_id", "abox_id"], ["img_id", "bbox_id"]
    on = [f"b{level}"] if level else []
    j = a.join(b.repartition(parts, "img_id"), "img_id").select(*one, "bbox_id", *on, far.alias("far"), share.alias("iou"), inside.alias("inside"))
    near = topk_candidates(j, [*one, *on], k, F.col("far"), F.col("bbox_id"))
    w = Window.partitionBy(*one)
    near = near.withColumn("thr", F.round(F.avg("iou").over(w) + F.stddev_samp("iou").over(w), 6))
    own = near.where((F.col("iou") > F.col("thr")) & F.col("inside")).select(*anchor, F.struct("abox_id", "iou").alias("only"))
    sides = [f"b{c}" for c in ("x1", "y1", "x2", "y2")]
    claimed = own.join(b, anchor).groupBy(*anchor).agg(F.count(F.lit(1)).alias("n"), F.min("only").alias("only"), *(F.first(c).alias(c) for c in sides))
    met = claimed.alias("c").join(a.alias("t"), (F.col("c.img_id") == F.col("t.img_id")) & (F.col("n") > 1), "left")
    most = F.min(F.struct((-share).alias("less"), "abox_id", share.alias("iou")))
    found = met.groupBy("c.img_id", "bbox_id").agg(F.first("n").alias("n"), F.first("only").alias("only"), most.alias("most"))
    pick = lambda c: F.when(F.col("n") > 1, F.col(f"most.{c}")).otherwise(F.col(f"only.{c}")).alias(c)
    return found.select("img_id", pick("abox_id"), "bbox_id", pick("iou"))


def box_distance(p: str, q: str) -> Column:
    """Distance between two boxes; 0 where they touch or overlap."""
    dx = F.greatest(F.col(f"{p}x1") - F.col(f"{q}x2"), F.col(f"{q}x1") - F.col(f"{p}x2"), F.lit(0.0))
    dy = F.greatest(F.col(f"{p}y1") - F.col(f"{q}y2"), F.col(f"{q}y1") - F.col(f"{p}y2"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def point_to_box(x: str, y: str, p: str) -> tuple[Column, Column]:
    """Distance of a point from a box (0 inside) and whether it is on the box's boundary."""
    dx = F.greatest(F.col(f"{p}x1") - F.col(x), F.col(x) - F.col(f"{p}x2"), F.lit(0.0))
    dy = F.greatest(F.col(f"{p}y1") - F.col(y), F.col(y) - F.col(f"{p}y2"), F.lit(0.0))
    on = F.least(*(F.abs(F.col(c) - F.col(f"{p}{c[-1]}{k}")) for c in (x, y) for k in (1, 2))) == 0
    return F.sqrt(dx * dx + dy * dy), (dx == 0) & (dy == 0) & on


def shifted(boxes: DataFrame, dx: float, dy: float) -> DataFrame:
    return boxes.withColumns({c: F.col(c) + (dx if c[0] == "x" else dy) for c in ("x1", "y1", "x2", "y2")})
