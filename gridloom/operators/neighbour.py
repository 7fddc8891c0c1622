"""Neighbourhood filters, pyramids and corner responses over cells."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.numeric import sat
from gridloom.operators.cells import KEY, heights, neighbourhood, with_shape

#: Gaussian kernels of sizes 3, 5 and 7 where no sigma is given.
SMALL_GAUSS = {3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}


def _offsets(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def box(cells: DataFrame, k: int, border: str, whole: bool = True) -> DataFrame:
    """Mean of k by k cells; integer types truncate."""
    total = lambda at: _sum([at(a, b) for a, b in _offsets(k)])
    return neighbourhood(cells, k, border, lambda at: F.floor(total(at) / (k * k)).cast("int") if whole else total(at) / float(k * k))


def gauss_kernel(k: int, sigma: float) -> list[float]:
    if sigma <= 0 and k in SMALL_GAUSS:
        return SMALL_GAUSS[k]
    s = sigma if sigma > 0 else ((k - 1) / 2 - 1) * 0.3 + 0.8
    w = [math.exp(-((i - k // 2) ** 2) / (2 * s * s)) for i in range(k)]
    return [x / sum(w) for x in w]


def filter2d(cells: DataFrame, kernel: list[list[float]], border: str, kind: str | None = None) -> DataFrame:
    """Correlation with a kernel; saturates to kind if one is given."""
    k = len(kernel)
    r = k // 2
    terms = [(a, b, float(kernel[a + r][b + r])) for a, b in _offsets(k) if kernel[a + r][b + r]]
    value = lambda at: _sum([at(a, b) * F.lit(w) for a, b, w in terms])
    return neighbourhood(cells, k, border, lambda at: sat(value(at), kind).cast("int") if kind else value(at))


def gaussian(cells: DataFrame, k: int, sigma: float, border: str, kind: str | None = None) -> DataFrame:
    w = gauss_kernel(k, sigma)
    return filter2d(cells, [[a * b for b in w] for a in w], border, kind)


def sobel_taps(order: int, k: int) -> list[float]:
    """Taps of a derivative of the given order: k - order - 1 smoothings by (1, 1) and order differences by (-1, 1). Size 1 means
    no smoothing; a derivative then still has three taps."""
    k = max(k, 3) if order else k
    taps = [1.0]
    for step in [[1.0, 1.0]] * (k - order - 1) + [[-1.0, 1.0]] * order:
        taps = [a * step[0] + b * step[1] for a, b in zip([*taps, 0.0], [0.0, *taps])] if step[0] > 0 else [b - a for a, b in zip([*taps, 0.0], [0.0, *taps])]
    return taps


def _outer(down: list[float], across: list[float], scale: float = 1.0) -> list[list[float]]:
    """A square kernel; the shorter of the two is centred."""
    n = max(len(down), len(across))
    wide = lambda t: [0.0] * ((n - len(t)) // 2) + t + [0.0] * ((n - len(t)) // 2)
    return [[a * b * scale for b in wide(across)] for a in wide(down)]


def sobel_kernel(dx: int, dy: int, k: int = 3, scale: float = 1.0) -> list[list[float]]:
    return _outer(sobel_taps(dy, k), sobel_taps(dx, k), scale)


def laplacian_kernel(k: int = 3) -> list[list[float]]:
    return [[a + b for a, b in zip(u, v)] for u, v in zip(sobel_kernel(2, 0, k), sobel_kernel(0, 2, k))]


def sobel(cells: DataFrame, dx: int, dy: int, border: str, scale: float = 1.0, k: int = 3) -> DataFrame:
    """Derivative of size 1, 3, 5 or 7."""
    return filter2d(cells, sobel_kernel(dx, dy, k, scale), border)


def laplacian(cells: DataFrame, border: str, k: int = 3) -> DataFrame:
    """Second derivatives in both directions, summed."""
    return filter2d(cells, laplacian_kernel(k), border)


def median(cells: DataFrame, k: int, border: str = "REPLICATE") -> DataFrame:
    return neighbourhood(cells, k, border, lambda at: F.get(F.array_sort(F.array(*(at(a, b) for a, b in _offsets(k)))), F.lit(k * k // 2)))


def bilateral(cells: DataFrame, k: int, sigma_color: float, sigma_space: float, border: str) -> DataFrame:
    def value(at):
        centre = at(0, 0)
        pairs = []
        for a, b in _offsets(k):
            if math.hypot(a, b) > k // 2:
                continue
            d = at(a, b) - centre
            w = F.exp(d * d * (-0.5 / sigma_color**2)) * math.exp(-0.5 * (a * a + b * b) / sigma_space**2)
            pairs.append((w, w * at(a, b)))
        return _sum([p[1] for p in pairs]) / _sum([p[0] for p in pairs])

    return neighbourhood(cells, k, border, value)


def _boxes(planes: DataFrame, k: int, border: str, names: list[str], h: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Means of k by k cells of several planes at once (img_id, y, x and the columns names), in one pass over the rows; columns keep stay."""
    means = lambda at: F.struct(*((_sum([at(a, b)[n] for a, b in _offsets(k)]) / float(k * k)).alias(n) for n in names), *(at(0, 0)[n].alias(n) for n in keep))
    stacked = planes.select("img_id", "y", "x", F.lit(0).alias("c"), F.struct(*names, *keep).alias("v"))
    return neighbourhood(stacked, k, border, means, h=h).select("img_id", "y", "x", "v.*")


def guided(pairs: DataFrame, k: int, eps: float, border: str) -> DataFrame:
    """Edge-preserving linear model of b guided by a (pairs: KEY, a, b): means, then a * guide + b averaged."""
    h, own = heights(pairs), ("guide", "channel")
    planes = {"a": F.col("a"), "b": F.col("b"), "aa": F.col("a") * F.col("a"), "ab": F.col("a") * F.col("b")}
    stacked = pairs.select("img_id", "y", "x", *(e.cast("double").alias(n) for n, e in planes.items()), F.col("a").alias("guide"), F.col("c").alias("channel"))
    m = _boxes(stacked, k, border, list(planes), h, own)
    a = (F.col("ab") - F.col("a") * F.col("b")) / (F.col("aa") - F.col("a") * F.col("a") + eps)
    m = m.select("img_id", "y", "x", a.alias("k"), (F.col("b") - a * F.col("a")).alias("o"), *own)
    m = _boxes(m, k, border, ["k", "o"], h, own)
    return m.select("img_id", "y", "x", F.col("channel").alias("c"), (F.col("k") * F.col("guide") + F.col("o")).alias("v"))


def element(shape: str, k: int) -> list[tuple[int, int]]:
    """Offsets of a structuring element."""
    r = k // 2
    if shape == "CROSS":
        return [(a, b) for a, b in _offsets(k) if a == 0 or b == 0]
    if shape == "ELLIPSE":
        span = {a: round(r * math.sqrt(max(r * r - a * a, 0)) / r) if r else 0 for a in range(-r, r + 1)}
        return [(a, b) for a, b in _offsets(k) if abs(b) <= span[a]]
    return _offsets(k)


def morph(cells: DataFrame, how: str, k: int, shape: str = "RECT") -> DataFrame:
    """erode, dilate; open, close, gradient, tophat, blackhat made of them. Cells outside don't count."""
    cut = element(shape, k)

    def one(c: DataFrame, f) -> DataFrame:
        # the nearest cell stands in for one outside: it is inside the element's reach for these shapes
        return neighbourhood(c, k, "CONSTANT", lambda at: f(*(at(a, b) for a, b in cut)), None)

    erode, dilate = lambda c: one(c, F.least), lambda c: one(c, F.greatest)
    simple = {"erode": lambda: erode(cells), "dilate": lambda: dilate(cells), "open": lambda: dilate(erode(cells)), "close": lambda: erode(dilate(cells))}
    if how in simple:
        return simple[how]()
    a, b = {"gradient": (dilate(cells), erode(cells)), "tophat": (cells, dilate(erode(cells))), "blackhat": (erode(dilate(cells)), cells)}[how]
    return a.select(*KEY, F.col("v").alias("a")).join(b.select(*KEY, F.col("v").alias("b")), KEY).select(*KEY, (F.col("a") - F.col("b")).alias("v"))


def pyr_down(cells: DataFrame, border: str) -> DataFrame:
    """5 by 5 Gaussian, then every second cell."""
    g = gaussian(cells, 5, 0, border, "U8").where((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0))
    return g.select("img_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), "c", "v")


def pyr_up(cells: DataFrame, border: str) -> DataFrame:
    """Twice the size: even places take the taps (1, 6, 1) / 8, odd ones (4, 4) / 8, in both directions."""
    phases = []
    for py in (0, 1):
        for px in (0, 1):
            wy = [(-1, 0.125), (0, 0.75), (1, 0.125)] if py == 0 else [(0, 0.5), (1, 0.5)]
            wx = [(-1, 0.125), (0, 0.75), (1, 0.125)] if px == 0 else [(0, 0.5), (1, 0.5)]
            phases.append((py, px, [(a, b, u * v) for a, u in wy for b, v in wx]))
    value = lambda at: F.array(*(sat(_sum([at(a, b) * F.lit(w) for a, b, w in t]), "U8").cast("int") for _, _, t in phases))
    got = neighbourhood(cells, 3, border, value).select(*KEY, F.posexplode("v").alias("k", "v"))
    return got.select("img_id", (F.col("y") * 2 + F.floor(F.col("k") / 2)).cast("int").alias("y"), (F.col("x") * 2 + F.col("k") % 2).alias("x"), "c", F.col("v"))


def adaptive_threshold(cells: DataFrame, top: int, k: int, delta: float, inverse: bool = False, gauss: bool = False) -> DataFrame:
    """Compare with the local mean, plain or Gaussian (REPLICATE, rounded half to even), less delta; delta is rounded up, or down for
    the inverse."""
    d = math.floor(delta) if inverse else math.ceil(delta)
    w = gauss_kernel(k, 0)
    weights = {(a, b): w[a + k // 2] * w[b + k // 2] for a, b in _offsets(k)}
    total = lambda at: _sum([at(a, b) * F.lit(weights[a, b]) for a, b in _offsets(k)]) if gauss else _sum([at(a, b) for a, b in _offsets(k)]) / float(k * k)
    return neighbourhood(cells, k, "REPLICATE", lambda at: F.when((at(0, 0) > F.bround(total(at), 0) - d) != F.lit(inverse), top).otherwise(0))


def funnel_relu(cells: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """max(v, what a 3 by 3 filter over zero-padded cells gives): the activation whose condition looks at the neighbourhood."""
    filtered = lambda at: _sum([at(a, b) * F.lit(float(kernel[a + 1][b + 1])) for a, b in _offsets(3)])
    return neighbourhood(cells, 3, "CONSTANT", lambda at: F.greatest(at(0, 0).cast("double"), filtered(at)), 0)


def corner_products(cells: DataFrame, border: str) -> DataFrame:
    """KEY, dx, dy: Sobel derivatives."""
    kernels = {"dx": sobel_kernel(1, 0), "dy": sobel_kernel(0, 1)}
    value = lambda at: F.struct(*(_sum([at(a, b) * F.lit(float(w[a + 1][b + 1])) for a, b in _offsets(3) if w[a + 1][b + 1]]).alias(n) for n, w in kernels.items()))
    return neighbourhood(cells, 3, border, value).select(*KEY, "v.*")


def _tensor(cells: DataFrame, block: int, border: str) -> DataFrame:
    dx, dy = F.col("dx"), F.col("dy")
    planes = corner_products(cells, border).select("img_id", "y", "x", (dx * dx).alias("a"), (dx * dy).alias("b"), (dy * dy).alias("d"))
    return _boxes(planes, block, border, ["a", "b", "d"], heights(cells))


def harris(cells: DataFrame, block: int, k: float, border: str) -> DataFrame:
    """ac - b * b - k * (a + c) ** 2 of the averaged derivative products."""
    a, b, c = F.col("a"), F.col("b"), F.col("d")
    return _tensor(cells, block, border).select("img_id", "y", "x", (a * c - b * b - k * (a + c) * (a + c)).alias("v"))


def min_eigen(cells: DataFrame, block: int, border: str) -> DataFrame:
    a, b, c = F.col("a") / 2, F.col("b"), F.col("d") / 2
    return _tensor(cells, block, border).select("img_id", "y", "x", ((a + c) - F.sqrt((a - c) * (a - c) + b * b)).alias("v"))


def good_features(response: DataFrame, quality: float, most: int, border: str = "REPLICATE") -> DataFrame:
    """Interior local maxima over 3 by 3 with a response of at least quality * max, the strongest ``most`` of each image."""
    from pyspark.sql import Window

    whole = response.groupBy("img_id").agg(F.max("v").alias("top"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    peak = lambda at: F.struct(at(0, 0).alias("v"), F.greatest(*(at(a, b) for a, b in _offsets(3))).alias("m"))
    p = neighbourhood(response.withColumn("c", F.lit(0)), 3, border, peak, h=whole.select("img_id", "h"))
    p = p.where((F.col("v.v") == F.col("v.m")) & (F.col("v.v") > 0)).join(whole, "img_id").where(F.col("v.v") >= quality * F.col("top"))
    p = p.where((F.col("y") > 0) & (F.col("x") > 0) & (F.col("y") < F.col("h") - 1) & (F.col("x") < F.col("w") - 1))
    rank = F.row_number().over(Window.partitionBy("img_id").orderBy(F.col("v.v").desc(), "y", "x"))
    return p.select("img_id", rank.alias("rank"), "y", "x", F.col("v.v").alias("response")).where(F.col("rank") <= most)


def spread_features(peaks: DataFrame, distance: float, most: int) -> DataFrame:
    """Of ranked peaks (img_id, rank, y, x, response), the strongest ones that are at least ``distance`` from every stronger one
    kept, ``most`` an image. The choice depends on what was kept before, so an image's peaks go through one task; the grid
    of cells of that size keeps the work in proportion to their number."""

    def keep(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rank")
        size, grid, kept = max(distance, 1.0), {}, []
        for i, (y, x) in enumerate(zip(p["y"].tolist(), p["x"].tolist())):
            gy, gx = int(y // size), int(x // size)
            near = (q for a in (-1, 0, 1) for b in (-1, 0, 1) for q in grid.get((gy + a, gx + b), ()))
            if all((y - q[0]) ** 2 + (x - q[1]) ** 2 >= distance * distance for q in near):
                grid.setdefault((gy, gx), []).append((y, x))
                kept.append(i)
                if len(kept) == most:
                    break
        out = p.iloc[kept].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return peaks.groupBy("img_id").applyInPandas(keep, peaks.schema)


#: The ring of 16 places (dy, dx) of the segment test, clockwise from the top.
RING = [(-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1)]


def fast_corners(cells: DataFrame, t: int, run: int = 9) -> DataFrame:
    """Interior cells with ``run`` ring cells in a row all brighter than v + t or all darker than v - t."""

    def value(at):
        c = at(0, 0)
        bits = lambda ok, places: _sum([F.when(ok(at(*RING[k])), 1 << k).otherwise(0) for k in places])
        # a run holds no fewer than run // 4 of the four places on the axes, so most cells need no more than those
        some = lambda ok: F.bit_count(bits(ok, (0, 4, 8, 12))) >= run // 4
        along = lambda ok: F.bin(bits(ok, range(16)).cast("long") * 65537).contains("1" * run)  # noqa: E731  (the ring twice)
        both = (lambda p: p > c + t), (lambda p: p < c - t)
        return reduce(lambda u, v: u | v, [F.when(some(ok), along(ok)).otherwise(False) for ok in both])

    got = with_shape(neighbourhood(cells, 7, "REPLICATE", value)).where("v")
    return got.where((F.col("y") >= 3) & (F.col("x") >= 3) & (F.col("y") < F.col("h") - 3) & (F.col("x") < F.col("w") - 3)).select("img_id", "y", "x")


def _circle(size: int) -> list[tuple[int, int]]:
    """The ring of 16, 12 or 8 cells around a cell, in order (radius 3, 2 or 1)."""
    if size == 16:
        return RING
    # fixed values: rings of the segment test's smaller types
    rings = {12: [(2, 0), (2, 1), (1, 2), (0, 2), (-1, 2), (-2, 1), (-2, 0), (-2, -1), (-1, -2), (0, -2), (1, -2), (2, -1)], 8: [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]}
    return rings[size]


def fast_features(cells: DataFrame, t: int, run: int = 9, ring: int = 16, suppress: bool = True, max_num: int | None = 3000) -> DataFrame:
    """img_id, y, x, score: corners of the segment test with ``run`` of ``ring`` cells in a row (9 of 16, 7 of 12, 5 of 8).

    The score is the largest threshold at which the cell still passes: the best arc's least difference, less one. With ``suppress`` a corner stays
    if its score is above those of all corners next to it. The ``max_num`` strongest of an image stay (ties by y, x); None: all. A margin of
    3 cells has no corners, whatever the ring."""
    circle = _circle(ring)

    def value(at):
        def best(d):
            arcs = [[F.get(d, F.lit((k + j) % ring)) for j in range(run)] for k in range(ring)]
            return F.greatest(F.greatest(*(F.least(*a) for a in arcs)), -F.least(*(F.greatest(*a) for a in arcs))) - 1

        # the list in between makes the differences worked out once
        return F.get(F.transform(F.array(F.array(*(at(a, b) - at(0, 0) for a, b in circle))), best), F.lit(0))

    got = with_shape(neighbourhood(cells, 7, "REPLICATE", value)).where(F.col("v") >= t)
    inside = (F.col("y") >= 3) & (F.col("x") >= 3) & (F.col("y") < F.col("h") - 3) & (F.col("x") < F.col("w") - 3)
    got = got.where(inside).select("img_id", "y", "x", F.col("v").alias("score"))
    if suppress:
        steps = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
        seen = got.select("img_id", "y", "x", "score", F.explode(steps).alias("s"))
        own = (F.col("s.dy") == 0) & (F.col("s.dx") == 0)
        seen = seen.groupBy("img_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
        seen = seen.agg(F.max(F.when(own, F.col("score"))).alias("score"), F.max(F.when(~own, F.col("score"))).alias("around"))
        got = seen.where("score > coalesce(around, score - 1)").select("img_id", "y", "x", "score")
    if max_num is None:
        return got
    order = Window.partitionBy("img_id").orderBy(F.col("score").desc(), "y", "x")
    return got.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_num).drop("k")


def match_template(cells: DataFrame, template: list[list[int]], how: str = "SSD") -> DataFrame:
    """A template whose top left corner is at each place where it fits: SSD, sum of squared differences; CCORR, sum of products;
    CCOEFF_NORMED, correlation of the differences from both means (0 where one of them is constant)."""
    th, tw = len(template), len(template[0])
    k, n = 2 * max(th, tw) - 1, th * tw
    places = [(a, b) for a in range(th) for b in range(tw)]
    mean = sum(map(sum, template)) / n
    spread = sum((template[a][b] - mean) ** 2 for a, b in places)

    def value(at):
        if how == "SSD":
            return _sum([(at(a, b) - template[a][b]) * (at(a, b) - template[a][b]) for a, b in places])
        if how == "CCORR":
            return _sum([at(a, b) * template[a][b] for a, b in places])
        # n * covariance and n * variance in whole numbers; the root comes last
        cross = _sum([at(a, b) * F.lit(template[a][b] - mean) for a, b in places])
        own = n * _sum([at(a, b) * at(a, b) for a, b in places]) - _sum([at(a, b) for a, b in places]) * _sum([at(a, b) for a, b in places])
        return F.when((own > 0) & F.lit(spread > 0), cross / F.sqrt(own * F.lit(spread / n))).otherwise(0.0)

    got = with_shape(neighbourhood(cells, k, "REPLICATE", value))
    return got.where((F.col("y") <= F.col("h") - th) & (F.col("x") <= F.col("w") - tw)).select(*KEY, "v")
