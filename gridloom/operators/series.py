"""Ordered series: runs, intervals, interpolation, fits. Windows are keyed; nothing is collected."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_array(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """One array per key, in order (bounded by the key's own rows)."""
    g = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("value_")))).alias("s"))
    return g.select(by, F.transform("s", lambda r: r["value_"]).alias("values"))


def moving_average(df: DataFrame, by: str, order: list[str], value: str, period: int) -> Column:
    """Mean of the last ``period`` samples (of those there are, at the start)."""
    return F.avg(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(1 - period, 0))


def frame_rate(by: str, order: list[str], ms: Column) -> Column:
    """1000 / gap in milliseconds; 0 where time doesn't increase or for the first row."""
    gap = ms - F.lag(ms).over(Window.partitionBy(by).orderBy(*order))
    return F.when(gap > 0, 1000.0 / gap).otherwise(0.0)


def duty(df: DataFrame, by: str, order: list[str], flag: Column, window: int = 15) -> DataFrame:
    """Share of true flags over the last ``window`` rows."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - window, 0)
    return df.withColumn("duty", F.avg(flag.cast("int")).over(w))


def hysteresis(df: DataFrame, by: str, order: list[str], on: float = 0.8, off: float = 0.4) -> DataFrame:
    """state: true from a duty of ``on`` until it falls under ``off``; the last decisive row wins."""
    mark = F.when(F.col("duty") >= on, True).when(F.col("duty") < off, False)
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("state", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def merge_intervals(df: DataFrame, by: str, lo: str, hi: str) -> DataFrame:
    """Intervals of a key that touch or overlap become one."""
    w = Window.partitionBy(by).orderBy(lo, hi)
    top = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col(lo) > top) | top.isNull()
    g = df.withColumn("new_", new.cast("int")).withColumn("island", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(by, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("island")


def interpolate(samples: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """samples: by, t, value; asked: by, t. Piecewise linear value at each asked t; null outside the samples."""
    u = samples.select(by, "t", "value", F.lit(0).alias("ask")).unionByName(asked.select(by, "t", F.lit(None).cast("double").alias("value"), F.lit(1).alias("ask")))
    point = F.when(F.col("ask") == 0, F.struct("t", "value"))
    back = Window.partitionBy(by).orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.col("t").desc(), F.col("ask")).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("a", F.last(point, ignorenulls=True).over(back)).withColumn("b", F.last(point, ignorenulls=True).over(ahead)).where("ask = 1")
    slope = (F.col("b.value") - F.col("a.value")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0))
    return u.select(by, "t", F.when(F.col("a.t") == F.col("b.t"), F.col("a.value")).otherwise(F.col("a.value") + slope * (F.col("t") - F.col("a.t"))).alias("value"))


def newton(xs: list[float], ys: list[float], x: Column) -> Column:
    """Value at x of the polynomial through the points, by divided differences and Horner's rule."""
    c = list(ys)
    for k in range(1, len(xs)):
        for i in range(len(xs) - 1, k - 1, -1):
            c[i] = (c[i] - c[i - 1]) / (xs[i] - xs[i - k])
    out = F.lit(float(c[-1]))
    for k in range(len(xs) - 2, -1, -1):
        out = out * (x - xs[k]) + c[k]
    return out


def power_sums(df: DataFrame, by: str, x: str, y: str, degree: int) -> DataFrame:
    """Sums of powers for a least-squares polynomial: one row a key whatever the number of points."""
    X, Y = F.col(x), F.col(y)
    return df.groupBy(by).agg(
        F.array(*(F.sum(F.pow(X, F.lit(float(k)))) for k in range(2 * degree + 1))).alias("sx"), F.array(*(F.sum(F.pow(X, F.lit(float(k))) * Y) for k in range(degree + 1))).alias("sy"), F.count("*").alias("n")
    )


def polynomial_fit(df: DataFrame, by: str, x: str, y: str, degree: int = 3) -> DataFrame:
    """Coefficients c0.. of the least-squares polynomial of each key: sums in Spark, a small solve per key."""
    import numpy as np

    def solve(sx: pd.Series, sy: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(sx, sy):
            m = np.array([[a[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
            out.append(np.linalg.lstsq(m, np.array(b), rcond=None)[0].tolist())
        return pd.Series(out)

    fit = F.pandas_udf(solve, "array<double>")
    return power_sums(df, by, x, y, degree).select(by, "n", fit("sx", "sy").alias("coef"))


def ransac_cubic(df: DataFrame, by: str, x: str, y: str, threshold: float, rounds: int = 50, seed: int = 123) -> DataFrame:
    """by, n_inliers, coef: the cubic through 4 random points with most inliers, refitted on them; seeded, one key a group."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        p = p.sort_values([x, y])
        xs, ys = p[x].to_numpy(float), p[y].to_numpy(float)
        rng = np.random.default_rng(seed)
        best = np.zeros(len(xs), bool)
        for _ in range(rounds if len(xs) >= 4 else 0):
            i = rng.choice(len(xs), 4, replace=False)
            m = np.vander(xs[i], 4)
            if np.linalg.matrix_rank(m) == 4:
                ok = np.abs(np.vander(xs, 4) @ np.linalg.solve(m, ys[i]) - ys) < threshold
                best = ok if ok.sum() > best.sum() else best
        c = np.linalg.lstsq(np.vander(xs[best], 4), ys[best], rcond=None)[0] if best.any() else np.zeros(4)
        return pd.DataFrame({by: [p[by].iloc[0]], "n_inliers": [int(best.sum())], "coef": [c.tolist()]})

    return df.select(by, x, y).groupBy(by).applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, n_inliers long, coef array<double>")


def bspline_basis(t: Column, i: int, k: int, knots: list[float]) -> Column:
    """Cox-de Boor basis function of order k at t."""
    if k == 0:
        return F.when((t >= knots[i]) & (t < knots[i + 1]), 1.0).otherwise(0.0)
    out = F.lit(0.0)
    if knots[i + k] > knots[i]:
        out = out + (t - knots[i]) / (knots[i + k] - knots[i]) * bspline_basis(t, i, k - 1, knots)
    if knots[i + k + 1] > knots[i + 1]:
        out = out + (knots[i + k + 1] - t) / (knots[i + k + 1] - knots[i + 1]) * bspline_basis(t, i + 1, k - 1, knots)
    return out


def bspline_bases(t: Column, k: int, knots: list[float]) -> list[Column]:
    """All len(knots) - k - 1 basis functions of degree k at t; the last span includes its end. Outside the knots all are 0."""
    spans = len(knots) - 1
    end = max((i for i in range(spans) if knots[i + 1] > knots[i]), default=-1)
    b = [F.when((t >= knots[i]) & ((t <= knots[i + 1]) if i == end else (t < knots[i + 1])), 1.0).otherwise(0.0) for i in range(spans)]
    for d in range(1, k + 1):
        up = lambda i: (t - knots[i]) / (knots[i + d] - knots[i]) * b[i] if knots[i + d] > knots[i] else F.lit(0.0)
        down = lambda i: (knots[i + d + 1] - t) / (knots[i + d + 1] - knots[i + 1]) * b[i + 1] if knots[i + d + 1] > knots[i + 1] else F.lit(0.0)
        b = [up(i) + down(i) for i in range(spans - d)]
    return b


def bspline_fit(df: DataFrame, by: str, t: str, y: str, k: int, knots: list[float]) -> DataFrame:
    """by, n, coef: least-squares coefficients of the spline of degree k (the smallest ones where they aren't determined).

    A row has at most k + 1 basis functions that aren't 0; their products are summed to the band of the key's normal matrix, so what
    is shuffled and solved is (k + 1) sums a coefficient, however many rows a key has. Rows with a null, or outside the knots, take
    no part; a key of such rows only has no row."""
    import numpy as np

    m = len(knots) - k - 1
    rows = df.select(F.col(by).alias("by_"), F.col(t).cast("double").alias("t_"), F.col(y).cast("double").alias("y_")).where("y_ is not null and not isnan(y_)")
    rows = rows.where((F.col("t_") >= knots[k]) & (F.col("t_") <= knots[m]))
    near = F.filter(F.transform(F.array(*bspline_bases(F.col("t_"), k, knots)), lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda e: e["b"] != 0)
    one = rows.withColumn("near", near).select("by_", "y_", "near", F.posexplode("near").alias("p", "u"))
    one = one.select("by_", "y_", "p", "u", F.explode(F.slice("near", F.col("p") + 1, F.lit(k + 1))).alias("v"))
    first = F.when(F.col("u.i") == F.col("v.i"), F.col("u.b"))
    band = one.groupBy("by_", F.col("u.i").alias("i"), F.col("v.i").alias("j")).agg(F.sum(F.col("u.b") * F.col("v.b")).alias("a"), F.sum(first * F.col("y_")).alias("r"))
    whole = band.groupBy("by_").agg(F.collect_list(F.struct("i", "j", "a", "r")).alias("band"))  # m * (k + 1) entries at most

    def solve(bands: pd.Series) -> pd.Series:
        out = []
        for entries in bands:
            a, r = np.zeros((m, m)), np.zeros(m)
            for e in entries:
                a[e["i"], e["j"]] = a[e["j"], e["i"]] = e["a"]
                if e["i"] == e["j"]:
                    r[e["i"]] = e["r"]
            out.append(np.linalg.lstsq(a, r, rcond=None)[0].tolist())
        return pd.Series(out)

    counts = rows.groupBy("by_").agg(F.count("*").alias("n"))
    fitted = whole.select("by_", F.pandas_udf(solve, "array<double>")("band").alias("coef"))
    return counts.join(fitted, counts["by_"].eqNullSafe(fitted["by_"])).select(counts["by_"].alias(by), "n", "coef")


def bspline_value(coef: Column, t: Column, k: int, knots: list[float]) -> Column:
    """Value at t of the spline with these coefficients."""
    return reduce(lambda u, v: u + v, [F.get(coef, F.lit(i)) * b for i, b in enumerate(bspline_bases(t, k, knots))])


def find_homography(pairs: DataFrame, by: str, threshold: float = 3.0, rounds: int = 2000, confidence: float = 0.995, seed: int = 7) -> DataFrame:
    """by, n_inliers, h (9 values, the last 1): the plane map of (sx, sy) to (tx, ty) with most inliers, refitted on them. Samples of four are
    drawn until one of inliers alone was among them with this confidence, judged by the best share so far; ``rounds`` at most."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        p = p.sort_values(["sx", "sy", "tx", "ty"])
        s, t = p[["sx", "sy"]].to_numpy(float), p[["tx", "ty"]].to_numpy(float)

        def fit(i: np.ndarray) -> np.ndarray:
            r = np.zeros((0, 9))  # the triangle of a QR factorisation, a stretch of pairs after the other
            for at in range(0, len(i), 4096):
                (x, y), (u, v) = s[i[at : at + 4096]].T, t[i[at : at + 4096]].T
                one, none = np.ones_like(x), np.zeros_like(x)
                m = np.stack([x, y, one, none, none, none, -u * x, -u * y, -u, none, none, none, x, y, one, -v * x, -v * y, -v], 1).reshape(-1, 9)
                r = m if len(i) <= 4 else np.linalg.qr(np.concatenate([r, m]), mode="r")
            return np.linalg.svd(r)[2][-1].reshape(3, 3)

        def off(h: np.ndarray) -> np.ndarray:
            w = np.c_[s, np.ones(len(s))] @ h.T
            z = np.where(np.abs(w[:, 2:]) < 1e-12, 1e-12, w[:, 2:])
            return np.hypot(*(w[:, :2] / z - t).T)

        rng, best = np.random.default_rng(seed), np.zeros(len(s), bool)
        need, drawn = rounds if len(s) >= 4 else 0, 0
        while drawn < need:
            drawn += 1
            ok = off(fit(rng.choice(len(s), 4, replace=False))) < threshold
            if ok.sum() > best.sum():
                best, miss = ok, 1 - ok.mean() ** 4
                need = min(rounds, int(np.ceil(np.log(1 - confidence) / np.log(miss)))) if 0 < miss < 1 else rounds if miss else drawn
        h = fit(np.flatnonzero(best)) if best.sum() >= 4 else np.eye(3)
        return pd.DataFrame({by: [p[by].iloc[0]], "n_inliers": [int(best.sum())], "h": [(h / h[2, 2]).ravel().tolist()]})

    return pairs.groupBy(by).applyInPandas(run, f"{by} {pairs.schema[by].dataType.simpleString()}, n_inliers long, h array<double>")
