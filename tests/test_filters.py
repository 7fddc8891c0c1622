"""Filters composed from steps against plain loops; one key holds a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import filters as L

MOVE = np.array([[1, 0, 0.5, 0], [0, 1, 0, 0.5], [0, 0, 1, 0], [0, 0, 0, 1.0]])
SEEN = np.array([[1, 0, 0, 0], [0, 1, 0.1, 0]])
NOISE = np.array([[0.125, 0], [0, 0.125], [0.5, 0], [0, 0.5]])
ERROR = np.array([[4, 1], [1, 9.0]])
PUSH = np.array([0.1, 0, 0, -0.2])
X0, P0 = np.array([1.0, 2, 0, 0]), np.array([[10, 1, 0, 0], [1, 10, 0, 0], [0, 0, 5, 0], [0, 0, 0, 5.0]])


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(1)
    got = [(0 if i % 3 == 0 else int(g.integers(1, 30)), i // 2, float(g.normal()), float(g.normal()) if i % 11 else None) for i in range(3000)]
    return got + [(77, 1, 5.0, 6.0), (78, 1, None, 2.0)]


def table(spark, rows):
    return spark.createDataFrame([*rows, (None, 1, 1.0, 1.0)], "k long, i long, a double, b double").withColumn("order0_", F.lit("clash")).repartition(8)


def of_key(rows, k):
    """In the order of the filter: by place, then by value with unknown ones (not a number) last."""
    inf = float("inf")
    mine = sorted((r[1:] for r in rows if r[0] == k), key=lambda r: (r[0], *(inf if v is None else v for v in r[1:])))
    return [np.array([np.nan if v is None else v for v in r[1:]]) for r in mine]


def plain(zs):
    x, p = X0, P0
    for z in zs:
        x, p = MOVE @ x + PUSH, MOVE @ p @ MOVE.T + NOISE @ NOISE.T
        if np.isfinite(z).all():
            gain = p @ SEEN.T @ np.linalg.inv(SEEN @ p @ SEEN.T + ERROR)
            x, p = x + gain @ (z - SEEN @ x), p - gain @ SEEN @ p
    return x, p


@pytest.mark.parametrize("root", [None, "direct", "symmetric"])
def test_two_measurements(spark, rows, root):
    df = table(spark, rows)
    got = {r.k: r for r in L.kalman(df, "k", ["i"], [F.col("a"), F.col("b")], MOVE, SEEN, NOISE, ERROR, X0, P0, PUSH, root).collect()}
    assert got.keys() == {r[0] for r in rows}
    for k, r in got.items():
        x, p = plain(of_key(rows, k))
        assert np.allclose(r.x, x, atol=1e-10) and np.allclose(r.p, p.ravel(), atol=1e-10)
    assert L.kalman(df.limit(0), "k", ["i"], [F.col("a"), F.col("b")], MOVE, SEEN, NOISE, ERROR, X0, P0, PUSH, root).count() == 0


@pytest.mark.parametrize("root", [None, "direct", "symmetric"])
def test_first_row_is_the_state(spark, rows, root):
    got = {r.k: r for r in L.kalman(table(spark, rows), "k", ["i"], [F.col("a")], [[1.0]], [[1.0]], [[0.1]], [[4.0]], None, [[1.0]], None, root).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        zs = sorted((r[1], r[2]) for r in rows if r[0] == k and r[2] is not None)
        for n, (_, z) in enumerate(zs):
            p = 1.0 if n == 0 else p + 0.01
            x, p = (z, p) if n == 0 else (x + p / (p + 4) * (z - x), p - p / (p + 4) * p)
            want[k] = x, p
    assert got.keys() == want.keys()
    assert all(np.allclose((got[k].x[0], got[k].p[0]), want[k], atol=1e-12) for k in want)


def test_low_pass_of_vectors(spark, rows):
    known = [r for r in rows if None not in r]
    got = {r.k: r.v for r in L.low_pass(table(spark, known), "k", ["i"], F.array("a", "b"), 0.9).collect()}
    assert got.keys() == {r[0] for r in known}
    for k, v in got.items():
        zs = of_key(known, k)
        want = zs[0]
        for z in zs[1:]:
            want = want * 0.9 + 0.1 * z
        assert np.allclose(v, want, atol=1e-12)


def test_strings_as_keys_and_values_of_null(spark):
    df = spark.createDataFrame([("a", 2, 3.0), ("a", 1, 1.0), ("b", 1, None), ("a", None, 5.0)], "k string, i int, x double")
    got = L.low_pass(df, "k", ["i"], F.when(F.col("x").isNotNull(), F.array("x")), 0.5).collect()
    assert [(r.k, r.v) for r in got] == [("a", [3.0])]  # a null place comes first: 5, then 1, then 3


def test_a_large_key_is_many_tasks(spark):
    """The key of a third of the rows is cut over the tasks of the first shuffle, and any cut gives the same result."""
    df = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).cast("long").alias("k"), "id", (F.col("id") % 101).cast("double").alias("x"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stretch = df.repartitionByRange("k", "id").groupBy("k", F.spark_partition_id()).count()
        assert stretch.where("k = 0").count() >= 3
        cut = {r.k: r.v[0] for r in L.low_pass(df, "k", ["id"], F.array("x"), 0.9).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {}
    for i in range(60000):
        k, x = (0 if i % 3 == 0 else i % 50 + 1), float(i % 101)
        want[k] = want[k] * 0.9 + 0.1 * x if k in want else x
    assert cut.keys() == want.keys() and all(abs(cut[k] - want[k]) < 1e-10 for k in want)


@pytest.mark.parametrize("name", sorted(L.CORRECTIONS))
def test_one_correction(name):
    g = np.random.default_rng(5)
    s = np.linalg.cholesky(P0)
    s = L.predict_root(s, MOVE, NOISE)
    p = s @ s.T
    assert np.allclose(p, MOVE @ P0 @ MOVE.T + NOISE @ NOISE.T)
    for m in (1, 2, 3):
        h, v = g.normal(size=(m, 4)), np.tril(g.normal(size=(m, m))) + 2 * np.eye(m)
        gain, after = L.CORRECTIONS[name](s, h, v)
        want = p @ h.T @ np.linalg.inv(h @ p @ h.T + v @ v.T)
        assert np.allclose(gain, want) and np.allclose(after @ after.T, p - want @ h @ p)


def test_spline_fit(spark):
    from gridloom.operators import series as S

    knots, k, g = [0.0, 0, 0, 0, 1, 2, 3, 4, 4, 4, 4], 3, np.random.default_rng(4)

    def basis(t, i, d):
        if d == 0:
            return float(knots[i] <= t < knots[i + 1] or (t == 4 and knots[i] < 4 == knots[i + 1]))
        left = (t - knots[i]) / (knots[i + d] - knots[i]) * basis(t, i, d - 1) if knots[i + d] > knots[i] else 0
        return left + ((knots[i + d + 1] - t) / (knots[i + d + 1] - knots[i + 1]) * basis(t, i + 1, d - 1) if knots[i + d + 1] > knots[i + 1] else 0)

    rows = [("a" if i % 3 == 0 else f"k{i % 4}", float(t), float(np.sin(t) + g.normal() / 10)) for i, t in enumerate(np.r_[g.uniform(0, 4, 300), 0, 4, 4])]
    odd = [("a", 9.0, 1.0), ("a", 1.0, None), ("none", None, 1.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows + odd, "g string, t double, y double").withColumn("near", F.lit(1))
    got = {r.g: r for r in S.bspline_fit(df, "g", "t", "y", k, knots).collect()}
    assert set(got) == {r[0] for r in rows} | {None} and got[None].n == 1
    for key in {r[0] for r in rows}:
        t, y = np.array([r[1:] for r in rows if r[0] == key]).T
        a = np.array([[basis(x, i, k) for i in range(7)] for x in t])
        assert got[key].n == len(t) and np.allclose(got[key].coef, np.linalg.lstsq(a, y, rcond=None)[0], atol=1e-8)
    one = spark.createDataFrame([(got["a"].coef, 4.0)], "c array<double>, t double").select(S.bspline_value(F.col("c"), F.col("t"), k, knots)).first()[0]
    assert abs(one - got["a"].coef[-1]) < 1e-12
    assert S.bspline_fit(df.limit(0), "g", "t", "y", k, knots).count() == 0


def test_homography_among_many_outliers(spark):
    from gridloom.operators import series as S

    g = np.random.default_rng(9)
    h = np.array([[1.1, 0.2, 3], [-0.1, 0.9, 5], [0.001, 0.0, 1]])
    s = g.uniform(0, 100, (120, 2))
    w = np.c_[s, np.ones(120)] @ h.T
    t = w[:, :2] / w[:, 2:]
    t[40:] = g.uniform(0, 150, (80, 2))  # two thirds are wrong: about 370 samples are needed
    few = [("few", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([("a", *map(float, (*p, *q))) for p, q in zip(s, t)] + few, "g string, sx double, sy double, tx double, ty double")
    got = {r.g: r for r in S.find_homography(df, "g", 1.0).collect()}
    assert got["a"].n_inliers >= 40 and np.allclose(np.array(got["a"].h).reshape(3, 3), h, atol=0.05)
    assert got["few"].n_inliers == 0
