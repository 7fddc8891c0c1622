"""Crowded grid cells and pairs of boxes are dealt to several tasks; a plane map is fitted on many pairs in bounded memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.operators import match as M
from gridloom.operators import series as S


@pytest.mark.parametrize("name", ["within", "points_in_boxes"])
def test_one_crowded_cell(spark, monkeypatch, name):
    monkeypatch.setattr(M, "BLOCK", 50, raising=False)
    g = np.random.default_rng(1)
    p, s = g.uniform(0.1, 3.9, (500, 2)), g.uniform(0.1, 3.9, (300, 2))
    p[:50] += 90.0
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(9000, None, 1.0)], "point_id int, px double, py double")
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(s)], "site_id int, sx double, sy double")
    off = abs(p[:, None] - s)
    if name == "within":
        out, want = M.within(points, sites, 4.0), np.hypot(*off.T).T <= 4.0
    else:
        boxes = sites.select(F.col("site_id").alias("box_id"), *(F.expr(f"s{c[0]} {'-' if c[1] == '1' else '+'} 2").alias(c) for c in ("x1", "y1", "x2", "y2")))
        out, want = M.points_in_boxes(points, boxes, 4.0), (2 - off).min(2) > 1e-9
    tasks = out.withColumn("task", F.spark_partition_id()).toPandas()
    found = list(tasks.iloc[:, :2].itertuples(index=False, name=None))
    assert len(found) == len(set(found)) and set(found) == set(zip(*map(list, np.nonzero(want))))
    assert tasks.groupby("task").size().max() < len(found) / 2


def test_assignment_is_dealt(spark):
    """Images of few bytes go to all partitions, both to be ranked and where a claimed anchor meets all truths again."""
    g = np.random.default_rng(7)
    at, size = g.uniform(0, 30, (1200, 2)), g.uniform(5, 14, (1200, 2))
    rows = [(k // 40, k, *map(float, (*at[k], *(at[k] + size[k])))) for k in range(1200)]
    df = spark.createDataFrame(rows + [(None, 9000, 0.0, 0.0, 9.0, 9.0), (None, 9001, 0.0, 0.0, 9.0, 9.0), (77, 9002, 0.0, 0.0, 9.0, 9.0)], "img_id int, box_id long, x1 double, y1 double, x2 double, y2 double")
    out = M.atss(df.where("box_id % 4 = 0"), df.where("box_id % 4 <> 0"), 5)
    want, contested = {}, 0
    for img in range(30):
        ids = np.arange(40) + 40 * img
        a, b = ids[ids % 4 == 0], ids[ids % 4 != 0]
        both = np.clip(np.minimum((at + size)[a, None], (at + size)[b]) - np.maximum(at[a, None], at[b]), 0, None).prod(2)
        share = (both / (size[a].prod(1)[:, None] + size[b].prod(1) - both)).round(6)
        mid = at + size / 2
        near = np.hypot(*np.moveaxis(mid[a, None] - mid[b], 2, 0)).argsort(1)[:, :5]
        held = np.take_along_axis(share, near, 1)
        claim = np.zeros(share.shape, bool)
        np.put_along_axis(claim, near, held > (held.mean(1) + held.std(1, ddof=1)).round(6)[:, None], 1)
        claim &= (abs(mid[a, None] - mid[b]) < size[a, None] / 2).all(2)
        for k in np.nonzero(claim.any(0))[0]:
            contested += claim[:, k].sum() > 1
            best = (claim[:, k] if claim[:, k].sum() == 1 else share[:, k]).argmax()
            want[img, int(b[k])] = (int(a[best]), float(share[best, k]))
    tasks = out.withColumn("task", F.spark_partition_id()).toPandas()
    assert {(r.img_id, r.bbox_id): (r.abox_id, r.iou) for r in tasks.itertuples()} == want and len(tasks) == len(want) and contested > 5
    assert tasks.groupby("task").size().max() < len(tasks) / 2 and tasks.task.nunique() > 8  # more than are set
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2


def test_homography_of_many_pairs(spark):
    """The full left factor of 40,000 pairs would take 51 GB."""
    df = spark.range(40_000).select(F.lit(1).alias("g"), (F.col("id") % 200).cast("double").alias("sx"), F.floor(F.col("id") / 200).cast("double").alias("sy"))
    w = 0.001 * F.col("sx") + 1
    df = df.withColumn("tx", (1.1 * F.col("sx") + 0.2 * F.col("sy") + 3) / w).withColumn("ty", (0.9 * F.col("sy") - 0.1 * F.col("sx") + 5) / w)
    got = S.find_homography(df, "g").first()
    assert got.n_inliers == 40_000 and np.allclose(got.h, [1.1, 0.2, 3, -0.1, 0.9, 5, 0.001, 0, 1], atol=1e-8)


def test_pairs_within_take_few_bytes(spark, tmp_path):
    """F1: 3.2 million pairs took 9.0 bytes each in files, since no dictionary held their distances."""
    spark = spark.newSession()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    g = np.random.default_rng(4)
    spots = lambda n: np.stack([g.integers(0, 120_000, n) / 1e4, g.integers(0, 12, n).astype(float)], 1)
    p, s = spots(6000), spots(1500)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "point_id long, px double, py double")
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(s)], "site_id long, sx double, sy double")
    M.within(points, sites, 5.0).withColumn("dist", N.rounded(F.col("dist"), 6)).write.parquet(str(tmp_path / "out"))
    off = p[:, None] - s
    far = np.sqrt(off[..., 0] * off[..., 0] + off[..., 1] * off[..., 1])
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    at = np.full(far.shape, np.nan)
    at[got.point_id, got.site_id] = got.dist
    assert len(got) == (far <= 5).sum() > 2_000_000 and np.array_equal(np.isnan(at), far > 5) and np.nanmax(abs(at - far)) < 6e-7
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 4 * len(got)


@pytest.mark.parametrize("radius", [0.3, 0.7, 4.0])
def test_within_at_the_radius(spark, radius):
    """Steps of a tenth: many pairs are as far apart as the radius, and rounding puts some of them on other sides of a grid line."""
    at = [(k, x / 10, y / 10) for k, (x, y) in enumerate((x, y) for x in range(-3, 61, 4) for y in (-41, -40, -1, 0, 24, 64))]
    odd = [(900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 1.0), (903, 1.0, float("-inf"))]
    points, sites = (spark.createDataFrame(at + odd, f"{n}_id int, {n[0]}x double, {n[0]}y double") for n in ("point", "site"))
    got = [tuple(r) for r in M.within(points, sites, radius).collect()]
    want = {(i, j, d) for i, x, y in at for j, u, v in at if (d := float(np.sqrt((x - u) * (x - u) + (y - v) * (y - v)))) <= radius}
    assert len(got) == len(want) and set(got) == want


def test_rounded_is_round(spark):
    g = np.random.default_rng(5)
    v = [*g.uniform(-6, 6, 3000), *(g.integers(-999, 999, 999) / 2e6), *(np.nextafter(g.integers(-999, 999, 999) / 2e6, 9)), *(10.0 ** g.uniform(-9, 300, 300)), 0.0, -0.0, -1e-9, 2.0**53 / 1e6, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(None if x is None else float(x),) for x in v], "v double")
    bad = df.select("v", N.rounded(F.col("v"), 6).alias("a"), F.round("v", 6).alias("b")).where("NOT a <=> b OR cast(a AS string) <> cast(b AS string)")
    assert not bad.collect()
