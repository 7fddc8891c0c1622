"""Images with few and with many boxes meet in their own ways; the overlap of a pair is worked out once."""

import numpy as np
import pytest

from gridloom.operators import match as M
from gridloom.operators import polygons as P


@pytest.mark.parametrize("few", [0, 4, 100])
def test_few_and_many(spark, monkeypatch, few):
    monkeypatch.setattr(M, "FEW", few)
    g = np.random.default_rng(4)
    at, img = g.uniform(0, 40, (120, 2)), np.r_[np.zeros(40, int), g.integers(1, 25, 80)]
    rows = [(int(i), k, *map(float, (x, y, x + 9, y + 9))) for k, (i, (x, y)) in enumerate(zip(img, at))] + [(None, 900, 0.0, 0.0, 9.0, 9.0), (1, 901, 5.0, 5.0, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "img_id int, box_id int, x1 double, y1 double, x2 double, y2 double")
    other = df.where("box_id % 3 <> 0")  # few on one side, many on the other
    got = [(r.abox_id, r.bbox_id) for r in M.pairwise(other, df).collect()]
    want = {(i, j) for i in range(120) for j in range(120) if i % 3 and img[i] == img[j] and (abs(at[i] - at[j]) < 9).all()}
    assert len(got) == len(set(got)) and set(got) == want


def test_overlap_once(spark):
    df = spark.range(4).selectExpr("id", "array(0d, 0d, 2d, 0d, 2d, 2d, 0d, 2d) as a", "array(1d, 0d, 3d, 0d, 3d, 2d, 1d, 2d) as b")
    out = df.withColumn("iou", P.quad_overlap("a", "b")).where("iou > 0")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and out.count() == 4
