"""Labelling sends no table through the driver."""

import numpy as np

from gridloom.operators import label as L


def test_no_broadcast(spark, tmp_path):
    g = np.random.default_rng(6)
    on = g.random((30, 40)) < 0.55
    df = spark.createDataFrame([(0, y, x, 0, int(on[y, x])) for y in range(30) for x in range(40)], "img_id long, y int, x int, c int, v int")
    plans = []

    def written(d):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        path = str(tmp_path / str(len(plans)))
        d.write.parquet(path)
        return spark.read.parquet(path)

    out = L.label_components(df, 4, written)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans)
    got = {(r.y, r.x): r.label for r in out.collect()}
    assert got.keys() == set(zip(*map(list, np.nonzero(on))))
    assert all(got[y, x] == got[q] for y, x in got for q in ((y + 1, x), (y, x + 1)) if q in got)
