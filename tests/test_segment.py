"""Corners of the segment test against a plain loop, decided by the places on the axes first."""

import numpy as np
import pytest

from gridloom.operators import neighbour as B


@pytest.mark.parametrize("run", [3, 9, 12])
def test_fast_corners(spark, run):
    g = np.random.default_rng(run)
    v = g.integers(0, 3, (14, 17)) * 20
    v[:, 8:] = np.where(g.random((14, 9)) < 0.9, 60, 0)
    df = spark.createDataFrame([(0, y, x, 0, int(v[y, x])) for y in range(14) for x in range(17)], "img_id long, y int, x int, c int, v int")
    out = B.fast_corners(df, 12, run)
    assert "bit_count" in out._jdf.queryExecution().optimizedPlan().toString()

    def corner(y, x):
        d = [int(v[y + a, x + b]) - int(v[y, x]) for a, b in B.RING] * 2
        return any(all(s * e > 12 for e in d[k : k + run]) for s in (1, -1) for k in range(16))

    want = {(y, x) for y in range(3, 11) for x in range(3, 14) if corner(y, x)}
    assert want and {(r.y, r.x) for r in out.collect()} == want
