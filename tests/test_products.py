"""Products of tiles against numpy, without a Python object a cell."""

import tracemalloc

import numpy as np
import pyarrow as pa

from gridloom.operators import linalg as L


def tile(m):
    return [{"i": i, "j": j, "v": float(m[i, j])} for i in range(m.shape[0]) for j in range(m.shape[1])][::-1]  # in any order


def test_products_of_tiles():
    g = np.random.default_rng(8)
    pairs = [(g.normal(size=(a, b)), g.normal(size=(b, c))) for a, b, c in [(64, 64, 64)] * 20 + [(3, 5, 2), (1, 1, 1), (64, 7, 9)]]
    kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))
    left, right = (pa.array([tile(p[k]) for p in pairs], kind) for k in (0, 1))
    tracemalloc.start()
    got = L._products(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6
    for (x, y), r in zip(pairs, got.to_pylist()):
        assert np.allclose(np.array(r["z"]).reshape(-1, r["w"]), x @ y)
    assert len(L._products(left[:0], right[:0])) == 0
