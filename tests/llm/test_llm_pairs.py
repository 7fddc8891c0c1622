"""Frequent pairs travel packed, a row for each part and shard."""

import numpy as np
import pyarrow as pa

from gridloom.llm import collocations as K
from gridloom.llm.postings import deltas, packed, unpacked


def test_summed_has_a_row_for_each_shard():
    """op13: a row for each frequent pair and shard made a join that grew with both."""
    codes = [np.array([3, 5, 900, 1 << 33]), np.array([5, 7, 900]), np.array([7])]
    counts = [np.array([1, 20, 40, 2]), np.array([15, 1, 3]), np.array([2])]
    length = np.array([4, 3, 1])
    part = pa.table({"part": [6, 6, 6], "shard": [10, 11, 12], "codes": packed(deltas(np.concatenate(codes), length), length), "n": packed(np.concatenate(counts), length)})
    got = {r["shard"]: r for r in K.summed(part, 30).to_pylist()}
    assert set(got) == {-1, 10, 11} and all(r["part"] == 6 for r in got.values())
    read = lambda k, c: np.cumsum(unpacked(got[k][c])).tolist()
    assert read(-1, "codes") == [5, 900] and unpacked(got[-1]["n"]).tolist() == [35, 43]
    assert read(10, "codes") == read(11, "codes") == [5, 900] and read(10, "n") == read(11, "n") == [0, 1]
    assert K.summed(part, 1000).num_rows == 0  # no frequent pair
