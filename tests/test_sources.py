"""Raw arrays as a data source, symbols of addresses, long numbers."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.operators import asof
from gridloom.sources import rawarrays
from gridloom.sources.files import DTYPE


@pytest.mark.parametrize("kind", list(DTYPE))
def test_raw_files_in_several_tasks(spark, tmp_path, kind):
    """A file that is cut at places that aren't row ends, beside an empty one, hidden ones and one with bytes to spare."""
    r = np.random.default_rng(3)
    values = (r.normal(size=1001) * 1e3).astype(DTYPE[kind]) if kind[0] == "F" else r.integers(np.iinfo(DTYPE[kind]).min, np.iinfo(DTYPE[kind]).max, 1001, DTYPE[kind], endpoint=True)
    values.tofile(tmp_path / "a.raw")
    (tmp_path / "b.raw").write_bytes(values[:5].tobytes() + (b"" if kind[-1] == "8" else b"x"))
    (tmp_path / "empty.raw").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"12345678")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "c.raw").write_bytes(b"12345678")
    got = rawarrays.scan_raw(spark, str(tmp_path), kind, 7, 3, part_bytes=100 * values.itemsize)
    assert got.rdd.getNumPartitions() == 11  # the last one has the rest of a.raw, and b.raw
    rows = {(q.path.rsplit("/", 1)[1], q.y, q.x, q.c): q.v for q in got.collect()}
    want = {(name, i // 21, i // 3 % 7, i % 3): v for name, n in (("a.raw", 1001), ("b.raw", 5)) for i, v in enumerate(values[:n].tolist())}
    assert rows == want
    pruned = rawarrays.scan_raw(spark, f"{tmp_path}/a.raw", kind, 7, 3, columns="v, y")
    assert pruned.columns == ["v", "y"] and sorted(map(tuple, pruned.collect())) == sorted((v, i // 21) for i, v in enumerate(values.tolist()))
    assert rawarrays.scan_raw(spark, str(tmp_path), kind, 7, 3, glob="none*").count() == 0


def test_raw_dump(spark, tmp_path):
    cells = spark.range(60 * 40).select((F.col("id") % 3).alias("img_id"), F.floor(F.col("id") / 120).alias("y"), (F.floor(F.col("id") / 3) % 40).alias("x"), F.lit(0).alias("c"), (F.col("id") % 251).alias("v"))
    rawarrays.dump_raw(cells.repartition(5), f"{tmp_path}/out", "U8")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0.raw", "1.raw", "2.raw"]
    for k in range(3):
        assert (tmp_path / "out" / f"{k}.raw").read_bytes() == bytes(i % 251 for i in range(k, 2400, 3))
    rawarrays.dump_raw(cells.limit(0), f"{tmp_path}/none", "U8")
    loose = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("a", b"3")], "name string, content binary").coalesce(1)
    with pytest.raises(Exception, match="several tasks or not in order"):
        loose.write.format("raw_arrays").mode("append").save(f"{tmp_path}/bad")
    assert list((tmp_path / "bad").iterdir()) == []


def test_latest_marks(spark):
    """Against bisection; a third of the keys lie between two marks, and there are keys before the first mark."""
    r = random.Random(5)
    marks = sorted({r.randrange(-(10**6), 10**6) * 1000 for _ in range(300)})
    keys = {r.randrange(-(2 * 10**9), 2 * 10**9) for _ in range(1500)} | {marks[7] + k for k in range(1, 700)} | set(marks[:50])
    m = [(k, f"s{i}") for i, k in enumerate(marks)] + [(marks[3], "zz"), (None, "null")]
    got = asof.latest_marks(spark.createDataFrame([(k,) for k in [*keys, None, *marks[:9]]], "k long"), spark.createDataFrame(m, "k long, name string"), "k", "name").collect()
    want = {}
    for k in keys:
        i = bisect.bisect_right(marks, k) - 1
        want[k] = (marks[i], f"s{i}") if i >= 0 else (None, None)
    assert len(got) == len(keys) and {q.k: (q.start, q.name) for q in got} == want
    none = spark.createDataFrame([], "k long, name string")
    assert [tuple(q) for q in asof.latest_marks(spark.createDataFrame([(4,)], "k long"), none, "k", "name").collect()] == [(4, None, None)]
    assert asof.latest_marks(none.select("k"), none, "k", "name").count() == 0


def test_symbols(spark):
    a = spark.createDataFrame([("0x10",), ("0x1f",), ("0x20",), ("0xffffffffffffffff",), ("0x1",), ("0X1F",), ("zero",), (None,)], "address string")
    s = spark.createDataFrame([("f", 16, 16), ("g", 32, None)], "name string, start long, size long")
    got = {q.address: (q.name, q.away) for q in asof.symbols_of(a, s).collect()}
    assert got["0x10"] == ("f", 0) and got["0x1f"] == got["0X1F"] == ("f", 15) and got["0x20"] == ("g", 0) and got["0x1"] == got["zero"] == got[None] == (None, None)
    short = {q.address: q.name for q in asof.symbols_of(a, s.where("name = 'f'")).collect()}
    assert short["0x1f"] == "f" and short["0x20"] is None and short["0xffffffffffffffff"] is None


def test_long_numbers(spark):
    r = random.Random(6)
    pairs = [(str(r.randrange(10 ** r.randrange(1, 260))), str(r.randrange(10 ** r.randrange(1, 260)))) for _ in range(60)]
    pairs += [("0", "0"), ("0", "99"), ("000", "7"), ("9" * 200, "9" * 200), ("1" + "0" * 120, "1" + "0" * 99), ("999999", "1"), ("999999999999", "1000001")]
    df = spark.createDataFrame([*pairs, ("", "1"), (None, "1"), ("-1", "1"), ("1", "1a"), ("1\n", "1")], "a string, b string")
    got = df.select("a", "b", A.long_product(F.col("a"), F.col("b")).alias("p"), A.long_sum(F.col("a"), F.col("b")).alias("s")).collect()
    for q in got[: len(pairs)]:
        assert q.p == str(int(q.a) * int(q.b)) and q.s == str(int(q.a) + int(q.b))
    assert all(q.p is None and q.s is None for q in got[len(pairs) :])
