"""Queries over arrays against their SQL where the last image of the table is cut off."""

import pytest
from compare import engine, rows

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["grid_dft", "grid_idft", "grid_dft_8", "split_nv12", "split_yu12", "split_yv12"])
def test_cut_image(spark, tmp_path, name):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 64")
    more = e.selectExpr("vec_id + 64 as vec_id", "embedding", "label").where("vec_id < 64 + 42")  # 42 rows: the second chroma plane is cut
    last = e.selectExpr("vec_id + 128 as vec_id", "embedding", "label").where("vec_id < 128 + 51")
    e.union(more).union(last).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = engine("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = rows(con.execute(entry.oracle_sql()[name]).df())
    assert rows(entry.queries()[name](spark, str(tmp_path)).toPandas()) == want
