"""Stream queries over events split in several files, out of order, one file a batch, against their batch twins in SQL."""

import pytest
from pyspark.sql import functions as F

from compare import engine, rows
from gridloom.plans.registry import ORACLES, QUERIES
from gridloom.streaming import entities as S

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_dir(spark, tmp_path_factory):
    """events dealt to five files by a hash, so that every batch goes back in time."""
    at = tmp_path_factory.mktemp("split")
    e = spark.read.parquet(f"{DIR}/events.parquet")
    for k in range(5):
        e.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == k).coalesce(1).write.parquet(f"{at}/events-{k}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["stream_window_counts", "stream_low_pass", "stream_duty", "stream_distinct"])
def test_batches_out_of_order(spark, split_dir, name, monkeypatch):
    from gridloom.plans import streams

    monkeypatch.setattr(streams, "stream", lambda s, d: S.read_events(s, f"{d}/events*.parquet", files_per_batch=1))
    con = engine(DIR)
    assert rows(QUERIES[name](spark, split_dir).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_idle_keys_are_forgotten(spark, tmp_path):
    """A key's state goes after its idle time, so it starts anew; within it, it goes on from batch to batch."""
    for k, (minute, user, value) in enumerate([(0, 1, 10.0), (1, 1, 20.0), (200, 2, 1.0), (201, 2, 1.0), (400, 1, 5.0)]):
        one = spark.createDataFrame([(k, user, value)], "event_id long, user_id long, value double")
        one.select("event_id", F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minute)).alias("ts"), "user_id", F.lit("x").alias("event_type"), "value", F.lit("{}").alias("props")).coalesce(1).write.parquet(f"{tmp_path}/e{k}.parquet")
    stream = S.read_events(spark, f"{tmp_path}/e*.parquet", files_per_batch=1)
    got = S.drain(S.low_pass_state(stream, "user_id", 0.5, idle_ms=600_000, late="1 minute"), "update").collect()
    assert sorted((r.user_id, r.n, r.v) for r in got) == [(1, 1, 5.0), (1, 1, 10.0), (1, 2, 15.0), (2, 1, 1.0), (2, 2, 1.0)]
