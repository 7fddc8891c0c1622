"""Where tables that a job writes for itself go, and how they are removed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session has it.

    Where it is unset a local session gets a temporary folder of its own (and keeps it); a session on
    a cluster falls back to its warehouse, never to a folder that only one machine sees.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        base = getattr(spark, "_gridloom_shared", None) or "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark._gridloom_shared = base
        return base
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_gridloom"


def written_tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that were written for this session and not removed."""
    if not hasattr(spark, "_gridloom_written"):
        spark._gridloom_written = []
    return spark._gridloom_written


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: later work starts from the
    written rows, so an executor that is lost costs no more than the tasks that re-read them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written_tables(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the tables written after the first ``since``, but for the last ``keep``. Results that were made from them and
    not yet used or written can't be read any more."""
    tables = written_tables(spark)
    gone = tables[since : len(tables) - keep]
    del tables[since : since + len(gone)]
    conf = spark._jsc.hadoopConfiguration()
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def writer(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table to the shared folder and reads it back, cutting its lineage."""
    return lambda df: write_table(df, name)
