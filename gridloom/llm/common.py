"""Shared helpers of the training-data operators: text rules, scratch tables and column hygiene."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.shared import write_table as scratch  # noqa: F401  (the operators' name for it)

#: White space of every text rule here: space and the five ASCII controls tab to carriage return.
WS = r"[\x20\x09-\x0D]"
NON_WS = r"[^\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones of any name can't clash with what an operator adds."""
    return df.select(*(F.col(f"`{n}`") for n in names))


#: A key with more than 1 / SHARE of a table's rows is hot (so there are fewer than SHARE of them) and dealt to PIECES tasks.
SHARE, PIECES = 64, 64


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The hot keys of a written table, in a column hot: fewer than SHARE rows."""
    few = df.groupBy(F.col(key).alias("hot")).count().where(F.col("count") * SHARE > max(df.count(), 16 * SHARE))
    return scratch(few.select("hot"), "hot-keys")


def lookup(left: DataFrame, key: str, found: DataFrame, by: str, hot: DataFrame) -> DataFrame:
    """left join found on key; found has one row per key. Rows of hot keys are dealt out by a hash of ``by`` and meet a copy of the key's row
    in each piece, so that no key goes to one task."""
    is_hot = F.col("hot").isNotNull()
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left").withColumn("piece", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(PIECES)).cast("int")).otherwise(0))
    pieces = F.when(is_hot, F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0)))
    copied = found.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left").withColumn("piece", F.explode(pieces)).drop("hot")
    return dealt.drop("hot").join(copied, [key, "piece"], "left").drop("piece")
