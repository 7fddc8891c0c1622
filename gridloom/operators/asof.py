"""As-of joins: the last mark at or before a key, and the symbols of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.shared import write_table


def latest_marks(keys: DataFrame, marks: DataFrame, key: str, *held: str) -> DataFrame:
    """Each distinct key of ``keys`` with ``start``, the largest key of ``marks`` that isn't above it, and that row's ``held`` columns
    (nulls where there is none; of marks with one key the smallest ``held`` values count). Null keys have no row.

    Keys and marks are range-partitioned together, so a range that holds a third of the rows is many tasks; inside a range a window
    looks back, and what a range begins with comes from the ranges before it: one row a range. The ranges are written once, since both
    looks must see the same ones.
    """
    spot = F.struct(F.col(key).alias("start"), *held)
    first = marks.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*held)).alias("m")).select(key, *(F.col(f"m.{c}").alias(c) for c in held))
    probes = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("spot", F.lit(None))
    both = first.select(key, spot.alias("spot")).unionByName(probes.withColumn("spot", F.lit(None).cast(first.select(spot.alias("s")).schema["s"].dataType)))
    both = write_table(both.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "asof")
    tops = both.groupBy("part").agg(F.max_by("spot", F.when(F.col("spot").isNotNull(), F.col(key))).alias("top"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    tops = tops.select("part", F.last("top", ignorenulls=True).over(before).alias("carried"))
    # at one key the mark comes first
    back = Window.partitionBy("part").orderBy(key, F.col("spot").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seen", F.last("spot", ignorenulls=True).over(back)).where(F.col("spot").isNull())
    found = seen.join(tops, "part").select(key, F.coalesce("seen", "carried").alias("at"))
    return found.select(key, "at.start", *(F.col(f"at.{c}").alias(c) for c in held))


def address_value(address: Column) -> Column:
    """The number of a 0x... token of up to 16 hexadecimal digits; null for another."""
    digits = F.regexp_extract(address, r"\A0[xX]([0-9a-fA-F]{1,16})\z", 1)
    return F.when(digits != "", F.conv(digits, 16, 10)).cast("decimal(20,0)")


def symbols_of(addresses: DataFrame, symbols: DataFrame) -> DataFrame:
    """addresses: address (0x...). symbols: name, start, size (null: up to the next one). Each distinct address with the symbol that it lies
    in and how far from its start: address, name, away (decimal(20,0), as addresses may have 64 bits); nulls for one that lies in none."""
    known = addresses.select("address", address_value(F.col("address")).alias("value")).distinct()
    marks = symbols.select(F.col("start").cast("decimal(20,0)").alias("value"), "name", "size")
    found = latest_marks(known, marks, "value", "name", "size")
    away = F.col("value") - F.col("start")
    inside = F.coalesce(away < F.col("size"), F.col("start").isNotNull())
    j = known.join(found, "value", "left")
    return j.select("address", F.when(inside, F.col("name")).alias("name"), F.when(inside, away.cast("decimal(20,0)")).alias("away"))
