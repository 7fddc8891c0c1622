"""Text sources: links of pages, addresses of logs, last-wins settings, annotation lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def links(pages: DataFrame) -> DataFrame:
    """page_id, seq, href, label of every anchor with a quoted href, but for navigation labels (all, prev, next)."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    one = pages.select("page_id", F.posexplode(found).alias("seq", "a"))
    one = one.withColumn("href", F.regexp_extract("a", r'(?is)href="([^"]*)"', 1)).withColumn("label", F.trim(F.regexp_replace(F.regexp_extract("a", r"(?is)>(.*)</a>", 1), "<[^>]*>", "")))
    return one.where(~F.lower("label").isin("all", "prev", "next")).select("page_id", "seq", "href", "label")


def addresses(lines: DataFrame, col: str) -> DataFrame:
    """Distinct 0x... tokens."""
    return lines.select(F.explode(F.regexp_extract_all(col, F.lit("0x[0-9a-fA-F]+"), F.lit(0))).alias("address")).distinct()


def ini(lines: DataFrame) -> DataFrame:
    """lines (pos, line) to (section, key, value): the last value of a key wins; ; and # begin comments."""
    text = F.trim(F.regexp_replace("line", "[;#].*$", ""))
    head = F.regexp_extract(text, r"^\[(.*)\]$", 1)
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one file
    s = lines.withColumn("section", F.coalesce(F.last(F.when(head != "", head), ignorenulls=True).over(w), F.lit("")))
    kv = s.where(text.contains("=") & (head == "")).select("pos", "section", F.trim(F.substring_index(text, "=", 1)).alias("key"), F.trim(F.regexp_extract(text, "^[^=]*=(.*)$", 1)).alias("value"))
    return kv.groupBy("section", "key").agg(F.max_by("value", "pos").alias("value"))


def kitti_line(name: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Annotation line with corners instead of width and height."""
    n = lambda c: F.format_string("%.2f", c)
    return F.concat_ws(" ", name, F.lit("0.0 0 0.0"), n(x), n(y), n(x + w), n(y + h), F.lit("0.0 0.0 0.0 0.0 0.0 0.0 0.0"))
