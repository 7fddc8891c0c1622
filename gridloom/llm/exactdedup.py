"""Exact dedup by a content sort.

Texts are range-partitioned by sampled splitters over (head, hash, piece): the first HEAD characters of the normalised text,
its 64-bit hash and a piece number. Splitters come to the driver, so they stay short whatever the texts. Every partition
is sorted by the whole normalised text and the id (Spark's external sort, which spills), so equal texts are adjacent, and
the window operator compares each text in full with its neighbour to find the runs. Of a run the row with the
smallest id stays.

A group of copies may hold a third of all rows. Only texts whose hash occurs more than ``run`` times are cut into pieces by a hash
of the id, so that splitters may fall inside their runs; ``run`` grows with the table, so there are at most HOT such texts.
The first rows of their pieces are brought together again by comparing the texts in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import columns, scratch

HEAD, LEAST, HOT = 24, 256, 50_000
KEY = ("head", "h", "piece")


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty. A lone space needs no replacement."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _runs(docs: DataFrame, id_col: str, text_col: str, rows: int, rule: Callable[[Column], Column] = normalised) -> DataFrame:
    """Every row (packed in ``row``) with its sort key, normalised text, run (within the key), place in the run and its length."""
    norm = rule(F.col(f"`{text_col}`"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.substring(norm, 1, HEAD).alias("head"), F.xxhash64(norm).alias("h"))
    # at most rows / run <= HOT texts are over it: what is broadcast is bounded
    run = max(LEAST, rows // HOT)
    often = docs.select(F.xxhash64(norm).alias("often")).groupBy("often").count().where(F.col("count") > run)
    often = scratch(often.select("often", F.ceil(F.col("count") / run).cast("int").alias("pieces")), "exact-often")
    dealt = packed.join(F.broadcast(often), F.col("h") == F.col("often"), "left").select(
        "row", "head", "h",
        F.coalesce(F.pmod(F.xxhash64(F.col("row")[id_col]), F.col("pieces")), F.lit(0)).cast("int").alias("piece"),
        F.col("often").isNotNull().alias("cut"),
    )
    dealt = dealt.repartitionByRange(*KEY).select("*", rule(F.col("row")[text_col]).alias("norm"), F.col("row")[id_col].alias("doc_id"))
    same = Window.partitionBy(*KEY, "norm")
    by_id = same.orderBy(F.col("doc_id").asc_nulls_last())
    return dealt.select(
        "*",
        F.row_number().over(by_id).alias("at"),
        F.first("doc_id").over(by_id).alias("first"),
        F.count(F.lit(1)).over(same).alias("n"),
    ).withColumn("run", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("norm")))  # in the order the rows have already


def _merged(firsts: DataFrame) -> DataFrame:
    """firsts: the first rows of the pieces of cut texts. For every piece: the first row of the whole group and its size."""
    whole = firsts.groupBy("h", "norm").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "piece")).alias("least"), F.sum("n").alias("size"))
    found = firsts.select(*KEY, "run", "norm").join(whole, ["h", "norm"])
    # as many rows as there are pieces: 2 * HOT at most, but for texts whose hashes collide
    return scratch(found.select(*KEY, "run", F.col("least.first").alias("keep_id"), F.col("least.piece").alias("keep_piece"), "size"), "exact-merged")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. A null id sorts after every other id; rows that repeat an id are rows of
    their own and exactly one row of a group is kept. Empty table: no rows. Extra columns of any name are ignored.
    """
    two = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", normalised(F.col("text")))
    found = _runs(two, "doc_id", "text", docs.count(), lambda norm: norm).select(
        "doc_id", *KEY, "run", "cut", "at", "first", "n", F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.when(F.col("cut") & (F.col("at") == 1), F.col("norm")).alias("norm"),
    )
    found = scratch(found, "exact-rows")
    merged = _merged(found.where("cut and at = 1"))
    joined = found.join(F.broadcast(merged), [*KEY, "run"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("cut"), F.col("keep_id")).otherwise(F.col("first")).alias("keep_id"),
        F.coalesce("size", "n").cast("long").alias("group_size"),
        ((F.col("at") == 1) & (~F.col("cut") | (F.col("piece") == F.col("keep_piece")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns: of every text one row, whatever ids repeat or are null.

    Of rows that repeat the smallest id and the text any one stays. Empty table: no rows.
    """
    found = _runs(docs, id_col, text_col, docs.count()).where("at = 1")
    found = scratch(found.select("row", *KEY, "run", "cut", "first", "n", F.when(F.col("cut"), F.col("norm")).alias("norm")), "exact-firsts")
    merged = _merged(found.where("cut"))
    joined = found.join(F.broadcast(merged), [*KEY, "run"], "left")
    return joined.where(~F.col("cut") | (F.col("piece") == F.col("keep_piece"))).select("row.*")
