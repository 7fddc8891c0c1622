"""Line dedup: lines that many documents share are dropped from all of them.

Every text is split at newlines; a line's key is the line stripped of ASCII white space at both ends
with A-Z lower-cased. First each document posts its distinct keys once, as 128-bit hashes, so counting rows per
hash counts documents, with partial sums before the shuffle. Then lines are exploded with their positions, those whose hash is
common are dropped, and each document is reassembled from its other lines in the order of their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WS_CHARS, ascii_lower, columns, scratch

#: So many of the commonest hashes are sent to all tasks (16 bytes each). One that isn't among them is in at most 1 / SENT of all postings.
SENT = 100_000


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(WS_CHARS))


def common_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """h, n: hashes of keys of min_chars code points or more that min_docs rows of docs (text) or more have, and how many have them."""
    keys = F.transform(F.split(ascii_lower(F.col("text")), "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)))
    distinct = F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))
    posted = docs.select(F.explode(F.transform(distinct, lambda k: F.unhex(F.md5(k)))).alias("h"))
    return posted.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text.

    Null or empty text is one empty line. Each input row is one document, rows that repeat an id and rows without one among
    them. Keys shorter than min_chars code points (1: empty ones) are never dropped. A text whose lines all go becomes empty.
    Long texts are taken whole. Empty table: no rows. Extra columns of any name are ignored.
    """
    base = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    common = scratch(common_lines(base, min_docs, min_chars), "common-lines")
    top = scratch(common.orderBy(F.desc("n"), "h").limit(SENT), "commonest-lines")
    # the number of a row holds for this one pass only: lines are exploded and brought together under it
    numbered = base.withColumn("row", F.monotonically_increasing_id())
    lines = numbered.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line")))
    lines = lines.withColumn("h", F.when(F.char_length("key") >= min_chars, F.unhex(F.md5("key")))).drop("key")
    lines = lines.join(F.broadcast(top.select(F.col("h").alias("hit"))), F.col("h") == F.col("hit"), "left")
    if common.count() > SENT:
        # the lines still open are joined by hash; the others would be a hot key and are spread by their rows instead
        rest = common.join(top, "h", "left_anti").select(F.col("h").alias("rest"))
        open_ = F.when(F.col("hit").isNull() & F.col("h").isNotNull(), F.col("h")).otherwise(F.concat(F.lit("row ").cast("binary"), F.col("row").cast("string").cast("binary")))
        lines = lines.withColumn("at", open_).join(rest, F.col("at") == F.col("rest"), "left").withColumn("hit", F.coalesce("hit", "rest"))
    stays = F.col("hit").isNull()
    whole = lines.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(~stays, 1)).alias("n_dropped"),
        F.sort_array(F.collect_list(F.when(stays, F.struct("pos", "line")))).alias("kept"),
    )
    return whole.select("doc_id", "n_lines", "n_dropped", F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("kept_text"))
