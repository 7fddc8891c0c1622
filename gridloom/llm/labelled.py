"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(mod: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo mod; -1 for a null id, which is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)).cast("int"), F.lit(-1))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, max_docs: int, share: float = 0.5,
    max_doc_bytes: int = 1 << 16,
) -> tuple[list[bytes], np.ndarray]:
    """Texts and 0/1 labels of at most max_docs usable documents, a share of them of class 1 where there are enough.

    The choice is by a hash of the id, so it is the same on every run and spread over the whole table. Rows whose label
    is null and texts over max_doc_bytes are passed over before the draw; a label that is repeated counts once (the smallest), and of
    rows that repeat an id the smallest text. Empty tables give an empty sample.
    This is all that comes to the driver: at most max_docs * max_doc_bytes bytes, whatever the size of the input.
    """
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(usable & F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    short = docs.select("doc_id", raw.alias("raw")).where(F.octet_length("raw") <= max_doc_bytes)
    known = known.join(short.select("doc_id"), "doc_id", "left_semi")
    draw = F.xxhash64(F.lit(5), "doc_id")
    ones = int(max_docs * share)
    chosen = [known.where(F.col("y") == y).orderBy(draw, "doc_id").limit(n) for y, n in ((0, max_docs - ones), (1, ones))]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most max_docs rows of two numbers
    got = short.join(ids, "doc_id").groupBy("doc_id").agg(F.min("raw").alias("raw"), F.first("y").alias("y")).orderBy("doc_id").collect()
    return [bytes(r["raw"]) for r in got], np.array([r["y"] for r in got], np.int64)
