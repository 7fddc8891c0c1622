"""The corpus pipeline: documents through five stages, each on all that the one before kept.

1. quality: documents that the classifier rejects go; 2. exact dedup; 3. near dedup: one document of each group stays;
4. mix: every source is brought to its target, documents repeated or left out; 5. encode: the final token ids.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exactdedup, labelled, mixing, neardup, piecebpe, quality
from gridloom.llm.common import NON_WS, scratch, table
from gridloom.llm.queries import tokenizer_path
from gridloom.sources.shared import remove_tables, written_tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # a trained classifier decides in the first stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality score of 0.5 or more, unchanged.

    A null or empty text has a score as well, long texts count whole, and only the text decides: rows that repeat an id or a
    text, and rows without an id, have the score of their text. Empty table: no rows. Columns beyond those of documents are dropped.
    """
    net = quality.train_quality(docs, table(spark, sf_dir, "labels"), labelled.fold(3) != 1)
    scored = docs.select(*COLUMNS, quality.quality_score(net, F.col("text")).alias("quality_score"))
    return scored.where(F.col("quality_score") >= 0.5).select(*COLUMNS)


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The documents whose id isn't among those that were decided against; each id names one row."""
    gone = decided.where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def _ids_name_rows(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()


def _first(docs: DataFrame, *by: str) -> DataFrame:
    """Of the rows that agree in ``by``, the smallest by its columns."""
    rest = [c for c in COLUMNS if c not in by]
    return docs.groupBy(*by).agg(F.min(F.struct(*rest)).alias("least")).select(*by, "least.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest id (null last), decided row by row.

    Null and empty texts are equal texts. Rows that repeat an id are decided by their texts, so a row with its own text stays
    and of copied rows exactly one does. Ties: any one of rows that agree in id and text. Empty table: no rows. Columns
    beyond those of documents are dropped.
    """
    return exactdedup.first_copies(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the smallest id (null ids last, then by a digest of the text).

    Rows that repeat an id, or have none, are decided by their own texts. Texts without a word, null ones among them, are linked with
    nothing and all stay. Rows equal in id and text count once. Empty table: no rows. Columns beyond those of documents are dropped.
    """
    docs = docs.select(*COLUMNS)
    if _ids_name_rows(docs):
        return _kept(docs, neardup.near_duplicates(docs, percent=85, words=5))
    # a row's name sorts by id, null ids last, then by its text; texts without a word are linked with nothing
    worded = F.coalesce("text", F.lit("")).rlike(NON_WS)
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.sha2("text", 256).alias("sha"))
    rows = scratch(_first(docs.where(worded), "doc_id", "text").withColumn("row", name), "near-rows")
    gone = neardup.near_duplicates(rows, percent=85, words=5, id_col="row").where("not kept").select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select(*COLUMNS).union(docs.where(~worded))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice.

    Null source is a source of its own, null and empty texts have no words, and rows that repeat an id and a text are rows of their
    own. Empty table: no rows. Columns beyond those of documents are dropped.
    """
    mixed = mixing.mix_sources(docs.select(*COLUMNS), weights=(3, 1, 2), ratio=1.5, max_copies=2)
    repeated = mixed.where("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return repeated.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each row; null text counts as empty, repeated rows are encoded each.
    Empty table: no rows."""
    return piecebpe.encode_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and what it wrote on the
    way, the rows of the stage before it among them, is removed."""
    docs = table(spark, sf_dir, "documents")
    since = len(written_tables(spark))
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_tables(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
