"""Ranked lexical search: MaxScore over the inverted lists of shards.

1. Tasks build shards: a run of documents becomes one inverted list per term (document numbers in order of their ids, and
   occurrences). The lists are written; statistics of the corpus are aggregates over them.
2. The terms of the queries are joined with the lists; each list brings the term's weight and the queries that ask for it, so
   a shard gets only what its queries need. Queries are dealt into blocks of BLOCK, so a list's queries are bounded as well.
3. In a shard a term's upper bound is its weight times its largest part in a score there. A query's lists are split: those
   with the lowest bounds, which together can't lift a document above the k-th score so far, aren't essential. Ranges of
   documents are scored from the essential lists; the others are probed from the highest bound down, for those documents only
   that can still qualify. The split is taken anew for each range.
4. The k best of each shard are ranked once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, columns, scratch
from gridloom.llm.postings import SHARD, Shard, blobs, pieces_of, slices

#: Queries of a block, documents of a range, and the most query terms that are sent to all tasks (beyond it they are joined by hash).
BLOCK, RANGE, SENT = 4096, 2048, 500_000
#: The bytes of a term: digits, A-Z (lower-cased) and a-z, and all bytes of characters from U+0080.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """All terms of a text, repeats included (for queries)."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), 0)


def inverted_lists(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """docs: doc_id, text. Rows (shard, term, df, at, tf) with the lists, and one row a shard without a term: ids, lengths and their sum,
    and in df the documents that have a term.

    Numbers of documents in a shard follow the order of their ids (null last), so that equal scores go by number.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(held: Shard, ids: list, shard: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        vocabulary = held.vocabulary()[0]
        term, doc = held.tokens()
        doc = number[doc]
        by = np.lexsort((doc, term))
        term, doc = term[by], doc[by]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[first, len(term)]).astype(np.uint32)
        df = np.bincount(term[first], minlength=len(vocabulary)) if len(term) else np.zeros(0, np.int64)
        words = pa.array(vocabulary, pa.binary()).cast(pa.string())
        n = len(words)
        names = ["shard", "term", "df", "words", "at", "tf", "ids", "lengths"]
        none = pa.nulls(n, pa.list_(id_type))
        if n:
            yield from pieces_of(pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard)), words, pa.array(df), pa.nulls(n, pa.int64()), blobs(doc[first].astype(np.uint32), df), blobs(tf, df), none, pa.nulls(n, pa.binary())], names))
        lengths = np.asarray(held.lengths, np.int64)[order]
        head = [pa.array([shard]), pa.nulls(1, pa.string()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                pa.array([[ids[i] for i in order]], pa.list_(id_type)), pa.array([lengths.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(head, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, ids, id_type = TaskContext.get().partitionId() << 24, Shard(), [], pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (t.as_py() or "").encode()
                held.add((s.translate(_TERM).split() for s in slices(raw, b" \n")), len(raw))
                ids.append(i)
                if held.size >= shard_bytes:
                    yield from rows(held, ids, shard, id_type)
                    shard, held, ids = shard + 1, Shard(), []
        if ids:
            yield from rows(held, ids, shard, id_type)

    return docs.mapInArrow(run, f"shard long, term string, df long, words long, at binary, tf binary, ids array<{kind}>, lengths binary")


class Lists:
    """The lists of one shard that queries ask for: documents, parts of scores and where each range of documents begins."""

    def __init__(self, n_docs: int):
        self.edges = np.arange(0, n_docs + RANGE, RANGE)
        self.n_docs, self.docs, self.part, self.top, self.cut = n_docs, [], [], [], []

    def add(self, docs: np.ndarray, part: np.ndarray) -> None:
        self.docs.append(docs); self.part.append(part); self.top.append(int(part.max(initial=0)))
        self.cut.append(np.searchsorted(docs, self.edges))

    def best(self, asks: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best, best first; asks are lists with how often each counts."""
        asks = sorted((a for a in asks if self.top[a[0]] > 0), key=lambda a: -self.top[a[0]] * a[1])
        bounds = np.array([self.top[i] * times for i, times in asks], np.int64)
        below = np.r_[np.cumsum(bounds[::-1])[::-1], 0]  # what the lists from here on can add
        docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for r in range(len(self.edges) - 1):
            essential = int((below[:-1] > least).sum())
            if not essential:
                break
            lo = self.edges[r]
            total = np.zeros(min(RANGE, self.n_docs - lo), np.int64)
            for i, times in asks[:essential]:
                a, b = self.cut[i][r], self.cut[i][r + 1]
                total[self.docs[i][a:b] - lo] += times * self.part[i][a:b]
            open_ = np.flatnonzero(total)
            for at in range(essential, len(asks)):
                open_ = open_[total[open_] + below[at] > least]
                if not len(open_):
                    break
                i, times = asks[at]
                a, b = self.cut[i][r], self.cut[i][r + 1]
                if a < b:
                    held = self.docs[i][a:b] - lo
                    where = np.minimum(np.searchsorted(held, open_), b - a - 1)
                    total[open_] += np.where(held[where] == open_, times * self.part[i][a:b][where], 0)
            open_ = open_[total[open_] > least]  # a later document of an equal score comes after those found
            if len(open_):
                docs, scores = np.r_[docs, open_ + lo], np.r_[scores, total[open_]]
                by = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[by], scores[by]
                if len(scores) == k:
                    least = int(scores[-1])
        return docs, scores


def _weights(n_docs: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents with the highest scores above 0 for each row of items.

    Weights, lengths and scores are those of the ranking described in queries.op12_search, over all documents. Equal scores go to
    the smaller id, rows without an id last. Every row of docs is a document and every row of items a query of its own: rows that
    repeat an id are ranked each for itself. Null and empty texts have no terms; a query without terms, or whose terms no
    document has, has no rows. Long texts are read whole, slice by slice. Extra columns are ignored; empty tables give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    index = scratch(inverted_lists(columns(docs, id_col, text_col).toDF("doc_id", "text"), shard_bytes), "inverted-lists")
    corpus = index.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n_docs, n_words = int(corpus[0]), max(int(corpus[1]), 1)
    asked = columns(items, item_col, item_text).toDF("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    asked = scratch(asked.select("item", "item_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item", "item_id", "term").count(), "query-terms")
    blocks = -(-asked.select("item").distinct().count() // BLOCK)
    few = asked.groupBy("term").count().count() <= SENT
    hint = F.broadcast if few else (lambda df: df)
    counts = index.join(hint(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("all"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("all") + 1).cast("double"))).cast("long")
    block = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))).cast("int").alias("block")
    asks = asked.groupBy(block, "term").agg(F.collect_list(F.struct("item", F.col("count").alias("times"))).alias("asks"))
    asks = scratch(asks.join(counts, "term").select("term", "block", weight.alias("w"), "asks"), "weighted-terms")
    wanted = index.join(hint(asks), "term").select("shard", "block", "w", "asks", "at", "tf", "lengths", "ids")
    heads = index.where("term is null").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    heads = heads.select("shard", "block", F.lit(None).cast("long").alias("w"), F.lit(None).cast("array<struct<item:long,times:long>>").alias("asks"), "at", "tf", "lengths", "ids")

    def rank(part: pa.Table) -> pa.Table:
        # Arrow, since ids with nulls among them would become doubles in pandas
        head = part.filter(pc.is_valid(part["lengths"]))
        ids, length = head["ids"].combine_chunks().flatten(), np.frombuffer(head["lengths"][0].as_py(), np.int64)
        m = 75 + (25 * length * n_docs) // n_words
        held, of = Lists(len(length)), {}
        rows = part.filter(pc.is_null(part["lengths"]))
        for w, asks_, at, tf in zip(rows["w"].to_pylist(), rows["asks"].to_pylist(), rows["at"].to_pylist(), rows["tf"].to_pylist()):
            at, tf = np.frombuffer(at, np.uint32).astype(np.int64), np.frombuffer(tf, np.uint32).astype(np.int64)
            for ask in asks_:
                of.setdefault(ask["item"], []).append((len(held.docs), ask["times"]))
            held.add(at, w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[at])))
        found = {item: held.best(asks_, k) for item, asks_ in of.items()}
        at = np.concatenate([d for d, _ in found.values()]) if found else np.zeros(0, np.int64)
        item = np.repeat(np.array(list(found), np.int64), [len(d) for d, _ in found.values()])
        return pa.table({"item": item, "doc_id": ids.take(pa.array(at)), "score": np.concatenate([s for _, s in found.values()]) if found else at})

    hits = wanted.union(heads).groupBy("shard", "block").applyInArrow(rank, f"item long, doc_id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
