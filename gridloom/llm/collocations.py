"""Phrase collocations from vertical positional lists.

1. Tasks build shards: the words of a run of documents get positions, and each word of a language one list of them. A piece's end
   takes a position of its own, so words of different pieces are never neighbours. The lists are written.
2. Level by level: a phrase of k + 1 words is a frequent phrase of k words whose last k - 1 words begin another one. In each
   shard the positions of the lists are merge-joined with the positions one further on; the length of the joined list is
   the phrase's number of occurrences there. Sums over shards leave the frequent phrases, and these alone get lists.
3. Scores, the cheapest cut and the phrases inside longer ones are joins of the tables of frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import columns, scratch
from gridloom.llm.pieces import mix64
from gridloom.llm.postings import Shard, deltas, packed, pieces_of, positions, slices, unpacked

#: A-Z become a-z, a tab a space, and the ends of pieces a comma.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 44 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_END = b","
#: Bytes of text in a shard: a task holds the positions of all its words several times over.
SHARD = 1 << 24
#: Most frequent words that are sent to all tasks (beyond it they are joined by hash), and occurrences for which a part of the pairs is made.
SENT, PART = 1_000_000, 2_000_000


def word_lists(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """docs: lang, text. (shard, lang, word, n, at): the positions of each word in a shard, ascending, as differences."""

    def rows(held: Shard, shard: int) -> Iterator[pa.RecordBatch]:
        ids, doc = held.tokens()
        at = np.arange(len(ids), dtype=np.int64) + doc  # a gap of one between documents
        words, langs = held.vocabulary()
        order = np.argsort(ids, kind="stable")
        n = np.bincount(ids, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        is_word = np.array([w != _END for w in words], bool)
        kept = at[order][np.repeat(is_word, n)]
        n = n[is_word]
        if not len(n):
            return
        names = [w for w in words if w != _END]
        yield from pieces_of(pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), shard)), pa.array([o for o, w in zip(langs, words) if w != _END], pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
             pa.array(n), packed(deltas(kept, n), n)], ["shard", "lang", "word", "n", "at"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 24, Shard()
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (t.as_py() or "").encode()
                held.add((s.translate(_FOLD).replace(_END, b" , ").split() for s in slices(raw, b" \n")), len(raw), lang)
                if held.size >= shard_bytes:
                    yield from rows(held, shard)
                    shard, held = shard + 1, Shard()
        yield from rows(held, shard)

    return docs.mapInArrow(run, "shard long, lang string, word string, n long, at binary")


def _joined(lists: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where a phrase is followed one position on by another: the positions, both as indices, and the lists' phrases, ascending."""
    n = unpacked(b"".join(lists["n"].to_pylist())) if pa.types.is_binary(lists["n"].type) else lists["n"].to_numpy()
    phrase = unpacked(b"".join(lists["phrase"].to_pylist())) if pa.types.is_binary(lists["phrase"].type) else lists["phrase"].to_numpy()
    at = positions(unpacked(b"".join(lists["at"].to_pylist())), n)
    by = np.argsort(phrase)
    index = np.empty(len(phrase), np.int64)
    index[by] = np.arange(len(phrase))
    of = np.repeat(index, n)
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    # a position holds one phrase of a level at most, so neighbours in the merged order are all there is to join
    hit = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[hit], of[hit], of[hit + 1], phrase[by]


def _whole(n: int) -> np.ndarray:
    return np.array([n], np.int64)


def counted(lists: pa.Table, parts: int) -> pa.Table:
    """part, shard, codes, n: how often phrase a is followed one position on by phrase b, dealt to parts by a hash of the two; a code
    is a * 2^32 + b, codes are ascending and kept as differences."""
    _, a, b, phrase = _joined(lists)
    code, n = np.unique((phrase[a] << 32) | phrase[b], return_counts=True)
    part = (mix64(code.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, code, n = part[order], code[order], n[order]
    some, length = np.unique(part, return_counts=True)
    shard = np.full(len(some), lists["shard"][0].as_py())
    return pa.table({"part": some, "shard": shard, "codes": packed(deltas(code, length), length), "n": packed(n, length)})


def summed(part: pa.Table, least: int) -> pa.Table:
    """The pairs of a part with ``least`` occurrences in all shards, ascending, in one row without a shard (codes, f), and for each shard that has
    some of them the places of its own in that row (codes): all as differences."""
    codes = [np.cumsum(unpacked(c)) for c in part["codes"].to_pylist()]
    n = unpacked(b"".join(part["n"].to_pylist()))
    code, of = np.unique(np.concatenate(codes), return_inverse=True)
    f = np.zeros(len(code), np.int64)
    np.add.at(f, of, n)
    often = f >= least
    if not often.any():
        return pa.table({"part": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "codes": pa.array([], pa.binary()), "n": pa.array([], pa.binary())})
    place = np.cumsum(often) - 1
    hit = often[of]
    lengths = np.add.reduceat(np.r_[hit, False].astype(np.int64), np.r_[0, np.cumsum(list(map(len, codes)))[:-1]])  # no list is empty
    mine = np.flatnonzero(lengths)
    own, lengths = place[of[hit]], lengths[mine]
    ends = _whole(int(often.sum()))
    shard = np.r_[-1, part["shard"].to_numpy()[mine]]
    pairs, count = packed(deltas(code[often], ends), ends), packed(f[often], ends)
    held = packed(deltas(own, lengths), lengths)
    at = code[often][own]
    known = packed(deltas(at, lengths), lengths)
    first = part["part"][0].as_py()
    return pa.table({
        "part": pa.array(np.full(len(shard), first)), "shard": pa.array(shard), "codes": pa.concat_arrays([pairs.cast(pa.binary()), known.cast(pa.binary())]),
        "n": pa.concat_arrays([count.cast(pa.binary()), held.cast(pa.binary())])})


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, place, a, b, f: the frequent pairs of the rows without a shard."""
    for x in batches:
        for part, codes, n in zip(x["part"].to_pylist(), x["codes"].to_pylist(), x["n"].to_pylist()):
            code, f = np.cumsum(unpacked(codes)), unpacked(n)
            yield from pieces_of(pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(code), part)), pa.array(np.arange(len(code))), pa.array(code >> 32), pa.array(code & 0xFFFFFFFF), pa.array(f)], ["part", "place", "a", "b", "f"]))


def extended(lists: pa.Table, named: pa.Table) -> pa.Table:
    """shard, phrase, n, at: one row with the lists of the frequent phrases of the next level. named: for each part the codes of the shard's frequent
    pairs and their places (n), and the number of the part's first phrase."""
    shard, phrases, n, at = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lists.num_rows and named.num_rows:
        at, a, b, phrase = _joined(lists)
        code = np.concatenate([np.cumsum(unpacked(c)) for c in named["codes"].to_pylist()])
        number = np.concatenate([np.cumsum(unpacked(c)) + first for c, first in zip(named["n"].to_pylist(), named["first"].to_pylist())])
        order = np.argsort(code)
        mine = (phrase[a] << 32) | phrase[b]
        where = np.minimum(np.searchsorted(code, mine, sorter=order), len(code) - 1)
        hit = code[order[where]] == mine
        at, of = at[hit], order[where[hit]]
        order = np.argsort(of, kind="stable")
        at, n = at[order], np.bincount(of, minlength=len(code))
        phrases, n, shard = number[n > 0], n[n > 0], [lists["shard"][0].as_py()]
    one = len(shard)
    return pa.table({"shard": pa.array(shard, pa.int64()), "phrase": packed(phrases, _whole(len(phrases))[:one]), "n": packed(n, _whole(len(n))[:one]),
                     "at": packed(deltas(at, n) if len(n) else at[:0], _whole(len(at))[:one])})


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with id: numbers from 0 without gaps (each partition begins where the ones before it end)."""
    rows = scratch(df.withColumn("at_", F.monotonically_increasing_id()), name)
    part = F.shiftright("at_", 33)
    held = rows.groupBy(part.alias("part_")).count()  # one row a partition
    first = held.select("part_", (F.sum("count").over(Window.orderBy("part_")) - F.col("count")).alias("first_"))
    placed = rows.withColumn("part_", part).join(F.broadcast(first), "part_")
    return placed.withColumn("id", F.col("first_") + F.col("at_").bitwiseAND((1 << 33) - 1)).drop("at_", "part_", "first_")


def frequent_phrases(docs: DataFrame, min_count: int = 30, longest: int = 4, shard_bytes: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """docs: lang, text. The frequent phrases (lang, words, phrase, f) of 1 to ``longest`` words, and n per lang."""
    index = scratch(word_lists(docs, shard_bytes), "word-lists")
    words = scratch(index.groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    level = numbered(words.where(F.col("f") >= min_count).select("lang", F.array("word").alias("words"), "f"), "frequent-words")
    names = level.select(F.col("id").alias("phrase"), "lang", F.col("words")[0].alias("word"))
    size = level.agg(F.count("*"), F.sum("f")).first()
    if size[0] >= 1 << 31:
        raise ValueError("more than 2^31 frequent words")
    lists = index.join(F.broadcast(names) if size[0] <= SENT else names, ["lang", "word"]).select("shard", "phrase", "n", "at")
    found = level
    parts = 1 + (size[1] or 0) // PART
    for k in range(1, longest):
        count = lambda t: counted(t, parts)  # noqa: E731, B023
        total = lambda t: summed(t, min_count)
        dealt = lists.groupBy("shard").applyInArrow(count, "part long, shard long, codes binary, n binary")
        local = scratch(dealt.groupBy("part").applyInArrow(total, "part long, shard long, codes binary, n binary"), "phrase-counts")
        whole = scratch(local.where("shard < 0").mapInArrow(_listed, "part long, place long, a long, b long, f long"), "frequent-phrases")
        firsts = whole.groupBy("part").count()  # one row a part
        firsts = F.broadcast(firsts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("first")))
        often = whole.join(firsts, "part").select("a", "b", "f", (F.col("first") + F.col("place")).alias("id"))
        head, tail = level.select(F.col("id").alias("a"), "lang", "words"), level.select(F.col("id").alias("b"), F.element_at("words", -1).alias("last"))
        level = scratch(often.join(head, "a").join(tail, "b").select("id", "lang", F.concat("words", F.array("last")).alias("words"), "f"), "named-phrases")
        found = found.unionByName(level)
        if k + 1 < longest:
            named = local.where("shard >= 0").join(firsts, "part").select("shard", "first", "codes", "n")
            lists = scratch(lists.groupBy("shard").cogroup(named.groupBy("shard")).applyInArrow(extended, "shard long, phrase binary, n binary, at binary"), "phrase-lists")
    return found.select("lang", "words", F.array_join("words", " ").alias("phrase"), "f"), totals


def collocations(docs: DataFrame, min_count: int = 30, longest: int = 4, inside_percent: int = 80, top: int = 2000, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the best phrases of 2 to ``longest`` words of each language.

    A-Z are lower-cased, texts are split at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words. A phrase with
    at least ``min_count`` occurrences a is cut after its first k words into parts with l and r occurrences; its score is
    floor(2000000 * a / (l + r)) at its lowest-scoring cut (ties: the first). Phrases that lie in a longer one with at least
    ``inside_percent`` of their occurrences go. Order: score, a (both descending), phrase. n is the language's number of words.
    A null language is ``und``; null and empty texts have no words; each row counts as a document; long texts are read whole, slice
    by slice; extra columns are ignored; an empty table gives no rows.
    """
    base = columns(docs, lang_col, text_col).toDF("lang", "text").withColumn("lang", F.coalesce("lang", F.lit("und")))
    phrases, totals = frequent_phrases(base, min_count, longest, shard_bytes)
    counts = phrases.select("lang", "phrase", "f")
    size = F.size("words")
    many = phrases.where(size >= 2)
    part = lambda lo, n: F.array_join(F.slice("words", lo, n), " ")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "f", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(10,0)) * cast(f as decimal(20,0))) div cast(l + r as decimal(20,0))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("f").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = many.where(size >= 3).withColumn("len", F.explode(F.sequence(F.lit(2), size - 1)))
    longer = longer.withColumn("lo", F.explode(F.sequence(F.lit(1), size - F.col("len") + 1))).select("lang", part(F.col("lo"), F.col("len")).alias("phrase"), "f")
    inside = longer.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
