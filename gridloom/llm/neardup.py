"""MinHash near-dedup by a signature-coordinate inverted join.

1. Every text becomes its set of distinct word shingles; texts with the same set are one class.
2. A class has a signature of COORDINATES minima. It is posted under its (coordinate, value) pairs. Pairs of documents at
   the threshold (85%) collide in 0.85 * 48 = 41 coordinates on average and in fewer than 27 of them with a probability
   below 1e-6, so two classes are a candidate if they collide in 27 coordinates (``matches``, worked out for each threshold).
3. Prefix merging: a class with c shared values is posted under the c - matches + 1 rarest only, since a pair that collides
   ``matches`` times meets there; classes with fewer shared values are passed over. The matches - 1 longest lists of each class
   are skipped: they are only looked up for the pairs that met, when their collisions are counted over both lists of values.
4. A list of more than SPLIT classes (one text copied thousands of times with small edits) is split by a second key:
   its classes are posted again under the rarest shingles of their full sets, by size, which loses no link.
5. All lists go one way: the most central members of each meet its other members, pairs that collide ``matches`` times are
   confirmed on their full sets, linked classes are gathered to components, and what is in one component isn't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import columns, hot_keys, lookup, scratch
from gridloom.llm.components import components
from gridloom.llm.shingles import Shingler

COORDINATES, SPLIT, GROW, MISS = 48, 24, 8, 1e-6
#: Classes up to this number are sent to all tasks to pick their texts (8 bytes each); beyond it texts are shuffled.
SMALL = 1_000_000
#: Ratio of the sizes of neighbouring size classes.
STEP = 1.01


def matches_for(percent: int, k: int = COORDINATES) -> int:
    """The most collisions that can be asked for so that a pair at the threshold has fewer with a probability below MISS."""
    p, missed, m = percent / 100, 0.0, 0
    while m < k and (missed := missed + comb(k, m) * p**m * (1 - p) ** (k - m)) < MISS:
        m += 1
    if m == 0:
        raise ValueError(f"{k} coordinates are too few for {percent} per cent")
    return m


def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Minima of the shingles under each multiplier; the lowest 6 bits of a value are its coordinate."""
    low = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        low = np.minimum(low, (shingles[at : at + (1 << 14), None] * by[None, :]).min(0))
    return ((low & ~np.uint64(63)) | np.arange(len(by), dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, words: int, k: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits), sig (k values; none for an empty set)."""
    by = _multipliers(k)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            n, digest, sig = [], [], []
            for s in shingler.sets(b.column(1).to_pylist()):
                n.append(len(s))
                digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s, by) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_hash", "sig"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_hash binary, sig array<bigint>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, shingles (sorted 64-bit hashes, end to end)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            sets = list(shingler.sets(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "shingles"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    kind = pairs.schema["a"].dataType.simpleString()
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for sa, sb in zip(x.column(2), x.column(3)):
                u, v = np.frombuffer(sa.as_py(), np.uint64), np.frombuffer(sb.as_py(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _colliding(pairs: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """The pairs whose signatures collide in ``matches`` coordinates or more."""
    one = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("ga"))
    two = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("gb"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b")
    return joined.where(F.size(F.array_intersect("ga", "gb")) >= matches).select("a", "b")


def _ordered(x: str = "x", y: str = "y") -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _refined(sets: DataFrame, percent: int) -> DataFrame:
    """Postings of full sets: (size, token) is a list, with doc_id, its set size n, role and pos (rarer shingles it has).

    A pair at the threshold with sizes p <= q has p >= percent * q / 100 and shares percent * (p + q) / (100 + percent)
    shingles, so the two share one of their rarest ones: the smaller is posted under as many as a partner of its own size
    needs (role s, in its size class), the larger under as many as the smallest partner of each size class needs (role l).
    """
    kind = sets.schema["doc_id"].dataType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, 256):
                part = x.slice(lo, 256)
                got = [np.frombuffer(s.as_py(), np.int64) for s in part.column(1)]
                ids = np.repeat(np.arange(len(got)), list(map(len, got)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(ids)), pa.array(np.concatenate(got))], ["doc_id", "token"]
                )

    tokens = sets.select("doc_id", "shingles").mapInArrow(unpack, f"doc_id {kind}, token long")
    tokens = scratch(tokens, "refined-tokens")
    rare = scratch(tokens.groupBy("token").count(), "refined-counts")
    by_doc = (
        tokens.join(rare, "token")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("all"))
        .withColumn("n", F.size("all"))
    )
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.lit(float(np.log(STEP))) + 1e-9).cast("int")
    least = F.ceil(F.lit(percent) * F.col("n") / 100)  # smallest partner
    need = lambda both: F.ceil(F.lit(percent) * both / (100 + percent)).cast("int")
    floor_of = lambda s: F.greatest(F.floor(F.pow(F.lit(STEP), s.cast("double")) - 1e-6), least)
    roles = F.concat(
        F.array(F.struct(size_class(F.col("n")).alias("size"), F.lit("s").alias("role"), (F.col("n") - need(2 * F.col("n")) + 1).cast("int").alias("take"))),
        F.transform(
            F.sequence(size_class(least), size_class(F.col("n"))),
            lambda s: F.struct(s.alias("size"), F.lit("l").alias("role"), (F.col("n") - need(floor_of(s) + F.col("n")) + 1).cast("int").alias("take")),
        ),
    )
    return (
        by_doc.withColumn("r", F.explode(roles))
        .select("doc_id", "n", "r.size", "r.role", F.posexplode(F.slice("all", F.lit(1), F.greatest(F.col("r.take"), F.lit(1)))))
        .select("doc_id", "n", "size", F.col("col.token").alias("token"), "role", "pos")
    )


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (doc_id, c) with the components that the links (a, b) join made one; only ends of links are touched."""
    of = lambda end: comp.select(F.col("doc_id").alias(end), F.col("c").alias(f"c{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(ends).toDF("c", "to")
    alone = moved.join(comp.select(F.col("doc_id").alias("c")), "c", "left_anti").select(F.col("c").alias("doc_id"), F.col("to").alias("c"))
    return comp.join(moved, "c", "left").select("doc_id", F.coalesce("to", "c").alias("c")).union(alone)


def _linked(lists: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the linked classes. lists: size, token (the list), doc_id, role, pos, n, with all members of a list.

    In a round the first members of every list and role (the most central ones: those with the fewest rarer entries) meet the members of
    the other role that are in another component so far. A list all of whose members have been first ones, or whose pairs are each
    in one component, is finished. Of a list that wasn't split all members are first ones at once; of the others one is, and GROW times
    as many in every further round. So pairs inside a component aren't looked at again, and a list of any length is finished after
    a few rounds. The work follows the number of classes unless a list holds many that share their rarest shingles and still aren't linked.
    """
    at, matches = ["size", "token"], matches_for(percent)
    rank = F.row_number().over(Window.partitionBy(*at, "role").orderBy("pos", "doc_id"))
    comp = lists.sparkSession.createDataFrame([], f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, c {lists.schema['doc_id'].dataType.simpleString()}")
    named = lists.withColumn("c", F.col("doc_id"))
    done, upto = 0, 1
    while True:
        firsts = named.withColumn("rank", rank).where(F.col("rank") <= max(upto, SPLIT))
        firsts = firsts.where((F.col("rank") > done) & ((F.col("size") < 0) | (F.col("rank") <= upto)))
        firsts = firsts.select(*at, F.when(F.col("role") == "s", "l").otherwise("s").alias("role"), F.col("doc_id").alias("first"), F.col("c").alias("fc"), F.col("pos").alias("fp"), F.col("n").alias("fn"))
        # a list of shingles has a pair's first common shingle only if enough shingles follow it in both sets
        enough = (F.col("size") < 0) | (F.least(F.col("n") - F.col("pos"), F.col("fn") - F.col("fp")) * (100 + percent) >= percent * (F.col("n") + F.col("fn")))
        pairs = named.join(scratch(firsts, "first-members"), [*at, "role"]).where((F.col("c") != F.col("fc")) & enough)
        pairs = scratch(pairs.select(*_ordered("doc_id", "first")).distinct(), "pairs")
        links = scratch(confirmed(_colliding(pairs, sigs, matches), sets, percent), "links")
        if not links.isEmpty():
            comp = scratch(_joined(comp, links), "components-so-far")
            named = lists.join(comp, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
        small, large = F.count(F.when(F.col("role") == "s", 1)), F.count(F.when(F.col("role") == "l", 1))
        each = named.groupBy(*at, "c").agg(small.alias("s"), large.alias("l"))
        left = each.groupBy(*at).agg(
            F.sum("s").alias("ns"), F.sum("l").alias("nl"), (F.sum("s") * F.sum("l") - F.sum(F.col("s") * F.col("l"))).alias("apart")
        )
        left = scratch(left.where((F.col("size") >= 0) & (F.col("apart") > 0) & (F.least("ns", "nl") > upto)).select(*at), "open-lists")
        if left.isEmpty():
            return comp
        lists = scratch(lists.join(left, at, "left_semi"), "lists-left")
        named = scratch(named.join(left, at, "left_semi"), "named")
        done, upto = upto, upto * GROW


def near_duplicates(
    docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    id reachable. A text with fewer than ``words`` words is one shingle; a null or empty text, or one of white space,
    has none and is linked with nothing. Ids name documents: rows that repeat an id share its links. A row without an
    id takes no part: component_id null, kept. Thresholds below 26% are refused. Extra columns are ignored; empty table: no rows.
    """
    matches = matches_for(percent)
    base = columns(docs, id_col, text_col).toDF("doc_id", "text").select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    )
    table = scratch(signed(base, words), "signatures")
    sound = table.where("doc_id is not null and n_shingles > 0")
    classes = scratch(sound.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id")), "classes")
    posted = sound.join(classes, ["set_hash", "doc_id"], "left_semi").select("doc_id", F.explode("sig").alias("token"))
    often = scratch(posted.groupBy("token").count().where("count >= 2"), "shared-values")
    active = scratch(
        posted.join(often, "token")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set(F.struct("count", "token"))).alias("own"))
        .where(F.size("own") >= matches),
        "active",
    )
    prefix = F.posexplode(F.slice("own", F.lit(1), F.size("own") - (matches - 1)))
    posts = active.select("doc_id", F.size("own").alias("n"), prefix).select("doc_id", "n", "pos", F.col("col.token").alias("token"))
    lengths = scratch(posts.groupBy("token").count().where("count >= 2").toDF("token", "length"), "lists")
    posts = scratch(posts.join(lengths, "token"), "posts")
    in_lists = scratch(posts.select("doc_id").distinct(), "in-lists")
    sigs = scratch(active.select("doc_id", F.col("own.token").alias("sig")).join(in_lists, "doc_id", "left_semi"), "list-signatures")
    small = in_lists.count() <= SMALL
    sets = scratch(shingle_sets(base.join(F.broadcast(in_lists) if small else in_lists, "doc_id", "left_semi"), words), "sets")
    split = scratch(posts.where(F.col("length") > SPLIT).select("doc_id").distinct(), "split-members")
    both = F.explode(F.array(F.lit("s"), F.lit("l"))).alias("role")
    lists = posts.where(F.col("length") <= SPLIT).select(F.lit(-1).alias("size"), "token", "doc_id", both, "pos", "n")
    lists = scratch(lists.union(_refined(sets.join(split, "doc_id", "left_semi"), percent).select("size", "token", "doc_id", "role", "pos", "n")), "all-lists")
    of = _linked(lists, sigs, sets, percent)
    # rows reach their component through their set; rows with a set in common may be many
    found = classes.join(of, "doc_id", "left").select("set_hash", F.coalesce("c", "doc_id").alias("reach"))
    placed = lookup(table, "set_hash", found, "doc_id", hot_keys(table, "set_hash")).withColumn("reach", F.when(F.col("doc_id").isNotNull(), F.col("reach")))
    reach = F.coalesce("reach", "doc_id")
    return placed.select("doc_id", "n_shingles", reach.alias("component_id"), F.coalesce(reach == F.col("doc_id"), F.lit(True)).alias("kept"))
