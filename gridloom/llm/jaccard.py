"""N-gram Jaccard join by partitions of the token universe (pigeonhole).

1. Every text becomes its set of distinct word shingles (64-bit hashes); texts with the same set are one class. Sets have a size
   band. Two sets of a band's sizes at the threshold differ in at most H shingles, so the band's scheme cuts the universe of
   shingles into H + 1 segments by hash: a pair at the threshold has all shingles of some segment in common.
2. A class is posted under its segments in the scheme of its own band and in those of smaller bands that a partner can be in.
   Costs decide which segments of a band serve: where a segment is shared by so many classes (the sum of the squares of its
   lists) that an index of one-deletion neighbourhoods of the band's cheapest segment costs less, that segment is left
   out and the cheap one is posted with its neighbourhood (its shingles, and its shingles but one). A segment tolerates no
   difference, a neighbourhood one; together they tolerate H, so a pair always meets.
3. Of each list (classes with the same value of a segment) pivots are compared with the other members on full sets: the most central
   one first, which puts all members at a distance (of differing shingles), then more at a time. Linked classes are gathered to
   components. Members in one component aren't compared again, nor are two whose distances from the first pivot differ by more
   than the differences of a linked pair. A list is finished when all its members have been pivots or are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import PIECES, SHARE, columns, hot_keys, lookup, scratch
from gridloom.llm.components import components
from gridloom.llm.neardup import STEP, shingle_sets
from gridloom.llm.pieces import mix64
from gridloom.llm.shingles import Shingler

#: Ratio of the sizes of neighbouring bands, growth of the number of pivots, and the most members of a list that aren't posted anew.
BAND, GROW, SPLIT = 1.2, 8, 24
TASK_PAIRS = 1 << 20  # that a task makes of one long list


@lru_cache(maxsize=1)
def band_edges() -> np.ndarray:
    """Smallest size of each band."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return np.array(edges, np.int64)


def segments(band: int, percent: int) -> int:
    """H + 1 for pairs whose smaller set is in the band."""
    s = int(band_edges()[band + 1]) - 1
    return 1 + (s + 100 * s // percent) * (100 - percent) // (100 + percent)


def schemes(size: int, percent: int) -> list[int]:
    """The bands in whose schemes a set takes part: its own and those of possible smaller partners. Where H is 0 pairs are equal."""
    if not size:
        return []
    own = band = int(np.searchsorted(band_edges(), size, "right")) - 1
    found = []
    while band >= 0 and (band == own or 100 * (int(band_edges()[band + 1]) - 1) >= percent * size):
        if segments(band, percent) > 1:
            found.append(band)
        band -= 1
    return found


def segment_sums(tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the m segments begins in the sorted tokens (and the end), and the sum of the mixed tokens of each."""
    edges = np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m)
    cut = np.r_[0, np.searchsorted(tokens, edges), len(tokens)]
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix64(tokens), out=total[1:])
    return cut, total[cut[1:]] - total[cut[:-1]]


def _salt(*parts: np.ndarray | int) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = mix64(out + np.asarray(p, np.uint64) + np.uint64(0x9E37))
    return out


def list_keys(tokens: np.ndarray, band: int, percent: int) -> np.ndarray:
    m = segments(band, percent)
    return mix64(segment_sums(tokens, m)[1] ^ _salt(band, np.arange(m, dtype=np.uint64)))


def posted(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits), keys: the lists of a set in all its schemes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            n, digest, keys = [], [], []
            for s in shingler.sets(b.column(1).to_pylist()):
                n.append(len(s))
                digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                of = [list_keys(s, band, percent) for band in schemes(len(s), percent)]
                keys.append(np.concatenate(of).view(np.int64) if of else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "keys"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, set_hash binary, keys array<bigint>")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For the pairs (a, b): na, nb, both (sizes of the sets and of the intersection) and linked. A class with many pairs is dealt out."""
    pairs = scratch(pairs, "pairs")
    kind = pairs.schema["a"].dataType.simpleString()
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    joined = lookup(lookup(pairs, "b", two, "a", hot_keys(pairs, "b")), "a", one, "b", hot_keys(pairs, "a")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for sa, sb in zip(x.column(2), x.column(3)):
                u, v = np.frombuffer(sa.as_py(), np.uint64), np.frombuffer(sb.as_py(), np.uint64)
                rows.append((len(u), len(v), len(np.intersect1d(u, v, assume_unique=True))))
            na, nb, both = np.array(rows, np.int64).reshape(-1, 3).T
            linked = pa.array(100 * both >= percent * (na + nb - both))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(na), pa.array(nb), pa.array(both), linked], ["a", "b", "na", "nb", "both", "linked"])

    return joined.mapInArrow(run, f"a {kind}, b {kind}, na long, nb long, both long, linked boolean")


def _neighbourhoods(docs: DataFrame, chosen: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """docs: doc_id, n, bands; chosen: band, seg. Posts (doc_id, n, key) under the one-deletion neighbourhoods of the chosen segments."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.withColumn("band", F.explode("bands")).join(chosen.groupBy("band").agg(F.collect_list("seg").alias("segs")), "band")
    asked = asked.select("doc_id", "n", "band", "segs").join(sets.select("doc_id", F.col("n_shingles").alias("n"), "shingles"), ["doc_id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = []
            for band, segs, raw in zip(x["band"].to_pylist(), x["segs"].to_pylist(), x["shingles"]):
                tokens = np.frombuffer(raw.as_py(), np.uint64)
                cut, sums = segment_sums(tokens, segments(band, percent))
                made.append(np.concatenate([
                    mix64(np.r_[sums[j : j + 1], sums[j] - mix64(tokens[cut[j] : cut[j + 1]])] ^ _salt(band, j, 1)) for j in segs]).view(np.int64))
            at = pa.array(np.repeat(np.arange(len(made)), list(map(len, made))))
            yield pa.RecordBatch.from_arrays([x["doc_id"].take(at), x["n"].take(at), pa.array(np.concatenate(made) if made else np.zeros(0, np.int64))], ["doc_id", "n", "key"])

    return asked.mapInArrow(run, f"doc_id {kind}, n long, key long").distinct()


def _allocated(posts: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """posts: doc_id, n, key, pos; classes: doc_id, n. Posts (doc_id, n, key) after costs have decided which segments serve.

    The r-th dearest segment of a band gives its place to the neighbourhood of the r-th cheapest one where that costs less: a
    neighbourhood has a post for each shingle of the segment and each class of the band, and lists that are longer in proportion.
    """
    bands_of = F.udf(lambda n: schemes(n, percent), "array<int>")
    sizes_of = F.udf(lambda n: [segments(b, percent) for b in schemes(n, percent)], "array<int>")
    sizes = scratch(classes.select("n").distinct().select("n", bands_of("n").alias("bands"), sizes_of("n").alias("sizes")), "set-sizes")
    per_band = classes.join(sizes, "n").select(F.explode(F.arrays_zip("bands", "sizes")).alias("x"), "n").groupBy("x.bands", "x.sizes")
    per_band = per_band.agg(F.count("*").alias("held"), F.avg(F.col("n") / F.col("x.sizes")).alias("width")).select(F.col("bands").alias("band"), F.col("sizes").alias("m"), "held", "width")
    # place in the arrays of a set's schemes: band and segment
    starts = F.transform("sizes", lambda _, i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda t, v: t + v))
    which = F.size(F.filter("starts", lambda v: v <= F.col("pos"))) - 1
    placed = posts.join(sizes.withColumn("starts", starts), "n").withColumn("i", which)
    placed = scratch(placed.select("doc_id", "n", "key", F.get("bands", "i").alias("band"), (F.col("pos") - F.get("starts", "i")).cast("int").alias("seg")), "placed-posts")
    cost = placed.groupBy("band", "seg", "key").count().groupBy("band", "seg").agg(F.sum(F.col("count") * F.col("count")).alias("cost"))
    every = scratch(per_band.select("band", "held", "width", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("seg")).join(cost, ["band", "seg"], "left").fillna(0, "cost"), "costs")
    by = Window.partitionBy("band")
    dear = every.select("band", F.col("seg").alias("out"), F.col("cost").alias("dear"), F.row_number().over(by.orderBy(F.col("cost").desc(), F.col("seg"))).alias("r"))
    cheap = every.select("*", F.row_number().over(by.orderBy("cost", F.col("seg").desc())).alias("r"), F.count("*").over(by).alias("m")).where(2 * F.col("r") <= F.col("m"))
    swaps = cheap.join(dear, ["band", "r"]).where(F.col("dear") > (F.col("cost") + F.col("held")) * (F.col("width") + 1)).select("band", "seg", "out")
    swaps = scratch(swaps, "swapped-segments")
    out = swaps.select("band", F.explode(F.array("seg", "out")).alias("seg"))
    kept = placed.join(out, ["band", "seg"], "left_anti").select("doc_id", "n", "key")
    bands = classes.join(sizes.select("n", "bands"), "n").join(F.broadcast(swaps.agg(F.collect_set("band").alias("in"))), F.arrays_overlap("bands", "in")).select("doc_id", "n", "bands")
    return kept.union(_neighbourhoods(bands, swaps.select("band", "seg"), sets, percent))


def _open(lists: DataFrame) -> DataFrame:
    """The rows of lists with members in more than one component. can: a member may be a pivot, held: how many of its list may. These are
    those with own or, if they are fewer, those outside the list's greatest component: one end of each pair that is left is among either."""
    each = lists.groupBy("key", "c").agg(F.count("*").alias("of"), F.count(F.when(F.col("own"), 1)).alias("owned"))
    by_list = each.groupBy("key").agg(F.sum("owned").alias("owned"), F.sum("of").alias("all"), F.max(F.struct("of", "c")).alias("most"))
    by_list = by_list.select("key", "owned", (F.col("all") - F.col("most.of")).alias("out"), F.col("most.c").alias("most")).where("owned > 0 and out > 0")
    can = F.when(F.col("owned") <= F.col("out"), F.col("own")).otherwise(F.col("c") != F.col("most"))
    joined = lists.drop("held", "can").join(by_list, "key").withColumn("can", can).withColumn("held", F.least("owned", "out"))
    return scratch(joined.drop("owned", "out", "most"), "open-lists")


def _by_rarest(sets: DataFrame, percent: int) -> DataFrame:
    """Lists (key, doc_id, n, rank, own) of the sets under their rarest shingles, by size: two sets at the threshold are in one list.

    A pair of sizes p <= q shares percent * (p + q) / (100 + percent) shingles, so the rarest that it shares has few rarer ones in both sets:
    the smaller is posted under as many as a partner of its own size needs (own), the larger under as many as the smallest
    partner of each size class needs. Shingles of one set only are counted but not posted. rank: the rarer shingles of the set.
    """
    kind = sets.schema["doc_id"].dataType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo in range(0, x.num_rows, 256):
                part = x.slice(lo, 256)
                got = [np.frombuffer(s.as_py(), np.int64) for s in part["shingles"]]
                at = pa.array(np.repeat(np.arange(len(got)), list(map(len, got))))
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(at), part["of"].take(at), part["n"].take(at), pa.array(np.concatenate(got))], ["doc_id", "of", "n", "token"])

    # an id may have several sets
    each = sets.select("doc_id", F.xxhash64("shingles").alias("of"), F.col("n_shingles").alias("n"), "shingles").dropDuplicates(["doc_id", "of"])
    tokens = scratch(each.mapInArrow(unpack, f"doc_id {kind}, of long, n long, token long"), "tokens")
    shared = scratch(tokens.groupBy("token").count().where("count >= 2"), "shared-tokens")
    ranked = tokens.join(shared, "token").groupBy("doc_id", "of", "n").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("all"))
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.lit(float(np.log(STEP))) + 1e-9).cast("int")
    least = F.ceil(F.lit(percent) * F.col("n") / 100)  # smallest partner
    prefix = lambda both: (F.col("n") - F.ceil(F.lit(percent) * both / (100 + percent)) + 1).cast("int")
    smallest = lambda s: F.greatest(F.floor(F.pow(F.lit(STEP), s.cast("double")) - 1e-6), least)
    role = lambda size, own, take: F.struct(size.alias("size"), F.lit(own).alias("own"), take.alias("take"))
    roles = F.concat(
        F.array(role(size_class(F.col("n")), True, prefix(2 * F.col("n")))),
        F.transform(F.sequence(size_class(least), size_class(F.col("n"))), lambda s: role(s, False, prefix(smallest(s) + F.col("n")))),
    )
    alone = (F.col("n") - F.size("all")).cast("int")
    posts = ranked.select("doc_id", "of", "n", "all", alone.alias("alone"), F.explode(roles).alias("r"))
    posts = posts.select("doc_id", "of", "n", "r.size", "r.own", "alone", F.posexplode(F.slice("all", F.lit(1), F.greatest(F.col("r.take") - F.col("alone"), F.lit(0)))))
    posts = posts.select(F.xxhash64("size", "col.token").alias("key"), "doc_id", "n", (F.col("alone") + F.col("pos")).alias("rank"), "own")
    return posts.groupBy("key", "doc_id", "n", "rank").agg(F.max("own").alias("own"))


def _split(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rest with its long lists replaced by lists of their members' rarest shingles."""
    kept = rest.where(F.col("held") <= SPLIT)
    members = scratch(rest.where(F.col("held") > SPLIT).select("doc_id", "c").distinct(), "split-members")
    if members.isEmpty():
        return rest
    made = _by_rarest(sets.join(members, "doc_id", "left_semi"), percent).join(members, "doc_id").withColumn("far", F.lit(None).cast("long"))
    return kept.union(_open(made).select(*kept.columns))


def _met(rest: DataFrame, pivot: DataFrame, pieces: int) -> DataFrame:
    """The members of each list with its pivots, at most ``pieces`` of them. Lists that hold more than 1 / SHARE of all rows are dealt
    out by member, to more tasks the more pairs they make; a pivot is copied to each of them."""
    pairs = F.col("held") * F.least(F.col("held"), F.lit(max(pieces, SPLIT)))
    slots = F.least(F.greatest(F.ceil(pairs / TASK_PAIRS), F.lit(PIECES // pieces)), F.lit(PIECES)).cast("int")
    lists = rest.groupBy(F.col("key").alias("hot")).agg(F.count("*").alias("held"))
    large = lists.where(F.col("held") * SHARE > max(rest.count(), 16 * SHARE)).select("hot", slots.alias("slots")).where("slots > 1")
    large = F.broadcast(scratch(large, "large-lists"))  # fewer than SHARE rows
    slots = F.coalesce("slots", F.lit(1))
    dealt = rest.join(large, F.col("key") == F.col("hot"), "left").withColumn("slot", F.pmod(F.xxhash64("doc_id"), slots).cast("int")).drop("hot", "slots")
    copied = pivot.join(large, F.col("key") == F.col("hot"), "left").withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("hot", "slots")
    return dealt.join(copied, ["key", "slot"]).drop("slot")


def _linked(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the linked classes. lists: key, doc_id, n (set size), rank (the central members have the lowest).

    In a round each open list is dealt into pieces by a hash of the member, and the first member of every piece is a pivot: it meets
    all members that haven't been pivots, are in another component and can be near enough. After the first round, in which every list has
    one pivot, long lists are replaced by lists of rarest shingles, and all members of a short list are pivots at once. The pieces
    grow from round to round.
    """
    comp = lists.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")).limit(0)
    edges, pieces, rest = None, 1, _open(lists.withColumn("c", F.col("doc_id")).withColumn("own", F.lit(True)))
    while not rest.isEmpty():
        started = pieces > 1
        piece = F.xxhash64("doc_id", F.lit(pieces))
        piece = F.when(F.col("held") <= max(pieces, SPLIT), piece).otherwise(F.pmod(piece, F.lit(pieces))) if started else F.lit(0)
        first = F.struct("rank", "doc_id", "n", "c", "own", *(["far"] if started else []))
        pivot = (rest.where("can") if started else rest).groupBy("key", piece.alias("deal")).agg(F.min(first).alias("p"))
        far_of = F.col("p.far") if started else F.lit(None).cast("long")
        pivot = scratch(pivot.select("key", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.c").alias("pc"), F.col("p.rank").alias("prank"), F.col("p.own").alias("pown"), far_of.alias("pfar")), "pivots")
        most = (F.col("n") + F.col("pn")) * (100 - percent) / (100 + percent)  # differences of a linked pair
        near = F.col("doc_id") != F.col("pivot")
        if started:
            # pivots meet each other once; the rarest shingle that a pair shares has enough others after it in both sets
            rest = scratch(rest.join(pivot.select("key", F.col("pivot").alias("doc_id"), F.lit(True).alias("first")).distinct(), ["key", "doc_id"], "left"), "dealt-lists")
            enough = F.least(F.col("n") - F.col("rank"), F.col("pn") - F.col("prank")) * (100 + percent) >= percent * (F.col("n") + F.col("pn"))
            near = (F.col("first").isNull() | (F.col("doc_id") < F.col("pivot"))) & near & (F.col("c") != F.col("pc")) & (F.col("own") | F.col("pown")) & enough
            near = near & F.coalesce(F.abs(F.col("far") - F.col("pfar")) <= most, F.lit(True))
        met = _met(rest, pivot, pieces).where(near)
        ends = F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")
        found = scratch(_compared(met.select(*ends).distinct(), sets, percent), "compared")
        if started:
            rest = rest.where("first is null").drop("first")
        else:  # every member has met the pivot of its list
            rest = rest.join(pivot.select("key", "pivot"), "key").where(near).select(*rest.columns, *ends)
            rest = rest.join(found.select("a", "b", (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("far")), ["a", "b"]).drop("a", "b")
        links = found.where("linked").select("a", "b")
        if not links.isEmpty():
            comp = components(links if edges is None else links.union(edges))
            edges = comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            rest = rest.drop("c").join(comp.toDF("doc_id", "c"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
        rest = _open(scratch(rest, "rest-of-lists"))
        if not started:
            rest = scratch(_split(rest, sets, percent), "split-lists")
        pieces *= GROW
    return comp


class Postings:
    """Tables of a join: rows (doc_id, n_shingles, set_hash, keys), classes (set_hash, doc_id), lists (key, doc_id, n, rank), sets."""

    def __init__(self, docs: DataFrame, percent: int, words: int, id_col: str, text_col: str):
        if not 50 <= percent <= 100:
            raise ValueError("the threshold is a percentage from 50 to 100")
        base = columns(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
        self.rows = scratch(posted(base, words, percent), "segments")
        sound = self.rows.where("doc_id is not null and n_shingles > 0")
        self.classes = scratch(sound.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id")), "classes")
        first = sound.join(self.classes, ["set_hash", "doc_id"], "left_semi").dropDuplicates(["doc_id", "set_hash"])
        first = first.select("doc_id", F.col("n_shingles").alias("n"), "keys")
        posts = first.select("doc_id", "n", F.posexplode("keys").alias("pos", "key"))
        often = scratch(posts.groupBy("key").count().where("count >= 2").select("key"), "shared-segments")
        posts = scratch(posts.join(often, "key"), "posts")
        wanted = posts.select("doc_id").distinct()
        self.sets = scratch(shingle_sets(base.join(wanted, "doc_id", "left_semi"), words).where("n_shingles > 0"), "sets")
        posts = scratch(_allocated(posts, posts.select("doc_id", "n").distinct(), self.sets, percent), "allocated-posts")
        rank = posts.groupBy("doc_id").agg((-F.count("*")).cast("int").alias("rank"))
        self.lists = scratch(posts.join(rank, "doc_id").select("key", "doc_id", "n", "rank"), "lists")


def jaccard_pairs(docs: DataFrame, percent: int = 90, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between different texts: (a, b, na, nb, both), a < b, between representatives of classes, with their set sizes and
    the size of the intersection; and the membership (doc_id, class_id). Copies aren't expanded into pairs. All members of a list
    meet, so the work follows the number of pairs that share a segment, most of which are links."""
    of = Postings(docs, percent, words, id_col, text_col)
    two = of.lists.select("key", F.col("doc_id").alias("b"), F.col("n").alias("m"))
    met = lookup(of.lists, "key", two, "doc_id", hot_keys(of.lists, "key")).where((F.col("doc_id") < F.col("b")) & (F.least("n", "m") * 100 >= percent * F.greatest("n", "m")))
    members = lookup(of.rows.select("doc_id", "set_hash"), "set_hash", of.classes.toDF("set_hash", "class_id"), "doc_id", hot_keys(of.rows, "set_hash"))
    links = _compared(met.select(F.col("doc_id").alias("a"), "b").distinct(), of.sets, percent).where("linked")
    return links.select("a", "b", "na", "nb", "both"), members.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def jaccard_components(docs: DataFrame, percent: int = 90, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles of ``words`` words (A-Z
    lower-cased, words end at white space); component_id is the smallest id reachable. A text with fewer words is one shingle; a null
    or empty text, or one of white space, has none and is linked with nothing. Long texts are read whole. Rows that repeat an id
    are placed each by its own text; texts with the same smallest id are one node. A row without an id takes no part: component_id
    null. Extra columns are ignored; empty table: no rows. Thresholds below 50% are refused.
    """
    of = Postings(docs, percent, words, id_col, text_col)
    linked = _linked(of.lists, of.sets, percent)
    found = of.classes.join(linked.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("set_hash", F.coalesce("component", "doc_id").alias("reach"))
    placed = lookup(of.rows.select("doc_id", "n_shingles", "set_hash"), "set_hash", found, "doc_id", hot_keys(of.rows, "set_hash"))
    reach = F.when(F.col("doc_id").isNotNull(), F.coalesce("reach", "doc_id"))
    return placed.select("doc_id", "n_shingles", reach.alias("component_id"))
