"""Mixing sources to target weights by Pareto order sampling.

Targets: each source gets a share of ``ratio`` times all words by its weight and stops at ``max_copies`` times its own size; what
is over is reshared by weight (water-filling over the sources in the order in which they reach their stops).

Every document of a source gets the whole copies of target / size for certain. The words that are left, R, are sampled. A source's
documents are cut into size bands (four to a doubling). A band with words S_b wants R_b = R * S_b / S of them, and a document of
size s in it has the inclusion odds p / (1 - p) * s / (mean size of the band), p = R / S, so longer documents are likelier. The
number of documents n_b to take from the band is fixed beforehand: R_b over the expected size of a sampled document,
rounded from the largest band down, what rounding leaves going to the next band. In each band the n_b documents
with the smallest random odds over inclusion odds, (u / (1 - u)) / (p_i / (1 - p_i)), have one copy more.

The n_b-th smallest rank is found without ordering a band in one task: documents are counted per cell of the ranking (4,096 cells,
then the 4,096 cells of the cell that has it, then what is left of that).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import NON_WS, columns, scratch

KEY_BITS, CELL_BITS = 48, 12
PER_DOUBLING = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NON_WS + "+")), F.lit(0)).cast("long")


def _band(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double")) * PER_DOUBLING).cast("int")


def _uniform(seed: int) -> Column:
    """A number in (0, 1) that depends on the document alone, so reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def _rank(u: Column, odds: Column) -> Column:
    """Q = (u / (1 - u)) / odds as a whole number of KEY_BITS bits, by Q / (1 + Q)."""
    return F.floor(u / (u + (1 - u) * odds) * F.lit(float(1 << KEY_BITS))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], ratio: float, max_copies: int) -> DataFrame:
    """sizes (source, source_size), one row per source. Adds target. Sources take the weights in the order of their code points."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.lit(max_copies) * F.col("source_size"))
    # sources in the order in which a rising level reaches their stops
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, on = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    left = F.lit(ratio) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    t = t.withColumn("level", left / F.sum("weight").over(on))
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    full = F.col("cap").cast("double")
    return t.select("source", "source_size", F.least(full, F.coalesce(F.col("level") * F.col("weight"), full)).alias("target"))


def _fixed_sizes(bands: DataFrame) -> DataFrame:
    """bands (sid, band, docs, wanted words, mean words of a sampled document): adds take, the number of documents.

    A source has at most PER_DOUBLING * 63 bands, so its list is short whatever the input."""
    listed = bands.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("band", "docs", "wanted", "mean")), asc=False).alias("bands"))
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<band:int,take:bigint>>").alias("done"))

    def step(state: Column, b: Column) -> Column:
        due = b["wanted"] + state["carry"]
        take = F.least(F.greatest(F.round(due / b["mean"]).cast("long"), F.lit(0).cast("long")), b["docs"])
        return F.struct((due - take * b["mean"]).alias("carry"), F.array_append(state["done"], F.struct(b["band"].alias("band"), take.alias("take"))).alias("done"))

    done = listed.select("sid", F.explode(F.aggregate("bands", start, step)["done"]).alias("d"))
    return done.select("sid", "d.band", "d.take")


def _cuts(keyed: DataFrame) -> DataFrame:
    """keyed (sid, band, take, key): for each band the take-th smallest key, how many documents have it and how many of those go in."""
    at = ["sid", "band"]
    shift = KEY_BITS
    while shift > 0:
        shift = max(0, shift - CELL_BITS if shift > 2 * CELL_BITS else 0)
        cells = keyed.groupBy(*at, "take", F.shiftright("key", shift).alias("cell")).count()
        before = F.sum("count").over(Window.partitionBy(*at).orderBy("cell")) - F.col("count")
        found = cells.withColumn("before", before).where("before < take and take <= before + count")
        found = scratch(found.select(*at, "cell", (F.col("take") - F.col("before")).alias("take"), F.col("count").alias("ties")), "mix-cells")
        if shift:
            inside = keyed.drop("take").withColumn("cell", F.shiftright("key", shift)).join(found, [*at, "cell"])
            keyed = scratch(inside.select(*at, "take", "key"), "mix-inside")
    return found.withColumnRenamed("cell", "cut")


def mixing_plan(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, max_copies: int = 2, seed: int = 17
) -> DataFrame:
    """One row per source and size band (null: no words): source, band, source_size, target, whole (certain copies), odds (inclusion
    odds per word), take (documents with a copy more), cut (largest rank taken), ties (documents of that rank) and last (those of them taken)."""
    sized = scratch(docs.select("source", word_count(F.col("text")).alias("size"), _uniform(seed).alias("u")), "mix-sized")
    sizes = scratch(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets(sizes, weights, ratio, max_copies).withColumn("whole", F.floor(rate).cast("int"))
    plan = plan.withColumn("p", rate - F.col("whole")).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    plan = scratch(plan.withColumnRenamed("source", "of"), "mix-plan")
    named = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select("sid", "size", "u", "p", F.when(F.col("size") > 0, _band(F.col("size"))).alias("band"))
    named = scratch(named, "mix-named")
    bands = named.groupBy("sid", "band").agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words"))
    odds = F.when((F.col("p") > 0) & F.col("band").isNotNull(), F.col("p") / (1 - F.col("p")) * F.col("docs") / F.col("words"))
    bands = scratch(bands.withColumn("odds", odds), "mix-bands")
    drawn = named.where("p > 0").select("sid", "band", "size", "u").join(bands.where("odds is not null").drop("p"), ["sid", "band"])
    drawn = scratch(drawn.withColumn("o", F.col("odds") * F.col("size")).select("sid", "band", "size", "o", _rank(F.col("u"), F.col("o")).alias("key")), "mix-drawn")
    chance = F.col("o") / (1 + F.col("o"))
    sampled = drawn.groupBy("sid", "band").agg((F.sum(chance * F.col("size")) / F.sum(chance)).alias("mean"))
    wanted = bands.join(sampled, ["sid", "band"]).select("sid", "band", "docs", (F.col("p") * F.col("words")).alias("wanted"), "mean")
    takes = scratch(_fixed_sizes(wanted), "mix-takes")
    cuts = _cuts(drawn.join(takes.where("take > 0"), ["sid", "band"]).select("sid", "band", "take", "key"))
    cuts = cuts.select("sid", "band", "cut", "ties", F.col("take").alias("last"))
    known = bands.drop("p", "docs", "words").join(takes, ["sid", "band"], "left").join(cuts, ["sid", "band"], "left")
    return plan.join(known, "sid").select(F.col("of").alias("source"), "band", "source_size", "target", "whole", "odds", "take", "cut", "ties", "last")


def _among_ties(tied: DataFrame) -> DataFrame:
    """tied: rows that share id, text and rank at the cut. Sets more (0 or 1) to 1 for as many of a group as its last says: rows are
    numbered within the partitions they come from and those by a running sum, so no group goes to one task."""
    tied = scratch(tied.withColumn("part", F.spark_partition_id()), "mix-tied")
    sums = tied.groupBy("of", "band", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("of", "band").orderBy("part")) - F.col("n")
    sums = sums.select(F.col("of").alias("s"), F.col("band").alias("b"), F.col("part").alias("p"), upto.alias("upto"))
    at = F.row_number().over(Window.partitionBy("of", "band", "part").orderBy(F.lit(0)))
    same = F.col("of").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")) & (F.col("part") == F.col("p"))
    return tied.withColumn("at", at).join(sums, same).withColumn("more", (F.col("at") + F.col("upto") <= F.col("last")).cast("int"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, max_copies: int = 2, seed: int = 17
) -> DataFrame:
    """docs with size, source_size, target, copies (0 to max_copies) and taken = copies * size added.

    docs needs doc_id, text and source; its other columns stay, whatever their names, unless they bear one of the added
    ones, which are replaced. Null text has size 0. Null source is a source of its own, last in order. A document's draw
    depends on its id and text alone; of rows that repeat both and fall on the cut, as many as are wanted have the copy. Sources
    without words, and an empty table, have target 0. Texts count whole.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*added)
    plan = scratch(mixing_plan(columns(docs, "doc_id", "text", "source"), weights, ratio, max_copies, seed), "mix-final")
    # the row is packed, so that its columns can't clash with the working ones
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), word_count(F.col("text")).alias("size"), _uniform(seed).alias("u"))
    here = F.when(F.col("size") > 0, _band(F.col("size")))
    same = F.col("row.source").eqNullSafe(F.col("of")) & here.eqNullSafe(F.col("band"))
    joined = packed.join(plan.withColumnRenamed("source", "of"), same, "left").withColumn("key", _rank(F.col("u"), F.col("odds") * F.col("size")))
    joined = joined.withColumn("more", F.when(F.col("key") <= F.col("cut"), 1).otherwise(0))
    if not plan.where("last < ties").isEmpty():
        split = F.coalesce((F.col("key") == F.col("cut")) & (F.col("last") < F.col("ties")), F.lit(False))
        joined = joined.where(~split).unionByName(_among_ties(joined.where(split)), allowMissingColumns=True)
    copies = (F.col("whole") + F.col("more")).cast("int")
    return joined.select("row.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
