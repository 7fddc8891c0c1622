"""Paths over cells: words spelled by neighbouring cells, and contours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def word_search(letters: DataFrame, word: str) -> DataFrame:
    """img_id, y, x of cells (img_id, y, x, letter) from which ``word`` can be spelled over 4-neighbours, no cell used twice.

    One join a letter: a path meets the cells of the next letter among the four beside its end. Paths carry the cells they
    used. An empty word has no start.
    """
    if not word:
        return letters.select("img_id", "y", "x").where(F.lit(False))
    at = F.struct("y", "x")
    paths = letters.where(F.col("letter") == word[0]).select("img_id", F.col("y").alias("y0"), F.col("x").alias("x0"), "y", "x", F.array(at).alias("used"))

    def longer(paths: DataFrame, letter: str) -> DataFrame:
        beside = F.array(*(F.struct((F.col("y") + a).alias("y"), (F.col("x") + b).alias("x")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))))
        ends = paths.select("img_id", "y0", "x0", "used", F.explode(beside).alias("e")).where(~F.array_contains("used", F.col("e")))
        ends = ends.select("img_id", "y0", "x0", "used", "e.y", "e.x")
        met = ends.join(letters.where(F.col("letter") == letter).select("img_id", "y", "x"), ["img_id", "y", "x"])
        return met.select("img_id", "y0", "x0", "y", "x", F.concat("used", F.array(at)).alias("used"))

    return reduce(longer, word[1:], paths).select("img_id", F.col("y0").alias("y"), F.col("x0").alias("x")).distinct()


#: Clockwise directions of a cell's four sides: up, right, down, left.
_AHEAD = ((-1, 0), (0, 1), (1, 0), (0, -1))


#: Side of the squares of cells in which borders are followed in one task, and rows that are followed at once.
TILE, ROWS = 64, 1 << 16


def _to_end(after: np.ndarray, steps: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By doubling: whether each side's chain ends (at the place after the last side), the steps to there, and the place of the least one on the way."""
    end = len(after)
    after, steps, low = np.r_[after, end], np.r_[steps, 0], np.r_[low, end]
    while True:
        best, far = np.minimum(low, low[after]), after[after]
        if (best == low).all() and ((far == end) == (after == end)).all():
            return after[:-1] == end, steps[:-1], low[:-1]
        after, steps, low = far, steps + steps[after], best


def _followed(g: np.ndarray, y: np.ndarray, x: np.ndarray, ty: np.ndarray, tx: np.ndarray, tile: int) -> dict[str, np.ndarray]:
    """The sides of the cells of tiles g (with the cells around them): row (of the cell), id, area; contour and left of those on a border inside
    the tile; for the others exit (the side after the last one in the tile), steps to there, and where a chain enters the tile its least side and
    the steps from that to the exit."""
    wide = tile + 2
    key, at = np.unique((g * wide + y - ty * tile + 1) * wide + x - tx * tile + 1, return_index=True)
    y, x = y[at], x[at]
    ly, lx = key // wide % wide, key % wide
    core = (ly > 0) & (ly <= tile) & (lx > 0) & (lx <= tile)
    on = {}
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            k = key[core] + a * wide + b
            on[a, b] = key[np.minimum(np.searchsorted(key, k), len(key) - 1)] == k
    at, key, y, x, ly, lx = (v[core] for v in (at, key, y, x, ly, lx))
    parts = []
    for d, (a, b) in enumerate(_AHEAD):
        # along side d of a cell one goes in direction e; the cell ahead or the one beyond its corner may take over
        e = (d + 1) % 4
        p, q = _AHEAD[e]
        beyond, ahead = on[a + p, b + q], on[p, q]
        dy, dx = np.where(beyond, a + p, np.where(ahead, p, 0)), np.where(beyond, b + q, np.where(ahead, q, 0))
        side = np.where(beyond, (d + 3) % 4, np.where(ahead, d, e))
        inside = (ly + dy > 0) & (ly + dy <= tile) & (lx + dx > 0) & (lx + dx <= tile)
        # twice the signed area that the side adds: clockwise borders sum to more than 0
        turn = (-y, x + 1, y + 1, -x)[d]
        of = np.array([key * 4 + d, (key + dy * wide + dx) * 4 + side, inside, at, (y * (1 << 30) + x) * 4 + d, ((y + dy) * (1 << 30) + x + dx) * 4 + side, turn])
        parts.append(of[:, ~on[a, b]])
    sides = np.concatenate(parts, axis=1)
    own, after, inside, row, name, name_after, area = sides[:, np.lexsort((sides[4], sides[0] // (4 * wide * wide)))]  # by tile and name
    where, n = np.argsort(own), len(own)
    after = np.where(inside > 0, where[np.searchsorted(own, after, sorter=where) % max(n, 1)] if n else after, n)
    opens, steps, low = _to_end(after, np.ones(n, np.int64), np.arange(n))
    # a border inside the tile: cut before its least side
    last = after == low
    left = _to_end(np.where(last | opens, n, after), (~last).astype(np.int64), np.arange(n))[1]
    enters = opens & ~np.isin(np.arange(n), after)
    tail = np.where(after == n, np.arange(n), after)  # to the last side of a chain
    while opens.any() and (tail[tail] != tail)[opens].any():
        tail = tail[tail]
    exit_ = name_after[tail]
    return {"row": row, "id": name, "area": area, "opens": opens, "enters": enters, "contour": name[low], "left": left, "exit": exit_, "steps": steps, "at": steps[low]}


def _sides(cells: DataFrame, tile: int) -> DataFrame:
    """img_id, y, x, id, area, contour, left, exit, steps, least, at of the sides of cells (img_id, y, x), followed in tiles (see _followed).
    The cells are dealt out by tile, those at the edge of a tile to the tiles beside it too."""
    kind = cells.schema["img_id"].dataType.simpleString()
    tiles = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + k) / tile) for k in (-1, 0, 1))))
    by = ["img_id", "ty", "tx"]
    dealt = cells.select("img_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).dropna()
    dealt = dealt.withColumn("ty", F.explode(tiles("y"))).withColumn("tx", F.explode(tiles("x"))).repartition(*by).sortWithinPartitions(*by)

    def made(t: pa.Table, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        f = _followed(g, *(t[c].to_numpy() for c in ("y", "x", "ty", "tx")), tile)
        only = lambda c, where: pa.array(f[c], mask=~where)
        row, opens = pa.array(f["row"]), f["opens"]
        cols = [t[c].take(row) for c in ("img_id", "y", "x")] + [pa.array(f["id"]), pa.array(f["area"]), only("contour", ~opens), only("left", ~opens)]
        cols += [only("exit", opens), only("steps", opens), only("contour", f["enters"]), only("at", f["enters"])]
        yield from pa.table(cols, names=["img_id", "y", "x", "id", "area", "contour", "left", "exit", "steps", "least", "at"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= ROWS:
                t = pa.Table.from_batches(held)
                g = tile_of(t)
                cut = int(np.searchsorted(g, g[-1]))  # the last tile may go on
                if cut:
                    yield from made(t.slice(0, cut), g[:cut])
                held = t.slice(cut).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            if t.num_rows:
                yield from made(t, tile_of(t))

    def tile_of(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in by:
            v = t[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    longs = ", ".join(f"{c} long" for c in ("y", "x", "id", "area", "contour", "left", "exit", "steps", "least", "at"))
    return dealt.mapInArrow(run, f"img_id {kind}, {longs}")


def contours(cells: DataFrame, written, simple: bool = False, tile: int = TILE) -> DataFrame:
    """img_id, contour, hole, seq, y, x: the borders of the non-zero cells (8-connected), in order, clockwise around them.

    Every side between a non-zero cell and a zero or outside one has exactly one side after it, so borders are the cycles
    of that successor. They are followed in tiles of cells first, which finishes those inside a tile; the chains that cross tiles are named
    (smallest side) and ranked by doubling: with each round a chain knows twice as many of the chains after it, so rounds follow
    the logarithm of the longest border in tiles; only the last step, which numbers
    the points, sorts one border in a task. ``hole``: the border runs around zero cells. Cells that repeat one after the other are one point; ``simple`` keeps only points at
    which the direction changes. ``written`` cuts the lineage of a table. No non-zero cell: no rows.
    """
    types = {c: cells.schema[c].dataType for c in ("y", "x")}
    sides = written(_sides(cells.where("v <> 0").select("img_id", "y", "x"), tile))
    chains = written(sides.where("least is not null").select("img_id", "id", F.col("exit").alias("next"), "least", "steps", "at"))
    ranked = sides.where("exit is null").select("img_id", "id", "y", "x", "area", "contour", "left")
    if not chains.isEmpty():
        low = chains.select("img_id", "id", "next", "least")
        while True:
            far = low.select("img_id", F.col("id").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"))
            step = written(low.join(far, ["img_id", "next"]).select("img_id", "id", F.col("next2").alias("next"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved")))
            low = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        named = chains.join(low.select("img_id", "id", F.col("least").alias("contour")), ["img_id", "id"])
        # steps from a chain's first side to the side that names the border
        has = F.col("least") == F.col("contour")
        named = written(named.select("img_id", "id", "next", "contour", "steps", F.when(has, F.col("at")).alias("cut")))
        cut = F.col("cut").isNotNull()
        rank = written(named.select("img_id", "id", "contour", F.when(~cut, F.col("next")).alias("next"), (F.col("steps") - F.coalesce("cut", F.lit(0))).alias("to")))
        while not rank.where("next is not null").isEmpty():
            far = rank.select("img_id", F.col("id").alias("next"), F.col("next").alias("next2"), F.col("to").alias("to2"))
            rank = written(rank.join(far, ["img_id", "next"], "left").select("img_id", "id", "contour", F.col("next2").alias("next"), (F.col("to") + F.coalesce("to2", F.lit(0))).alias("to")))
        exits = rank.select("img_id", F.col("id").alias("exit"), "contour", "to").join(named.select("img_id", F.col("next").alias("exit"), "cut"), ["img_id", "exit"])
        left = F.when(F.col("steps") > F.col("cut"), F.col("steps") - F.col("cut")).otherwise(F.col("steps") + F.col("to")) - 1
        crossing = sides.where("exit is not null").drop("contour", "left").join(exits, ["img_id", "exit"])
        ranked = ranked.union(crossing.select("img_id", "id", "y", "x", "area", "contour", left.alias("left")))
    border = Window.partitionBy("img_id", "contour")
    w = border.orderBy(F.col("left").desc())
    here = ranked.select(
        "img_id", "contour", "y", "x", "left", F.count("*").over(border).alias("n"), (F.sum("area").over(border) < 0).alias("hole"),
        F.max(F.when(F.col("left") == 0, F.struct("y", "x"))).over(border).alias("last"),
    )
    here = here.withColumn("p", F.coalesce(F.lag(F.struct("y", "x")).over(w), F.col("last")))
    here = here.withColumn("dy", F.col("y") - F.col("p.y")).withColumn("dx", F.col("x") - F.col("p.x"))
    points = here.where("dy <> 0 or dx <> 0 or (n = 4 and left = 3)").select("img_id", "contour", "hole", "left", "y", "x", "dy", "dx")
    if simple:
        first = F.max(F.struct("left", "dy", "dx")).over(border)
        points = points.withColumn("f", first).withColumn("go", F.coalesce(F.lead(F.struct("dy", "dx")).over(w), F.struct(F.col("f.dy").alias("dy"), F.col("f.dx").alias("dx"))))
        points = points.where("go.dy <> dy or go.dx <> dx or (dy = 0 and dx = 0)")
    return points.select("img_id", "contour", "hole", (F.row_number().over(w) - 1).alias("seq"), *(F.col(c).cast(t).alias(c) for c, t in types.items()))
