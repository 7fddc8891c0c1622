"""Dense arrays as DataFrames of cells (img_id, y, x, c, v), and as rows (img_id, c, y, row array)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import sat

KEY = ["img_id", "y", "x", "c"]
SIDE = 64

#: Keys that the rows of an image are dealt to where they meet what is known of the whole image.
PARTS = 16


def to_cells(vectors: DataFrame, id_col: str, vec_col: str, side: int = SIDE) -> DataFrame:
    """Vectors as cells: ``side`` consecutive ids are the rows of one single-channel image."""
    i = F.col(id_col)
    return vectors.select(
        F.floor(i / side).cast("long").alias("img_id"), F.pmod(i, F.lit(side)).cast("int").alias("y"), F.posexplode(vec_col).alias("x", "e")
    ).select("img_id", "y", "x", F.lit(0).alias("c"), F.col("e").cast("double").alias("v"))


def quantised(cells: DataFrame) -> DataFrame:
    """Values of [-1, 1] as U8."""
    return cells.withColumn("v", sat((F.col("v") + 1) * 127.5, "U8").cast("int"))


def shape(cells: DataFrame) -> DataFrame:
    """h, w of each image (derived, one row an image)."""
    return cells.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def with_shape(cells: DataFrame) -> DataFrame:
    return cells.join(shape(cells), "img_id")


def border_index(i: Column, n: Column, border: str) -> Column:
    """Index of the cell that stands in for place i of n; null for CONSTANT."""
    if border == "REPLICATE":
        return F.least(F.greatest(i, F.lit(0)), n - 1)
    if border == "REFLECT_101":
        a = F.abs(i)
        return F.when(a >= n, 2 * (n - 1) - a).otherwise(a)
    return F.when((i >= 0) & (i < n), i)


def to_rows(cells: DataFrame) -> DataFrame:
    """One array per image row, in x order."""
    got = cells.groupBy("img_id", "c", "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("r"))
    return got.select("img_id", "c", "y", F.col("r.v").alias("row"))


def from_rows(rows: DataFrame) -> DataFrame:
    return rows.select("img_id", "y", "c", F.posexplode("row").alias("x", "v")).select(*KEY, "v")


def heights(cells: DataFrame) -> DataFrame:
    return cells.groupBy("img_id").agg((F.max("y") + 1).alias("h"))


def neighbourhood(cells: DataFrame, ksize: int | tuple[int, int], border: str, value, constant: float = 0, h: DataFrame | None = None) -> DataFrame:
    """Cells whose v is value(at): at(dy, dx) is the cell of that offset under the border rule. v may be a struct, whose fields share
    the shuffles. ``h`` (img_id, h) has the heights, where cells are made from others of the same shape: without it
    they are taken from cells, which then are worked out once more.

    Each row goes to the ksize rows around it (a row array each, by (image, row), so one large image doesn't fall to one
    task), and a row's output is computed from its ksize neighbours in one expression. Rows are sent by what they know of their image, its
    height, so cells are worked out once.
    """
    kh, kw = (ksize, ksize) if isinstance(ksize, int) else ksize
    rh, rw = kh // 2, kw // 2
    y, part = F.col("y"), F.pmod(F.col("y"), F.lit(PARTS)).alias("part")
    of = (heights(cells) if h is None else h).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = to_rows(cells).select("*", part).join(of, ["img_id", "part"])
    # a row stands for its own place, and at a border for some outside, that are no farther than rh from the rows that see them
    places = [(-dy, dy) for dy in range(-rh, kh - rh)] if border == "CONSTANT" else [(o, dy) for dy in range(-rh, kh - rh) for o in range(-rh, rh + 1)]
    steps = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(dy).alias("dy")) for o, dy in places))
    seen = lambda p: (y + p["o"] >= 0) & (y + p["o"] < F.col("h")) & (border_index(y + p["o"] + p["dy"], F.col("h"), border) == y)
    met = rows.select("img_id", "c", "y", "row", F.explode(F.filter(steps, seen)).alias("p"))
    met = met.select("img_id", "c", (y + F.col("p.o")).alias("y"), "p.dy", "row").groupBy("img_id", "c", "y").agg(F.map_from_entries(F.collect_list(F.struct("dy", "row"))).alias("m"))
    band = F.array(*(F.element_at("m", F.lit(dy)) for dy in range(-rh, kh - rh)))
    met = met.where(F.element_at("m", F.lit(0)).isNotNull()).select("img_id", "c", "y", band.alias("band"), F.size(F.element_at("m", F.lit(0))).alias("w"))

    def out(x: Column) -> Column:
        def at(dy: int, dx: int) -> Column:
            i = border_index(x + dx, F.col("w"), border) if dx else x
            cell = F.get(F.get("band", F.lit(dy + rh)), i)
            return F.coalesce(cell, F.lit(constant)) if border == "CONSTANT" else cell

        return value(at)

    # outer: else the optimizer asks first whether the array is empty and so makes it twice
    done = met.select("img_id", "c", "y", F.transform(F.sequence(F.lit(0), F.col("w") - 1), out).alias("row"))
    return done.select("img_id", "y", "c", F.posexplode_outer("row").alias("x", "v")).select(*KEY, "v")
