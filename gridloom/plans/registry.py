"""Names of queries, the functions that build them, and the SQL each is checked against."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import cells as C

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding matrix as images of 64 rows."""
    return C.to_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quantised(real(spark, sf_dir))


#: The same two views for the SQL side.
CELLS = """cells AS (SELECT vec_id // 64 AS img_id, CAST(vec_id % 64 AS INT) AS y, CAST(i - 1 AS INT) AS x, 0 AS c, CAST(embedding[i] AS DOUBLE) AS v
            FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
Q = CELLS + """, q AS (SELECT img_id, y, x, c, CAST(least(greatest(round_even((v + 1) * 127.5, 0), 0), 255) AS INT) AS v FROM cells)"""
DIM = "dim AS (SELECT img_id, max(y) + 1 AS h, max(x) + 1 AS w FROM q GROUP BY 1)"


def border_sql(i: str, n: str, border: str) -> str:
    if border == "REPLICATE":
        return f"least(greatest({i}, 0), {n} - 1)"
    if border == "REFLECT_101":
        return f"CASE WHEN abs({i}) >= {n} THEN 2 * ({n} - 1) - abs({i}) ELSE abs({i}) END"
    return f"CASE WHEN {i} >= 0 AND {i} < {n} THEN {i} END"


def around_sql(k: int, border: str, constant: float = 0, src: str = "q") -> str:
    """CTE nb(img_id, y, x, c, dy, dx, v): every cell with the cells around it."""
    r = k // 2
    return f"""{DIM.replace('FROM q', f'FROM {src}')}, nb AS (SELECT o.img_id, o.y, o.x, o.c, a.dy, b.dx, coalesce(s.v, {constant}) AS v
            FROM {src} o JOIN dim USING (img_id) CROSS JOIN (SELECT unnest(range(-{r}, {k - r})) AS dy) a CROSS JOIN (SELECT unnest(range(-{r}, {k - r})) AS dx) b
            LEFT JOIN {src} s ON s.img_id = o.img_id AND s.c = o.c AND s.y = {border_sql('o.y + a.dy', 'h', border)} AND s.x = {border_sql('o.x + b.dx', 'w', border)})"""
