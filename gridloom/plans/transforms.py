"""Queries of matrix products, transforms, colour conversion, labelling and line votes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.operators import color as K
from gridloom.operators import label as M
from gridloom.operators import linalg as L
from gridloom.plans.arrays import RGB, rgb
from gridloom.plans.registry import CELLS, DIM, Q, around_sql, query, real, u8
from gridloom.sources.shared import writer


@query("gemm", f"WITH {CELLS} SELECT a.img_id, a.y, b.x, round(sum(a.v * b.v), 8) AS v FROM cells a JOIN cells b ON b.img_id = a.img_id + 1 AND b.y = a.x GROUP BY 1, 2, 3")
def _(s, d):
    a = real(s, d)
    return L.gemm(a, a.withColumn("img_id", F.col("img_id") - 1)).select("img_id", "y", "x", F.round("v", 8).alias("v"))


def _dft_sql(m: int, sign: int, re: str, im: str, src: str, div: int = 1) -> str:
    ang = f"((k * (x % {m})) % {m}) * ({sign * 2 * math.pi / m!r})"
    return f"""SELECT img_id, y, CAST((x // {m}) * {m} + k AS INT) AS x, sum({re} * cos({ang}) - {im} * sin({ang})) / {div} AS re, sum({re} * sin({ang}) + {im} * cos({ang})) / {div} AS im FROM {src} CROSS JOIN (SELECT unnest(range(0, {m})) AS k) GROUP BY 1, 2, 3"""


def _complex(s, d):
    return real(s, d).select("img_id", "y", "x", F.col("v").alias("re"), F.lit(0.0).alias("im"))


def _round(df, n):
    clean = lambda c: (F.round(c, n) + 0.0).alias(c)
    return df.select("img_id", "y", "x", clean("re"), clean("im"))


@query("dft_rows", f"WITH {CELLS}, f AS ({_dft_sql(64, -1, 'v', '0.0', 'cells')}) SELECT img_id, y, x, round(re, 7) + 0.0 AS re, round(im, 7) + 0.0 AS im FROM f")
def _(s, d):
    return _round(L.dft_rows(_complex(s, d)), 7)


@query("idft_rows", f"WITH {CELLS} SELECT img_id, y, x, round(v, 5) + 0.0 AS re, 0.0 AS im FROM cells")
def _(s, d):
    return _round(L.dft_rows(L.dft_rows(_complex(s, d)), True, True), 5)


def _dft_sql_of(n: str, re: str, im: str, src: str) -> str:
    """The transform of rows whose length is in the column n of src."""
    ang = f"((k * x) % {n}) * ({-2 * math.pi!r} / {n})"
    return f"""SELECT img_id, y, CAST(k AS INT) AS x, sum({re} * cos({ang}) - {im} * sin({ang})) AS re, sum({re} * sin({ang}) + {im} * cos({ang})) AS im FROM (SELECT *, unnest(range(0, {n})) AS k FROM {src}) GROUP BY 1, 2, 3"""


@query("dft_2d", f"""WITH {CELLS}, s AS (SELECT *, count(*) OVER (PARTITION BY img_id, y) AS n FROM cells), f AS ({_dft_sql_of('n', 'v', '0.0', 's')}),
    t AS (SELECT img_id, x AS y, y AS x, re, im, count(*) OVER (PARTITION BY img_id, x) AS n FROM f), g AS ({_dft_sql_of('n', 're', 'im', 't')}) SELECT img_id, x AS y, y AS x, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM g""")
def _(s, d):
    return _round(L.dft2(_complex(s, d)), 6)


@query("grid_dft", f"""WITH {CELLS}, f AS ({_dft_sql(4, -1, 'v', '0.0', 'cells')}), t AS (SELECT img_id, x AS y, y AS x, re, im FROM f), g AS ({_dft_sql(4, -1, 're', 'im', 't')})
    SELECT img_id, x AS y, y AS x, round(re, 7) + 0.0 AS re, round(im, 7) + 0.0 AS im FROM g""")
def _(s, d):
    return _round(L.dft2(_complex(s, d), group=4, fill=True), 7)


for _n in (8, 16, 32):

    @query(f"grid_dft_{_n}", f"""WITH {CELLS}, f AS ({_dft_sql(_n, -1, 'v', '0.0', 'cells')}), t AS (SELECT img_id, x AS y, y AS x, re, im FROM f WHERE y < (SELECT max(y) + 1 FROM cells c WHERE c.img_id = f.img_id) // {_n} * {_n}), g AS ({_dft_sql(_n, -1, 're', 'im', 't')})
        SELECT img_id, x AS y, y AS x, round(re, 7) + 0.0 AS re, round(im, 7) + 0.0 AS im FROM g""")
    def _(s, d, n=_n):
        c = _complex(s, d)
        high = c.groupBy("img_id").agg((F.floor((F.max("y") + 1) / n) * n).alias("whole"))  # the grid covers whole tiles
        return _round(L.dft2(c.join(high, "img_id").where("y < whole").drop("whole"), group=n), 7)


@query("grid_idft", f"WITH {CELLS} SELECT img_id, y, x, round(v, 5) + 0.0 AS re FROM cells")
def _(s, d):
    return _round(L.dft2(L.dft2(_complex(s, d), group=4), True, True, group=4), 5).select("img_id", "y", "x", "re")


@query("dct_rows", f"""WITH {CELLS} SELECT img_id, y, CAST(k AS INT) AS x, round(sum(v * (CASE WHEN k = 0 THEN {math.sqrt(1 / 64)!r} ELSE {math.sqrt(2 / 64)!r} END) * cos((2 * x + 1) * k * ({math.pi / 128!r}))), 7) + 0.0 AS v
    FROM cells CROSS JOIN (SELECT unnest(range(0, 64)) AS k) GROUP BY 1, 2, 3""")
def _(s, d):
    return L.dct_rows(real(s, d)).select("img_id", "y", "x", (F.round("v", 7) + 0.0).alias("v"))


@query("idct_rows", f"WITH {CELLS} SELECT img_id, y, x, round(v, 5) + 0.0 AS v FROM cells")
def _(s, d):
    return L.dct_rows(L.dct_rows(real(s, d)), True).select("img_id", "y", "x", (F.round("v", 5) + 0.0).alias("v"))


def pixels(s, d):
    return rgb(s, d).groupBy("img_id", "y", "x").pivot("c", [0, 1, 2]).agg(F.first("v")).toDF("img_id", "y", "x", "c0", "c1", "c2")


@query("bgr_to_rgb", f"WITH {RGB} SELECT img_id, y, x, 2 - c AS c, v FROM rgb")
def _(s, d):
    return rgb(s, d).withColumn("c", 2 - F.col("c"))


@query("bgr_to_bgra", f"WITH {RGB} SELECT img_id, y, x, CAST(c AS INT) AS c, v FROM rgb UNION ALL SELECT DISTINCT img_id, y, x, 3 AS c, 255 AS v FROM rgb")
def _(s, d):
    r = rgb(s, d)
    return r.unionByName(r.where("c = 0").select("img_id", "y", "x", F.lit(3).alias("c"), F.lit(255).alias("v")))


@query("bgr_to_gray", f"WITH {RGB} SELECT img_id, y, x, (c0 * 3735 + c1 * 19235 + c2 * 9798 + 16384) >> 15 AS v FROM px")
def _(s, d):
    return pixels(s, d).select("img_id", "y", "x", K.gray(F.col("c0"), F.col("c1"), F.col("c2")).alias("v"))


@query("gray_to_bgr", f"WITH {Q} SELECT img_id, y, x, CAST(k AS INT) AS c, v FROM q CROSS JOIN (SELECT unnest(range(0, 3)) AS k)")
def _(s, d):
    return u8(s, d).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))


def _sat_sql(e: str) -> str:
    return f"CAST(least(greatest(round_even({e}, 0), 0), 255) AS INT)"


for _full in (False, True):
    _ky, _rv, _gv, _gu, _bu = ("1.0", "1.403", "-0.714", "-0.343", "1.77") if _full else ("1.164", "1.596", "-0.813", "-0.391", "2.018")
    _l = f"CAST({_ky} AS DOUBLE) * " + ("c0" if _full else "greatest(c0 - 16, 0)")
    _d = lambda k: f"CAST({k} AS DOUBLE)"

    @query(f"yuv444_to_rgb{'_full' if _full else ''}", f"""WITH {RGB} SELECT img_id, y, x, {_sat_sql(f'{_l} + {_d(_rv)} * (c2 - 128)')} AS r, {_sat_sql(f'{_l} + {_d(_gv)} * (c2 - 128) + {_d(_gu)} * (c1 - 128)')} AS g, {_sat_sql(f'{_l} + {_d(_bu)} * (c1 - 128)')} AS b FROM px""")
    def _(s, d, full=_full):
        r, g, b = K.yuv_to_rgb(F.col("c0"), F.col("c1"), F.col("c2"), full)
        return pixels(s, d).select("img_id", "y", "x", r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


@query("nv12_to_rgb", f"""WITH {Q}, l AS (SELECT * FROM q WHERE y < 32 AND x < 32), u AS (SELECT img_id, y - 32 AS cy, CAST((x // 2) AS INT) AS cx, max(CASE WHEN x % 2 = 0 THEN v END) AS u, max(CASE WHEN x % 2 = 1 THEN v END) AS w FROM q WHERE y >= 32 AND y < 48 AND x < 32 GROUP BY 1, 2, 3)
    SELECT l.img_id, l.y, l.x, {_sat_sql('CAST(1.164 AS DOUBLE) * greatest(l.v - 16, 0) + CAST(1.596 AS DOUBLE) * (w - 128)')} AS r FROM l JOIN u ON u.img_id = l.img_id AND cy = l.y // 2 AND cx = l.x // 2""")
def _(s, d):
    q = u8(s, d)
    luma = q.where("y < 32 and x < 32").select("img_id", "y", "x", "v", F.floor(F.col("y") / 2).cast("int").alias("cy"), F.floor(F.col("x") / 2).cast("int").alias("cx"))
    chroma = q.where("y >= 32 and y < 48 and x < 32").groupBy("img_id", (F.col("y") - 32).alias("cy"), F.floor(F.col("x") / 2).cast("int").alias("cx")).agg(
        F.max(F.when(F.col("x") % 2 == 0, F.col("v"))).alias("u"), F.max(F.when(F.col("x") % 2 == 1, F.col("v"))).alias("w"))
    r, _, _ = K.yuv_to_rgb(F.col("v"), F.col("u"), F.col("w"))
    return luma.join(chroma, ["img_id", "cy", "cx"]).select("img_id", "y", "x", r.cast("int").alias("r"))


_Y = "(CAST(0.299 AS DOUBLE) * c2 + CAST(0.587 AS DOUBLE) * c1 + CAST(0.114 AS DOUBLE) * c0)"


@query("rgb_to_yuv444", f"WITH {RGB} SELECT img_id, y, x, {_sat_sql(_Y)} AS luma, {_sat_sql(f'CAST(0.564 AS DOUBLE) * (c0 - {_Y}) + 128')} AS u, {_sat_sql(f'CAST(0.713 AS DOUBLE) * (c2 - {_Y}) + 128')} AS v FROM px")
def _(s, d):
    y, u, v = K.rgb_to_yuv(F.col("c2"), F.col("c1"), F.col("c0"))
    return pixels(s, d).select("img_id", "y", "x", y.cast("int").alias("luma"), u.cast("int").alias("u"), v.cast("int").alias("v"))


@query("rgb_to_nv12_chroma", f"""WITH {RGB}, k AS (SELECT img_id, y, x, {_sat_sql(f'CAST(0.564 AS DOUBLE) * (c0 - {_Y}) + 128')} AS u, {_sat_sql(f'CAST(0.713 AS DOUBLE) * (c2 - {_Y}) + 128')} AS v FROM px)
    SELECT img_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(round_even(avg(u), 0) AS INT) AS u, CAST(round_even(avg(v), 0) AS INT) AS v FROM k GROUP BY 1, 2, 3""")
def _(s, d):
    _, u, v = K.rgb_to_yuv(F.col("c2"), F.col("c1"), F.col("c0"))
    return K.subsample(pixels(s, d).select("img_id", "y", "x", u.alias("u"), v.alias("v")), "u", "v")


_P = lambda dy, dx: f"max(CASE WHEN dy = {dy} AND dx = {dx} THEN v END)"


def _bayer_sql(by: int, bx: int) -> str:
    row, col = f"y % 2 = {by}", f"x % 2 = {bx}"
    return f"""WITH {Q}, {around_sql(3, 'REFLECT_101')}, k AS (SELECT img_id, y, x, {_P(0, 0)} AS o, ({_P(0, -1)} + {_P(0, 1)} + 1) >> 1 AS h, ({_P(-1, 0)} + {_P(1, 0)} + 1) >> 1 AS vv, ({_P(-1, -1)} + {_P(-1, 1)} + {_P(1, -1)} + {_P(1, 1)} + 2) >> 2 AS dd,
    ({_P(-1, 0)} + {_P(1, 0)} + {_P(0, -1)} + {_P(0, 1)} + 2) >> 2 AS p FROM nb GROUP BY 1, 2, 3)
    SELECT img_id, y, x, CASE WHEN {row} AND {col} THEN o WHEN {row} THEN h WHEN {col} THEN vv ELSE dd END AS b, CASE WHEN ({row}) = ({col}) THEN p ELSE o END AS g, CASE WHEN NOT ({row}) AND NOT ({col}) THEN o WHEN NOT ({row}) THEN h WHEN NOT ({col}) THEN vv ELSE dd END AS r FROM k"""


for _tile, _at in K.BLUE.items():

    @query("bayer_to_bgr" if _tile == "BG" else f"bayer_{_tile.lower()}_to_bgr", _bayer_sql(*_at))
    def _(s, d, tile=_tile):
        return K.bayer(u8(s, d), tile)


_ON = "CASE WHEN v > 140 THEN 1 ELSE 0 END"


def _mask(s, d, t=140):
    return u8(s, d).withColumn("v", F.when(F.col("v") > t, 1).otherwise(0))


for _n in (4, 8):
    _near = "abs(b.y - a.y) + abs(b.x - a.x) = 1" if _n == 4 else "greatest(abs(b.y - a.y), abs(b.x - a.x)) = 1"

    @query(f"connected_components_{_n}", f"""WITH RECURSIVE {Q}, m AS (SELECT img_id, y, x, CAST(y AS BIGINT) * 2147483648 + x AS id FROM q WHERE v > 140), e AS (SELECT a.img_id, a.id AS p, b.id AS n FROM m a JOIN m b ON b.img_id = a.img_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND {_near}),
        r(img_id, id, label) AS (SELECT img_id, id, id FROM m UNION SELECT r.img_id, e.n, r.label FROM r JOIN e ON e.img_id = r.img_id AND e.p = r.id WHERE r.label < e.n)
        SELECT m.img_id, m.y, m.x, min(r.label) AS label FROM m JOIN r USING (img_id, id) GROUP BY 1, 2, 3""")
    def _(s, d, n=_n):
        return M.label_components(_mask(s, d), n, writer(s, "labels"))


@query("boundary", f"""WITH {Q}, m AS (SELECT img_id, y, x FROM q WHERE v > 140) SELECT img_id, y, x FROM m o WHERE (SELECT count(*) FROM m s WHERE s.img_id = o.img_id AND abs(s.y - o.y) + abs(s.x - o.x) = 1) < 4""")
def _(s, d):
    return M.boundary(_mask(s, d))


@query("hough_lines", f"""WITH {Q}, e AS (SELECT img_id, CAST(round_even(round(x * cos(k * {math.pi / 45!r}) + y * sin(k * {math.pi / 45!r}), 6), 0) AS INT) AS rho, CAST(k AS INT) AS theta FROM q CROSS JOIN (SELECT unnest(range(0, 45)) AS k) WHERE v > 150),
    n AS (SELECT img_id, rho, theta, count(*) AS votes FROM e GROUP BY 1, 2, 3) SELECT a.img_id, a.rho, a.theta, a.votes FROM n a LEFT JOIN n b ON b.img_id = a.img_id AND abs(b.rho - a.rho) + abs(b.theta - a.theta) = 1 AND b.votes > a.votes WHERE a.votes >= 12 AND b.votes IS NULL""")
def _(s, d):
    return M.hough_lines(u8(s, d).withColumn("v", F.when(F.col("v") > 150, 1).otherwise(0)), 45, 12)


@query("canny")
def _(s, d):
    return M.canny(u8(s, d), 60.0, 140.0, writer(s, "canny"))
