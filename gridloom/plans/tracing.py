"""Queries of stored colour layouts, segments, circles, words in grids and contours."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.operators import color as K
from gridloom.operators import label as M
from gridloom.operators import tracing as P
from gridloom.plans.arrays import RGB
from gridloom.plans.images import _kernel_sql, _sobel
from gridloom.plans.registry import Q, around_sql, query, u8
from gridloom.plans.transforms import _Y, _sat_sql, pixels
from gridloom.sources.shared import writer

_H = _W = 32
_N = (_H // 2) * (_W // 2)
_PLANE = f"(({{}}) + (l.y // 2) * {_W // 2} + l.x // 2)"


def _flat(k: str) -> tuple[str, str]:
    return f"{_H} + ({k}) // {_W}", f"({k}) % {_W}"


#: Where a pixel's luma, u and v are stored: (y, x) of each.
_PLACES = {
    "NV12": (("l.y", "l.x"), (f"{_H} + l.y // 2", "l.x // 2 * 2"), (f"{_H} + l.y // 2", "l.x // 2 * 2 + 1")),
    "NV21": (("l.y", "l.x"), (f"{_H} + l.y // 2", "l.x // 2 * 2 + 1"), (f"{_H} + l.y // 2", "l.x // 2 * 2")),
    "YU12": (("l.y", "l.x"), _flat(_PLANE.format(0)), _flat(_PLANE.format(_N))),
    "YV12": (("l.y", "l.x"), _flat(_PLANE.format(_N)), _flat(_PLANE.format(0))),
    "YUYV": (("l.y", "l.x * 2"), ("l.y", "l.x // 2 * 4 + 1"), ("l.y", "l.x // 2 * 4 + 3")),
    "YVYU": (("l.y", "l.x * 2"), ("l.y", "l.x // 2 * 4 + 3"), ("l.y", "l.x // 2 * 4 + 1")),
    "UYVY": (("l.y", "l.x * 2 + 1"), ("l.y", "l.x // 2 * 4"), ("l.y", "l.x // 2 * 4 + 2")),
}
_GRID = f"l AS (SELECT img_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT *, unnest(range(0, {_W})) AS x FROM (SELECT *, unnest(range(0, {_H})) AS y FROM (SELECT DISTINCT img_id FROM q))))"

for _layout, _p in _PLACES.items():
    _joins = " ".join(f"JOIN q {n} ON {n}.img_id = l.img_id AND {n}.y = {y} AND {n}.x = {x}" for n, (y, x) in zip("abd", _p))

    @query(f"split_{_layout.lower()}", f"WITH {Q}, {_GRID} SELECT l.img_id, l.y, l.x, a.v AS luma, b.v AS u, d.v AS v FROM l {_joins}")
    def _(s, d, layout=_layout):
        return K.split_yuv(u8(s, d), layout, _H, _W)


_FH, _FW = 32, 20
_FN = (_FH // 2) * (_FW // 2)


def _stored_sql(layout: str) -> str:
    one, two = ("u", "v") if layout in ("NV12", "YU12") else ("v", "u")
    if layout in ("NV12", "NV21"):
        places = [(f"{_FH} + y", "2 * x", one), (f"{_FH} + y", "2 * x + 1", two)]
    else:
        places = [(f"{_FH} + (y * {_FW // 2} + x + {o}) // {_FW}", f"(y * {_FW // 2} + x + {o}) % {_FW}", v) for o, v in ((0, one), (_FN, two))]
    chroma = " ".join(f"UNION ALL SELECT img_id, {y} AS y, {x} AS x, 0 AS c, {v} AS v FROM m" for y, x, v in places)
    return f"""WITH {RGB}, k AS (SELECT img_id, y, x, {_sat_sql(_Y)} AS l, {_sat_sql(f'CAST(0.564 AS DOUBLE) * (c0 - {_Y}) + 128')} AS u, {_sat_sql(f'CAST(0.713 AS DOUBLE) * (c2 - {_Y}) + 128')} AS v FROM px WHERE y < {_FH} AND x < {_FW}),
        m AS (SELECT img_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, CAST(round_even(avg(u), 0) AS INT) AS u, CAST(round_even(avg(v), 0) AS INT) AS v FROM k GROUP BY 1, 2, 3)
        SELECT img_id, y, x, 0 AS c, l AS v FROM k {chroma}"""


for _layout in ("NV12", "NV21", "YU12", "YV12"):

    @query(f"rgb_to_{_layout.lower()}", _stored_sql(_layout))
    def _(s, d, layout=_layout):
        y, u, v = K.rgb_to_yuv(F.col("c2"), F.col("c1"), F.col("c0"))
        px = pixels(s, d).select("img_id", "y", "x", y.cast("int").alias("luma"), u.cast("int").alias("u"), v.cast("int").alias("v"))
        return K.store_yuv(px, layout, _FH, _FW)


def _ten_sql(e: str) -> str:
    return f"CAST(least(greatest(round_even({e}, 0), 0), 1023) * 64 AS INT)"


def _weigh_sql(r: float, g: float, b: float) -> str:
    return f"CAST({r} AS DOUBLE) * (4 * c2) + CAST({g} AS DOUBLE) * (4 * c1) + CAST({b} AS DOUBLE) * (4 * c0)"


@query("rgb_to_p010", f"WITH {RGB} SELECT img_id, y, x, {_ten_sql(_weigh_sql(0.299, 0.587, 0.114))} AS luma, {_ten_sql(_weigh_sql(-0.1687, -0.3313, 0.5) + ' + 512')} AS u, {_ten_sql(_weigh_sql(0.5, -0.4187, -0.0813) + ' + 512')} AS v FROM px")
def _(s, d):
    y, u, v = K.rgb_to_p010(*(F.col(c) * 4 for c in ("c2", "c1", "c0")))
    return pixels(s, d).select("img_id", "y", "x", y.alias("luma"), u.alias("u"), v.alias("v"))


_A = f"{math.pi / 45!r}"


@query("hough_segments", f"""WITH {Q}, e AS (SELECT img_id, y, x, CAST(round_even(round(x * cos(k * {_A}) + y * sin(k * {_A}), 6), 0) AS INT) AS rho, CAST(k AS INT) AS theta, round(y * cos(k * {_A}) - x * sin(k * {_A}), 6) AS s FROM q CROSS JOIN (SELECT unnest(range(0, 45)) AS k) WHERE v > 150),
    n AS (SELECT img_id, rho, theta, count(*) AS votes FROM e GROUP BY 1, 2, 3), p AS (SELECT a.img_id, a.rho, a.theta FROM n a LEFT JOIN n b ON b.img_id = a.img_id AND abs(b.rho - a.rho) + abs(b.theta - a.theta) = 1 AND b.votes > a.votes WHERE a.votes >= 12 AND b.votes IS NULL),
    o AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY img_id, rho, theta ORDER BY s, y, x) > 3.5 THEN 1 ELSE 0 END AS cut FROM e JOIN p USING (img_id, rho, theta)),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY img_id, rho, theta ORDER BY s, y, x ROWS UNBOUNDED PRECEDING) AS part FROM o)
    SELECT img_id, rho, theta, count(*) AS n, first(y ORDER BY s, y, x) AS y1, first(x ORDER BY s, y, x) AS x1, last(y ORDER BY s, y, x) AS y2, last(x ORDER BY s, y, x) AS x2 FROM g GROUP BY img_id, rho, theta, part HAVING max(s) - min(s) >= 8.0""")
def _(s, d):
    return M.hough_segments(u8(s, d).withColumn("v", F.when(F.col("v") > 150, 1).otherwise(0)), 45, 12, 8.0, 3.5)


@query("hough_circles", f"""WITH {Q}, {around_sql(3, 'REPLICATE')}, sb AS (SELECT img_id, y, x, sum(v * {_kernel_sql(_sobel(1, 0))}) AS dx, sum(v * {_kernel_sql(_sobel(0, 1))}) AS dy FROM nb GROUP BY 1, 2, 3), m AS (SELECT *, sqrt(dx * dx + dy * dy) AS m FROM sb),
    k AS (SELECT unnest([-6, -5, -4, -3, 3, 4, 5, 6]) AS k), r AS (SELECT img_id, CAST(floor(y + k * dy / m + 0.5) AS INT) AS y, CAST(floor(x + k * dx / m + 0.5) AS INT) AS x, CAST(abs(k) AS INT) AS radius, count(*) AS n FROM m CROSS JOIN k WHERE m >= 80 GROUP BY 1, 2, 3, 4),
    a AS (SELECT img_id, y, x, CAST(sum(n) AS BIGINT) AS votes, first(radius ORDER BY n DESC, radius) AS radius FROM r GROUP BY 1, 2, 3)
    SELECT a.img_id, a.y, a.x, a.radius, a.votes FROM a LEFT JOIN a b ON b.img_id = a.img_id AND abs(b.y - a.y) + abs(b.x - a.x) = 1 AND b.votes > a.votes WHERE a.votes >= 8 AND b.votes IS NULL""")
def _(s, d):
    return M.hough_circles(u8(s, d), 80.0, 3, 6, 8)


@query("word_search", f"""WITH RECURSIVE {Q}, l AS (SELECT img_id, y, x, substr('abcd', v % 4 + 1, 1) AS letter FROM q), p(img_id, y0, x0, y, x, n, used) AS (SELECT img_id, y, x, y, x, 1, [y * 65536 + x] FROM l WHERE letter = 'a'
    UNION ALL SELECT p.img_id, p.y0, p.x0, l.y, l.x, p.n + 1, list_append(p.used, l.y * 65536 + l.x) FROM p JOIN l ON l.img_id = p.img_id AND abs(l.y - p.y) + abs(l.x - p.x) = 1 AND l.letter = substr('abaca', p.n + 1, 1) WHERE p.n < 5 AND NOT list_contains(p.used, l.y * 65536 + l.x))
    SELECT DISTINCT img_id, y0 AS y, x0 AS x FROM p WHERE n = 5""")
def _(s, d):
    q = u8(s, d)
    letters = q.select("img_id", "y", "x", F.substring(F.lit("abcd"), F.col("v") % 4 + 1, F.lit(1)).alias("letter"))
    return P.word_search(letters, "abaca")


for _simple in (False, True):

    @query(f"contours{'_simple' if _simple else ''}")
    def _(s, d, simple=_simple):
        return P.contours(u8(s, d).withColumn("v", F.when(F.col("v") > 140, 1).otherwise(0)), writer(s, "contours"), simple)
