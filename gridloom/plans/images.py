"""Queries over images: re-indexing, resampling, neighbourhood filters, corners."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import geometry as G
from gridloom.operators import neighbour as B
from gridloom.operators.elementwise import threshold
from gridloom.operators.cells import shape
from gridloom.plans.arrays import PAIR, pair
from gridloom.plans.registry import DIM, Q, around_sql, border_sql, query, real, u8

KEY = ["img_id", "y", "x", "c"]
QD = f"{Q}, {DIM}"


def _v(df, digits: int | None = None):
    v = F.col("v")
    return df.select(*KEY, (v if digits is None else F.round(v, digits)).alias("v"))


for _how, _y, _x in (("HORIZONTAL", "y", "w - 1 - x"), ("VERTICAL", "h - 1 - y", "x"), ("BOTH", "h - 1 - y", "w - 1 - x")):

    @query(f"flip_{_how.lower()}", f"WITH {QD} SELECT img_id, {_y} AS y, {_x} AS x, c, v FROM q JOIN dim USING (img_id)")
    def _(s, d, how=_how):
        return G.flip(u8(s, d), how)


for _a, _y, _x in ((90, "x", "h - 1 - y"), (180, "h - 1 - y", "w - 1 - x"), (270, "w - 1 - x", "y")):

    @query(f"rotate_{_a}", f"WITH {QD} SELECT img_id, {_y} AS y, {_x} AS x, c, v FROM q JOIN dim USING (img_id)")
    def _(s, d, a=_a):
        return G.rotate(u8(s, d), a)


@query("transpose", f"WITH {Q} SELECT img_id, x AS y, y AS x, c, v FROM q")
def _(s, d):
    return G.transpose(u8(s, d))


for _b in ("CONSTANT", "REPLICATE", "REFLECT_101"):

    @query(f"make_border_{_b.lower()}", f"""WITH {QD}, g AS (SELECT img_id, h, w, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT *, unnest(range(0, w + 7)) AS x FROM (SELECT *, unnest(range(0, h + 3)) AS y FROM dim)))
        SELECT g.img_id, g.y, g.x, 0 AS c, coalesce(q.v, 9) AS v FROM g LEFT JOIN q ON q.img_id = g.img_id AND q.y = {border_sql('g.y - 2', 'h', _b)} AND q.x = {border_sql('g.x - 4', 'w', _b)}""")
    def _(s, d, b=_b):
        return G.make_border(u8(s, d), 2, 1, 4, 3, b, 9)


def _grid_sql(oh: int, ow: int) -> str:
    return f"g AS (SELECT img_id, h, w, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT *, unnest(range(0, {ow})) AS x FROM (SELECT *, unnest(range(0, {oh})) AS y FROM dim)))"


@query("resize_nearest", f"WITH {QD}, {_grid_sql(40, 100)} SELECT g.img_id, g.y, g.x, c, v FROM g JOIN q ON q.img_id = g.img_id AND q.y = least(CAST(floor(g.y * (CAST(h AS DOUBLE) / 40)) AS INT), h - 1) AND q.x = least(CAST(floor(g.x * (CAST(w AS DOUBLE) / 100)) AS INT), w - 1)")
def _(s, d):
    return G.resize_nearest(u8(s, d), 40, 100)


def _tap_sql(oh: int, ow: int, taps: list[int], weight, digits: int = 6) -> str:
    fy, fx = f"((g.y + 0.5) * h / {oh} - 0.5)", f"((g.x + 0.5) * w / {ow} - 0.5)"
    lst = ", ".join(f"({t})" for t in taps)
    return f"""WITH {QD}, {_grid_sql(oh, ow)}, f AS (SELECT *, {fy} AS fy, {fx} AS fx FROM g), t(k) AS (VALUES {lst}),
        e AS (SELECT f.*, least(greatest(CAST(floor(fy) AS INT) + a.k, 0), h - 1) AS sy, least(greatest(CAST(floor(fx) AS INT) + b.k, 0), w - 1) AS sx, ({weight('fy - floor(fy)', 'a.k')}) * ({weight('fx - floor(fx)', 'b.k')}) AS k FROM f CROSS JOIN t a CROSS JOIN t b)
        SELECT e.img_id, e.y, e.x, q.c, round(sum(q.v * e.k), {digits}) AS v FROM e JOIN q ON q.img_id = e.img_id AND q.y = e.sy AND q.x = e.sx GROUP BY 1, 2, 3, 4"""


def _cubic_sql(d: str, k: str) -> str:
    a = f"abs({d} - {k})"
    return f"CASE WHEN {a} <= 1 THEN 1 - 2.25 * {a} * {a} + 1.25 * {a} * {a} * {a} WHEN {a} < 2 THEN 3 - 6 * {a} + 3.75 * {a} * {a} - 0.75 * {a} * {a} * {a} ELSE 0 END"


@query("resize_linear", _tap_sql(40, 100, [0, 1], lambda d, k: f"CASE WHEN {k} = 0 THEN 1 - ({d}) ELSE {d} END"))
def _(s, d):
    return _v(G.resize_linear(u8(s, d), 40, 100), 6)


@query("resize_cubic", _tap_sql(44, 92, [-1, 0, 1, 2], _cubic_sql, 4))
def _(s, d):
    return _v(G.resize_cubic(u8(s, d), 44, 92), 4)


@query("resize_area", f"WITH {Q} SELECT img_id, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, c, round(avg(v), 6) AS v FROM q GROUP BY 1, 2, 3, 4")
def _(s, d):
    return _v(G.resize_area(u8(s, d), 4), 6)


def _remap_sql(my: str, mx: str) -> str:
    return f"""p AS (SELECT g.*, floor(round_even(({my}) * 32, 0) / 32) AS iy, floor(round_even(({mx}) * 32, 0) / 32) AS ix, round_even(({my}) * 32, 0) / 32 - floor(round_even(({my}) * 32, 0) / 32) AS dy, round_even(({mx}) * 32, 0) / 32 - floor(round_even(({mx}) * 32, 0) / 32) AS dx FROM g),
        e AS (SELECT p.*, a, b, (CASE WHEN a = 1 THEN dy ELSE 1 - dy END) * (CASE WHEN b = 1 THEN dx ELSE 1 - dx END) AS k FROM p CROSS JOIN (VALUES (0), (1)) t1(a) CROSS JOIN (VALUES (0), (1)) t2(b))
        SELECT e.img_id, e.y, e.x, 0 AS c, round(sum(coalesce(q.v, 0) * k), 6) AS v FROM e LEFT JOIN q ON q.img_id = e.img_id AND q.y = iy + a AND q.x = ix + b GROUP BY 1, 2, 3"""


@query("remap_linear", f"WITH {QD}, {_grid_sql(32, 32)}, {_remap_sql('1.37 * y + 0.21 * x', '1.9 * x - 0.3 * y')}")
def _(s, d):
    q = u8(s, d)
    g = G.grid(shape(q).join(G.channels(q), "img_id"), F.lit(32), F.lit(32))
    return _v(G.remap_linear(g.withColumn("my", F.lit(1.37) * F.col("y") + F.lit(0.21) * F.col("x")).withColumn("mx", F.lit(1.9) * F.col("x") - F.lit(0.3) * F.col("y")), q), 6)


_FULL = "g AS (SELECT img_id, h, w, y, x FROM q JOIN dim USING (img_id))"


@query("warp_affine", f"WITH {QD}, {_FULL}, {_remap_sql('CAST(-0.17 AS DOUBLE) * x + CAST(0.93 AS DOUBLE) * y + CAST(5.5 AS DOUBLE)', 'CAST(0.9 AS DOUBLE) * x + CAST(0.2 AS DOUBLE) * y + CAST(-3.25 AS DOUBLE)')}")
def _(s, d):
    return _v(G.warp(u8(s, d), [[0.9, 0.2, -3.25], [-0.17, 0.93, 5.5]]), 6)


_D = "(CAST(0.002 AS DOUBLE) * x + CAST(0.001 AS DOUBLE) * y + CAST(1 AS DOUBLE))"


@query("warp_perspective", f"WITH {QD}, {_FULL}, {_remap_sql(f'(CAST(-0.17 AS DOUBLE) * x + CAST(0.93 AS DOUBLE) * y + CAST(5.5 AS DOUBLE)) / {_D}', f'(CAST(0.9 AS DOUBLE) * x + CAST(0.2 AS DOUBLE) * y + CAST(1.25 AS DOUBLE)) / {_D}')}")
def _(s, d):
    return _v(G.warp(u8(s, d), [[0.9, 0.2, 1.25], [-0.17, 0.93, 5.5], [0.002, 0.001, 1.0]]), 6)


@query("crop", f"WITH {Q} SELECT img_id, y - 10 AS y, x - 20 AS x, c, v FROM q WHERE y >= 10 AND y < 40 AND x >= 20 AND x < 60")
def _(s, d):
    return G.crop(u8(s, d), 10, 20, 30, 40)


@query("strided_slice", f"WITH {Q} SELECT img_id, CAST((y - 1) // 3 AS INT) AS y, CAST((x - 2) // 3 AS INT) AS x, c, v FROM q WHERE y >= 1 AND y < 50 AND x >= 2 AND x < 62 AND (y - 1) % 3 = 0 AND (x - 2) % 3 = 0")
def _(s, d):
    return G.crop(u8(s, d), 1, 2, 49, 60, 3)


@query("pad_to_square", f"""WITH {QD}, m AS (SELECT *, greatest(h, w) AS n FROM dim), g AS (SELECT img_id, h, w, n, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT *, unnest(range(0, n)) AS x FROM (SELECT *, unnest(range(0, n)) AS y FROM m)))
    SELECT g.img_id, g.y, g.x, 0 AS c, coalesce(q.v, 114) AS v FROM g LEFT JOIN q ON q.img_id = g.img_id AND q.y = g.y - (n - h) // 2 AND q.x = g.x - (n - w) // 2""")
def _(s, d):
    q = u8(s, d)
    n = F.greatest("h", "w")
    g = G.grid(shape(q).join(G.channels(q), "img_id"), n, n)
    g = g.withColumn("sy", (F.col("y") - F.floor((n - F.col("h")) / 2)).cast("int")).withColumn("sx", (F.col("x") - F.floor((n - F.col("w")) / 2)).cast("int"))
    return G.gather(g, q).withColumn("v", F.coalesce("v", F.lit(114)))


@query("spiral", f"""WITH {QD}, a AS (SELECT *, least(y, x, h - 1 - y, w - 1 - x) AS r FROM q JOIN dim USING (img_id)), b AS (SELECT *, h - 2 * r AS ih, w - 2 * r AS iw, y - r AS ry, x - r AS rx FROM a)
    SELECT img_id, h * w - ih * iw + CASE WHEN ry = 0 THEN rx WHEN rx = iw - 1 THEN iw - 1 + ry WHEN ry = ih - 1 THEN iw + ih - 2 + iw - 1 - rx ELSE 2 * iw + ih - 3 + ih - 1 - ry END AS pos, v FROM b""")
def _(s, d):
    return G.spiral(u8(s, d))


@query("rotate_1d", f"WITH {Q} SELECT img_id, y, CAST((x + 5) % 64 AS INT) AS x, v FROM q")
def _(s, d):
    return u8(s, d).select("img_id", "y", F.pmod(F.col("x") + 5, F.lit(64)).alias("x"), "v")


def _nb(k: int, border: str, value: str, more: str = "") -> str:
    return f"WITH {Q}, {around_sql(k, border)} SELECT img_id, y, x, c, {value} AS v FROM nb GROUP BY 1, 2, 3, 4{more}"


@query("box_filter", _nb(3, "REFLECT_101", "CAST(sum(v) // 9 AS INT)"))
def _(s, d):
    return B.box(u8(s, d), 3, "REFLECT_101")


def _kernel_sql(kernel: list[list[float]]) -> str:
    r = len(kernel) // 2
    return "CASE " + " ".join(f"WHEN dy = {a - r} AND dx = {b - r} THEN CAST({kernel[a][b]!r} AS DOUBLE)" for a in range(len(kernel)) for b in range(len(kernel))) + " END"


def _sat_sql(e: str) -> str:
    return f"CAST(least(greatest(round_even({e}, 0), 0), 255) AS INT)"


_W5 = B.gauss_kernel(5, 0)


@query("gaussian_5", _nb(5, "REPLICATE", _sat_sql(f"sum(v * {_kernel_sql([[a * b for b in _W5] for a in _W5])})")))
def _(s, d):
    return B.gaussian(u8(s, d), 5, 0, "REPLICATE", "U8")


_W3 = B.gauss_kernel(3, 1.1)


@query("gaussian_sigma", _nb(3, "CONSTANT", f"round(sum(v * {_kernel_sql([[a * b for b in _W3] for a in _W3])}), 6)"))
def _(s, d):
    return _v(B.gaussian(u8(s, d), 3, 1.1, "CONSTANT"), 6)


_K = [[0.5, -1.0, 0.25], [2.0, 0.0, -2.0], [0.125, 1.0, 0.5]]


@query("filter2d", _nb(3, "REFLECT_101", _sat_sql(f"sum(v * {_kernel_sql(_K)})")))
def _(s, d):
    return B.filter2d(u8(s, d), _K, "REFLECT_101", "U8")


def _sobel(dx: int, dy: int) -> list[list[float]]:
    return B.sobel_kernel(dx, dy)


@query("sobel", _nb(3, "REPLICATE", f"round(sum(v * {_kernel_sql(_sobel(1, 0))}), 6)"))
def _(s, d):
    return _v(B.sobel(u8(s, d), 1, 0, "REPLICATE"), 6)


_LAP = [[a + b for a, b in zip(u, v)] for u, v in zip(_sobel(2, 0), _sobel(0, 2))]


@query("laplacian", _nb(3, "REFLECT_101", f"round(sum(v * {_kernel_sql(_LAP)}), 6)"))
def _(s, d):
    return _v(B.laplacian(u8(s, d), "REFLECT_101"), 6)


@query("isolated_points", f"WITH {Q}, {around_sql(3, 'REPLICATE')}, f AS (SELECT img_id, y, x, c, sum(v * {_kernel_sql([[-1.0] * 3, [-1.0, 8.0, -1.0], [-1.0] * 3])}) AS r FROM nb GROUP BY 1, 2, 3, 4) SELECT img_id, y, x, c, CASE WHEN abs(r) > 400 THEN 255 ELSE 0 END AS v FROM f")
def _(s, d):
    r = B.filter2d(u8(s, d), [[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]], "REPLICATE")
    return r.select(*KEY, threshold(F.abs("v"), 400, 255, "BINARY").alias("v"))


@query("median_filter", _nb(3, "REPLICATE", "CAST(median(v) AS INT)"))
def _(s, d):
    return B.median(u8(s, d), 3)


@query("bilateral", f"""WITH {Q}, {around_sql(5, 'REFLECT_101')}, z AS (SELECT n.*, o.v AS o FROM nb n JOIN q o USING (img_id, y, x, c) WHERE n.dy * n.dy + n.dx * n.dx <= 4),
    k AS (SELECT *, exp((v - o) * (v - o) * (-0.5 / 900.0)) * exp(-0.5 * (dy * dy + dx * dx) / 6.25) AS k FROM z) SELECT img_id, y, x, c, round(sum(k * v) / sum(k), 6) AS v FROM k GROUP BY 1, 2, 3, 4""")
def _(s, d):
    return _v(B.bilateral(u8(s, d), 5, 30.0, 2.5, "REFLECT_101"), 6)


@query("guided_filter", f"""WITH {PAIR}, dim AS (SELECT img_id, max(y) + 1 AS h, max(x) + 1 AS w FROM p GROUP BY 1), o AS (SELECT unnest(range(-1, 2)) AS k),
    g AS (SELECT p.img_id, p.y, p.x, s.a, s.b FROM p JOIN dim USING (img_id) CROSS JOIN o u CROSS JOIN o v JOIN p s ON s.img_id = p.img_id AND s.y = {border_sql('p.y + u.k', 'h', 'REPLICATE')} AND s.x = {border_sql('p.x + v.k', 'w', 'REPLICATE')}),
    m AS (SELECT img_id, y, x, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS maa, avg(a * b) AS mab FROM g GROUP BY 1, 2, 3),
    l AS (SELECT img_id, y, x, (mab - ma * mb) / (maa - ma * ma + 100) AS k, mb - (mab - ma * mb) / (maa - ma * ma + 100) * ma AS o FROM m),
    n AS (SELECT l.img_id, l.y, l.x, avg(s.k) AS k, avg(s.o) AS o FROM l JOIN dim USING (img_id) CROSS JOIN o u CROSS JOIN o v JOIN l s ON s.img_id = l.img_id AND s.y = {border_sql('l.y + u.k', 'h', 'REPLICATE')} AND s.x = {border_sql('l.x + v.k', 'w', 'REPLICATE')} GROUP BY 1, 2, 3)
    SELECT p.img_id, p.y, p.x, p.c, round(n.k * p.a + n.o, 5) AS v FROM p JOIN n USING (img_id, y, x)""")
def _(s, d):
    return _v(B.guided(pair(s, d), 3, 100.0, "REPLICATE"), 5)


def _morph_sql(k: int, cond: str, agg: str, src: str) -> str:
    r = k // 2
    return f"""SELECT o.img_id, o.y, o.x, o.c, {agg}(s.v) AS v FROM {src} o CROSS JOIN (SELECT unnest(range(-{r}, {r + 1})) AS dy) a CROSS JOIN (SELECT unnest(range(-{r}, {r + 1})) AS dx) b
        JOIN {src} s ON s.img_id = o.img_id AND s.c = o.c AND s.y = o.y + dy AND s.x = o.x + dx WHERE {cond} GROUP BY 1, 2, 3, 4"""


_SHAPES = {"RECT": "true", "CROSS": "(dy = 0 OR dx = 0)", "ELLIPSE": " OR ".join(f"(dy = {a} AND dx = {b})" for a, b in B.element("ELLIPSE", 5))}
for _s in ("RECT", "CROSS", "ELLIPSE"):
    for _m, _f in (("erode", "min"), ("dilate", "max")):

        @query(f"{_m}_{_s.lower()}", f"WITH {Q} {_morph_sql(5, f'({_SHAPES[_s]})', _f, 'q')}")
        def _(s, d, m=_m, sh=_s):
            return B.morph(u8(s, d), m, 5, sh)


_E1, _D1 = (f"{n} AS ({_morph_sql(3, 'true', f, 'q')})" for n, f in (("e1", "min"), ("d1", "max")))
_DIFF = "SELECT a.img_id, a.y, a.x, a.c, a.v - b.v AS v FROM {} a JOIN {} b USING (img_id, y, x, c)"
_OPEN, _CLOSE = f"oo AS ({_morph_sql(3, 'true', 'max', 'e1')})", f"cc AS ({_morph_sql(3, 'true', 'min', 'd1')})"
for _m, _q in (
    ("open", f"WITH {Q}, {_E1}, {_OPEN} SELECT * FROM oo"), ("close", f"WITH {Q}, {_D1}, {_CLOSE} SELECT * FROM cc"), ("gradient", f"WITH {Q}, {_E1}, {_D1} {_DIFF.format('d1', 'e1')}"),
    ("tophat", f"WITH {Q}, {_E1}, {_OPEN} {_DIFF.format('q', 'oo')}"), ("blackhat", f"WITH {Q}, {_D1}, {_CLOSE} {_DIFF.format('cc', 'q')}"),
):

    @query(f"morph_{_m}", _q)
    def _(s, d, m=_m):
        return B.morph(u8(s, d), m, 3)


@query("pyr_down", f"WITH {Q}, {around_sql(5, 'REFLECT_101')}, f AS (SELECT img_id, y, x, c, {_sat_sql(f'sum(v * {_kernel_sql([[a * b for b in _W5] for a in _W5])})')} AS v FROM nb GROUP BY 1, 2, 3, 4) SELECT img_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, c, v FROM f WHERE y % 2 = 0 AND x % 2 = 0")
def _(s, d):
    return B.pyr_down(u8(s, d), "REFLECT_101")


@query("pyr_up", f"""WITH {Q}, {around_sql(3, 'REPLICATE')}, t(ph, o, k) AS (VALUES (0, -1, 0.125), (0, 0, 0.75), (0, 1, 0.125), (1, 0, 0.5), (1, 1, 0.5))
    SELECT img_id, y * 2 + a.ph AS y, x * 2 + b.ph AS x, c, {_sat_sql('sum(v * CAST(a.k AS DOUBLE) * CAST(b.k AS DOUBLE))')} AS v FROM nb JOIN t a ON a.o = dy JOIN t b ON b.o = dx GROUP BY 1, 2, 3, 4""")
def _(s, d):
    return B.pyr_up(u8(s, d), "REPLICATE")


@query("adaptive_threshold", f"WITH {Q}, {around_sql(5, 'REPLICATE')}, m AS (SELECT img_id, y, x, c, round_even(sum(v) / 25.0, 0) AS m FROM nb GROUP BY 1, 2, 3, 4) SELECT img_id, y, x, c, CASE WHEN q.v > m - 3 THEN 255 ELSE 0 END AS v FROM q JOIN m USING (img_id, y, x, c)")
def _(s, d):
    return B.adaptive_threshold(u8(s, d), 255, 5, 2.5)


_TENSOR = f"""{Q}, {around_sql(3, 'REPLICATE')}, sb AS (SELECT img_id, y, x, c, sum(v * {_kernel_sql(_sobel(1, 0))}) AS dx, sum(v * {_kernel_sql(_sobel(0, 1))}) AS dy FROM nb GROUP BY 1, 2, 3, 4), o AS (SELECT unnest(range(-1, 2)) AS k),
    tn AS (SELECT p.img_id, p.y, p.x, sum(s.dx * s.dx) / 9.0 AS a, sum(s.dx * s.dy) / 9.0 AS b, sum(s.dy * s.dy) / 9.0 AS d FROM sb p JOIN dim USING (img_id) CROSS JOIN o u CROSS JOIN o v
    JOIN sb s ON s.img_id = p.img_id AND s.y = {border_sql('p.y + u.k', 'h', 'REPLICATE')} AND s.x = {border_sql('p.x + v.k', 'w', 'REPLICATE')} GROUP BY 1, 2, 3)"""


@query("harris", f"WITH {_TENSOR} SELECT img_id, y, x, round(a * d - b * b - 0.04 * (a + d) * (a + d), 2) AS v FROM tn")
def _(s, d):
    return B.harris(u8(s, d), 3, 0.04, "REPLICATE").select("img_id", "y", "x", F.round("v", 2).alias("v"))


@query("min_eigen", f"WITH {_TENSOR} SELECT img_id, y, x, round((a / 2 + d / 2) - sqrt((a / 2 - d / 2) * (a / 2 - d / 2) + b * b), 5) AS v FROM tn")
def _(s, d):
    return B.min_eigen(u8(s, d), 3, "REPLICATE").select("img_id", "y", "x", F.round("v", 5).alias("v"))


@query("good_features", f"""WITH {_TENSOR}, e AS (SELECT img_id, y, x, round((a / 2 + d / 2) - sqrt((a / 2 - d / 2) * (a / 2 - d / 2) + b * b), 3) AS v FROM tn), t AS (SELECT img_id, max(v) AS top FROM e GROUP BY 1),
    m AS (SELECT o.img_id, o.y, o.x, o.v, max(s.v) AS m FROM e o JOIN e s ON s.img_id = o.img_id AND abs(s.y - o.y) <= 1 AND abs(s.x - o.x) <= 1 GROUP BY 1, 2, 3, 4),
    r AS (SELECT m.*, row_number() OVER (PARTITION BY m.img_id ORDER BY m.v DESC, m.y, m.x) AS rank FROM m JOIN t USING (img_id) JOIN dim USING (img_id) WHERE m.v = m.m AND m.v >= 0.1 * top AND m.v > 0 AND y > 0 AND x > 0 AND y < h - 1 AND x < w - 1)
    SELECT img_id, CAST(rank AS INT) AS rank, y, x, v AS response FROM r WHERE rank <= 20""")
def _(s, d):
    e = B.min_eigen(u8(s, d), 3, "REPLICATE").withColumn("v", F.round("v", 3))
    return B.good_features(e, 0.1, 20)


_RING = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(B.RING))


@query("fast_corners", f"""WITH {QD}, r(i, dy, dx) AS (VALUES {_RING}), z AS (SELECT o.img_id, o.y, o.x, string_agg(CASE WHEN s.v > o.v + 12 THEN '1' ELSE '0' END, '' ORDER BY i) AS b, string_agg(CASE WHEN s.v < o.v - 12 THEN '1' ELSE '0' END, '' ORDER BY i) AS k
    FROM q o JOIN dim USING (img_id) CROSS JOIN r JOIN q s ON s.img_id = o.img_id AND s.y = o.y + r.dy AND s.x = o.x + r.dx WHERE o.y >= 3 AND o.x >= 3 AND o.y < h - 3 AND o.x < w - 3 GROUP BY 1, 2, 3)
    SELECT img_id, y, x FROM z WHERE contains(b || b, repeat('1', 9)) OR contains(k || k, repeat('1', 9))""")
def _(s, d):
    return B.fast_corners(u8(s, d), 12, 9)


def _features_sql(t: int, run: int, ring: int, most: int) -> str:
    at = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(B._circle(ring)))
    arc = f"list_transform(range({run}), lambda j: d[(k + j) % {ring} + 1])"
    return f"""WITH {QD}, r(i, dy, dx) AS (VALUES {at}), z AS (SELECT o.img_id, o.y, o.x, list(s.v - o.v ORDER BY i) AS d
    FROM q o JOIN dim USING (img_id) CROSS JOIN r JOIN q s ON s.img_id = o.img_id AND s.y = o.y + r.dy AND s.x = o.x + r.dx WHERE o.y >= 3 AND o.x >= 3 AND o.y < h - 3 AND o.x < w - 3 GROUP BY 1, 2, 3),
    f AS (SELECT img_id, y, x, CAST(greatest(list_max(list_transform(range({ring}), lambda k: list_min({arc}))), -list_min(list_transform(range({ring}), lambda k: list_max({arc})))) - 1 AS INT) AS score FROM z), c AS (SELECT * FROM f WHERE score >= {t}),
    m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.img_id = c.img_id AND abs(o.y - c.y) <= 1 AND abs(o.x - c.x) <= 1 AND (o.y <> c.y OR o.x <> c.x) AND o.score >= c.score)),
    k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY score DESC, y, x) AS k FROM m) SELECT img_id, y, x, score FROM k WHERE k <= {most}"""


@query("fast_features_9_16", _features_sql(12, 9, 16, 3000))
def _(s, d):
    return B.fast_features(u8(s, d), 12, 9, 16)


@query("fast_features_7_12", _features_sql(8, 7, 12, 3000))
def _(s, d):
    return B.fast_features(u8(s, d), 8, 7, 12)


@query("fast_features_5_8", _features_sql(5, 5, 8, 20))
def _(s, d):
    return B.fast_features(u8(s, d), 5, 5, 8, max_num=20)


_T = [[120, 130], [140, 110]]


@query("match_template", f"""WITH {QD}, t(a, b, k) AS (VALUES (0, 0, 120), (0, 1, 130), (1, 0, 140), (1, 1, 110)) SELECT o.img_id, o.y, o.x, o.c, CAST(sum((s.v - k) * (s.v - k)) AS INT) AS v FROM q o JOIN dim USING (img_id) CROSS JOIN t
    JOIN q s ON s.img_id = o.img_id AND s.y = o.y + a AND s.x = o.x + b WHERE o.y <= h - 2 AND o.x <= w - 2 GROUP BY 1, 2, 3, 4""")
def _(s, d):
    return B.match_template(u8(s, d), _T)
