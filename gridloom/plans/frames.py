"""Queries of comparing and scaling frames, larger kernels, fractional resizing, matrix filters, assignment and file sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import detect as D
from gridloom.operators import filters as L
from gridloom.operators import frames as X
from gridloom.operators import geometry as G
from gridloom.operators import match as M
from gridloom.operators import neighbour as B
from gridloom.operators.elementwise import split
from gridloom.plans.arrays import PAIR, RGB, pair, rgb
from gridloom.plans.images import QD, _kernel_sql, _nb, _tap_sql, _v
from gridloom.plans.matching import BOX, boxes
from gridloom.plans.ordered import ORD, events
from gridloom.plans.registry import CELLS, Q, around_sql, border_sql, query, real, table, u8
from gridloom.sources import files, rawarrays
from gridloom.sources.shared import shared_dir, written_tables


def _r(c: str, n: int):
    return F.round(c, n).alias(c)


# comparison of two frames ---------------------------------------------------------------------------------------------------------


@query("diff_cells", f"WITH {PAIR} SELECT img_id, y, x, a, b, CAST(abs(a - b) AS DOUBLE) AS diff FROM p WHERE abs(a - b) > 60")
def _(s, d):
    return X.diff_cells(pair(s, d), 60)


@query("diff_sample", f"""WITH {PAIR}, r AS (SELECT *, CAST(abs(a - b) AS DOUBLE) AS diff FROM p WHERE abs(a - b) > 60),
    k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY md5('7/' || img_id || '/' || y || '/' || x)) AS rank FROM r) SELECT img_id, CAST(rank AS INT) AS rank, y, x, a, b, diff FROM k WHERE rank <= 10""")
def _(s, d):
    return X.seeded_sample(X.diff_cells(pair(s, d), 60), "img_id", ["y", "x"], 10, 7)


@query("unit_scaled", f"WITH {CELLS} SELECT img_id, y, x, c, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-9), 9) AS v FROM cells WINDOW w AS (PARTITION BY img_id)")
def _(s, d):
    return _v(X.unit_scaled(real(s, d)), 9)


@query("train_test_split", "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('5/' || doc_id), 1, 8) AS BIGINT) % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM documents")
def _(s, d):
    return X.split_rows(table(s, d, "documents").select("doc_id"), "doc_id", 4, 5)


# scaling, layout and overlays -----------------------------------------------------------------------------------------------------

_MEAN, _STD = [123.675, 116.28, 103.53], [58.395, 57.12, 57.375]
_OF = "CASE c WHEN 0 THEN {0[0]} WHEN 1 THEN {0[1]} ELSE {0[2]} END"


@query("standardise", f"WITH {RGB} SELECT img_id, y, x, CAST(c AS INT) AS c, round((v - CAST({_OF.format(_MEAN)} AS DOUBLE)) / CAST({_OF.format(_STD)} AS DOUBLE), 9) AS v FROM rgb")
def _(s, d):
    return _v(X.standardised(rgb(s, d), _MEAN, _STD), 9)


@query("masked_min_max", f"""WITH {Q}, m AS (SELECT * FROM q WHERE (y + x) % 3 <> 0) SELECT img_id, min(v) AS min_v, arg_min(y, (v, y, x)) AS min_y, arg_min(x, (v, y, x)) AS min_x, max(v) AS max_v, arg_min(y, (-v, y, x)) AS max_y, arg_min(x, (-v, y, x)) AS max_x FROM m GROUP BY 1""")
def _(s, d):
    from gridloom.operators.reduce import min_max_loc

    return min_max_loc(u8(s, d).where((F.col("y") + F.col("x")) % 3 != 0))


@query("channel_spread", f"WITH {RGB} SELECT img_id, round((var_pop(c0 - c1) + var_pop(c1 - c2) + var_pop(c2 - c0)) / 3, 6) AS variance FROM px GROUP BY 1")
def _(s, d):
    return X.channel_spread(split(rgb(s, d), 3)).select("img_id", _r("variance", 6))


@query("planar_layout", f"WITH {RGB}, n AS (SELECT img_id, max(y) + 1 AS h, max(x) + 1 AS w FROM rgb GROUP BY 1) SELECT img_id, CAST((y * w + x) * 3 + c AS BIGINT) AS hwc, CAST((c * h + y) * w + x AS BIGINT) AS chw, v FROM rgb JOIN n USING (img_id)")
def _(s, d):
    return X.planar(rgb(s, d), 3)


_MARKS = "mk AS (SELECT p_partkey % 8 AS img_id, p_partkey AS box_id, CAST(p_size AS INT) AS x1, CAST(p_size + p_partkey % 7 AS INT) AS x2, CAST(p_partkey % 50 AS INT) AS y1, CAST(p_partkey % 50 + p_size % 9 AS INT) AS y2, CAST(p_partkey % 256 AS INT) AS fill FROM part)"


@query("overlay_boxes", f"""WITH {Q}, {_MARKS}, o AS (SELECT img_id, y, x, c, v, arg_max(fill, box_id) AS fill FROM q LEFT JOIN mk USING (img_id) WHERE x1 IS NULL OR (x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2) GROUP BY ALL)
    SELECT q.img_id, q.y, q.x, q.c, round(CASE WHEN o.fill IS NULL THEN q.v ELSE q.v * 0.6 + o.fill * 0.4 END, 6) AS v FROM q LEFT JOIN o USING (img_id, y, x, c)""")
def _(s, d):
    p, key = table(s, d, "part"), F.col("p_partkey")
    marks = p.select((key % 8).alias("img_id"), key.alias("box_id"), F.col("p_size").alias("x1"), (F.col("p_size") + key % 7).cast("int").alias("x2"), (key % 50).cast("int").alias("y1"), (key % 50 + F.col("p_size") % 9).cast("int").alias("y2"), (key % 256).cast("int").alias("fill"))
    return _v(X.overlay(u8(s, d), marks, 0.4), 6)


# larger kernels and fractional resizing -------------------------------------------------------------------------------------------

for _k, _dx, _dy in ((1, 1, 0), (5, 1, 1), (7, 0, 2)):

    @query(f"sobel_{_k}", _nb(max(_k, 3), "REPLICATE", f"round(sum(v * {_kernel_sql(B.sobel_kernel(_dx, _dy, _k))}), 6)"))
    def _(s, d, k=_k, dx=_dx, dy=_dy):
        return _v(B.sobel(u8(s, d), dx, dy, "REPLICATE", k=k), 6)


for _k in (1, 5, 7):

    @query(f"laplacian_{_k}", _nb(max(_k, 3), "REFLECT_101", f"round(sum(v * {_kernel_sql(B.laplacian_kernel(_k))}), 6)"))
    def _(s, d, k=_k):
        return _v(B.laplacian(u8(s, d), "REFLECT_101", k), 6)


def _cover(i: str, n: str, out: int, g: str) -> str:
    return f"greatest(least({i} + 1, ({g} + 1) * {n} / {out}.0) - greatest({i}, {g} * {n} / {out}.0), 0)"


_AREA = f"""WITH {QD}, g AS (SELECT unnest(range(0, 24)) AS gy), e AS (SELECT unnest(range(0, 40)) AS gx), a AS (SELECT img_id, gy, x, c, w, h, sum(v * {_cover('y', 'h', 24, 'gy')}) AS v FROM q JOIN dim USING (img_id) JOIN g ON {_cover('y', 'h', 24, 'gy')} > 1e-9 WHERE h >= 24 AND w >= 40 GROUP BY ALL)
    SELECT img_id, CAST(gy AS INT) AS y, CAST(gx AS INT) AS x, c, round(sum(v * {_cover('x', 'w', 40, 'gx')}) / (h / 24.0 * w / 40.0), 6) AS v FROM a JOIN e ON {_cover('x', 'w', 40, 'gx')} > 0 GROUP BY img_id, gy, gx, c, h, w"""


@query("resize_area_fraction", _AREA)
def _(s, d):
    q = u8(s, d)
    high = q.groupBy("img_id").agg(F.max("y").alias("m")).where("m >= 23").select("img_id")  # lower images are resized linearly, which has a query
    return _v(G.resize_area_to(q.join(high, "img_id", "left_semi"), 24, 40), 6)


@query("resize_area_upwards", _tap_sql(80, 80, [0, 1], lambda d, k: f"CASE WHEN {k} = 0 THEN 1 - ({d}) ELSE {d} END"))
def _(s, d):
    return _v(G.resize_area_to(u8(s, d), 80, 80), 6)


@query("spread_features")
def _(s, d):
    e = B.min_eigen(u8(s, d), 3, "REPLICATE").withColumn("v", F.round("v", 3))
    return B.spread_features(B.good_features(e, 0.05, 1_000), 6.0, 20)


_FUNNEL = [[0.25, -0.5, 0.125], [0.5, 0.0, 0.75], [-0.25, 0.5, 0.125]]


@query("funnel_relu", f"WITH {Q}, {around_sql(3, 'CONSTANT')} SELECT img_id, y, x, c, greatest(max(CASE WHEN dy = 0 AND dx = 0 THEN v END), round(sum(v * {_kernel_sql(_FUNNEL)}), 6)) AS v FROM nb GROUP BY 1, 2, 3, 4")
def _(s, d):
    return _v(B.funnel_relu(u8(s, d), _FUNNEL), 6)


_G5 = B.gauss_kernel(5, 0)


@query("adaptive_threshold_gauss", f"WITH {Q}, {around_sql(5, 'REPLICATE')}, m AS (SELECT img_id, y, x, c, round_even(sum(v * {_kernel_sql([[a * b for b in _G5] for a in _G5])}), 0) AS m FROM nb GROUP BY 1, 2, 3, 4) SELECT img_id, y, x, c, CASE WHEN q.v > m - 3 THEN 255 ELSE 0 END AS v FROM q JOIN m USING (img_id, y, x, c)")
def _(s, d):
    return B.adaptive_threshold(u8(s, d), 255, 5, 2.5, gauss=True)


_T = [[120, 130], [140, 110]]
_MEET = "FROM q o JOIN dim USING (img_id) CROSS JOIN t JOIN q s ON s.img_id = o.img_id AND s.y = o.y + a AND s.x = o.x + b WHERE o.y <= h - 2 AND o.x <= w - 2 GROUP BY 1, 2, 3, 4"
_TV = "t(a, b, k) AS (VALUES (0, 0, 120), (0, 1, 130), (1, 0, 140), (1, 1, 110))"


@query("match_template_corr", f"WITH {QD}, {_TV} SELECT o.img_id, o.y, o.x, o.c, CAST(sum(s.v * k) AS INT) AS v {_MEET}")
def _(s, d):
    return B.match_template(u8(s, d), _T, "CCORR")


@query("match_template_coeff", f"""WITH {QD}, {_TV}, m AS (SELECT o.img_id, o.y, o.x, o.c, sum(s.v * (k - 125)) AS u, 4 * sum(s.v * s.v) - sum(s.v) * sum(s.v) AS own {_MEET})
    SELECT img_id, y, x, c, CASE WHEN own > 0 THEN round(u / sqrt(own * 125.0), 6) + 0.0 ELSE 0 END AS v FROM m""")
def _(s, d):
    return B.match_template(u8(s, d), _T, "CCOEFF_NORMED").withColumn("v", F.round("v", 6) + 0.0)


@query("upsample_nearest", f"WITH {Q} SELECT img_id, CAST(y * 2 + a AS INT) AS y, CAST(x * 2 + b AS INT) AS x, c, v FROM q CROSS JOIN (SELECT unnest(range(0, 2)) AS a) CROSS JOIN (SELECT unnest(range(0, 2)) AS b)")
def _(s, d):
    return G.upsample_nearest(u8(s, d), 2)


for _b in ("CONSTANT", "REPLICATE", "REFLECT_101"):

    @query(f"remap_nearest_{_b.lower()}", f"""WITH {QD}, g AS (SELECT img_id, h, w, y, x, c, CAST(floor(CAST(1.02 AS DOUBLE) * y + CAST(0.11 AS DOUBLE) * x - 3 + 0.5) AS INT) AS iy, CAST(floor(CAST(0.97 AS DOUBLE) * x - CAST(0.08 AS DOUBLE) * y + CAST(2.3 AS DOUBLE) + 0.5) AS INT) AS ix FROM q JOIN dim USING (img_id))
        SELECT g.img_id, g.y, g.x, g.c, coalesce(q.v, 7) AS v FROM g LEFT JOIN q ON q.img_id = g.img_id AND q.y = {border_sql('iy', 'h', _b)} AND q.x = {border_sql('ix', 'w', _b)}""")
    def _(s, d, b=_b):
        q = u8(s, d)
        at = q.select("img_id", "c", "y", "x", (F.lit(1.02) * F.col("y") + F.lit(0.11) * F.col("x") - 3).alias("my"), (F.lit(0.97) * F.col("x") - F.lit(0.08) * F.col("y") + 2.3).alias("mx"))
        out = G.remap_nearest(at, q, b, 7)
        return out.withColumn("v", F.coalesce("v", F.lit(7)))  # a reflection of a place far outside may be outside as well


@query("points_and_boxes", f"""WITH {BOX}, b AS (SELECT img_id, box_id, x1 + 0.5 AS x1, y1 - 1 AS y1, x2 + 0.5 AS x2, y2 - 1 AS y2 FROM bx), j AS (SELECT a.img_id, a.box_id AS ka, b.box_id AS kb, greatest(b.x1 - a.x1, a.x1 - b.x2, 0) AS dx, greatest(b.y1 - a.y1, a.y1 - b.y2, 0) AS dy,
    least(abs(a.x1 - b.x1), abs(a.x1 - b.x2), abs(a.y1 - b.y1), abs(a.y1 - b.y2)) AS side FROM bx a JOIN b USING (img_id)) SELECT img_id, ka, kb, round(sqrt(dx * dx + dy * dy), 6) AS dist, dx = 0 AND dy = 0 AND side = 0 AS on_side FROM j""")
def _(s, d):
    b = boxes(s, d)
    j = b.select("img_id", F.col("box_id").alias("ka"), F.col("x1").alias("px"), F.col("y1").alias("py")).join(M.prefixed(M.shifted(b, 0.5, -1.0), "b", "img_id"), "img_id")
    far, on = M.point_to_box("px", "py", "b")
    return j.select("img_id", "ka", F.col("bbox_id").alias("kb"), F.round(far, 6).alias("dist"), on.alias("on_side"))


# filters, assignment, evaluation --------------------------------------------------------------------------------------------------

_DT, _QV, _R = 1.0, 0.05, 4.0


@query("kalman_motion", f"""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r(user_id, k, x, v, a, b, e) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(100 AS DOUBLE), CAST(0 AS DOUBLE), CAST(10 AS DOUBLE) FROM o
    UNION ALL SELECT user_id, k, x + a / (a + 4.0) * (z - x), v + b / (a + 4.0) * (z - x), a - a / (a + 4.0) * a, b - b / (a + 4.0) * a, e - b / (a + 4.0) * b FROM (
        SELECT r.user_id, o.k, r.x + r.v AS x, r.v AS v, r.a + r.b + r.b + r.e + 0.05 AS a, r.b + r.e AS b, r.e + 0.05 AS e, o.value AS z FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
    SELECT user_id, round(x, 6) AS x, round(v, 6) AS v, round(a, 6) AS p00, round(b, 6) AS p01, round(e, 6) AS p11 FROM r JOIN (SELECT user_id, max(k) AS k FROM o GROUP BY 1) USING (user_id, k)""")
def _(s, d):
    k = L.kalman(events(s, d), "user_id", ORD, [F.col("value")], [[1.0, _DT], [0.0, 1.0]], [[1.0, 0.0]], [[_QV**0.5, 0.0], [0.0, _QV**0.5]], [[_R]], [0.0, 0.0], [[100.0, 0.0], [0.0, 10.0]])
    at = {"x": F.col("x")[0], "v": F.col("x")[1], "p00": F.col("p")[0], "p01": F.col("p")[1], "p11": F.col("p")[3]}
    return k.select("user_id", *(F.round(c, 6).alias(m) for m, c in at.items()))


_MID = "({0}.{1}1 + {0}.{1}2) / 2"
_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_FAR = f"round(sqrt(pow({_MID.format('a', 'x')} - {_MID.format('b', 'x')}, 2) + pow({_MID.format('a', 'y')} - {_MID.format('b', 'y')}, 2)), 6)"


@query("atss_centres", f"""WITH {BOX}, j AS (SELECT a.img_id, a.box_id AS ka, b.box_id AS kb, b.box_id % 4 AS level, {_FAR} AS far, round({_INTER} / (144 - {_INTER}), 6) AS iou,
        least({_MID.format('b', 'x')} - a.x1, a.x2 - {_MID.format('b', 'x')}, {_MID.format('b', 'y')} - a.y1, a.y2 - {_MID.format('b', 'y')}) AS inner_ FROM bx a JOIN bx b ON a.img_id = b.img_id AND a.box_id % 2 = 0 AND b.box_id % 2 = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY img_id, ka, level ORDER BY far, kb) AS k FROM j), m AS (SELECT *, round(avg(iou) OVER w + stddev_samp(iou) OVER w, 6) AS thr FROM t WHERE k <= 2 WINDOW w AS (PARTITION BY img_id, ka)),
    c AS (SELECT *, count(*) OVER (PARTITION BY img_id, kb) AS n FROM m WHERE iou > thr AND inner_ > 0), b AS (SELECT *, row_number() OVER (PARTITION BY img_id, kb ORDER BY iou DESC, ka) AS pos FROM j)
    SELECT img_id, ka, kb, iou FROM c WHERE n = 1 UNION ALL SELECT img_id, ka, kb, iou FROM b SEMI JOIN (SELECT * FROM c WHERE n > 1) USING (img_id, kb) WHERE pos = 1""")
def _(s, d):
    b = boxes(s, d).drop("cls", "score")
    found = M.atss(b.where("box_id % 2 = 0"), b.where("box_id % 2 = 1").withColumn("level", F.col("box_id") % 4), 2, "level")
    return found.select("img_id", F.col("abox_id").alias("ka"), F.col("bbox_id").alias("kb"), "iou")


def _hits(s, d):
    h = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return h.select("lang", F.col("doc_id").alias("id"), F.round(F.col("n_chars") % 1000 / 1000.0, 6).alias("score"), F.col("quality").alias("hit"), (F.col("doc_id") % 10 / 10.0).alias("overlap"))


_HITS = "h AS (SELECT lang, doc_id AS id, round(n_chars % 1000 / 1000.0, 6) AS score, quality AS hit, doc_id % 10 / 10.0 AS overlap FROM documents JOIN labels USING (doc_id))"


@query("average_precision_11", f"""WITH {_HITS}, t AS (SELECT lang, sum(hit) AS n FROM h GROUP BY 1), w AS (SELECT h.lang, row_number() OVER o AS pos, sum(hit) OVER o AS tp, t.n FROM h JOIN t USING (lang) WINDOW o AS (PARTITION BY h.lang ORDER BY score DESC, id)),
    l AS (SELECT lang, k, max(tp / pos) AS best FROM w JOIN (SELECT unnest(range(0, 11)) AS k) ON tp * 10 >= k * n GROUP BY 1, 2) SELECT lang, round(sum(best) / 11, 9) AS ap FROM l GROUP BY 1""")
def _(s, d):
    h = _hits(s, d)
    return D.eleven_point(h.select("lang", "id", "score", "hit"), h.groupBy("lang").agg(F.sum("hit").alias("n")), "lang").select("lang", F.round("ap", 9).alias("ap"))


@query("mean_average_precision", f"""WITH {_HITS}, n AS (SELECT lang, count(*) AS n FROM h GROUP BY 1), g AS (SELECT * FROM h CROSS JOIN (VALUES (0.5), (0.7), (0.9)) t(t)),
    w AS (SELECT t, g.lang, row_number() OVER o AS pos, sum(CASE WHEN overlap >= t THEN 1 ELSE 0 END) OVER o AS tp, n.n FROM g JOIN n USING (lang) WINDOW o AS (PARTITION BY t, g.lang ORDER BY score DESC, id)),
    e AS (SELECT *, max(tp / pos) OVER (PARTITION BY t, lang ORDER BY pos DESC) AS env, tp / n - coalesce(lag(tp / n) OVER (PARTITION BY t, lang ORDER BY pos), 0) AS step FROM w),
    a AS (SELECT t, lang, sum(step * env) AS ap FROM e GROUP BY 1, 2) SELECT round(avg(ap), 9) AS map, count(*) AS n FROM a""")
def _(s, d):
    h = _hits(s, d).drop("hit")
    return D.mean_average_precision(h, h.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", [0.5, 0.7, 0.9]).select(F.round("map", 9).alias("map"), "n")


# switches and errors --------------------------------------------------------------------------------------------------------------


@query("ability_switches", "SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING count(*) % 2 = 0)")
def _(s, d):
    e = table(s, d, "events")
    on = e.groupBy("event_type").agg((F.count(F.lit(1)) % 2 == 0).alias("enabled")).withColumnRenamed("event_type", "ability")
    return X.switched(e.select("event_id", "event_type"), on, "event_type")


@query("isolated_errors", """SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS INT) AS number, CASE WHEN value <> 0 THEN round(100 / value, 6) END AS rate,
    array_to_string(list_filter([CASE WHEN TRY_CAST(regexp_extract(props, '[0-9]+') AS INT) IS NULL THEN 'number' END, CASE WHEN TRY_CAST(event_type AS INT) IS NULL THEN 'kind' END, CASE WHEN value = 0 THEN 'rate' END], lambda x: x IS NOT NULL), ',') AS failed FROM events""")
def _(s, d):
    e = X.isolated(
        table(s, d, "events"), number=lambda: F.regexp_extract("props", "[0-9]+", 0).try_cast("int"), kind=lambda: F.col("event_type").try_cast("int"),
        rate=lambda: F.round(F.try_divide(F.lit(100), F.col("value")), 6),
    )
    return e.select("event_id", "number", "rate", F.array_join("failed", ",").alias("failed"))


# file sources ---------------------------------------------------------------------------------------------------------------------

_RAW = "SELECT CAST(vec_id AS VARCHAR) AS path, CAST(0 AS INT) AS y, CAST(i - 1 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"
for _kind in ("F32", "F64", "S16"):

    @query(f"raw_{_kind.lower()}", _RAW if _kind[0] == "F" else _RAW.replace("CAST(embedding[i] AS DOUBLE)", "CAST(round_even(CAST(embedding[i] AS DOUBLE) * 1000, 0) AS BIGINT)"))
    def _(s, d, kind=_kind):
        e = table(s, d, "embeddings").select(F.col("vec_id").alias("img_id"), F.lit(0).alias("y"), F.posexplode("embedding").alias("x", "v"), F.lit(0).alias("c"))
        if kind == "S16":
            e = e.withColumn("v", F.bround(F.col("v").cast("double") * 1000, 0).cast("int"))
        dumped = files.raw_rows(e, kind).select(F.col("img_id").cast("string").alias("path"), "content")
        return files.decode_raw(dumped, kind, 1 << 20).select("path", "y", "x", "v")


def _folder(s, name: str) -> str:
    import uuid

    at = f"{shared_dir(s)}/gridloom/{name}-{uuid.uuid4().hex}"
    written_tables(s).append(at)
    return at


@query("raw_files", "SELECT CAST(vec_id AS VARCHAR) || '.raw' AS file, CAST((i - 1) // 16 AS INT) AS y, CAST((i - 1) // 2 % 8 AS INT) AS x, CAST((i - 1) % 2 AS INT) AS c, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def _(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("i", "v"))
    at = _folder(s, "raw")
    rawarrays.dump_raw(e.select("img_id", F.floor(F.col("i") / 16).alias("y"), (F.floor(F.col("i") / 2) % 8).alias("x"), (F.col("i") % 2).alias("c"), "v"), at, "F32")
    return rawarrays.scan_raw(s, at, "F32", 8, 2).select(F.substring_index("path", "/", -1).alias("file"), "y", "x", "c", "v")


@query("csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(s, d):
    at = _folder(s, "csv")
    table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.csv(at, header=True)
    return files.read_csv(s, at, "s_suppkey long, s_name string, s_acctbal double")


@query("shape_boxes", "SELECT CAST(p_size % 5 AS VARCHAR) AS label, p_size + 0.5 AS x1, CAST(p_partkey % 50 AS DOUBLE) AS y1, p_size + 0.5 + p_partkey % 7 AS x2, CAST(p_partkey % 50 + 3 AS DOUBLE) AS y2 FROM part")
def _(s, d):
    at, p = _folder(s, "shapes"), table(s, d, "part")
    x, y = F.col("p_size") + 0.5, (F.col("p_partkey") % 50).cast("double")
    points = F.array(F.array(x + F.col("p_partkey") % 7, y), F.array(x, y + 3))
    shapes = p.select("p_brand", F.struct((F.col("p_size") % 5).cast("string").alias("label"), points.alias("points")).alias("s"))
    files.write_json(shapes.groupBy("p_brand").agg(F.collect_list("s").alias("shapes")).select("shapes"), at)
    return files.read_shapes(s, at, lines=True).drop("path")


@query("xml_round_trip", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    at = _folder(s, "xml")
    files.write_xml(table(s, d, "nation").select("n_nationkey", "n_name"), at, "nation")
    return s.read.format("xml").option("rowTag", "nation").schema("n_nationkey int, n_name string").load(at)


@query("list_files", "SELECT count(*) AS n FROM (SELECT DISTINCT n_regionkey FROM nation)")
def _(s, d):
    at = _folder(s, "listing")
    table(s, d, "nation").select("n_name", "n_regionkey").repartition(1).write.partitionBy("n_regionkey").csv(at)
    return files.list_files(s, at, "*.csv").where("length > 0").agg(F.count(F.lit(1)).alias("n"))


@query("report_rows", "SELECT event_type AS case_, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS INT) AS pos, 'ref' AS target, value AS ms FROM events")
def _(s, d):
    none = F.lit(None).cast("string")
    result = F.struct(none.alias("input"), none.alias("output"), none.alias("param"), F.create_map(F.lit("ref"), F.create_map(F.lit("avg"), F.col("value"))).alias("perf_result"))
    e = table(s, d, "events").groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", result.alias("r"))), lambda a, b: F.signum(a["event_id"] - b["event_id"]).cast("int")), lambda x: x["r"]).alias("result"))
    report = e.select(F.to_json(F.struct(F.create_map("event_type", F.struct("result")).alias("default"))).alias("j"))
    return files.report_rows(report, "j").select(F.col("case").alias("case_"), "pos", "target", "ms")
