"""Queries of matching, detection and evaluation. Boxes are built from lineitem, points from customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.operators import detect as D
from gridloom.operators import match as M
from gridloom.operators import polygons as P
from gridloom.plans.registry import query, table

#: Boxes: one a line of an order, in one image per order; box_id numbers them.
BOX = """bx AS (SELECT l_orderkey AS img_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate) AS box_id, CAST(l_linenumber % 3 AS INT) AS cls,
    l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 12 AS x2, l_discount * 100 + 6 AS y2, l_extendedprice / 200000 AS score FROM lineitem)"""


def boxes(s, d):
    from pyspark.sql import Window

    l = table(s, d, "lineitem")  # noqa: E741
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    return l.select(
        F.col("l_orderkey").alias("img_id"), F.row_number().over(w).cast("long").alias("box_id"), (F.col("l_linenumber") % 3).alias("cls"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"),
        (F.col("l_quantity") + 12).alias("x2"), (F.col("l_discount") * 100 + 6).alias("y2"), (F.col("l_extendedprice") / 200000).alias("score"),
    )


_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_PAIRS = f"""{BOX}, i AS (SELECT a.img_id, a.box_id AS ka, b.box_id AS kb, {_INTER} AS i, a.score AS sa FROM bx a JOIN bx b ON a.img_id = b.img_id AND a.box_id < b.box_id), pr AS (SELECT *, i / (144 - i) AS iou, i / 72 AS iof FROM i WHERE i > 0)"""


def pairs(s, d):
    b = boxes(s, d)
    return M.pairwise(b, b).where("abox_id < bbox_id")


@query("pairwise_iou", f"WITH {_PAIRS} SELECT img_id, ka, kb, round(iou, 6) AS iou, round(iof, 6) AS iof FROM pr")
def _(s, d):
    return pairs(s, d).select("img_id", F.col("abox_id").alias("ka"), F.col("bbox_id").alias("kb"), F.round("iou", 6).alias("iou"), F.round("iof", 6).alias("iof"))


@query("resolve_multi", f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY img_id, kb ORDER BY round(iou, 6) DESC, ka) AS k FROM pr) SELECT img_id, kb, ka FROM r WHERE k = 1")
def _(s, d):
    p = pairs(s, d).select("img_id", F.col("abox_id").alias("ka"), F.col("bbox_id").alias("kb"), F.round("iou", 6).alias("iou"))
    return M.best_of(p, ["img_id", "kb"], F.col("iou").desc(), F.col("ka")).select("img_id", "kb", "ka")


@query("atss_assign", f"""WITH {_PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY img_id, ka ORDER BY round(iou, 6) DESC, kb) AS k FROM pr), c AS (SELECT * FROM t WHERE k <= 3),
    m AS (SELECT *, round(avg(iou) OVER (PARTITION BY img_id, ka) + stddev_pop(iou) OVER (PARTITION BY img_id, ka), 6) AS thr FROM c) SELECT img_id, ka, kb, thr FROM m WHERE round(iou, 6) >= thr""")
def _(s, d):
    from pyspark.sql import Window

    p = pairs(s, d).select("img_id", F.col("abox_id").alias("ka"), F.col("bbox_id").alias("kb"), "iou")
    c = M.topk_candidates(p, ["img_id", "ka"], 3, F.round("iou", 6).desc(), F.col("kb"))
    w = Window.partitionBy("img_id", "ka")
    c = c.withColumn("thr", F.round(F.avg("iou").over(w) + F.stddev_pop("iou").over(w), 6))
    return c.where(F.round("iou", 6) >= F.col("thr")).select("img_id", "ka", "kb", "thr")


@query("task_aligned_assign", f"""WITH {_PAIRS}, t AS (SELECT *, sa * pow(iou, 6) AS metric FROM pr), r AS (SELECT *, row_number() OVER (PARTITION BY img_id, kb ORDER BY metric DESC, ka) AS k FROM t) SELECT img_id, kb, ka FROM r WHERE k <= 2""")
def _(s, d):
    p = pairs(s, d).select("img_id", F.col("abox_id").alias("ka"), F.col("bbox_id").alias("kb"), (F.col("ascore") * F.pow("iou", F.lit(6.0))).alias("metric"))
    return M.topk_candidates(p, ["img_id", "kb"], 2, F.col("metric").desc(), F.col("ka")).select("img_id", "kb", "ka")


_PTS = "SELECT c_custkey AS point_id, c_nationkey AS g, c_acctbal / 100 AS px, CAST(c_custkey % 97 AS DOUBLE) AS py FROM customer"
_SITES = "SELECT s_suppkey AS site_id, s_nationkey AS g, s_acctbal / 100 AS sx, CAST(s_suppkey % 97 AS DOUBLE) AS sy FROM supplier"


def points(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_nationkey").alias("g"), (F.col("c_acctbal") / 100).alias("px"), (F.col("c_custkey") % 97).cast("double").alias("py"))


def sites(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_nationkey").alias("g"), (F.col("s_acctbal") / 100).alias("sx"), (F.col("s_suppkey") % 97).cast("double").alias("sy"))


_NEAR = "WITH p AS ({}), t AS ({}), j AS (SELECT g, point_id, site_id, round(sqrt({}), 6) AS dist FROM p JOIN t USING (g)), r AS (SELECT *, row_number() OVER (PARTITION BY g, point_id ORDER BY dist, site_id) AS k FROM j) SELECT g, point_id, site_id, dist FROM r WHERE k = 1"


@query("nearest_euclidean", _NEAR.format(_PTS, _SITES, "(px - sx) * (px - sx) + (py - sy) * (py - sy)"))
def _(s, d):
    return M.nearest(points(s, d), sites(s, d), ["g"], lambda dx, dy: F.round(F.sqrt(dx * dx + dy * dy), 6))


@query("nearest_mahalanobis", _NEAR.format(_PTS, _SITES, "(px - sx) * (px - sx) * 0.5 + 2 * (px - sx) * (py - sy) * 0.25 + (py - sy) * (py - sy) * 5.0"))
def _(s, d):
    inv = (0.5, 0.25, 5.0)
    return M.nearest(points(s, d), sites(s, d), ["g"], lambda dx, dy: F.round(M.mahalanobis(dx, dy, inv), 6), M.mahalanobis_axes(inv))


@query("distance_within", f"WITH p AS ({_PTS}), t AS ({_SITES}) SELECT point_id, site_id, round(sqrt((px - sx) * (px - sx) + (py - sy) * (py - sy)), 6) AS dist FROM p CROSS JOIN t WHERE sqrt((px - sx) * (px - sx) + (py - sy) * (py - sy)) <= 5")
def _(s, d):
    return M.within(points(s, d), sites(s, d), 5.0).select("point_id", "site_id", N.rounded(F.col("dist"), 6).alias("dist"))


@query("points_in_boxes", f"WITH p AS ({_PTS}), t AS ({_SITES}) SELECT point_id, site_id AS box_id FROM p CROSS JOIN t WHERE least(px - (sx - 4), sx + 4 - px, py - (sy - 3), sy + 3 - py) > 1e-9")
def _(s, d):
    b = sites(s, d).select(F.col("site_id").alias("box_id"), (F.col("sx") - 4).alias("x1"), (F.col("sx") + 4).alias("x2"), (F.col("sy") - 3).alias("y1"), (F.col("sy") + 3).alias("y2"))
    return M.points_in_boxes(points(s, d), b, 4.0)


@query("category_lookup", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    return table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("class_filter", f"WITH {BOX} SELECT img_id, box_id FROM bx WHERE cls IN (0, 2)")
def _(s, d):
    allowed = s.range(3).where("id <> 1").select(F.col("id").cast("int").alias("cls"))
    return boxes(s, d).join(allowed, "cls", "left_semi").select("img_id", "box_id")


@query("feature_cosine", """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v) + 1e-6) * sqrt(list_dot_product(b.v, b.v) + 1e-6)), 6) AS cos
    FROM q a JOIN q b ON b.vec_id = a.vec_id + 1""")
def _(s, d):
    e = table(s, d, "embeddings")
    j = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("ea")).join(e.select((F.col("vec_id") - 1).alias("a_id"), F.col("vec_id").alias("b_id"), F.col("embedding").alias("eb")), "a_id")
    return j.select("a_id", "b_id", F.round(M.cosine("ea", "eb"), 6).alias("cos"))


@query("box_distance", f"WITH {BOX} SELECT a.img_id, a.box_id AS ka, b.box_id AS kb, round(sqrt(pow(greatest(a.x1 - b.x2, b.x1 - a.x2, 0), 2) + pow(greatest(a.y1 - b.y2, b.y1 - a.y2, 0), 2)), 6) AS dist FROM bx a JOIN bx b ON a.img_id = b.img_id AND a.box_id < b.box_id")
def _(s, d):
    b = boxes(s, d)
    j = M.prefixed(b, "a", "img_id").join(M.prefixed(b, "b", "img_id"), "img_id").where("abox_id < bbox_id")
    return j.select("img_id", F.col("abox_id").alias("ka"), F.col("bbox_id").alias("kb"), F.round(M.box_distance("a", "b"), 6).alias("dist"))


@query("box_merge", f"WITH {BOX} SELECT img_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM bx GROUP BY 1")
def _(s, d):
    return boxes(s, d).groupBy("img_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


@query("vector_algebra", f"WITH p AS ({_PTS}) SELECT point_id, round(sqrt(px * px + py * py), 6) AS len, round(atan2(py, px), 9) AS angle, round(px * 3 - py * 2, 6) AS cross_v, round(px * 2 + py * 3, 6) AS inner_v, round(px * cos(CAST(0.5 AS DOUBLE)) - py * sin(CAST(0.5 AS DOUBLE)), 6) AS rx, round(px * sin(CAST(0.5 AS DOUBLE)) + py * cos(CAST(0.5 AS DOUBLE)), 6) AS ry FROM p")
def _(s, d):
    x, y = F.col("px"), F.col("py")
    rx, ry = N.rotate2d(x, y, 0.5)
    a, b = F.lit(2.0), F.lit(3.0)
    return points(s, d).select("point_id", F.round(N.length2d(x, y), 6).alias("len"), F.round(N.angle2d(x, y), 9).alias("angle"), F.round(N.cross2d(x, y, a, b), 6).alias("cross_v"), F.round(N.inner2d(x, y, a, b), 6).alias("inner_v"), F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"))


@query("score_decode", f"WITH {BOX}, k AS (SELECT img_id, box_id, 1 / (1 + exp(-score)) * (1 / (1 + exp(-(score - 0.5)))) AS score, (1 / (1 + exp(-(x1 / 50))) + cls) * 16 AS cx, (1 / (1 + exp(-(y1 / 10))) + cls) * 16 AS cy, exp(score) * 10 AS w, exp(score / 2) * 13 AS h FROM bx) SELECT img_id, box_id, round(score, 6) AS score, round(cx - w / 2, 5) AS x1, round(cy - h / 2, 5) AS y1, round(cx + w / 2, 5) AS x2, round(cy + h / 2, 5) AS y2 FROM k")
def _(s, d):
    b = boxes(s, d)
    c = D.decode(F.col("cls"), F.col("cls"), F.col("x1") / 50, F.col("y1") / 10, F.col("score"), F.col("score") / 2, 16.0, 10.0, 13.0)
    k = b.select("img_id", "box_id", D.score(F.col("score"), F.col("score") - 0.5).alias("score"), *c)
    return k.select("img_id", "box_id", F.round("score", 6).alias("score"), *(F.round(n, 5).alias(n) for n in ("x1", "y1", "x2", "y2")))


@query("nms")
def _(s, d):
    return D.nms(boxes(s, d), 0.3).select("img_id", "box_id", "cls", "score")


@query("soft_nms")
def _(s, d):
    return D.soft_nms(boxes(s, d), "gaussian").select("img_id", "box_id", "cls", "score")


@query("locality_nms")
def _(s, d):
    return D.locality_nms(boxes(s, d), 0.3).select("img_id", "box_id", "cls", "score")


def quads(s, d):
    """The boxes under a linear map (a turn, a stretch and a shear), which keeps the share that two have in common."""
    mapped = lambda x, y: (F.col(x) * 0.8 - F.col(y) * 0.6, F.col(x) * 0.5 + F.col(y) * 1.1)
    corners = [c for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")) for c in mapped(x, y)]
    return boxes(s, d).select("img_id", "box_id", "cls", F.array(*corners).alias("quad"), "score")


@query("quad_overlaps", f"WITH {_PAIRS} SELECT img_id, ka, kb, round(iou, 6) AS iou FROM pr WHERE round(iou, 6) > 0")
def _(s, d):
    side = lambda k: F.transform(F.sequence(F.lit(k), F.lit(k + 6), F.lit(2)), lambda i: F.get("quad", i))
    ends = {"x1": F.array_min(side(0)), "y1": F.array_min(side(1)), "x2": F.array_max(side(0)), "y2": F.array_max(side(1))}
    q = quads(s, d).drop("cls", "score").withColumns(ends)
    p = M.pairwise(q, q).where("abox_id < bbox_id").withColumn("iou", F.round(P.quad_overlap("aquad", "bquad"), 6))
    return p.where("iou > 0").select("img_id", F.col("abox_id").alias("ka"), F.col("bbox_id").alias("kb"), "iou")


@query("locality_nms_quads")
def _(s, d):
    return P.locality_nms_quads(quads(s, d), 0.3).select("img_id", "box_id", "cls", F.round("score", 9).alias("score"))


@query("average_precision", """WITH h AS (SELECT lang, doc_id AS id, round(n_chars % 1000 / 1000.0, 6) AS score, quality AS hit FROM documents JOIN labels USING (doc_id)), t AS (SELECT lang, sum(hit) AS n FROM h GROUP BY 1),
    w AS (SELECT h.lang, hit, row_number() OVER (PARTITION BY h.lang ORDER BY score DESC, id) AS pos, sum(hit) OVER (PARTITION BY h.lang ORDER BY score DESC, id) AS tp, t.n FROM h JOIN t USING (lang)),
    e AS (SELECT *, max(tp / pos) OVER (PARTITION BY lang ORDER BY pos DESC) AS env, tp / n - coalesce(lag(tp / n) OVER (PARTITION BY lang ORDER BY pos), 0) AS step FROM w) SELECT lang, round(sum(step * env), 9) AS ap FROM e GROUP BY 1""")
def _(s, d):
    h = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("lang", F.col("doc_id").alias("id"), F.round(F.col("n_chars") % 1000 / 1000.0, 6).alias("score"), F.col("quality").alias("hit"))
    return D.average_precision(h, h.groupBy("lang").agg(F.sum("hit").alias("n")), "lang").select("lang", F.round("ap", 9).alias("ap"))


@query("fitness", "SELECT l_returnflag, round(0.1 * avg(l_discount) + 0.9 * avg(l_tax), 9) AS fitness FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(0.1 * F.avg("l_discount") + 0.9 * F.avg("l_tax"), 9).alias("fitness"))


@query("anchor_ratio_metric", "SELECT p_partkey, round(greatest(least(p_size / 10.0, 10.0 / p_size), least(p_size / 30.0, 30.0 / p_size)), 9) AS best FROM part")
def _(s, d):
    r = lambda a: F.least(F.col("p_size") / a, F.lit(a) / F.col("p_size"))
    return table(s, d, "part").select("p_partkey", F.round(F.greatest(r(10.0), r(30.0)), 9).alias("best"))


@query("anchor_kmeans")
def _(s, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    p = table(s, d, "part").select(F.col("p_size").cast("double").alias("w"), F.col("p_retailprice").alias("h"))
    v = VectorAssembler(inputCols=["w", "h"], outputCol="raw").transform(p)
    v = StandardScaler(inputCol="raw", outputCol="features").fit(v).transform(v)
    m = KMeans(k=6, maxIter=30, seed=1).fit(v)
    return m.transform(v).groupBy("prediction").agg(F.count("*").alias("n"), F.avg("w").alias("w"), F.avg("h").alias("h"))


@query("anchor_grid", "WITH s(stride) AS (VALUES (8), (16), (32)), y AS (SELECT stride, unnest(range(0, 128 // stride)) AS gy FROM s), g AS (SELECT stride, gy, unnest(range(0, 128 // stride)) AS gx FROM y) SELECT stride, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, CAST((gx + 0.5) * stride AS DOUBLE) AS cx, CAST((gy + 0.5) * stride AS DOUBLE) AS cy FROM g")
def _(s, d):
    return D.anchor_grid(s.range(1), [8, 16, 32], 128).select("stride", "gy", "gx", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
