"""Queries over the cells of the embedding matrix: reductions and cell-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.operators import elementwise as E
from gridloom.operators import reduce as R
from gridloom.plans.registry import CELLS, Q, query, real, table, u8

KEY = ["img_id", "y", "x", "c"]


def _r(c: str, d: int = 6):
    return F.round(c, d).alias(c)


@query("sum", f"WITH {Q} SELECT img_id, c, CAST(sum(v) AS BIGINT) AS sum_v FROM q GROUP BY 1, 2")
def _(s, d):
    return R.sums(u8(s, d))


@query("mean", f"WITH {Q} SELECT img_id, c, round(avg(v), 6) AS mean_v FROM q GROUP BY 1, 2")
def _(s, d):
    return R.means(u8(s, d)).select("img_id", "c", _r("mean_v"))


@query("mean_std_dev", f"WITH {CELLS} SELECT x, count(v) AS n, round(avg(v), 6) AS mean_v, round(stddev_pop(v), 6) AS std_v, min(v) AS min_v, max(v) AS max_v FROM cells GROUP BY 1")
def _(s, d):
    return R.mean_std_dev(real(s, d), "x").select("x", "n", _r("mean_v"), _r("std_v"), "min_v", "max_v")


@query("min_max_loc", f"""WITH {Q}, r AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY v, y, x, c) AS a, row_number() OVER (PARTITION BY img_id ORDER BY v DESC, y, x, c) AS b FROM q)
    SELECT l.img_id, l.v AS min_v, l.y AS min_y, l.x AS min_x, h.v AS max_v, h.y AS max_y, h.x AS max_x FROM r l JOIN r h ON l.img_id = h.img_id AND l.a = 1 AND h.b = 1""")
def _(s, d):
    return R.min_max_loc(u8(s, d))


@query("norm", f"WITH {Q} SELECT img_id, max(abs(v)) AS norm_inf, CAST(sum(abs(v)) AS BIGINT) AS norm_l1, round(sqrt(sum(v * v)), 6) AS norm_l2, CAST(sum(v * v) AS BIGINT) AS norm_l2sqr FROM q GROUP BY 1")
def _(s, d):
    return R.norms(u8(s, d)).select("img_id", "norm_inf", "norm_l1", _r("norm_l2"), "norm_l2sqr")


def pair(s, d):
    """Each image with the next one."""
    a = u8(s, d)
    return E.aligned(a, a.withColumn("img_id", F.col("img_id") - 1))


PAIR = f"{Q}, p AS (SELECT a.img_id, a.y, a.x, a.c, a.v AS a, b.v AS b FROM q a JOIN q b ON b.img_id = a.img_id + 1 AND b.y = a.y AND b.x = a.x AND b.c = a.c)"


@query("psnr", f"WITH {PAIR} SELECT img_id, round(20 * log10(255.0 / (sqrt(avg((a - b) * (a - b))) + 2.220446049250313e-16)), 6) AS psnr FROM p GROUP BY 1")
def _(s, d):
    return R.psnr(pair(s, d)).select("img_id", _r("psnr"))


@query("calc_hist", f"""WITH {Q}, g AS (SELECT DISTINCT img_id, b.bin FROM q CROSS JOIN (SELECT unnest(range(0, 242)) AS bin) b)
    SELECT g.img_id, CAST(g.bin AS INT) AS bin, count(q.v) AS n FROM g LEFT JOIN q ON q.img_id = g.img_id AND q.v >= 2 AND q.v < 244 AND CAST(floor((q.v - 2) * 242 / 242.0) AS INT) = g.bin AND q.x % 2 = 0 GROUP BY 1, 2""")
def _(s, d):
    return R.histogram(u8(s, d), "v", 242, 2, 244, "img_id", mask=F.col("x") % 2 == 0)


@query("calc_hist_lineitem", """WITH g AS (SELECT unnest(range(0, 10)) AS bin)
    SELECT CAST(bin AS INT) AS bin, count(l_quantity) AS n FROM g LEFT JOIN lineitem ON l_quantity >= 0 AND l_quantity < 50 AND CAST(floor(l_quantity * 10 / 50) AS INT) = bin GROUP BY 1""")
def _(s, d):
    return R.histogram(table(s, d, "lineitem"), "l_quantity", 10, 0.0, 50.0)


HIST = f"""{Q}, h AS (SELECT g.img_id, CAST(g.bin AS INT) AS bin, count(q.v) AS n FROM (SELECT DISTINCT img_id, b.bin FROM q CROSS JOIN (SELECT unnest(range(0, 256)) AS bin) b) g
    LEFT JOIN q ON q.img_id = g.img_id AND q.v = g.bin GROUP BY 1, 2)"""


@query("equalize_hist", f"""WITH {HIST}, t AS (SELECT *, min(CASE WHEN n > 0 THEN bin END) OVER (PARTITION BY img_id) AS f, sum(n) OVER (PARTITION BY img_id) AS total, sum(n) OVER (PARTITION BY img_id ORDER BY bin) AS cum FROM h),
    u AS (SELECT *, max(CASE WHEN bin = f THEN n END) OVER (PARTITION BY img_id) AS nf FROM t),
    l AS (SELECT img_id, bin, CAST(CASE WHEN bin <= f THEN 0 ELSE least(greatest(round_even((cum - nf) * 255.0 / (total - nf), 0), 0), 255) END AS INT) AS new FROM u)
    SELECT q.img_id, y, x, c, new AS v FROM q JOIN l ON l.img_id = q.img_id AND l.bin = q.v""")
def _(s, d):
    return R.equalise(u8(s, d))


@query("clahe", None)
def _(s, d):
    return R.clahe(u8(s, d), 2.0, (8, 8))


@query("depth_hist", """WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
    h AS (SELECT e.event_type, CAST(least(floor((value - lo) * 64 / (hi - lo)), 63) AS INT) AS bin, count(*) AS n FROM events e JOIN m USING (event_type) GROUP BY 1, 2)
    SELECT event_type, bin, n, round(n / sum(n) OVER (PARTITION BY event_type), 9) AS pdf, round(sum(n) OVER (PARTITION BY event_type ORDER BY bin) / sum(n) OVER (PARTITION BY event_type), 9) AS cdf FROM h""")
def _(s, d):
    return R.cdf_map(table(s, d, "events"), "value", 64, "event_type").select("event_type", "bin", "n", _r("pdf", 9), _r("cdf", 9))


@query("integral", f"""WITH {Q}, a AS (SELECT *, sum(v) OVER (PARTITION BY img_id, c, y ORDER BY x) AS s0, sum(v * v) OVER (PARTITION BY img_id, c, y ORDER BY x) AS q0 FROM q)
    SELECT img_id, y, x, c, CAST(sum(s0) OVER (PARTITION BY img_id, c, x ORDER BY y) AS BIGINT) AS s, CAST(sum(q0) OVER (PARTITION BY img_id, c, x ORDER BY y) AS BIGINT) AS sq FROM a""")
def _(s, d):
    return R.integral(u8(s, d))


@query("covariance", "SELECT round(var_samp(l_quantity), 6) AS var_a, round(var_samp(l_discount), 6) AS var_b, round(covar_samp(l_quantity, l_discount), 6) AS cov_ab FROM lineitem")
def _(s, d):
    return R.covariance(table(s, d, "lineitem"), "l_quantity", "l_discount").select(_r("var_a"), _r("var_b"), _r("cov_ab"))


@query("majority", """WITH n AS (SELECT l_shipdate, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY l_shipdate) AS tot, row_number() OVER (PARTITION BY l_shipdate ORDER BY n DESC, l_returnflag) AS k FROM n)
    SELECT l_shipdate, CASE WHEN n * 2 > tot THEN l_returnflag END AS majority, n FROM r WHERE k = 1""")
def _(s, d):
    return R.majority(table(s, d, "lineitem"), "l_returnflag", "l_shipdate")


@query("diff_stats", f"WITH {PAIR} SELECT img_id, count(*) AS n, count(*) FILTER (WHERE abs(a - b) > 30) AS n_diff, round(count(*) FILTER (WHERE abs(a - b) > 30) * 100 / count(*), 6) AS pct_diff FROM p GROUP BY 1")
def _(s, d):
    return R.diff_stats(pair(s, d), 30).select("img_id", "n", "n_diff", _r("pct_diff"))


@query("perf_records", "SELECT event_type, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 6) AS avg_ms, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return R.perf_records(table(s, d, "events"), "event_type", "value").select("event_type", "min_ms", "max_ms", _r("avg_ms"), "n")


@query("anchor_shape_stats", "SELECT p_size % 5 AS anchor, round(stddev_pop(p_size), 6) AS std_w, round(stddev_pop(p_retailprice), 4) AS std_h, count(*) FILTER (WHERE p_size < 3) AS n_small FROM part GROUP BY 1")
def _(s, d):
    p = table(s, d, "part").withColumn("anchor", F.col("p_size") % 5)
    return p.groupBy("anchor").agg(F.round(F.stddev_pop("p_size"), 6).alias("std_w"), F.round(F.stddev_pop("p_retailprice"), 4).alias("std_h"), F.count_if(F.col("p_size") < 3).alias("n_small"))


for _op, _sql, _kind, _lo, _hi in (
    ("add", "a + b", "U16", 0, 65535), ("sub", "a - b", "U8", 0, 255), ("mul", "a * b", "U8", 0, 255),
    ("div", "CASE WHEN b = 0 THEN 0 ELSE round_even(CAST(a AS DOUBLE) / b, 0) END", "U8", 0, 255),
):

    @query(f"arith_{_op}", f"WITH {PAIR} SELECT img_id, y, x, c, CAST(least(greatest({_sql}, {_lo}), {_hi}) AS INT) AS v FROM p")
    def _(s, d, op=_op, kind=_kind):
        return E.arithmetic(pair(s, d), op, kind).select(*KEY, F.col("v").cast("int").alias("v"))


@query("arith_scalar", f"WITH {Q} SELECT img_id, y, x, c, CAST(CASE WHEN v = 0 THEN 0 ELSE least(round_even(1000.0 / v, 0), 255) END AS INT) AS v FROM q")
def _(s, d):
    return E.scalar_divide(u8(s, d), 1000.0, "U8").select(*KEY, F.col("v").cast("int").alias("v"))


@query("cell_min_max", f"WITH {PAIR} SELECT img_id, y, x, c, least(a, b) AS lo, greatest(a, b) AS hi FROM p")
def _(s, d):
    return E.cell_min_max(pair(s, d))


@query("convert_to", f"WITH {CELLS} SELECT img_id, y, x, c, CAST(least(greatest(round_even(v * 300.0 + 7.25, 0), -128), 127) AS INT) AS v FROM cells")
def _(s, d):
    return E.convert_to(real(s, d), "S8", 300.0, 7.25).select(*KEY, F.col("v").cast("int").alias("v"))


@query("saturate_cast", f"""WITH {CELLS}, k AS (SELECT *, v * 1e6 AS b FROM cells) SELECT img_id, y, x, c,
    CAST(least(greatest(round_even(b, 0), 0), 255) AS INT) AS u8, CAST(least(greatest(round_even(b, 0), -128), 127) AS INT) AS s8, CAST(least(greatest(round_even(b, 0), 0), 65535) AS INT) AS u16,
    CAST(least(greatest(round_even(b, 0), -32768), 32767) AS INT) AS s16, CAST(least(greatest(round_even(b, 0), 0), 4294967295) AS BIGINT) AS u32, CAST(least(greatest(round_even(b, 0), -2147483648), 2147483647) AS INT) AS s32 FROM k""")
def _(s, d):
    b = F.col("v") * 1e6
    return real(s, d).select(*KEY, *(N.sat(b, k).cast("bigint" if k == "U32" else "int").alias(k.lower()) for k in N.TYPES))


@query("normalize_minmax", f"""WITH {Q}, m AS (SELECT img_id, min(v) AS lo, max(v) AS hi FROM q GROUP BY 1)
    SELECT q.img_id, y, x, c, round(v * (CASE WHEN hi > lo THEN 10.0 / (hi - lo) ELSE 0 END) + (-5.0 - lo * (CASE WHEN hi > lo THEN 10.0 / (hi - lo) ELSE 0 END)), 6) AS v FROM q JOIN m USING (img_id)""")
def _(s, d):
    return E.normalize(u8(s, d), 5.0, -5.0, "MINMAX").select(*KEY, _r("v"))


@query("normalize_l2", f"WITH {Q}, m AS (SELECT img_id, sqrt(sum(v * v)) AS n FROM q GROUP BY 1) SELECT q.img_id, y, x, c, round(v * 100.0 / n, 6) AS v FROM q JOIN m USING (img_id)")
def _(s, d):
    return E.normalize(u8(s, d), 100.0, 0.0, "L2").select(*KEY, _r("v"))


@query("mul_spectrums", f"""WITH {CELLS}, z AS (SELECT img_id, y, x // 2 AS x, max(CASE WHEN x % 2 = 0 THEN v END) AS re, max(CASE WHEN x % 2 = 1 THEN v END) AS im FROM cells GROUP BY 1, 2, 3)
    SELECT a.img_id, a.y, CAST(a.x AS INT) AS x, round(a.re * b.re + a.im * b.im, 9) AS re, round(a.im * b.re - a.re * b.im, 9) AS im FROM z a JOIN z b ON b.img_id = a.img_id + 1 AND a.y = b.y AND a.x = b.x""")
def _(s, d):
    z = real(s, d).groupBy("img_id", "y", F.floor(F.col("x") / 2).cast("int").alias("x")).agg(
        F.max(F.when(F.col("x") % 2 == 0, F.col("v"))).alias("re"), F.max(F.when(F.col("x") % 2 == 1, F.col("v"))).alias("im"))
    a, b = z.toDF("img_id", "y", "x", "are", "aim"), z.withColumn("img_id", F.col("img_id") - 1).toDF("img_id", "y", "x", "bre", "bim")
    return E.mul_spectrums(a.join(b, ["img_id", "y", "x"]), True).select("img_id", "y", "x", _r("re", 9), _r("im", 9))


def rgb(s, d):
    """Columns 0 to 62 of the matrix as 21 pixels of three channels."""
    q = u8(s, d).where("x < 63")
    return q.select("img_id", "y", F.floor(F.col("x") / 3).cast("int").alias("x"), (F.col("x") % 3).alias("c"), "v")


RGB = f"{Q}, rgb AS (SELECT img_id, y, CAST(x // 3 AS INT) AS x, x % 3 AS c, v FROM q WHERE x < 63), px AS (SELECT img_id, y, x, max(CASE WHEN c = 0 THEN v END) AS c0, max(CASE WHEN c = 1 THEN v END) AS c1, max(CASE WHEN c = 2 THEN v END) AS c2 FROM rgb GROUP BY 1, 2, 3)"


@query("split_channels", f"WITH {RGB} SELECT * FROM px")
def _(s, d):
    return E.split(rgb(s, d), 3)


@query("merge_channels", f"WITH {RGB} SELECT img_id, y, x, CAST(c AS INT) AS c, v FROM rgb")
def _(s, d):
    return E.merge(E.split(rgb(s, d), 3), 3)


@query("threshold", f"""WITH {Q} SELECT img_id, y, x, c, CASE WHEN v > 128 THEN 200 ELSE 0 END AS binary_v, CASE WHEN v > 128 THEN 0 ELSE 200 END AS binary_inv, least(v, 128) AS trunc_v,
    CASE WHEN v > 128 THEN v ELSE 0 END AS tozero, CASE WHEN v > 128 THEN 0 ELSE v END AS tozero_inv FROM q""")
def _(s, d):
    t = lambda k: E.threshold(F.col("v"), 128, 200, k)
    return u8(s, d).select(*KEY, t("BINARY").alias("binary_v"), t("BINARY_INV").alias("binary_inv"), t("TRUNC").alias("trunc_v"), t("TOZERO").alias("tozero"), t("TOZERO_INV").alias("tozero_inv"))


@query("otsu_threshold", f"""WITH {HIST}, k AS (SELECT *, sum(n) OVER (PARTITION BY img_id) AS tot, sum(n) OVER (PARTITION BY img_id ORDER BY bin) AS w, sum(n * bin) OVER (PARTITION BY img_id ORDER BY bin) AS s, sum(n * bin) OVER (PARTITION BY img_id) AS a FROM h),
    z AS (SELECT img_id, bin, CASE WHEN w / tot < 1e-6 OR w / tot > 1 - 1e-6 THEN 0 ELSE round((w / tot) * (1 - w / tot) * pow(s / w - (a - s) / (tot - w), 2), 6) END AS var FROM k),
    r AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY var DESC, bin) AS pos FROM z) SELECT img_id, bin AS threshold FROM r WHERE pos = 1""")
def _(s, d):
    return E.otsu(u8(s, d))


@query("triangle_threshold", f"""WITH {HIST}, b AS (SELECT img_id, greatest(min(CASE WHEN n > 0 THEN bin END) - 1, 0) AS l, least(max(CASE WHEN n > 0 THEN bin END) + 1, 255) AS r, max(n) AS top FROM h GROUP BY 1),
    p AS (SELECT b.*, (SELECT min(bin) FROM h WHERE h.img_id = b.img_id AND h.n = b.top) AS p FROM b), f AS (SELECT *, (p - l) < (r - p) AS flip FROM p),
    g AS (SELECT *, CASE WHEN flip THEN 255 - r ELSE l END AS le, CASE WHEN flip THEN 255 - p ELSE p END AS pk FROM f),
    j AS (SELECT g.img_id, flip, CASE WHEN flip THEN 255 - bin ELSE bin END AS i, le, pk, top, n FROM g JOIN h USING (img_id)),
    z AS (SELECT img_id, flip, i, row_number() OVER (PARTITION BY img_id ORDER BY top * i + (le - pk) * n DESC, i) AS k FROM j WHERE i > le AND i <= pk)
    SELECT img_id, CASE WHEN flip THEN 255 - (i - 1) ELSE i - 1 END AS threshold FROM z WHERE k = 1""")
def _(s, d):
    return E.triangle(u8(s, d))


TEN = f"{CELLS}, t AS (SELECT img_id, y, x, c, CAST(least(greatest(round_even((v + 1) * 511.5, 0), 0), 1023) AS INT) AS v FROM cells), g AS (SELECT img_id, y, c, x // 4 AS g, max(CASE WHEN x % 4 = 0 THEN v END) AS a, max(CASE WHEN x % 4 = 1 THEN v END) AS b, max(CASE WHEN x % 4 = 2 THEN v END) AS e, max(CASE WHEN x % 4 = 3 THEN v END) AS f FROM t GROUP BY 1, 2, 3, 4)"


def ten_bit(s, d):
    return real(s, d).withColumn("v", F.least(F.greatest(F.bround((F.col("v") + 1) * 511.5, 0), F.lit(0.0)), F.lit(1023.0)).cast("int"))


@query("mipi_pack", f"""WITH {TEN}, k AS (SELECT img_id, y, c, g, unnest([a >> 2, b >> 2, e >> 2, f >> 2, (a & 3) + ((b & 3) << 2) + ((e & 3) << 4) + ((f & 3) << 6)]) AS v, unnest([0, 1, 2, 3, 4]) AS k FROM g)
    SELECT img_id, y, CAST(g * 5 + k AS INT) AS x, c, v FROM k""")
def _(s, d):
    return E.mipi_pack(ten_bit(s, d))


@query("mipi_unpack", f"WITH {TEN} SELECT img_id, y, x, c, v FROM t")
def _(s, d):
    return E.mipi_unpack(E.mipi_pack(ten_bit(s, d)))


@query("math_scalars", f"""WITH {CELLS} SELECT img_id, y, x, abs(v) AS abs_v, floor(v * 10) AS floor_v, ceil(v * 10) AS ceil_v, round_even(v * 100, 0) AS round_v, round(sqrt(abs(v)), 9) AS sqrt_v, round(exp(v), 9) AS exp_v, round(pow(2, v), 9) AS exp2_v,
    round(ln(abs(v) + 1), 9) AS log_v, round(log2(abs(v) + 1), 9) AS log2_v, round(log10(abs(v) + 1), 9) AS log10_v, round(sin(v), 9) AS sin_v, round(cos(v), 9) AS cos_v, round(tan(v), 9) AS tan_v, round(asin(v), 9) AS asin_v, round(acos(v), 9) AS acos_v,
    round(atan(v), 9) AS atan_v, round(atan2(v, 2.0), 9) AS atan2_v, round(pow(abs(v), 1.5), 9) AS pow_v, least(greatest(v, -0.05), 0.05) AS clamp_v, abs(v - 0.1) < 1e-3 AS near_v FROM cells""")
def _(s, d):
    v = F.col("v")
    r = lambda e: F.round(e, 9)
    return real(s, d).select(
        "img_id", "y", "x", F.abs(v).alias("abs_v"), F.floor(v * 10).cast("double").alias("floor_v"), F.ceil(v * 10).cast("double").alias("ceil_v"), F.bround(v * 100, 0).alias("round_v"), r(F.sqrt(F.abs(v))).alias("sqrt_v"), r(F.exp(v)).alias("exp_v"),
        r(F.pow(F.lit(2.0), v)).alias("exp2_v"), r(F.log(F.abs(v) + 1)).alias("log_v"), r(F.log2(F.abs(v) + 1)).alias("log2_v"), r(F.log10(F.abs(v) + 1)).alias("log10_v"), r(F.sin(v)).alias("sin_v"), r(F.cos(v)).alias("cos_v"), r(F.tan(v)).alias("tan_v"),
        r(F.asin(v)).alias("asin_v"), r(F.acos(v)).alias("acos_v"), r(F.atan(v)).alias("atan_v"), r(F.atan2(v, F.lit(2.0))).alias("atan2_v"), r(F.pow(F.abs(v), F.lit(1.5))).alias("pow_v"), N.clamp(v, -0.05, 0.05).alias("clamp_v"), N.nearly_equal(v, F.lit(0.1), 1e-3).alias("near_v"),
    )


@query("activations", f"""WITH {CELLS}, k AS (SELECT img_id, y, x, v * 8 AS v FROM cells) SELECT img_id, y, x, round(1 / (1 + exp(-v)), 9) AS sigmoid_v, round(v / (1 + exp(-v)), 9) AS silu_v, round(v * least(greatest(v + 3, 0), 6) / 6, 9) AS hardswish_v,
    round(v * ((exp(2 * ln(1 + exp(v))) - 1) / (exp(2 * ln(1 + exp(v))) + 1)), 9) AS mish_v, round(0.8 * v / (1 + exp(-1.5 * 0.8 * v)) + 0.2 * v, 9) AS acon_v FROM k""")
def _(s, d):
    k = real(s, d).withColumn("v", F.col("v") * 8)
    v = F.col("v")
    return k.select("img_id", "y", "x", F.round(N.sigmoid(v), 9).alias("sigmoid_v"), F.round(N.silu(v), 9).alias("silu_v"), F.round(N.hardswish(v), 9).alias("hardswish_v"), F.round(N.mish(v), 9).alias("mish_v"), F.round(N.acon(v, 1.0, 0.2, 1.5), 9).alias("acon_v"))


@query("softmax", f"WITH {CELLS}, m AS (SELECT *, exp(v - max(v) OVER (PARTITION BY img_id, y)) AS e FROM cells) SELECT img_id, y, x, round(e / sum(e) OVER (PARTITION BY img_id, y), 9) AS p FROM m")
def _(s, d):
    return E.softmax(real(s, d), "v", "img_id", "y").select("img_id", "y", "x", _r("p", 9))
