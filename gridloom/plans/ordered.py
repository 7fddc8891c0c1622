"""Queries over ordered series, exercises and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.operators import asof
from gridloom.operators import filters as L
from gridloom.operators import series as S
from gridloom.operators import text as T
from gridloom.plans.registry import query, table
from gridloom.sources.files import pattern

ORD = ["ts", "event_id"]
#: A plane track of positions and velocities, half a time unit a row, pushed by two accelerations; two measurements with correlated noise.
_F = [[1.0, 0.0, 0.5, 0.0], [0.0, 1.0, 0.0, 0.5], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
_H = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.25, 0.0]]
_NOISE = [[0.125, 0.0], [0.0, 0.25], [0.5, 0.0], [0.0, 1.0]]
_Q = [[sum(a * b for a, b in zip(u, v)) for v in _NOISE] for u in _NOISE]
_R = [[4.0, 1.0], [1.0, 9.0]]
_X0, _P0 = [0.0, 0.0, 0.0, 0.0], [[100.0, 0.0, 0.0, 0.0], [0.0, 100.0, 0.0, 0.0], [0.0, 0.0, 10.0, 0.0], [0.0, 0.0, 0.0, 10.0]]
_E = "PARTITION BY user_id ORDER BY ts, event_id"


def events(s, d):
    return table(s, d, "events")


@query("moving_average", f"SELECT event_id, round(avg(value) OVER ({_E} ROWS 4 PRECEDING), 6) AS ma FROM events")
def _(s, d):
    e = events(s, d)
    return e.select("event_id", F.round(S.moving_average(e, "user_id", ORD, "value", 5), 6).alias("ma"))


@query("low_pass", f"""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER ({_E}) AS k FROM events), r(user_id, k, v) AS (SELECT user_id, k, value FROM o WHERE k = 1 UNION ALL SELECT r.user_id, o.k, r.v * 0.9 + 0.1 * o.value FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT user_id, round(v, 6) AS v FROM r JOIN (SELECT user_id, max(k) AS k FROM o GROUP BY 1) USING (user_id, k)""")
def _(s, d):
    return L.low_pass(events(s, d), "user_id", ORD, F.array("value"), 0.9).select("user_id", F.round(F.col("v")[0], 6).alias("v"))


def _constant(e, root):
    """A constant state seeded by the first sample with variance 1."""
    k = L.kalman(e, "user_id", ORD, [F.col("value")], [[1.0]], [[1.0]], [[0.1]], [[4.0]], None, [[1.0]], None, root)
    return k.select("user_id", F.round(F.col("x")[0], 6).alias("x"), F.round(F.col("p")[0], 9).alias("p"))


@query("kalman", f"""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER ({_E}) AS k FROM events), r(user_id, k, x, p) AS (SELECT user_id, k, value, CAST(1 AS DOUBLE) FROM o WHERE k = 1
    UNION ALL SELECT r.user_id, o.k, r.x + (r.p + 0.01) / (r.p + 0.01 + 4.0) * (o.value - r.x), (1 - (r.p + 0.01) / (r.p + 0.01 + 4.0)) * (r.p + 0.01) FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT user_id, round(x, 6) AS x, round(p, 9) AS p FROM r JOIN (SELECT user_id, max(k) AS k FROM o GROUP BY 1) USING (user_id, k)""")
def _(s, d):
    return _constant(events(s, d), None)


@query("kalman_sqrt", f"""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER ({_E}) AS k FROM events), r(user_id, k, x, p) AS (SELECT user_id, k, value, CAST(1 AS DOUBLE) FROM o WHERE k = 1
    UNION ALL SELECT r.user_id, o.k, r.x + (r.p + 0.01) / (r.p + 0.01 + 4.0) * (o.value - r.x), (1 - (r.p + 0.01) / (r.p + 0.01 + 4.0)) * (r.p + 0.01) FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT user_id, round(x, 6) AS x, round(p, 9) AS p FROM r JOIN (SELECT user_id, max(k) AS k FROM o GROUP BY 1) USING (user_id, k)""")
def _(s, d):
    return _constant(events(s, d), "direct")


def _tracks_sql() -> str:
    """The recursion of _F, _H, _Q, _R, predicted and corrected row by row."""
    n = range(4)
    dot = lambda w, terms: " + ".join(f"({c!r}) * {t}" for c, t in zip(w, terms) if c) or "0.0"
    fp = [[dot(_F[i], [f"p{k}{j}" for k in n]) for j in n] for i in n]
    predicted = [f"{dot(_F[i], [f'x{k}' for k in n])} AS x{i}" for i in n]
    predicted += [f"{dot(_F[j], [f'({t})' for t in fp[i]])} + {_Q[i][j]!r} AS p{i}{j}" for i in n for j in n]
    cross = [f"{dot(_H[a], [f'p{i}{k}' for k in n])} AS c{i}{a}" for i in n for a in range(2)]  # P H'
    cross += [f"{dot(_H[a], [f'p{k}{i}' for k in n])} AS d{a}{i}" for i in n for a in range(2)]  # H P: rounding makes it drift from the above
    total = [f"{dot(_H[a], [f'c{k}{b}' for k in n])} + {_R[a][b]!r} AS s{a}{b}" for a in range(2) for b in range(2)]
    gain = [f"(c{i}0 * s11 - c{i}1 * s10) / (s00 * s11 - s01 * s10) AS g{i}0, (c{i}1 * s00 - c{i}0 * s01) / (s00 * s11 - s01 * s10) AS g{i}1" for i in n]
    miss = [f"z{a} - ({dot(_H[a], [f'x{k}' for k in n])})" for a in range(2)]
    after = [f"x{i} + g{i}0 * ({miss[0]}) + g{i}1 * ({miss[1]})" for i in n] + [f"p{i}{j} - g{i}0 * d0{j} - g{i}1 * d1{j}" for i in n for j in n]
    names = [f"x{i}" for i in n] + [f"p{i}{j}" for i in n for j in n]
    start = [f"CAST({v!r} AS DOUBLE)" for v in [*_X0, *(v for row in _P0 for v in row)]]
    return f"""WITH RECURSIVE o AS (SELECT user_id, value AS z0, value * 0.5 + event_id % 17 AS z1, row_number() OVER ({_E}) AS k FROM events),
    r(user_id, k, {', '.join(names)}) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), {', '.join(start)} FROM o UNION ALL SELECT user_id, k, {', '.join(after)} FROM (SELECT *, {', '.join(gain)} FROM (SELECT *, {', '.join(total)} FROM (SELECT *, {', '.join(cross)} FROM
    (SELECT o.user_id, o.k, o.z0, o.z1, {', '.join(predicted)} FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)))))
    SELECT user_id, {', '.join(f'round({c}, 6) AS {c}' for c in names)} FROM r JOIN (SELECT user_id, max(k) AS k FROM o GROUP BY 1) USING (user_id, k)"""


def _tracks(e, root):
    k = L.kalman(e, "user_id", ORD, [F.col("value"), F.col("value") * 0.5 + F.col("event_id") % 17], _F, _H, _NOISE, _R, _X0, _P0, None, root)
    state, spread = [F.round(F.col("x")[i], 6).alias(f"x{i}") for i in range(4)], [F.round(F.col("p")[4 * i + j], 6).alias(f"p{i}{j}") for i in range(4) for j in range(4)]
    return k.select("user_id", *state, *spread)


@query("kalman_tracks", _tracks_sql())
def _(s, d):
    return _tracks(events(s, d), None)


@query("kalman_tracks_direct", _tracks_sql())
def _(s, d):
    return _tracks(events(s, d), "direct")


@query("kalman_tracks_symmetric", _tracks_sql())
def _(s, d):
    return _tracks(events(s, d), "symmetric")


@query("find_homography")
def _(s, d):
    c = table(s, d, "customer").select("c_nationkey", (F.col("c_custkey") % 97).cast("double").alias("sx"), (F.col("c_acctbal") / 100).alias("sy"))
    w = 0.001 * F.col("sx") + 1
    moved = c.withColumn("tx", (1.1 * F.col("sx") + 0.2 * F.col("sy") + 3) / w).withColumn("ty", (0.9 * F.col("sy") - 0.1 * F.col("sx") + 5) / w)
    return S.find_homography(moved, "c_nationkey")


@query("frame_rate", f"WITH g AS (SELECT event_id, epoch_ns(ts) // 1000000 - lag(epoch_ns(ts) // 1000000) OVER ({_E}) AS gap FROM events) SELECT event_id, round(CASE WHEN gap > 0 THEN 1000.0 / gap ELSE 0 END, 9) AS fps FROM g")
def _(s, d):
    return events(s, d).select("event_id", F.round(S.frame_rate("user_id", ORD, F.unix_millis(F.col("ts").cast("timestamp"))), 9).alias("fps"))


@query("duty_factor", f"WITH w AS (SELECT *, avg(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER ({_E} ROWS 14 PRECEDING) AS duty FROM events), m AS (SELECT *, CASE WHEN duty >= 0.6 THEN 1 WHEN duty < 0.4 THEN 0 END AS mark FROM w) SELECT event_id, round(duty, 9) AS duty, coalesce(last_value(mark IGNORE NULLS) OVER ({_E} ROWS UNBOUNDED PRECEDING), 0) = 1 AS state FROM m")
def _(s, d):
    e = S.duty(events(s, d), "user_id", ORD, F.col("value") > 50)
    return S.hysteresis(e, "user_id", ORD, 0.6, 0.4).select("event_id", F.round("duty", 9).alias("duty"), "state")


@query("bounded_history", f"SELECT event_id, array_to_string(list(event_type) OVER ({_E} ROWS 3 PRECEDING), ',') AS history FROM events")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy(*ORD).rowsBetween(-3, 0)
    return events(s, d).select("event_id", F.array_join(F.collect_list("event_type").over(w), ",").alias("history"))


@query("blink_frequency", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error'")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return events(s, d).where("event_type = 'error'").select("event_id", F.count("*").over(w).alias("n"))


@query("silence_reset", f"WITH g AS (SELECT *, CASE WHEN lag(ts) OVER ({_E}) IS NULL OR ts - lag(ts) OVER ({_E}) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events), k AS (SELECT *, sum(n) OVER ({_E} ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(event_id) AS first_id, count(*) AS n FROM k GROUP BY user_id, k")
def _(s, d):
    e = events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n")).drop("session_window")


@query("due_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts + to_microseconds(CAST(value * 1000000 AS BIGINT)), event_id) AS pos FROM events WHERE event_type <> 'error'")
def _(s, d):
    due = F.unix_micros(F.col("ts").cast("timestamp")) + F.bround(F.col("value") * 1_000_000, 0).cast("long")
    return events(s, d).where("event_type <> 'error'").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(due, "event_id")).alias("pos"))


@query("merge_intervals", """WITH i AS (SELECT p_brand, p_partkey % 200 * 5 AS lo, p_partkey % 200 * 5 + p_size % 10 AS hi FROM part), a AS (SELECT *, max(hi) OVER (PARTITION BY p_brand ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM i),
    b AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT p_brand, min(lo) AS lo, max(hi) AS hi FROM b GROUP BY p_brand, g""")
def _(s, d):
    i = table(s, d, "part").select("p_brand", (F.col("p_partkey") % 200 * 5).alias("lo"), (F.col("p_partkey") % 200 * 5 + F.col("p_size") % 10).alias("hi"))
    return S.merge_intervals(i, "p_brand", "lo", "hi")


@query("interpolate", """WITH a AS (SELECT c_mktsegment AS g, CAST(c_custkey % 1000 AS DOUBLE) AS t, avg(c_acctbal) AS value FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1, 2), q AS (SELECT DISTINCT c_mktsegment AS g, CAST(c_custkey % 1000 AS DOUBLE) AS t FROM customer WHERE c_custkey % 7 = 0),
    lo AS (SELECT q.g, q.t, max(a.t) AS t0 FROM q LEFT JOIN a ON a.g = q.g AND a.t <= q.t GROUP BY 1, 2), hi AS (SELECT q.g, q.t, min(a.t) AS t1 FROM q LEFT JOIN a ON a.g = q.g AND a.t >= q.t GROUP BY 1, 2)
    SELECT lo.g, lo.t, round(CASE WHEN t0 = t1 THEN x.value ELSE x.value + (y.value - x.value) / (t1 - t0) * (lo.t - t0) END, 5) AS value FROM lo JOIN hi USING (g, t) LEFT JOIN a x ON x.g = lo.g AND x.t = t0 LEFT JOIN a y ON y.g = lo.g AND y.t = t1""")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_mktsegment").alias("g"), (F.col("c_custkey") % 1000).cast("double").alias("t"), F.col("c_acctbal").alias("value"), "c_custkey")
    a = c.where("c_custkey % 7 <> 0").groupBy("g", "t").agg(F.avg("value").alias("value"))
    return S.interpolate(a, c.where("c_custkey % 7 = 0").select("g", "t").distinct(), "g").withColumn("value", F.round("value", 5))


@query("linear_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@query("newton_interpolation", "SELECT p_partkey, round(1 + (p_size - 1) * (3 + (p_size - 2) * 1.0), 6) AS y FROM part")
def _(s, d):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0]
    return table(s, d, "part").select("p_partkey", F.round(S.newton(xs, [x * x for x in xs], F.col("p_size").cast("double")), 6).alias("y"))


@query("cubic_fit")
def _(s, d):
    return S.polynomial_fit(table(s, d, "lineitem"), "l_returnflag", "l_discount", "l_extendedprice", 3)


@query("ransac_cubic")
def _(s, d):
    p = table(s, d, "part").withColumn("t", F.col("p_size") / 50.0)
    return S.ransac_cubic(p, "p_brand", "t", "p_retailprice", 150.0)


@query("bspline_basis", "WITH t AS (SELECT p_partkey, p_size / 51.0 * 4 AS t FROM part) SELECT p_partkey, round(CASE WHEN t < 1 THEN t * t / 2 WHEN t < 2 THEN (-2 * t * t + 6 * t - 3) / 2 WHEN t < 3 THEN (3 - t) * (3 - t) / 2 ELSE 0 END, 9) AS b FROM t")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.round(S.bspline_basis(F.col("p_size") / 51.0 * 4, 0, 2, [0.0, 1.0, 2.0, 3.0]), 9).alias("b"))


_KNOTS = [0.0, 0.0, 0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0, 1.0, 1.0]


@query("bspline_fit")
def _(s, d):
    p = table(s, d, "part").withColumn("t", F.col("p_size") / 50.0)
    fit = S.bspline_fit(p, "p_brand", "t", "p_retailprice", 3, _KNOTS)
    at = fit.select("p_brand", "n", "coef", F.explode(F.array(*(F.lit(i / 10) for i in range(11)))).alias("t"))
    return at.select("p_brand", "n", "t", F.round(S.bspline_value(F.col("coef"), F.col("t"), 3, _KNOTS), 4).alias("y"))


@query("bspline_bases", """WITH t AS (SELECT p_partkey, p_size / 50.0 * 3 AS t FROM part), b AS (SELECT p_partkey, CASE WHEN t < 1 THEN (1 - t) * (1 - t) ELSE 0 END AS b0, CASE WHEN t < 1 THEN t * (2 - 1.5 * t) WHEN t < 2 THEN (2 - t) * (2 - t) / 2 ELSE 0 END AS b1,
    CASE WHEN t < 1 THEN t * t / 2 WHEN t < 2 THEN -t * t + 3 * t - 1.5 ELSE (3 - t) * (3 - t) / 2 END AS b2, CASE WHEN t < 2 THEN 0 ELSE (t - 2) * (t - 2) END AS b4 FROM t)
    SELECT p_partkey, round(b0, 9) AS b0, round(b1, 9) AS b1, round(b2, 9) AS b2, round(1 - b0 - b1 - b2 - b4, 9) AS b3, round(b4, 9) AS b4 FROM b""")
def _(s, d):
    bases = S.bspline_bases(F.col("p_size") / 50.0 * 3, 2, [0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 3.0, 3.0])
    return table(s, d, "part").select("p_partkey", *(F.round(b, 9).alias(f"b{i}") for i, b in enumerate(bases)))


@query("feature_ema", """WITH RECURSIVE c AS (SELECT label, vec_id, i, CAST(embedding[i] AS DOUBLE) AS v, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    r(label, i, k, v) AS (SELECT label, i, k, v FROM c WHERE k = 1 UNION ALL SELECT r.label, r.i, c.k, r.v * (1 - 0.067) + 0.067 * c.v FROM r JOIN c ON c.label = r.label AND c.i = r.i AND c.k = r.k + 1)
    SELECT label, CAST(i - 1 AS INT) AS pos, round(v, 7) AS v FROM r JOIN (SELECT label, max(k) AS k FROM c GROUP BY 1) USING (label, k)""")
def _(s, d):
    a = L.low_pass(table(s, d, "embeddings"), "label", ["vec_id"], F.col("embedding").cast("array<double>"), 1 - 0.067)
    return a.select("label", F.posexplode("v").alias("pos", "v")).withColumn("v", F.round("v", 7))


_ARR = "a AS (SELECT user_id, list(CAST(floor(value) AS INT) ORDER BY ts, event_id) AS v FROM events GROUP BY 1)"


def arrays(s, d):
    return S.ordered_array(events(s, d).withColumn("value", F.floor("value").cast("int")), "user_id", ORD, "value").withColumnRenamed("values", "v")


@query("array_distinct", f"WITH {_ARR} SELECT user_id, len(list_distinct(v)) AS n FROM a")
def _(s, d):
    return arrays(s, d).select("user_id", F.size(F.array_distinct("v")).alias("n"))


@query("keep_two", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(value) AS INT) ORDER BY event_id) AS k FROM events) SELECT user_id, event_id FROM r WHERE k <= 2")
def _(s, d):
    k = F.row_number().over(Window.partitionBy("user_id", F.floor("value").cast("int")).orderBy("event_id"))
    return events(s, d).withColumn("k", k).where("k <= 2").select("user_id", "event_id")


@query("drop_all_duplicated", "SELECT user_id, CAST(floor(value) AS INT) AS v FROM events GROUP BY 1, 2 HAVING count(*) = 1")
def _(s, d):
    return events(s, d).groupBy("user_id", F.floor("value").cast("int").alias("v")).count().where("count = 1").select("user_id", "v")


@query("remove_element", f"WITH {_ARR} SELECT user_id, len(list_filter(v, lambda x: x <> 3)) AS n FROM a")
def _(s, d):
    return arrays(s, d).select("user_id", F.size(F.array_remove("v", 3)).alias("n"))


@query("max_profit", "WITH m AS (SELECT user_id, value - min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, round(max(p), 6) AS profit FROM m GROUP BY 1")
def _(s, d):
    a = S.ordered_array(events(s, d), "user_id", ORD, "value")
    return a.select("user_id", F.round(A.max_profit(F.col("values")), 6).alias("profit"))


@query("sum_of_rises", "WITH m AS (SELECT user_id, greatest(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS r FROM events) SELECT user_id, round(coalesce(sum(r), 0), 4) AS rises FROM m GROUP BY 1")
def _(s, d):
    a = S.ordered_array(events(s, d), "user_id", ORD, "value")
    return a.select("user_id", F.round(A.sum_of_rises(F.col("values")), 4).alias("rises"))


@query("product_except_self", """WITH e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) * 8 AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), p AS (SELECT a.vec_id, a.i, product(b.v) AS p FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <> b.i GROUP BY 1, 2)
    SELECT vec_id, CAST(i - 1 AS INT) AS pos, CAST(sign(p) AS INT) AS side, round(ln(abs(p)), 6) AS size FROM p WHERE p <> 0""")
def _(s, d):
    v = F.transform("embedding", lambda x: x.cast("double") * 8)
    e = table(s, d, "embeddings").select("vec_id", F.posexplode(A.product_except_self(v)).alias("pos", "p")).where("p <> 0")
    return e.select("vec_id", "pos", F.signum("p").cast("int").alias("side"), F.round(F.log(F.abs("p")), 6).alias("size"))


@query("jump_game", f"WITH {_ARR}, e AS (SELECT user_id, unnest(list_transform(v, lambda x: x % 7)) AS x, unnest(range(0, len(v))) AS i FROM a), m AS (SELECT *, coalesce(max(i + x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM e) SELECT user_id, bool_and(r >= i) AS ok FROM m GROUP BY 1")
def _(s, d):
    return arrays(s, d).select("user_id", A.can_reach_end(F.transform("v", lambda x: x % 7)).alias("ok"))


@query("climbing_stairs", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(1 AS BIGINT), CAST(2 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 60) SELECT p_partkey, a AS ways FROM part JOIN f ON n = p_size")
def _(s, d):
    return table(s, d, "part").select("p_partkey", A.stairs(F.col("p_size")).alias("ways"))


@query("triangle_min_path", """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), r(vec_id, v, n, best) AS (SELECT vec_id, v, 1, [v[1]] FROM e
    UNION ALL SELECT vec_id, v, n + 1, list_transform(range(1, n + 2), lambda i: v[n * (n + 1) // 2 + i] + least(coalesce(best[i - 1], 1e300), coalesce(best[i], 1e300))) FROM r WHERE n * (n + 1) // 2 < len(v))
    SELECT vec_id, round(list_min(arg_max(best, n)), 5) AS best FROM r GROUP BY 1""")
def _(s, d):
    """All 64 components: rows of 1 to 10, and of the 11th the 9 that are left; places that aren't there can't be stepped on."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = [F.slice(e, 1 + n * (n - 1) // 2, n) for n in range(1, 11)] + [F.concat(F.slice(e, 56, 9), F.array(F.lit(1e300), F.lit(1e300)))]
    return table(s, d, "embeddings").select("vec_id", F.round(A.triangle_min_path(F.array(*rows)), 5).alias("best"))


@query("longest_unique_substring", """WITH RECURSIVE c AS (SELECT c_custkey, replace(c_name, ' ', '') AS t FROM customer), r(c_custkey, t, i, run, best) AS (SELECT c_custkey, t, 0, '', 0 FROM c
    UNION ALL SELECT c_custkey, t, i + 1, CASE WHEN contains(run, t[i + 1]) THEN run[strpos(run, t[i + 1]) + 1:] ELSE run END || t[i + 1], greatest(best, length(CASE WHEN contains(run, t[i + 1]) THEN run[strpos(run, t[i + 1]) + 1:] ELSE run END) + 1) FROM r WHERE i < length(t))
    SELECT c_custkey, CAST(max(best) AS INT) AS n FROM r GROUP BY 1""")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", A.longest_unique_run(F.replace("c_name", F.lit(" "), F.lit(""))).alias("n"))


@query("longest_palindrome", "WITH s AS (SELECT c_custkey, replace(c_name, ' ', '') AS t FROM customer), p AS (SELECT c_custkey, t, i, unnest(range(1, length(t) - i + 2)) AS n FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM s)) SELECT c_custkey, CAST(max(n) AS INT) AS n FROM p WHERE t[i:i + n - 1] = reverse(t[i:i + n - 1]) GROUP BY 1")
def _(s, d):
    t = table(s, d, "customer").select("c_custkey", F.replace("c_name", F.lit(" "), F.lit("")).alias("t"))
    p = t.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("t")))).withColumn("n", F.explode(F.sequence(F.lit(1), F.length("t") - F.col("i") + 1)))
    sub = F.substring("t", F.col("i"), F.col("n"))
    return p.where(sub == F.reverse(sub)).groupBy("c_custkey").agg(F.max("n").alias("n"))


_PEELED = "replace(replace(replace(s, '()', ''), '[]', ''), '{}', '')"


@query("balanced_brackets", rf"""WITH RECURSIVE r(conv_id, turn, s, k) AS (SELECT conv_id, turn, regexp_replace(text, '[^()\[\]{{}}]', '', 'g'), 0 FROM conversations UNION ALL SELECT conv_id, turn, {_PEELED}, k + 1 FROM r WHERE {_PEELED} <> s)
    SELECT conv_id, turn, arg_max(s, k) = '' AS ok FROM r GROUP BY 1, 2""")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", A.balanced(F.col("text")).alias("ok"))


@query("is_subsequence", "SELECT p_partkey, regexp_matches(p_name, 'a.*e.*r') AS ok FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", A.is_subsequence("aer", F.col("p_name")).alias("ok"))


@query("remove_nth_from_end", f"WITH {_ARR} SELECT user_id, array_to_string(CASE WHEN len(v) >= 3 THEN v[1:len(v) - 3] || v[len(v) - 1:] ELSE v END, ',') AS v FROM a")
def _(s, d):
    """The third from the end; shorter arrays stay as they are."""
    a, n = F.col("v"), F.size("v")
    cut = F.concat(F.slice(a, F.lit(1), F.greatest(n - 3, F.lit(0))), F.slice(a, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    return arrays(s, d).select("user_id", F.array_join(F.when(n >= 3, cut).otherwise(a), ",").alias("v"))


@query("string_arithmetic", "SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 9876543210987654321 AS VARCHAR) AS product, CAST(CAST(o_orderkey AS HUGEINT) + 9876543210987654321 AS VARCHAR) AS total FROM orders")
def _(s, d):
    big = F.lit("9876543210987654321").cast("decimal(20,0)")
    k = F.col("o_orderkey").cast("string").cast("decimal(17,0)")
    return table(s, d, "orders").select("o_orderkey", (k * big).cast("string").alias("product"), (k + big).cast("string").alias("total"))


@query("long_arithmetic", """WITH RECURSIVE n AS (SELECT s_suppkey AS id, repeat(CAST(s_suppkey * 7919 + 13 AS VARCHAR), 25) AS a, reverse(repeat(CAST(s_suppkey + 104729 AS VARCHAR), 20)) AS b FROM supplier),
    x AS (SELECT id, i, CAST(substr(a, length(a) - i, 1) AS BIGINT) AS v FROM (SELECT *, unnest(range(0, length(a))) AS i FROM n)), y AS (SELECT id, i, CAST(substr(b, length(b) - i, 1) AS BIGINT) AS v FROM (SELECT *, unnest(range(0, length(b))) AS i FROM n)),
    c AS (SELECT 'product' AS op, id, x.i + y.i AS k, CAST(sum(x.v * y.v) AS BIGINT) AS s FROM x JOIN y USING (id) GROUP BY 2, 3 UNION ALL SELECT 'total', id, i AS k, CAST(sum(v) AS BIGINT) FROM (FROM x UNION ALL FROM y) GROUP BY 2, 3),
    r(op, id, k, over, t) AS (SELECT DISTINCT op, id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), '' FROM c UNION ALL SELECT r.op, r.id, c.k, (r.over + c.s) // 10, CAST((r.over + c.s) % 10 AS VARCHAR) || r.t FROM r JOIN c ON c.op = r.op AND c.id = r.id AND c.k = r.k + 1),
    e AS (SELECT op, id, ltrim(arg_max(CAST(over AS VARCHAR) || t, k), '0') AS t FROM r GROUP BY 1, 2) SELECT id AS s_suppkey, max(t) FILTER (op = 'product') AS product, max(t) FILTER (op = 'total') AS total FROM e GROUP BY 1""")
def _(s, d):
    k = F.col("s_suppkey")
    n = table(s, d, "supplier").select(k, F.repeat((k * 7919 + 13).cast("string"), 25).alias("a"), F.reverse(F.repeat((k + 104729).cast("string"), 20)).alias("b"))
    return n.select("s_suppkey", A.long_product(F.col("a"), F.col("b")).alias("product"), A.long_sum(F.col("a"), F.col("b")).alias("total"))


@query("avatar_url", "SELECT c_custkey, 'https://gravatar.com/avatar/' || md5(lower(trim(c_name))) || '?s=200&d=retro' AS url FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.concat(F.lit("https://gravatar.com/avatar/"), F.md5(F.lower(F.trim("c_name"))), F.lit("?s=200&d=retro")).alias("url"))


@query("format_times", "SELECT event_id, lpad(printf('%.2f', value), 12, ' ') || ' ms' AS t FROM events")
def _(s, d):
    return events(s, d).select("event_id", F.concat(F.lpad(F.format_string("%.2f", "value"), 12, " "), F.lit(" ms")).alias("t"))


@query("sort_values", f"WITH {_ARR} SELECT user_id, array_to_string(list_sort(v), ',') AS v FROM a")
def _(s, d):
    return arrays(s, d).select("user_id", F.array_join(F.array_sort("v"), ",").alias("v"))


@query("merge_sorted", "SELECT s_suppkey AS id, 0 AS src, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS pos FROM supplier")
def _(s, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    t = table(s, d, "supplier")
    both = t.where("s_suppkey % 2 = 0").unionByName(t.where("s_suppkey % 2 <> 0"))
    return both.select(F.col("s_suppkey").alias("id"), F.lit(0).alias("src"), F.col("s_acctbal").alias("v"), F.row_number().over(w).alias("pos"))


@query("insert_position", f"WITH {_ARR} SELECT user_id, len(list_filter(v, lambda x: x < 10)) AS pos, list_contains(v, 10) AS found FROM a")
def _(s, d):
    return arrays(s, d).select("user_id", F.size(F.filter("v", lambda x: x < 10)).alias("pos"), F.array_contains("v", 10).alias("found"))


@query("link_extraction", r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>')) AS a, unnest(range(0, len(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>')))) AS seq FROM pages),
    l AS (SELECT page_id, seq, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(a, '(?is)>(.*)</a>', 1), '<[^>]*>', '', 'g')) AS label FROM a) SELECT page_id, CAST(seq AS INT) AS seq, href, label FROM l WHERE lower(label) NOT IN ('all', 'prev', 'next')""")
def _(s, d):
    return T.links(table(s, d, "pages"))


@query("address_symbols", """WITH a AS (SELECT DISTINCT '0x' || to_hex(CAST(c_custkey * 7919 + 11 AS BIGINT)) AS address, CAST(c_custkey * 7919 + 11 AS BIGINT) AS v FROM customer), m AS (SELECT CAST(p_partkey * 4096 + 9000 AS BIGINT) AS start, p_name AS name, p_size * 64 + 500 AS size FROM part)
    SELECT address, CASE WHEN v < start + size THEN name END AS name, CASE WHEN v < start + size THEN v - start ELSE -1 END AS away FROM a ASOF LEFT JOIN m ON v >= start""")
def _(s, d):
    line = F.concat(F.lit("at 0x"), F.hex(F.col("c_custkey") * 7919 + 11))
    symbols = table(s, d, "part").select(F.col("p_name").alias("name"), (F.col("p_partkey") * 4096 + 9000).alias("start"), (F.col("p_size") * 64 + 500).cast("bigint").alias("size"))
    found = asof.symbols_of(T.addresses(table(s, d, "customer").select(line.alias("line")), "line"), symbols)
    return found.withColumn("away", F.coalesce(F.col("away").cast("bigint"), F.lit(-1)))


@query("address_extraction", "WITH l AS (SELECT 'at 0x' || to_hex(CAST(c_custkey * 7919 AS BIGINT)) || ' called from 0x' || to_hex(CAST(c_nationkey AS BIGINT)) AS line FROM customer) SELECT DISTINCT unnest(regexp_extract_all(line, '0x[0-9a-fA-F]+')) AS address FROM l")
def _(s, d):
    line = F.concat(F.lit("at 0x"), F.hex(F.col("c_custkey") * 7919), F.lit(" called from 0x"), F.hex("c_nationkey"))
    return T.addresses(table(s, d, "customer").select(line.alias("line")), "line")


@query("kitti_lines", "SELECT p_partkey, p_brand || ' 0.0 0 0.0 ' || printf('%.2f', CAST(p_size AS DOUBLE)) || ' ' || printf('%.2f', CAST(p_partkey % 50 AS DOUBLE)) || ' ' || printf('%.2f', CAST(p_size + 10 AS DOUBLE)) || ' ' || printf('%.2f', CAST(p_partkey % 50 + 20 AS DOUBLE)) || ' 0.0 0.0 0.0 0.0 0.0 0.0 0.0' AS line FROM part")
def _(s, d):
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")
    return table(s, d, "part").select("p_partkey", T.kitti_line(F.col("p_brand"), x, y, F.lit(10.0), F.lit(20.0)).alias("line"))


@query("json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def _(s, d):
    return events(s, d).groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("k"))


@query("synthetic_patterns", """WITH g AS (SELECT CAST(i // 48 AS INT) AS y, CAST(i % 48 AS INT) AS x FROM (SELECT unnest(range(0, 1536)) AS i)) SELECT y, x, round(2.0 * x / 47 - 1, 9) AS gradient, CASE WHEN (x // 8 + y // 8) % 2 = 0 THEN 1.0 ELSE -1.0 END AS checker, CASE WHEN x < 24 THEN -1.0 ELSE 1.0 END AS step FROM g""")
def _(s, d):
    a, b, c = (pattern(s, n, 32, 48).withColumnRenamed("v", m) for n, m in (("GRADIENT", "gradient"), ("CHECKERBOARD", "checker"), ("STEP_FUNCTION", "step")))
    return a.join(b, ["y", "x"]).join(c, ["y", "x"]).withColumn("gradient", F.round("gradient", 9))
