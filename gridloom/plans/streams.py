"""Streaming queries, each drained over the events table and checked against its batch twin in SQL.

No query bounds lateness where that would drop rows, so the answer doesn't depend on files and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.plans.registry import query
from gridloom.streaming import entities as S


def stream(s, d):
    return S.read_events(s, f"{d}/events*.parquet")  # a pattern: a file stream takes folders and patterns


@query("stream_window_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP), TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    w = S.drain(S.window_counts(stream(s, d), "1 hour", "10 minutes", "event_type"), "complete")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_low_pass", """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), r(user_id, k, v) AS (SELECT user_id, k, value FROM o WHERE k = 1 UNION ALL SELECT r.user_id, o.k, r.v * 0.9 + 0.1 * o.value FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT user_id, k AS n, round(v, 6) AS v FROM r JOIN (SELECT user_id, max(k) AS k FROM o GROUP BY 1) USING (user_id, k)""")
def _(s, d):
    out = S.drain(S.low_pass_state(stream(s, d), "user_id", 0.9, idle_ms=None, late=None), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("v", "n"), 6).alias("v"))


@query("stream_duty", """WITH w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, avg(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 14 PRECEDING) AS duty FROM events),
    m AS (SELECT *, last_value(CASE WHEN duty >= 0.6 THEN 1 WHEN duty < 0.4 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM w) SELECT user_id, max(n) AS n, round(arg_max(duty, n), 9) AS duty, coalesce(arg_max(s, n), 0) = 1 AS state FROM m GROUP BY 1""")
def _(s, d):
    out = S.drain(S.duty_state(stream(s, d), "user_id", F.col("value") > 50, 15, 0.6, 0.4, idle_ms=None, late=None), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("duty", "n"), 9).alias("duty"), F.max_by("state", "n").alias("state"))


@query("stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(s, d):
    return S.drain(S.distinct_within(stream(s, d), None, "user_id", "event_type").select("user_id", "event_type"), "append").distinct()
