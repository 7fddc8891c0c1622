"""Per-entity streams: sources, windowed counts, and keyed state with a time-out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.sources.shared import shared_dir

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """File stream of events; files_per_batch bounds what a batch takes in (back-pressure)."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and return what it wrote: all rows in append and update mode, those of the last batch in
    complete mode. Every batch overwrites a folder of its own in the shared folder, so a batch that is run again counts once and
    nothing passes through the driver."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/gridloom/stream-{uuid.uuid4().hex}"
    done: list[str] = []

    def put(rows: DataFrame, batch: int) -> None:
        path = f"{at}/rows/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        done.append(path)

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    paths = sorted(set(done)) if mode != "complete" else done[-1:]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def window_counts(events: DataFrame, size: str, late: str, *by: str) -> DataFrame:
    """Count and sum per window and key; windows close ``late`` after their end."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), *by)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap))
    return s.agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), "n")


def distinct_within(events: DataFrame, late: str | None, *keys: str) -> DataFrame:
    """The first row of each key. With ``late``, rows that far behind the last ones are dropped and old keys forgotten; without, neither."""
    if late is None:
        return events.dropDuplicates(list(keys))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def _in_order(events: DataFrame, by: str, value: Column, kind: str, start: tuple, fold: Callable, show: Callable, out: str, held: str, late: str | None, idle_ms: int | None) -> DataFrame:
    """Fold each key's rows in the order of (ts, event_id), whichever batch brings them, and show the key after every batch.

    ``fold(state, value)`` gives the next state, ``show(state)`` the output columns after ``by``. Rows that a later batch could
    still precede (all rows without ``late``; else those past the watermark) wait in the state and are folded anew for what is
    shown; older ones are folded for good. A key's state goes once the watermark is ``idle_ms`` past its last row.
    """
    if late is not None:
        events = events.withWatermark("ts", late)
    elif idle_ms is not None:
        raise ValueError("an idle time needs a lateness")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *settled, ts, ids, values = state.get if state.exists else (*start, [], [], [])
        waiting = list(zip(ts, ids, values))
        for rows in batches:
            waiting += zip((rows["ts"].astype("datetime64[us]").astype("int64")).tolist(), rows["event_id"].tolist(), rows["x"].tolist())
        waiting.sort(key=lambda r: r[:2])
        mark = state.getCurrentWatermarkMs() * 1000 if late is not None else None
        settled, done = tuple(settled), 0
        while mark is not None and done < len(waiting) and waiting[done][0] <= mark:
            settled, done = fold(settled, waiting[done][2]), done + 1
        last = waiting[-1][0] // 1000
        waiting = waiting[done:]
        state.update((*settled, *([r[k] for r in waiting] for k in range(3))))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        now = settled
        for r in waiting:
            now = fold(now, r[2])
        yield pd.DataFrame([(key[0], *show(now))], columns=names)

    names = [by, *(c.split()[0] for c in out.split(", "))]
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    keyed = events.select(by, "ts", "event_id", value.cast(kind).alias("x")).groupBy(by)
    state = f"{held}, ts array<bigint>, ids array<bigint>, waiting array<{kind}>"
    return keyed.applyInPandasWithState(step, f"{by} long, {out}", state, "update", timeout)


def low_pass_state(events: DataFrame, by: str, k: float, idle_ms: int | None = 1_800_000, late: str | None = "10 minutes") -> DataFrame:
    """by, n, v: low-pass value of each key's rows in event order after every batch. A key's state is made at first sight and
    goes once the watermark is ``idle_ms`` past its last row (a frame-complete marker, which would allow dropping it at once,
    isn't in the rows). Without both limits no row is dropped and the state holds all rows of a key."""

    def fold(state: tuple, x: float) -> tuple:
        n, v = state
        return n + 1, x if n == 0 else v * k + (1 - k) * x

    return _in_order(events, by, F.col("value"), "double", (0, 0.0), fold, tuple, "n long, v double", "n long, v double", late, idle_ms)


def duty_state(
    events: DataFrame, by: str, flag: Column, window: int = 15, on: float = 0.8, off: float = 0.4, idle_ms: int | None = 1_800_000, late: str | None = "10 minutes"
) -> DataFrame:
    """by, n, duty, state: share of true flags over the last ``window`` rows of each key in event order, with hysteresis, after
    every batch. A key's state goes once the watermark is ``idle_ms`` past its last row. Without both limits no row is dropped and the
    state holds all rows of a key."""

    def fold(state: tuple, f: bool) -> tuple:
        last, n, on_now = state
        last = (last + ("1" if f else "0"))[-window:]
        share = last.count("1") / len(last)
        return last, n + 1, True if share >= on else False if share < off else on_now

    def show(state: tuple) -> tuple:
        last, n, on_now = state
        return n, last.count("1") / max(len(last), 1), on_now

    return _in_order(events, by, flag, "boolean", ("", 0, False), fold, show, "n long, duty double, state boolean", "last string, n long, on_now boolean", late, idle_ms)
