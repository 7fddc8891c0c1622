"""Recursive filters over keyed series, folded by an associative composition of their steps.

A step of such a filter is a map of the state. Rows are range-partitioned by (key, order), so a key's rows are spread over as
many tasks as they fill; each task composes the maps of its stretch of a key to one, and a key's few maps (one a task at most)
are composed in a second shuffle. No key is an array or one task's rows, whatever its share.

Rows without a key or, in low_pass, without a value take no part. An empty table gives no rows. Equal places in the order are put in
the order of the values. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Flat = np.ndarray  # (rows, numbers of a step)
Combine = Callable[[Flat, Flat], Flat]


def compose_runs(flat: Flat, keys: np.ndarray, combine: Combine) -> Flat:
    """One step for each run of equal keys: neighbours are composed by halves, all runs at once."""
    run = np.cumsum(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    while len(run) > 1 and (same := run[1:] == run[:-1]).any():
        at = np.arange(len(run))
        left = (at - np.maximum.accumulate(np.where(np.r_[True, ~same], at, 0))) % 2 == 0
        pair = np.flatnonzero(left & np.r_[same, False])
        flat = flat.copy()
        flat[pair] = combine(flat[pair], flat[pair + 1])
        flat, run = flat[left], run[left]
    return flat


def fold(rows: DataFrame, by: str, order: list[str], value: Column, lift: Callable[[np.ndarray], Flat], combine: Combine, finish: Callable[[Flat], dict[str, list]], out: str) -> DataFrame:
    """by and what ``finish`` makes of each key's composed step. ``value`` is an array of doubles, all of one length; ``lift`` turns
    them into steps. Memory of a task: a batch of rows, and of a key at most one step a task of the first shuffle."""
    kind = rows.schema[by].dataType.simpleString()

    def composed(batches: Iterator[pd.DataFrame], column: str, make: Callable[[np.ndarray], Flat]) -> Iterator[tuple[np.ndarray, Flat]]:
        keys, flat = None, None  # of the run that is still open
        for batch in batches:
            if batch.empty:
                continue
            more, steps = batch["key_"].to_numpy(), make(np.stack([np.asarray(v, float) for v in batch[column]]))
            keys, flat = (more, steps) if keys is None else (np.concatenate([keys, more]), np.concatenate([flat, steps]))
            flat, keys = compose_runs(flat, keys, combine), keys[np.r_[True, keys[1:] != keys[:-1]]]
            if len(keys) > 1:
                yield keys[:-1], flat[:-1]
                keys, flat = keys[-1:], flat[-1:]
        if keys is not None:
            yield keys, flat

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for keys, flat in composed(batches, "value_", lift):
            yield pd.DataFrame({"key_": keys, "part_": part, "step_": list(flat)})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, flat in composed(batches, "step_", lambda steps: steps):
            yield pd.DataFrame({by: keys, **finish(flat)})

    places = [F.col(c).alias(f"order{i}_") for i, c in enumerate(order)]
    named = [f"order{i}_" for i in range(len(order))]
    spread = rows.where(F.col(by).isNotNull()).select(F.col(by).alias("key_"), *places, value.alias("value_"))
    spread = spread.repartitionByRange("key_", *named).sortWithinPartitions("key_", *named, "value_").select("key_", "value_")
    few = spread.mapInPandas(stretches, f"key_ {kind}, part_ int, step_ array<double>")
    return few.repartition("key_").sortWithinPartitions("key_", "part_").mapInPandas(whole, f"{by} {kind}, {out}")


def low_pass(rows: DataFrame, by: str, order: list[str], value: Column, k: float) -> DataFrame:
    """by, v: the last value of prev * k + (1 - k) * x, seeded by the first sample, for each component of the array ``value``.

    A stretch is its first sample and the affine map of the others, since only the key's first sample seeds. Null values take no part;
    a null component counts as not a number from there on. Arrays must be of one length."""

    def parts(s: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = (s.shape[1] - 1) // 2
        return s[:, :d], s[:, d : d + 1], s[:, d + 1 :]

    def lift(x: np.ndarray) -> Flat:
        return np.concatenate([x, np.ones((len(x), 1)), np.zeros_like(x)], 1)

    def combine(l: Flat, r: Flat) -> Flat:
        (seed, a, b), (x, c, d) = parts(l), parts(r)
        return np.concatenate([seed, a * k * c, c * (k * b + (1 - k) * x) + d], 1)

    def finish(s: Flat) -> dict[str, list]:
        seed, a, b = parts(s)
        return {"v": list(a * seed + b)}

    return fold(rows.where(value.isNotNull()), by, order, value, lift, combine, finish, "v array<double>")


def lower(m: np.ndarray) -> np.ndarray:
    """The lower triangular L with L L' = m m' (stacks of matrices)."""
    return np.linalg.qr(np.swapaxes(m, -1, -2), mode="r").swapaxes(-1, -2)


def predict_root(s: np.ndarray, f: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Root of F S S' F' + N N'."""
    return lower(np.concatenate([f @ s, noise], -1))


def correct_direct(s: np.ndarray, h: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and corrected root by S - S a W'^-1 (W + V)^-1 a', where a = S'H', W W' = a'a + V V' (Andrews; Potter's for one
    measurement). Exact for any number of measurements, also where their noises are correlated."""
    a = s.T @ h.T
    w = np.linalg.cholesky(a.T @ a + v @ v.T)
    gain = s @ a @ np.linalg.inv(w @ w.T)
    return gain, s @ (np.eye(len(s)) - a @ np.linalg.inv(w.T) @ np.linalg.inv(w + v) @ a.T)


def correct_symmetric(s: np.ndarray, h: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and corrected root by Joseph's form: the triangular root of ((I - K H) S : K V)."""
    a = s.T @ h.T
    gain = s @ a @ np.linalg.inv(a.T @ a + v @ v.T)
    return gain, lower(np.concatenate([(np.eye(len(s)) - gain @ h) @ s, gain @ v], -1))


CORRECTIONS = {"direct": correct_direct, "symmetric": correct_symmetric}


def kalman(
    rows: DataFrame, by: str, order: list[str], measured: list[Column], f: list[list[float]], h: list[list[float]], noise: list[list[float]], r: list[list[float]],
    x0: list[float] | None, p0: list[list[float]], u: list[float] | None = None, root: str | None = None,
) -> DataFrame:
    """by, x, p (row by row): state and covariance after a key's last row of x = F x + u, P = F P F' + N N' and the correction by
    the measurements z = H x + noise of covariance R; P0 and R positive definite.

    A step is the law of the next state given the last one, and what the measurement says of the last one: (A, b, C, eta, J); these
    compose associatively (Sarkka and Garcia-Fernandez 2021). With ``root`` C and J are carried as triangular roots, composed by
    QR (Yaghoobi and others 2022), and each row's correction is "direct" or "symmetric". Without x0 a key's first row is its
    first state (as many measurements as states), and rows that lack a measurement take no part; else they are predicted over only."""
    fm, hm, nm, rm = (np.array(m, float) for m in (f, h, noise, r))
    n, m = len(fm), len(hm)
    um = np.zeros(n) if u is None else np.array(u, float)
    seeded = x0 is None
    if seeded and m != n:
        raise ValueError("a first row that is the state needs as many measurements as states")
    ends = np.cumsum([n * n, n, n * n, n])
    eye, v, q_root = np.eye(n), np.linalg.cholesky(rm), predict_root(np.zeros((n, n)), fm, nm)
    t = lambda a: np.swapaxes(a, -1, -2)
    dot = lambda a, x: np.einsum("...ij,...j->...i", a, x)

    def unpack(s: Flat) -> tuple[np.ndarray, ...]:
        a, b, c, e, j = np.split(s, ends, axis=1)
        return a.reshape(-1, n, n), b, c.reshape(-1, n, n), e, j.reshape(-1, n, n)

    def pack(k: int, *parts: np.ndarray) -> Flat:
        return np.concatenate([np.broadcast_to(p, (k, *p.shape[p.ndim - w :])).reshape(k, -1) for p, w in zip(parts, (2, 1, 2, 1, 2))], 1)

    total = hm @ nm @ nm.T @ hm.T + rm
    weight = fm.T @ hm.T @ np.linalg.inv(total)  # of a miss, in what it says of the state before
    if root:
        gain, after = CORRECTIONS[root](q_root, hm, v)
        told = lower(np.concatenate([fm.T @ hm.T @ np.linalg.inv(np.linalg.cholesky(total)).T, np.zeros((n, n))], 1))[:, :n]
    else:
        gain = nm @ nm.T @ hm.T @ np.linalg.inv(total)
        after, told = (eye - gain @ hm) @ nm @ nm.T, weight @ hm @ fm
    before = q_root if root else nm @ nm.T

    def step(z: np.ndarray) -> Flat:
        known = np.isfinite(z).all(1)
        miss = np.where(known[:, None], z - hm @ um, 0.0)
        pick = lambda yes, no: np.where(known.reshape(-1, *(1,) * yes.ndim), yes, no)
        return pack(len(z), pick((eye - gain @ hm) @ fm, fm), um + miss @ gain.T, pick(after, before), miss @ weight.T, pick(told, np.zeros((n, n))))

    def then(l: Flat, r: Flat) -> Flat:
        (a, b, c, e, j), (a2, b2, c2, e2, j2) = unpack(l), unpack(r)
        if root:
            top = np.concatenate([t(c) @ j2, np.broadcast_to(eye, c.shape)], -1)
            x = lower(np.concatenate([top, np.concatenate([j2, np.zeros_like(j2)], -1)], -2))
            x11, x21, x22 = x[:, :n, :n], x[:, n:, :n], x[:, n:, n:]
            back = c @ t(np.linalg.inv(x11))
            keep = eye - back @ t(x21)
            told_a = dot(t(a), dot(t(keep), e2 - dot(j2 @ t(j2), b))) + e
            return pack(len(a), a2 @ keep @ a, dot(a2, dot(keep, b + dot(c @ t(c), e2))) + b2, lower(np.concatenate([a2 @ back, c2], -1)), told_a, lower(np.concatenate([t(a) @ x22, j], -1)))
        keep = np.linalg.inv(eye + c @ j2)
        mid = a2 @ keep
        return pack(len(a), mid @ a, dot(mid, b + dot(c, e2)) + b2, mid @ c @ t(a2) + c2, dot(t(a) @ t(keep), e2 - dot(j2, b)) + e, t(a) @ t(keep) @ j2 @ a + j)

    none = pack(1, eye, np.zeros(n), np.zeros((n, n)), np.zeros(n), np.zeros((n, n)))
    lift = (lambda z: np.concatenate([z, np.repeat(none, len(z), 0)], 1)) if seeded else step
    combine = (lambda l, r: np.concatenate([l[:, :m], then(then(l[:, m:], step(r[:, :m])), r[:, m:])], 1)) if seeded else then
    p = np.array(p0, float)

    def finish(s: Flat) -> dict[str, list]:
        k = len(s)
        start = s[:, :m] if seeded else np.array(x0, float)
        prior = pack(k, np.zeros((n, n)), start, np.linalg.cholesky(p) if root else p, np.zeros(n), np.zeros((n, n)))
        _, x, c, _, _ = unpack(then(prior, s[:, m:] if seeded else s))
        return {"x": list(x), "p": list((c @ t(c) if root else c).reshape(k, -1))}

    for c in measured if seeded else []:
        rows = rows.where(c.isNotNull() & ~F.isnan(c))
    return fold(rows, by, order, F.array(*(F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in measured)), lift, combine, finish, "x array<double>, p array<double>")
