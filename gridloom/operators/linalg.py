"""Matrix products by tiles, and discrete transforms of whole rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 64


def _tiles(m: DataFrame, key: str, down: str, across: str) -> DataFrame:
    """Tiles of up to TILE by TILE cells, each a list of (place down, place across, value)."""
    at = [F.floor(F.col(c) / TILE).cast("int").alias(f"{c}_tile") for c in (down, across)]
    cell = F.struct((F.col(down) % TILE).cast("int").alias("i"), (F.col(across) % TILE).cast("int").alias("j"), F.col("v").cast("double").alias("v"))
    return m.groupBy("img_id", *at).agg(F.collect_list(cell).alias(key))


def _dense(cells: pa.Array) -> np.ndarray:
    """A tile from its list of cells, without a Python object a cell."""
    i, j, v = (c.to_numpy(zero_copy_only=False) for c in cells.flatten())
    full = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
    full[i, j] = v
    return full


def _products(left: pa.Array, right: pa.Array) -> pa.Array:
    """Products of pairs of tiles, row by row, and their widths. Tiles are dense, but those at the rims are smaller."""
    done = []
    for k in range(len(left)):
        x, y = _dense(left[k].values), _dense(right[k].values)
        inner = min(x.shape[1], y.shape[0])
        done.append(x[:, :inner] @ y[:inner])
    ends = np.cumsum([0, *(z.size for z in done)], dtype=np.int32)
    flat = pa.array(np.concatenate([z.ravel() for z in done]) if done else np.zeros(0))
    return pa.StructArray.from_arrays([pa.array([z.shape[1] for z in done], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["w", "z"])


def gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """(img_id, y, x, v) products of dense matrices: equi-join of tiles on the inner index, one product a pair, sums over the inner tiles."""
    left = _tiles(a.withColumnRenamed("x", "k"), "left", "y", "k")
    right = _tiles(b.withColumnRenamed("y", "k"), "right", "k", "x")
    product = F.arrow_udf(_products, "w int, z array<double>")  # needs a session
    met = left.join(right, ["img_id", "k_tile"]).withColumn("o", product("left", "right"))
    met = met.select("img_id", "y_tile", "x_tile", "o.w", F.posexplode("o.z").alias("at", "v"))
    y, x = F.col("y_tile") * TILE + F.floor(F.col("at") / F.col("w")), F.col("x_tile") * TILE + F.col("at") % F.col("w")
    return met.groupBy("img_id", y.cast("int").alias("y"), x.cast("int").alias("x")).agg(F.sum("v").alias("v"))


def _by_row(cells: DataFrame, names: list[str], rule: Callable[..., list[np.ndarray]]) -> DataFrame:
    """cells (img_id, y, x and the named values): rule turns the whole rows of one length (2-D arrays, one per name) into new ones.

    A row is one array, so a row of n cells is one record, not n^2."""
    rows = cells.groupBy("img_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", *names))).alias("r"))
    rows = rows.select("img_id", "y", *(F.col(f"r.{c}").cast("array<double>").alias(c) for c in names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b[names[0]].map(len)):
                done = rule(*(np.stack(part[c].to_list()) for c in names))
                yield part[["img_id", "y"]].assign(**{c: list(v) for c, v in zip(names, done)})

    kinds = ", ".join(f"{c} array<double>" for c in names)
    out = rows.mapInPandas(run, f"img_id long, y int, {kinds}")
    return out.select("img_id", "y", F.posexplode(F.arrays_zip(*names)).alias("x", "o")).select("img_id", "y", "x", *(F.col(f"o.{c}").alias(c) for c in names))


def dft_rows(cells: DataFrame, inverse: bool = False, scale: bool = False, group: int | None = None, fill: bool = False) -> DataFrame:
    """Complex DFT along x of the rows of (img_id, y, x, re, im), of any length; with ``group``, of each run of that many cells
    (a last run that is shorter is transformed as it is, or with ``fill`` as if zeros followed)."""

    def rule(re: np.ndarray, im: np.ndarray) -> list[np.ndarray]:
        z = re + 1j * im
        if group and fill:
            z = np.pad(z, ((0, 0), (0, -z.shape[1] % group)))
        n = z.shape[1]
        for at in range(0, n, group or n):
            run = z[:, at : at + (group or n)]
            f = np.fft.ifft(run, axis=1) if inverse else np.fft.fft(run, axis=1)
            z[:, at : at + (group or n)] = f * (run.shape[1] if inverse and not scale else 1)
        return [z.real, z.imag]

    return _by_row(cells, ["re", "im"], rule)


def swapped(cells: DataFrame) -> DataFrame:
    return cells.select("img_id", F.col("x").alias("y"), F.col("y").alias("x"), "re", "im")


def dft2(cells: DataFrame, inverse: bool = False, scale: bool = False, group: int | None = None, fill: bool = False) -> DataFrame:
    """2-D DFT of images of any size: rows, then columns."""
    return swapped(dft_rows(swapped(dft_rows(cells, inverse, scale, group, fill)), inverse, scale, group, fill))


def dct_rows(cells: DataFrame, inverse: bool = False) -> DataFrame:
    """Orthonormal DCT-II along x of the rows of (img_id, y, x, v), of any length, or its inverse, by one FFT a row."""

    def rule(v: np.ndarray) -> list[np.ndarray]:
        n = v.shape[1]
        k = np.arange(n)
        norm = np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
        turn = np.exp(-1j * np.pi * k / (2 * n))
        if not inverse:
            folded = np.concatenate([v[:, 0::2], v[:, 1::2][:, ::-1]], 1)
            return [(np.fft.fft(folded, axis=1) * turn).real * norm]
        c = v / norm
        mirrored = np.concatenate([np.zeros((len(c), 1)), c[:, :0:-1]], 1)
        folded = np.fft.ifft((c - 1j * mirrored) / turn, axis=1).real
        out = np.empty_like(folded)
        out[:, 0::2], out[:, 1::2] = folded[:, : (n + 1) // 2], folded[:, (n + 1) // 2 :][:, ::-1]
        return [out]

    return _by_row(cells, ["v"], rule)
