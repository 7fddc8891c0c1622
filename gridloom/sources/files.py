"""Readers and writers: raw binary arrays, annotation JSON, CSV, INI, file listings, report JSON, generated patterns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes per element of the raw types.
WIDTH = {"U8": 1, "S8": 1, "U16": 2, "S16": 2, "U32": 4, "S32": 4, "F32": 4, "F64": 8}
#: Bits of the fraction, and what the exponent is shifted by, of the binary floating-point formats.
FLOAT = {"F32": (23, 127), "F64": (52, 1023)}


def _number(kind: str, at: Column) -> Column:
    """The little-endian element of ``content`` that starts at byte ``at``; infinities and not-a-number as such."""
    n = WIDTH[kind]
    # the highest byte comes last
    digits = lambda lo, hi: F.conv(F.concat(*(F.hex(F.substring("content", at + 1 + k, F.lit(1))) for k in range(hi - 1, lo - 1, -1))), 16, 10).cast("long")
    if kind not in FLOAT:
        v = digits(0, n)
        return F.when(v >= 1 << (8 * n - 1), v - (1 << (8 * n))).otherwise(v) if kind[0] == "S" else v
    bits, shift = FLOAT[kind]
    high, low = (digits(2, 4), digits(0, 2)) if n == 4 else (digits(4, 8), digits(0, 4))  # a sign bit would not fit a long beside 63 others
    half = 8 * n // 2
    exponent = F.shiftright(high, bits - half).bitwiseAND(F.lit((2 << (8 * n - 2 - bits)) - 1))
    fraction = high.bitwiseAND(F.lit((1 << (bits - half)) - 1)) * F.lit(float(1 << half)) + low
    size = F.when(exponent == 0, fraction * F.lit(2.0 ** (1 - shift - bits) if kind == "F32" else 5e-324)).otherwise((fraction / F.lit(float(1 << bits)) + 1) * F.pow(F.lit(2.0), exponent - shift))
    size = F.when(exponent == 2 * shift + 1, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(size)
    return F.when(high >= 1 << (half - 1), -size).otherwise(size)


def decode_raw(files: DataFrame, kind: str, width: int, channel: int = 1) -> DataFrame:
    """files: path, content (headless little-endian elements, row by row), as cells: path, y, x, c, v."""
    n = WIDTH[kind]
    count = F.floor(F.octet_length("content") / n).cast("int")
    cell = files.where(count > 0).select("path", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    at = F.col("i")
    return cell.select("path", F.floor(at / (width * channel)).cast("int").alias("y"), (F.floor(at / channel) % width).cast("int").alias("x"), (at % channel).alias("c"), _number(kind, at * n).alias("v"))


def read_raw(spark: SparkSession, path: str, kind: str, width: int, channel: int = 1) -> DataFrame:
    """Headless little-endian arrays (one file an image) as cells: path, y, x, c, v."""
    return decode_raw(spark.read.format("binaryFile").load(path).select("path", "content"), kind, width, channel)


#: Element types as numpy names them, little-endian.
DTYPE = {"U8": "<u1", "S8": "<i1", "U16": "<u2", "S16": "<i2", "U32": "<u4", "S32": "<i4", "F32": "<f4", "F64": "<f8"}


def raw_rows(cells: DataFrame, kind: str) -> DataFrame:
    """img_id, y, content: the bytes of each image row, cell by cell (x, c). An image's dump is its rows' bytes in order of y."""

    @F.pandas_udf("binary")
    def dump(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: np.asarray(v, DTYPE[kind]).tobytes())

    rows = cells.groupBy("img_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", "c", "v"))).alias("r"))
    return rows.select("img_id", "y", dump(F.col("r.v")).alias("content"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_shapes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Annotation JSON (shapes[].label, shapes[].points), one a file or with ``lines`` one a line, as boxes: path, label, x1, y1, x2, y2."""
    schema = "shapes array<struct<label: string, points: array<array<double>>>>"
    one = spark.read.schema(schema).json(path, multiLine=not lines).select(F.col("_metadata.file_path").alias("path"), F.explode("shapes").alias("s"))
    xs, ys = F.transform("s.points", lambda p: p[0]), F.transform("s.points", lambda p: p[1])
    return one.select("path", "s.label", F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_xml(df: DataFrame, path: str, row: str) -> None:
    df.write.mode("overwrite").format("xml").option("rowTag", row).save(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")


def report_rows(df: DataFrame, col: str) -> DataFrame:
    """Test report JSON (default: map of cases, each with a result array) as one row per result, target and statistic."""
    schema = "default map<string, struct<result: array<struct<input: string, output: string, param: string, perf_result: map<string, map<string, double>>>>>>"
    r = df.select(F.from_json(col, schema).alias("j")).select(F.explode("j.default").alias("case", "s")).select("case", F.posexplode("s.result").alias("pos", "r"))
    r = r.select("case", "pos", "r.input", "r.param", F.explode("r.perf_result").alias("target", "stats"))
    return r.select("case", "pos", "input", "param", "target", F.explode("stats").alias("stat", "ms"))


def pattern(spark: SparkSession, name: str, h: int, w: int, seed: int = 0) -> DataFrame:
    """Synthetic single-channel array in [-1, 1]: a closed form of (y, x), RANDOM a hash of it."""
    y, x = F.col("y"), F.col("x")
    cy, cx = (y - (h - 1) / 2) / (h / 2), (x - (w - 1) / 2) / (w / 2)
    value: dict[str, Column] = {
        "GRADIENT": 2.0 * x / max(w - 1, 1) - 1,
        "STRIPES": F.when(F.floor(x / 8) % 2 == 0, 1.0).otherwise(-1.0),
        "CHECKERBOARD": F.when((F.floor(x / 8) + F.floor(y / 8)) % 2 == 0, 1.0).otherwise(-1.0),
        "CIRCLE": F.when(cy * cy + cx * cx <= 0.25, 1.0).otherwise(-1.0),
        "SINEWAVE": F.sin(x * (2 * 3.141592653589793 / 16)),
        "GAUSSIAN": 2 * F.exp(-(cy * cy + cx * cx) * 2) - 1,
        "STEP_FUNCTION": F.when(x < w // 2, -1.0).otherwise(1.0),
        "RANDOM": F.pmod(F.xxhash64(F.lit(seed), y, x), F.lit(2_000_001)) / 1_000_000.0 - 1,
    }
    g = spark.range(h * w).select((F.floor(F.col("id") / w)).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    return g.select("y", "x", value[name].alias("v"))
