"""Headless arrays as a data source of Spark: ``spark.read.format("raw_arrays")`` and ``df.write.format("raw_arrays")``.

A file holds little-endian elements, row by row, channels innermost. Reading cuts every file into ranges of ``part_bytes``, so one
large file is many tasks, and small ones share a task; the columns are those of the reader's schema, any of path, y, x, c, v. Files are opened through
Arrow's file systems (local or mounted paths, and the remote ones it knows).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.sources.files import DTYPE, raw_rows

#: Elements that a task holds at a time.
BLOCK = 1 << 20


@dataclass
class Stretches(InputPartition):
    """Elements that one task reads: (path, first, count), small files together."""

    parts: list


@dataclass
class Written(WriterCommitMessage):
    files: list


class RawReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path, self.kind = options["path"], options.get("kind", "U8")
        self.width, self.channel = int(options["width"]), int(options.get("channel", 1))
        self.part, self.glob = int(options.get("part_bytes", 64 << 20)), options.get("glob", "*")
        if self.kind not in DTYPE or self.width < 1 or self.channel < 1 or set(self.names) - {"path", "y", "x", "c", "v"}:
            raise ValueError(f"no raw arrays of kind {self.kind}, width {self.width}, {self.channel} channels and columns {self.names}")

    def partitions(self) -> list[Stretches]:
        system, at = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
        if found and found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        size = np.dtype(DTYPE[self.kind]).itemsize
        step = max(self.part // size, 1)
        hidden = lambda p: any(s[:1] in "._" for s in p[len(at) :].split("/") if s)
        files = sorted((f.path, f.size // size) for f in found if f.type == fs.FileType.File and not hidden(f.path) and fnmatch(f.base_name, self.glob))
        out: list[Stretches] = []
        held = step
        for path, n in files:
            for k in range(0, n, step):
                cost = min(step, n - k) + step // 256  # to open a file costs as much as some bytes
                if held + cost > step + step // 256:
                    out.append(Stretches([]))
                    held = 0
                out[-1].parts.append((path, k, min(step, n - k)))
                held += cost
        return out

    def read(self, stretches: Stretches | None) -> Iterator[pa.RecordBatch]:
        for part in stretches.parts if stretches is not None else []:  # none: no file has an element
            yield from self.read_part(*part)

    def read_part(self, path: str, start: int, count: int) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        kind = np.dtype(DTYPE[self.kind])
        with system.open_input_file(path) as f:
            for first in range(start, start + count, BLOCK):
                n = min(BLOCK, start + count - first)
                at = np.arange(first, first + n)
                cell = at // self.channel
                columns = {
                    "path": lambda: pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), [path]).cast(pa.string()),
                    "y": lambda: pa.array((cell // self.width).astype(np.int32)),
                    "x": lambda: pa.array((cell % self.width).astype(np.int32)),
                    "c": lambda: pa.array((at % self.channel).astype(np.int32)),
                    "v": lambda: pa.array(np.frombuffer(f.read_at(n * kind.itemsize, first * kind.itemsize), kind).astype("f8" if kind.kind == "f" else "i8")),
                }
                yield pa.RecordBatch.from_arrays([columns[c]() for c in self.names], self.names)


class RawWriter(DataSourceArrowWriter):
    """Rows (name, content) in order: the contents of a name, one after the other, become the file name.raw. A task writes beside the
    folder's files; they get their names when all tasks are done, or go."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, at = fs.FileSystem.from_uri(self.path)
        room = f"{at}/_writing-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(room)
        files: list[tuple[str, str]] = []
        name, out = None, None
        try:
            for batch in batches:
                for key, content in zip(batch.column("name"), batch.column("content")):
                    if out is None or key.as_py() != name:
                        if out is not None:
                            out.close()
                        name = key.as_py()
                        if not name or "/" in name or name[0] in "._":
                            raise ValueError(f"{name!r} names no file")
                        files.append((f"{room}/{len(files)}", name))
                        out = system.open_output_stream(files[-1][0])
                    if content.is_valid:
                        out.write(content.as_buffer())
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = fs.FileSystem.from_uri(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if len({n for _, n in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one name are in several tasks or not in order: use dump_raw")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(at)):
                if old.type == fs.FileType.File and old.base_name.endswith(".raw"):
                    system.delete_file(old.path)
        for room, name in files:
            system.move(room, f"{at}/{name}.raw")
        self.abort(messages)  # the empty rooms

    def abort(self, messages: list[Written | None]) -> None:
        system, at = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{at}/_writing-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_writing-{self.job}")


class RawArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_arrays"

    def schema(self) -> str:
        return f"path string, y int, x int, c int, v {'double' if self.options.get('kind', 'U8')[0] == 'F' else 'bigint'}"

    def reader(self, schema: StructType) -> RawReader:
        return RawReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RawWriter:
        return RawWriter(dict(self.options), overwrite)


def scan_raw(spark: SparkSession, path: str, kind: str, width: int, channel: int = 1, columns: str = "path, y, x, c, v", part_bytes: int = 64 << 20, glob: str = "*") -> DataFrame:
    """The cells of the raw files at path: the columns named, and only they are made. Elements that are cut off at a file's end are
    passed over; names that begin with a dot or an underscore are hidden."""
    spark.dataSource.register(RawArrays)
    kinds = {"path": "string", "v": "double" if kind[0] == "F" else "bigint"}
    schema = ", ".join(f"{c} {kinds.get(c, 'int')}" for c in columns.split(", "))
    options = {"kind": kind, "width": width, "channel": channel, "part_bytes": part_bytes, "glob": glob}
    return spark.read.format("raw_arrays").schema(schema).options(**options).load(path)


def dump_raw(cells: DataFrame, path: str, kind: str) -> None:
    """Write cells (img_id, y, x, c, v) as one file an image, img_id.raw. An image is written by one task, a row at a time, since a
    file has one writer; images are spread over tasks."""
    cells.sparkSession.dataSource.register(RawArrays)
    rows = raw_rows(cells, kind).select(F.col("img_id").cast("string").alias("name"), "y", "content")
    rows.repartition("name").sortWithinPartitions("name", "y").select("name", "content").write.format("raw_arrays").mode("append").save(path)
