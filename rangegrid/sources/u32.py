"""Binary files of unsigned 32-bit columns: headerless and column-major, and their value maps; little-endian.

``spark.dataSource.register(U32Columns)``, then ``spark.read.format("u32cols").option("columns", 3).load(path)``; value maps
likewise as "u32maps". Files are opened through pyarrow's file systems, so a URI of a store that executors reach works as a
local path does. Readers deal a file into ranges of rows, and read nothing else of it. Writers let tasks write one part a
column each, in order of row ids; the parts, whose number and sizes are all that the driver keeps, are then appended to the
one file that the format asks for, as bytes and a few megabytes at a time.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Rows of a partition; rows of a batch; bytes that are copied at a time.
SLICE, BATCH, COPIED = 4 << 20, 1 << 18, 8 << 20


def _open(path: str):
    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _sink(path: str):
    """A stream that writes a new file; folders above it are made."""
    system, where = _open(path)
    system.create_dir(os.path.dirname(where), recursive=True)
    return system.open_output_stream(where)


class _Rows(InputPartition):
    def __init__(self, first: int, n: int, col: int = 0, at: int = 0):
        self.first, self.n, self.col, self.at = first, n, col, at


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: int):
        self.path, self.columns = path, columns
        system, where = _open(path)
        size = system.get_file_info(where).size
        if size % (4 * columns):
            raise ValueError(f"{path} has {size} bytes, which {columns} columns of 4 bytes don't divide")
        self.rows = size // (4 * columns)

    def partitions(self):
        return [_Rows(a, min(SLICE, self.rows - a)) for a in range(0, self.rows, SLICE)] or [_Rows(0, 0)]

    def read(self, part):
        system, where = _open(self.path)
        names = ["rid", *[f"c{k}" for k in range(self.columns)]]
        with system.open_input_file(where) as f:
            for at in range(part.first, part.first + part.n, BATCH):
                n = min(BATCH, part.first + part.n - at)
                cols = [np.frombuffer(f.read_at(4 * n, 4 * (k * self.rows + at)), "<u4").astype(np.int64) for k in range(self.columns)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *map(pa.array, cols)], names=names)


class U32Columns(DataSource):
    """rid and c0, c1, ... as longs."""

    @classmethod
    def name(cls):
        return "u32cols"

    def _columns(self) -> int:
        return int(self.options.get("columns", "3"))

    def schema(self):
        return StructType([StructField("rid", LongType()), *[StructField(f"c{k}", LongType()) for k in range(self._columns())]])

    def reader(self, schema):
        return _Reader(self.options["path"], self._columns())


class _MapReader(DataSourceReader):
    """Headers alone are read to find the columns; pairs by the tasks."""

    def __init__(self, path: str):
        self.path, self.columns = path, []
        system, where = _open(path)
        with system.open_input_file(where) as f:
            at = 4
            for _ in range(int(np.frombuffer(f.read_at(4, 0), "<i4")[0])):
                n = int(np.frombuffer(f.read_at(4, at), "<u4")[0])
                self.columns.append((at + 4, n))
                at += 4 + 8 * n
            if f.size() != at:
                raise ValueError(f"{path} has {f.size()} bytes, its headers say {at}")

    def partitions(self):
        return [_Rows(a, min(SLICE, n - a), c, at) for c, (at, n) in enumerate(self.columns) for a in range(0, n, SLICE)] or [_Rows(0, 0)]

    def read(self, part):
        system, where = _open(self.path)
        with system.open_input_file(where) as f:
            for at in range(part.first, part.first + part.n, BATCH):
                n = min(BATCH, part.first + part.n - at)
                pairs = np.frombuffer(f.read_at(8 * n, part.at + 8 * at), "<u4").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.col, np.int32)), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["col", "v", "pos"])


class U32Maps(DataSource):
    """col, v, pos."""

    @classmethod
    def name(cls):
        return "u32maps"

    def schema(self):
        return StructType([StructField("col", IntegerType()), StructField("v", LongType()), StructField("pos", LongType())])

    def reader(self, schema):
        return _MapReader(self.options["path"])


def read_columns(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    spark.dataSource.register(U32Columns)
    return spark.read.format("u32cols").option("columns", columns).load(path)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """(col, v, pos)."""
    spark.dataSource.register(U32Maps)
    return spark.read.format("u32maps").load(path)


def _write_parts(ordered: DataFrame, groups: list[list[str]], folder: str) -> list[tuple[int, int, list[str]]]:
    """Write each group of columns, interleaved, of each partition to a file of its own; (partition, rows, files), in order.

    A file has a name of its own attempt, and only those that a finished task reports count.
    """

    def write(batches):
        from pyspark import TaskContext

        part, sinks, names, rows = TaskContext.get().partitionId(), [], [], 0
        try:
            for b in batches:
                if not sinks:
                    names = [f"{folder}/{part:06d}-{k}-{uuid.uuid4().hex}" for k in range(len(groups))]
                    sinks = [_sink(name) for name in names]
                for sink, own in zip(sinks, groups, strict=True):
                    values = np.stack([np.asarray(b.column(b.schema.get_field_index(c)).cast(pa.int64())) for c in own], axis=1)
                    if len(values) and (values.min() < 0 or values.max() >= 2**32):
                        raise ValueError(f"{own} has values beyond 32 bits")
                    sink.write(memoryview(np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1)))
                rows += b.num_rows
        finally:
            for sink in sinks:
                sink.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([rows], pa.int64()), pa.array([names], pa.list_(pa.string()))], names=["part", "n", "files"])

    made = ordered.mapInArrow(write, "part bigint, n bigint, files array<string>").collect()  # a row a partition
    return sorted((r.part, r.n, list(r.files)) for r in made)


def _append(sink, files: list[str]) -> None:
    for name in files:
        system, where = _open(name)
        with system.open_input_stream(where) as f:
            while block := f.read(COPIED):
                sink.write(block)


def _drop(folder: str) -> None:
    system, where = _open(folder)
    if system.get_file_info(where).type == pafs.FileType.Directory:
        system.delete_dir(where)


def write_columns(df: DataFrame, path: str, columns: list[str]) -> None:
    """One file, column after column in order of rid, of one sort of the table. Values beyond 32 bits are an error."""
    folder = f"{path}-parts-{uuid.uuid4().hex}"
    cast = [F.col(c).cast("bigint").alias(f"c{k}") for k, c in enumerate(columns)]
    made = _write_parts(df.select("rid", *cast).orderBy("rid"), [[f"c{k}"] for k in range(len(columns))], folder)
    with _sink(path) as sink:
        for k in range(len(columns)):
            _append(sink, [files[k] for _, _, files in made])
    _drop(folder)


def write_maps(maps: list[DataFrame], path: str) -> None:
    """int32 number of columns; per column uint32 size and (value, first position) pairs, ascending."""
    with _sink(path) as sink:
        sink.write(np.array([len(maps)], "<i4").tobytes())
        for m in maps:
            folder = f"{path}-parts-{uuid.uuid4().hex}"
            made = _write_parts(m.select(F.col("v").cast("bigint").alias("v"), "pos").orderBy("v"), [["v", "pos"]], folder)
            sink.write(np.array([sum(n for _, n, _ in made)], "<u4").tobytes())
            _append(sink, [files[0] for _, _, files in made])
            _drop(folder)
