"""PLY files of points or splats as a Spark data source: spark.read.format("ply"), df.write.format("ply").

The header gives the schema. A file is read in ranges of vertices, one a partition; only the wanted columns'
values are kept. Writing makes one file a task. Paths are opened with pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

# The format's type names, numpy's, and the Spark type that holds them.
KINDS = {
    "char": ("i1", ShortType()), "int8": ("i1", ShortType()), "uchar": ("u1", ShortType()), "uint8": ("u1", ShortType()), "short": ("i2", ShortType()), "int16": ("i2", ShortType()),
    "ushort": ("u2", IntegerType()), "uint16": ("u2", IntegerType()), "int": ("i4", IntegerType()), "int32": ("i4", IntegerType()), "uint": ("u4", LongType()), "uint32": ("u4", LongType()),
    "float": ("f4", FloatType()), "float32": ("f4", FloatType()), "double": ("f8", DoubleType()), "float64": ("f8", DoubleType()),
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Header:
    count: int
    properties: list[tuple[str, str]]
    ascii: bool
    offset: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, "<" + KINDS[k][0]) for n, k in self.properties])


def header(path: str) -> Header:
    """A file's header; raises ValueError for what isn't a PLY file, has list properties, is big-endian or is cut short."""
    store, at = opened(path)
    with store.open_input_file(at) as f:
        head = f.read(1 << 16)
        size = f.size()
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError(f"{path} is not a PLY file")
    offset = head.index(b"\n", end) + 1
    count, properties, form, inside = 0, [], "", False
    for line in head[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            if words[1] not in KINDS:
                raise ValueError(f"{path}: property type {words[1]} isn't supported")
            properties.append((words[2], words[1]))
    if form not in ("ascii", "binary_little_endian"):
        raise ValueError(f"{path}: format {form or 'missing'} isn't supported")
    out = Header(count, properties, form == "ascii", offset)
    if not out.ascii and size < offset + count * out.dtype.itemsize:
        raise ValueError(f"{path} is cut short")
    return out


def missing_properties(path: str, required: list[str]) -> list[str]:
    have = {n for n, _ in header(path).properties}
    return [r for r in required if r not in have]


class Range(InputPartition):
    def __init__(self, path: str, first: int, after: int):
        super().__init__(None)
        self.path, self.first, self.after = path, first, after


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType, rows: int):
        self.paths, self.names, self.kinds, self.rows = paths, schema.fieldNames(), [f.dataType for f in schema.fields], rows

    def partitions(self) -> list[Range]:
        out = []
        for p in self.paths:
            h = header(p)
            step = h.count if h.ascii else self.rows
            out += [Range(p, a, min(a + step, h.count)) for a in range(0, h.count, max(1, step))]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        h = header(part.path)
        store, at = opened(part.path)
        schema = pa.schema([(n, {ShortType: pa.int16(), IntegerType: pa.int32(), LongType: pa.int64(), FloatType: pa.float32(), DoubleType: pa.float64()}[type(k)]) for n, k in zip(self.names, self.kinds, strict=True)])
        with store.open_input_file(at) as f:
            if h.ascii:
                f.seek(h.offset)
                rows = [line.split()[: len(h.properties)] for line in f.read().decode("ascii").splitlines()[: h.count]]
                columns = {n: np.array([float(r[i]) for r in rows]) for i, (n, _) in enumerate(h.properties)}
                yield pa.RecordBatch.from_arrays([pa.array(columns[n].astype(schema.field(n).type.to_pandas_dtype())) for n in self.names], schema=schema)
                return
            for first in range(part.first, part.after, 65536):
                n = min(65536, part.after - first)
                f.seek(h.offset + first * h.dtype.itemsize)
                block = np.frombuffer(f.read(n * h.dtype.itemsize), h.dtype)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(block[c]).astype(schema.field(c).type.to_pandas_dtype())) for c in self.names], schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class Writer(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType, bytes_: list[str]):
        self.folder, self.names, self.bytes = folder, schema.fieldNames(), set(bytes_)
        self.kinds = {f.name: "uchar" if f.name in self.bytes else "double" if isinstance(f.dataType, DoubleType) else "float" if isinstance(f.dataType, FloatType) else "int" for f in schema.fields}

    def write(self, rows: Iterator) -> Written:
        """One file; its rows are held as packed bytes until their number, which the header states, is known."""
        dtype, parts, held = np.dtype([(n, "<" + KINDS[self.kinds[n]][0]) for n in self.names]), [], []
        for r in rows:
            held.append(tuple(r))
            if len(held) == 65536:
                parts, held = [*parts, np.array(held, dtype).tobytes()], []
        parts.append(np.array(held, dtype).tobytes())
        n = sum(map(len, parts)) // dtype.itemsize
        head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property {self.kinds[c]} {c}" for c in self.names], "end_header", ""])
        store, at = opened(self.folder)
        store.create_dir(at, recursive=True)
        path = f"{at}/part-{uuid.uuid4().hex}.ply"
        with store.open_output_stream(path) as f:
            f.write(head.encode())
            for p in parts:
                f.write(p)
        return Written(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.folder)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class PlySource(DataSource):
    """Options: path (a file or a folder), rows (vertices a partition, 1,000,000 unless given), bytes (columns written as bytes)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _paths(self) -> list[str]:
        path = self.options["path"]
        store, at = opened(path)
        if store.get_file_info(at).type == fs.FileType.File:
            return [path]
        base = path.rstrip("/")
        return [f"{base}/{i.base_name}" for i in store.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".ply")]

    def schema(self) -> StructType:
        return StructType([StructField(n, KINDS[k][1]) for n, k in header(self._paths()[0]).properties])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._paths(), schema, int(self.options.get("rows", 1_000_000)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, [c for c in self.options.get("bytes", "").split(",") if c])
