"""NPZ archives of arrays as a Spark data source: spark.read.format("npz"), df.write.format("npz").

A row is one entry along the arrays' first axis, a column one array; rows of several numbers are arrays, flattened
in C order. Stored members are read in ranges of rows, one a partition, by their place in the file; deflated ones can't
be entered in the middle, so such a file is one partition and is streamed. Only the columns asked for are read.
Old flat buffers (positions, then colours) are read by the same ranges. Paths are opened as for PLY files.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

from cartolith.sources.ply import opened

# numpy's types and the Spark types that hold them.
KINDS = {"b1": BooleanType(), "i1": ByteType(), "u1": ShortType(), "i2": ShortType(), "u2": IntegerType(), "i4": IntegerType(), "u4": LongType(), "i8": LongType(), "f2": FloatType(), "f4": FloatType(), "f8": DoubleType()}
_DTYPES = {BooleanType: "?", ByteType: "<i1", ShortType: "<i2", IntegerType: "<i4", LongType: "<i8", FloatType: "<f4", DoubleType: "<f8"}
#: Rows of a partition, and of a batch.
ROWS, BATCH = 1_000_000, 65_536


@dataclass
class Member:
    """An array in a file: offset is where its first row stands, None if it is deflated; inside is then the archive's name for it."""

    name: str
    dtype: np.dtype
    shape: tuple[int, ...]
    rows: int
    offset: int | None
    inside: str = ""

    @property
    def width(self) -> int:
        """Bytes of a row."""
        return self.dtype.itemsize * int(np.prod(self.shape, dtype=np.int64))

    @property
    def kind(self) -> DataType:
        one = KINDS[self.dtype.str[1:]]
        return ArrayType(one) if self.shape else one


def _header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = npy.read_magic(stream)
    return npy.read_array_header_1_0(stream) if version == (1, 0) else npy.read_array_header_2_0(stream)


def members(path: str, wanted: list[str] | None = None) -> list[Member]:
    """The arrays of an archive, or those wanted; ValueError for what isn't an NPZ file or is cut short, lacks one, holds objects or columns first, or has arrays of unequal length."""
    store, at = opened(path)
    out = []
    with store.open_input_file(at) as f:
        size = f.size()
        try:
            with zipfile.ZipFile(f) as z:
                for info in z.infolist():
                    name = info.filename.removesuffix(".npy")
                    if wanted is not None and name not in wanted:
                        continue
                    with z.open(info) as stream:
                        shape, columns_first, dtype = _header(stream)
                        head = stream.tell()
                    if dtype.hasobject or dtype.str[1:] not in KINDS:
                        raise ValueError(f"{path}: {name} has type {dtype}, which isn't supported")
                    if not shape or columns_first and len(shape) > 1:
                        raise ValueError(f"{path}: {name} has no rows to read")
                    found = Member(name, dtype, shape[1:], shape[0], None, info.filename)
                    if head + found.width * found.rows != info.file_size:
                        raise ValueError(f"{path}: {name} is cut short")
                    if info.compress_type == zipfile.ZIP_STORED:
                        f.seek(info.header_offset + 26)
                        names = sum(struct.unpack("<HH", f.read(4)))
                        found.offset = info.header_offset + 30 + names + head
                        if found.offset + found.width * found.rows > size:
                            raise ValueError(f"{path}: {name} is cut short")
                    out.append(found)
        except (zipfile.BadZipFile, EOFError, struct.error, pa.ArrowInvalid) as e:
            raise ValueError(f"{path} is not an NPZ file, or is cut short: {e}") from e
    missing = set(wanted or ()) - {m.name for m in out}
    if missing:
        raise ValueError(f"{path} has no {', '.join(sorted(missing))}")
    if len({m.rows for m in out}) > 1:
        raise ValueError(f"{path}: arrays have unequal lengths; name those of one length by the option columns")
    return out


def flat_members(path: str, rows: int) -> list[Member]:
    """The two arrays of an old flat buffer: rows times three floats, then rows times three bytes."""
    store, at = opened(path)
    if store.get_file_info(at).size < 15 * rows:
        raise ValueError(f"{path} is cut short")
    return [Member("positions", np.dtype("<f4"), (3,), rows, 0), Member("colors", np.dtype("u1"), (3,), rows, 12 * rows)]


class Range(InputPartition):
    def __init__(self, path: str, first: int, after: int):
        super().__init__(None)
        self.path, self.first, self.after = path, first, after


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType, rows: int, flat: int | None):
        self.paths, self.schema, self.rows, self.flat = paths, schema, rows, flat

    def _members(self, path: str) -> dict[str, Member]:
        names = self.schema.fieldNames()
        found = flat_members(path, self.flat) if self.flat is not None else members(path, names)
        return {m.name: m for m in found if m.name in names}

    def partitions(self) -> list[Range]:
        out = []
        for p in self.paths:
            found = list(self._members(p).values())
            n = found[0].rows if found else 0
            step = self.rows if all(m.offset is not None for m in found) else max(1, n)
            out += [Range(p, a, min(a + step, n)) for a in range(0, n, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        found, schema = self._members(part.path), to_arrow_schema(self.schema)
        store, at = opened(part.path)

        def column(m: Member, data: bytes, n: int, kind: pa.DataType) -> pa.Array:
            if len(data) < m.width * n:
                raise ValueError(f"{part.path}: {m.name} is cut short")
            flat = np.frombuffer(data, m.dtype, n * m.width // m.dtype.itemsize)
            if not m.shape:
                return pa.array(flat.astype(flat.dtype.newbyteorder("="))).cast(kind)
            offsets = np.arange(n + 1, dtype=np.int32) * (m.width // m.dtype.itemsize)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(flat.dtype.newbyteorder("="))).cast(kind.value_type))

        with store.open_input_file(at) as f:
            streams = {}
            if any(m.offset is None for m in found.values()):  # deflated: one partition, from the start
                z = zipfile.ZipFile(f)
                for m in found.values():
                    streams[m.name] = z.open(m.inside)
                    _header(streams[m.name])
            for first in range(part.first, part.after, BATCH):
                n = min(BATCH, part.after - first)
                cols = []
                for field in schema:
                    m = found[field.name]
                    if m.name in streams:
                        data = streams[m.name].read(m.width * n)
                    else:
                        f.seek(m.offset + first * m.width)
                        data = f.read(m.width * n)
                    cols.append(column(m, data, n, field.type))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Writer(DataSourceWriter):
    """One archive a task, or one a value of the column by; an array column needs rows of one length, which may not hold nulls."""

    def __init__(self, folder: str, schema: StructType, by: str | None, deflated: bool):
        self.folder, self.by, self.how = folder, by, zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED
        self.fields = [(f.name, _DTYPES[type(f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType)]) for f in schema.fields if f.name != by]

    def _write(self, name: str, parts: list[list[np.ndarray]]) -> str:
        store, at = opened(self.folder)
        store.create_dir(at, recursive=True)
        path = f"{at}/{name}.npz"
        with store.open_output_stream(path) as f, zipfile.ZipFile(f, "w", self.how) as z:
            for (c, dtype), chunks in zip(self.fields, parts, strict=True):
                shapes = {x.shape[1:] for x in chunks if len(x)}
                if len(shapes) > 1:
                    raise ValueError(f"{c} has rows of unequal lengths")
                shape = (sum(len(x) for x in chunks), *(shapes.pop() if shapes else ()))
                with z.open(f"{c}.npy", "w", force_zip64=True) as out:
                    npy.write_array_header_1_0(out, {"descr": dtype, "fortran_order": False, "shape": shape})
                    for x in chunks:
                        out.write(np.ascontiguousarray(x).tobytes())
        return path

    def write(self, rows: Iterator) -> Written:
        """An array's header states its length, so a file's rows are held, packed, until all are there."""
        paths, now, begun, parts, held = [], None, False, [[] for _ in self.fields], []

        def pack() -> None:
            for i, (c, dtype) in enumerate(self.fields):
                parts[i].append(np.array([r[c] for r in held], dtype))
            held.clear()

        for r in rows:
            if self.by and begun and r[self.by] != now:
                pack()
                paths.append(self._write(str(now), parts))
                parts = [[] for _ in self.fields]
            now, begun = r[self.by] if self.by else None, True
            held.append(r)
            if len(held) == BATCH:
                pack()
        if begun or not self.by:
            pack()
            path = str(now) if self.by else f"part-{uuid.uuid4().hex}"
            if any(p.endswith(f"/{path}.npz") for p in paths):
                raise ValueError(f"rows of one {self.by} must follow each other: repartition and sort by it first")
            paths.append(self._write(path, parts))
        if len(set(paths)) < len(paths):
            raise ValueError(f"rows of one {self.by} must follow each other: repartition and sort by it first")
        return Written(paths)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.folder)
        for m in messages:
            for p in m.paths if m else []:
                store.delete_file(p)


class NpzSource(DataSource):
    """Options: path (a file or a folder), columns (names, separated by commas), rows (of a partition), flat (rows of an old flat buffer); to write: by (a file for each value), deflated."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _paths(self) -> list[str]:
        path = self.options["path"]
        store, at = opened(path)
        if store.get_file_info(at).type == fs.FileType.File:
            return [path]
        return [f"{path.rstrip('/')}/{i.base_name}" for i in store.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".npz")]

    def _flat(self) -> int | None:
        return int(self.options["flat"]) if "flat" in self.options else None

    def schema(self) -> StructType:
        wanted = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else None
        path = self._paths()[0]
        found = flat_members(path, self._flat()) if self._flat() is not None else members(path, wanted)
        named = {m.name: m for m in found}
        return StructType([StructField(c, named[c].kind) for c in wanted or named])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._paths(), schema, int(self.options.get("rows", ROWS)), self._flat())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, self.options.get("by"), self.options.get("deflated", "false") == "true")
