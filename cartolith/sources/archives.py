"""Capture archives, wire messages and packed splats."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def check_zips(spark: SparkSession, path: str, required: list[str], prefixes: list[str] = ()) -> DataFrame:
    """path, error (null: sound), members, unpacked bytes of each archive at path; only the central directory is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = z.infolist()
                except zipfile.BadZipFile:
                    rows.append((name, "not a zip", 0, 0))
                    continue
                names = [i.filename for i in infos]
                unsafe = [n for n in names if n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/")]
                lacking = [r for r in required if r not in names] + [p for p in prefixes if not any(n.startswith(p) for n in names)]
                error = f"unsafe member {unsafe[0]}" if unsafe else f"missing {lacking[0]}" if lacking else None
                rows.append((name, error, len(infos), sum(i.file_size for i in infos)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "error", "members", "bytes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, error string, members long, bytes long")


def decoded_message(data: Column) -> Column:
    """struct(header, body, error) of [4 bytes of length, big-endian][JSON header][blobs]; the header's `blobs` lists their sizes.

    error tells what doesn't add up: too short, header past the end, not JSON, or sizes that don't fill the body."""
    size = F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("long")
    header = F.substring(data, F.lit(5), size.cast("int")).cast("string")
    body = F.substring(data, (size + 5).cast("int"), F.octet_length(data))
    sizes = F.from_json(F.get_json_object(header, "$.blobs"), "array<long>")
    total = F.aggregate(F.coalesce(sizes, F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x)
    error = (
        F.when(F.octet_length(data) < 4, "too short").when(size + 4 > F.octet_length(data), "header past the end")
        .when(F.try_parse_json(header).isNull(), "header is not JSON").when(total != F.octet_length(data) - 4 - size, "sizes do not add up")
    )
    return F.struct(F.when(error.isNull(), header).alias("header"), F.when(error.isNull(), body).alias("body"), error.alias("error"))


def reassembled(parts: DataFrame, key: str, most_bytes: int = 512 << 20, most_parts: int = 4096) -> DataFrame:
    """key, data, error from parts (key, seq, last, fragment): joined in order if seq runs from 0 without gap or repeat to the one marked last.

    Both limits are checked on sums before anything is gathered, so what is gathered is bounded."""
    w = W.partitionBy(key)
    sized = parts.withColumns({"__n": F.count("*").over(w), "__bytes": F.sum(F.octet_length("fragment")).over(w), "__hi": F.max("seq").over(w), "__u": F.size(F.collect_set("seq").over(w)), "__last": F.max(F.when(F.col("last"), F.col("seq"))).over(w)})
    error = F.when(F.col("__n") > most_parts, "too many parts").when(F.col("__bytes") > most_bytes, "too large").when((F.col("__u") != F.col("__n")) | (F.col("__hi") + 1 != F.col("__n")) | ~F.col("__last").eqNullSafe(F.col("__hi")), "parts missing or out of order")
    marked = sized.withColumn("error", error)
    whole = marked.filter("error IS NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "fragment"))).alias("f"))
    data = F.unhex(F.array_join(F.transform("f", lambda s: F.hex(s["fragment"])), ""))
    return whole.select(key, data.alias("data"), F.lit(None).cast("string").alias("error")).unionByName(marked.filter("error IS NOT NULL").select(key, F.lit(None).cast("binary").alias("data"), "error").distinct())


_SPLAT = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
#: Fixed values of the format: its magic number, and coefficients beyond the first of each degree of spherical harmonics, a colour channel.
MAGIC, HARMONICS = 0x5053474E, (0, 3, 8, 15)


def read_spz(spark: SparkSession, path: str) -> DataFrame:
    """Packed splats (versions 1 to 3) as rows: position, zero normal, colour, opacity as a logit, log scales, a wxyz rotation.

    f_rest is an array of the higher harmonics, all of red, then of green, then of blue; empty at degree 0. A file
    that is cut short fails."""
    schema = "path string, i long, " + ", ".join(f"{c} float" for c in _SPLAT) + ", f_rest array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for first, columns, rest in unpacked(gzip.decompress(content)):
                    n, wide = rest.shape
                    lists = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * wide).astype(np.int32)), pa.array(rest.ravel().astype(np.float32)))
                    cols = [pa.array([name] * n), pa.array(np.arange(first, first + n)), *(pa.array(columns[c].astype(np.float32)) for c in _SPLAT), lists]
                    yield pa.RecordBatch.from_arrays(cols, ["path", "i", *_SPLAT, "f_rest"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def unpacked(raw: bytes, step: int = 1 << 16) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray]]:
    """(first row, columns by name, harmonics) of blocks of an unzipped splat file."""
    magic, version, n = np.frombuffer(raw[:12], "<u4").tolist()
    degree, bits = raw[12], raw[13]
    if magic != MAGIC or version not in (1, 2, 3) or degree >= len(HARMONICS):
        raise ValueError("not a packed splat file of a known version")
    widths = {"place": 6 if version == 1 else 9, "alpha": 1, "colour": 3, "scale": 3, "turn": 4 if version == 3 else 3, "rest": 3 * HARMONICS[degree]}
    if len(raw) < 16 + n * sum(widths.values()):
        raise ValueError("packed splat file is cut short")
    part, at = {}, 16
    for key, width in widths.items():
        part[key] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
    for first in range(0, n, step):
        p = {k: v[first : first + step] for k, v in part.items()}
        xyz = half_floats(p["place"]) if version == 1 else fixed_points(p["place"], bits)
        alpha = np.clip(p["alpha"][:, 0] / 255.0, 1 / 512, 1 - 1 / 512)
        turn = packed_quaternions(p["turn"]) if version == 3 else byte_quaternions(p["turn"])
        blocks = (xyz, np.zeros((len(xyz), 3)), (p["colour"] / 255.0 - 0.5) / 0.15, np.log(alpha / (1 - alpha))[:, None], p["scale"] / 16.0 - 10, turn)
        # stored coefficient by coefficient with its three channels; given channel by channel
        rest = ((p["rest"].astype(float) - 128) / 128).reshape(len(xyz), HARMONICS[degree], 3).transpose(0, 2, 1).reshape(len(xyz), -1)
        yield first, dict(zip(_SPLAT, np.concatenate(blocks, axis=1).T, strict=True)), rest


def half_floats(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view("<f2").astype(float)


def fixed_points(raw: np.ndarray, bits: int) -> np.ndarray:
    """Signed numbers of 24 bits, the low byte first, of which bits are behind the point."""
    wide = np.zeros((len(raw), 3, 4), np.uint8)
    wide[:, :, 1:] = raw.reshape(-1, 3, 3)
    return wide.view("<i4")[:, :, 0] / 256 / float(1 << bits)


def byte_quaternions(raw: np.ndarray) -> np.ndarray:
    """wxyz rotations from a byte each for x, y and z; w is what makes the length 1."""
    v = raw / 127.5 - 1
    return np.column_stack([np.sqrt(np.maximum(0, 1 - (v**2).sum(axis=1))), v])


def packed_quaternions(raw: np.ndarray) -> np.ndarray:
    """wxyz rotations from 32 bits: which of x, y, z, w is largest, then the others in order, each a sign and 9 bits of value times the root of 2."""
    word = np.ascontiguousarray(raw).view("<u4")
    fields = word >> np.array([20, 10, 0], np.uint32) & 0x3FF
    small = np.where(fields & 0x200, -1.0, 1.0) * (fields & 0x1FF) / (0x1FF * np.sqrt(2))
    largest = (word[:, 0] >> 30).astype(int)
    # the three go to the places that are left: 1 2 3, 0 2 3, 0 1 3 or 0 1 2
    places = np.array([[j for j in range(4) if j != k] for k in range(4)])[largest]
    out = np.empty((len(raw), 4))
    np.put_along_axis(out, places, small, axis=1)
    np.put_along_axis(out, largest[:, None], np.sqrt(np.maximum(0, 1 - (small**2).sum(axis=1)))[:, None], axis=1)
    return np.roll(out, 1, axis=1)
