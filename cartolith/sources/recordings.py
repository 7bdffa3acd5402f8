"""Recordings: SQLite files with a catalogue of streams, a table a stream and a table of its payloads."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

POSE = ["pose_x", "pose_y", "pose_z", "pose_qx", "pose_qy", "pose_qz", "pose_qw"]
_SCHEMA = "recording string, stream string, config string, id long, ts double, " + ", ".join(f"{c} double" for c in POSE) + ", payload binary"


def read_recordings(spark: SparkSession, path: str, streams: list[str] | None = None, payloads: bool = True) -> DataFrame:
    """One row an observation of the files at path: recording, stream, config, id, ts, pose columns, payload.

    Files (up to 2 GB each) are dealt to tasks whole and opened from memory, so any store that Spark reads will
    do. A stream that is in the catalogue but has no table gives one row with a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with sqlite3.connect(":memory:") as db:
                    db.deserialize(content)
                    tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
                    for stream, config in db.execute("SELECT name, config FROM _streams").fetchall():
                        if streams is not None and stream not in streams:
                            continue
                        if not stream.isidentifier() or stream not in tables:
                            yield _batch([(name, stream, config, *[None] * 10)])
                            continue
                        have = {r[1] for r in db.execute(f'PRAGMA table_info("{stream}")')}
                        pose = ", ".join(f"o.{c}" if c in have else "NULL" for c in POSE)
                        blob = f"{stream}_blob" in tables and payloads
                        cursor = db.execute(f'SELECT o.id, o.ts, {pose}, {"b.data" if blob else "NULL"} FROM "{stream}" o' + (f' LEFT JOIN "{stream}_blob" b ON o.id = b.id' if blob else ""))
                        while rows := cursor.fetchmany(500):
                            yield _batch([(name, stream, config, *r) for r in rows])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.float64()] * 8 + [pa.binary()]
    names = ["recording", "stream", "config", "id", "ts", *POSE, "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def stream_catalogue(rows: DataFrame) -> DataFrame:
    """recording, stream, codec, n, first, last, span_s; a stream without rows has n 0, null times and span 0."""
    out = rows.groupBy("recording", "stream").agg(F.first("config").alias("config"), F.count("id").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select("recording", "stream", F.get_json_object("config", "$.codec_id").alias("codec"), "n", "first", "last", F.coalesce(F.col("last") - F.col("first"), F.lit(0.0)).alias("span_s"))


def informative() -> Column:
    """Whether a row's pose says more than the origin: some translation, or some rotation."""
    parts = [F.abs(F.col(c)) > 1e-9 for c in POSE[:6]]
    return F.coalesce(parts[0] | parts[1] | parts[2] | parts[3] | parts[4] | parts[5], F.lit(False))


def poses(rows: DataFrame) -> DataFrame:
    """recording, stream, id, ts and a pose struct array of 7: from the pose columns if any of the stream's is informative,
    else from the payload's last 56 bytes (seven big-endian doubles). Rows without either are left out."""
    any_pose = F.max(informative()).over(W.partitionBy("recording", "stream"))
    own = F.when(F.col("pose_x").isNotNull(), F.array(*POSE))
    tail = F.when(F.octet_length("payload") >= 56, F.substring("payload", F.octet_length("payload") - 55, F.lit(56)))
    marked = rows.withColumns({"__any": any_pose, "__own": own, "__tail": tail})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            pose = [o if use else (np.frombuffer(t, ">f8").tolist() if t is not None else None) for use, o, t in zip(b.column("__any").to_pylist(), b.column("__own").to_pylist(), b.column("__tail").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("recording", "stream", "id", "ts")), pa.array(pose, pa.list_(pa.float64()))], ["recording", "stream", "id", "ts", "pose"])

    out = marked.select("recording", "stream", "id", "ts", "__any", "__own", "__tail").mapInArrow(run, "recording string, stream string, id long, ts double, pose array<double>")
    return out.filter("pose IS NOT NULL")


def pictures(rows: DataFrame) -> DataFrame:
    """rows whose payload holds a JPEG, with payload cut to begin at its start marker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [None if x is None or (at := x.find(b"\xff\xd8")) < 0 else x[at:] for x in b.column("payload").to_pylist()]
            yield b.set_column(b.schema.get_field_index("payload"), "payload", pa.array(cut, pa.binary()))

    return rows.mapInArrow(run, rows.schema).filter("payload IS NOT NULL")


def manifest(rows: DataFrame) -> DataFrame:
    """Of each recording's and stream's poses: frames, span, the largest range along an axis, and whether that makes a usable reference."""
    spread = F.greatest(*[F.max(F.col("pose")[i]) - F.min(F.col("pose")[i]) for i in range(3)])
    out = rows.groupBy("recording", "stream").agg(F.count("*").alias("n_frames"), F.bround(F.max("ts") - F.min("ts"), 3).alias("span_s"), spread.alias("spread"))
    return out.withColumn("usable", F.col("spread") > 0.05)
