"""Token counts by separator scan of flat token files.

A flat token file is ids one after another, each document closed by a separator id, with no index. Tasks
read byte ranges of it, blocks of a fixed size that ignore document borders, so that a file of any length
spreads over tasks. Each block is searched for the separator in one vectorised step; documents that lie
within a block are complete, and a prefix scan over the blocks' summaries gives what is carried into each
block, so that documents across borders are stitched together. The scan has two levels (blocks within a
chunk, then chunks), so no task holds a whole file's summaries.
"""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.llm.bpe import codec, default_path
from cartolith.llm.common import _drop, byte_rows, shared_dir, width, written

#: Ids in a block, and blocks in a chunk of the prefix scan.
BLOCK_IDS, CHUNK = 1 << 20, 1024
KINDS = {1: "<u1", 2: "<u2", 4: "<u4"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that a task opens a file of the cluster with, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def id_bytes_of(path: str | None = None, separator: int | None = None) -> int:
    """Bytes that the ids of a vocabulary and the separator need: 2 or 4."""
    largest = max(len(codec(path or default_path()).sizes) - 1, separator or 0)
    if largest >= 1 << 32:
        raise ValueError(f"id {largest} doesn't fit in 4 bytes")
    return 2 if largest < 1 << 16 else 4


def new_folder(spark: SparkSession) -> str:
    """An empty folder for flat files among the shared ones; it goes when the driver's process ends."""
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, folder)
    return folder


def write_flat(docs: DataFrame, folder: str, path: str | None = None, separator: int | None = None) -> DataFrame:
    """Writes docs as flat token files in folder, one a partition; gives file (its name), first and doc_ids, the
    doc_ids in the files' order from ordinal first on. Write that table: its rows are what a task's success commits.

    A file's name is new for each attempt of a task, so what a lost attempt left is told by its absence from
    the table. Special tokens' strings in a text are ordinary text here, so only document ends have the
    separator's id. A null text is a document without tokens, a null doc_id stays null; rows that repeat are
    documents of their own. Ids are little-endian, of id_bytes_of() bytes."""
    path = path or default_path()
    id_bytes = id_bytes_of(path, separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        eod = next(iter(own.special.values())) if separator is None else separator
        name, first, out = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0, None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                if out is None:
                    system, place = file_system(f"{folder}/{name}")
                    system.create_dir(os.path.dirname(place), recursive=True)
                    out = system.open_output_stream(place)
                for ids in own.encode(part.column("text").to_pylist(), special=False):
                    out.write(np.append(ids, eod).astype(KINDS[id_bytes]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64()))], ["file", "first", "doc_ids"])
                first += part.num_rows
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "file string, first long, doc_ids array<long>")


def _summary(ids: np.ndarray, separator: int) -> tuple[int, int, np.ndarray]:
    """How many ids a block has, how many follow its last separator, and the lengths of what each separator closes in it."""
    at = np.flatnonzero(ids == separator)
    return len(ids), len(ids) - (int(at[-1]) + 1 if len(at) else 0), np.diff(at, prepend=-1) - 1


def _summaries(file: pa.Array, block: pa.Array, found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    cols = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([file, block, *cols], ["file", "block", "n", "tail", "inner"])


def scan_files(spark: SparkSession, path: str, separator: int, id_bytes: int = 2, block_ids: int = BLOCK_IDS, names: DataFrame | None = None) -> DataFrame:
    """separator_scan() of the flat files (*.bin) in a folder, whatever their sizes; file is a file's full path.

    names: a table of the names (file) of those that count; others, such as a lost attempt's, aren't opened. A
    file whose size isn't a multiple of id_bytes is an error."""
    step, parts = id_bytes * block_ids, width(spark)
    # only names and lengths are read here
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length")
    if names is not None:
        files = files.join(names.select(F.col("file").alias("name")).distinct(), F.element_at(F.split("file", "/"), -1) == F.col("name"), "left_semi")
    ranges = files.filter("length > 0").select("file", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (name, length, block) in enumerate(zip(*(b.column(c).to_pylist() for c in ("file", "length", "block")), strict=True)):
                if length % id_bytes:
                    raise ValueError(f"{name} has {length} bytes, no multiple of {id_bytes}")
                system, place = file_system(name)
                with system.open_input_file(place) as f:
                    data = f.read_at(min(step, length - block * step), block * step)
                yield _summaries(b.column("file").slice(i, 1), b.column("block").slice(i, 1), [_summary(np.frombuffer(data, KINDS[id_bytes]), separator)])

    found = ranges.repartition(parts, "file", "block").mapInArrow(run, "file string, block long, n long, tail long, inner array<long>")
    return stitched(written(found, "block-summaries"))


def separator_scan(blocks: DataFrame, separator: int, id_bytes: int = 2) -> DataFrame:
    """file, ordinal (from 0 within the file), n_tokens (without the separator), closed, for each document.

    blocks has file, block and data. What follows a file's last separator is one more document with closed
    false, if it has any ids. Two separators in a row close an empty document. A file without blocks, or
    blocks that are null or empty, give nothing. Blocks must be numbered in order within a file; gaps in the
    numbers don't matter."""
    file_type = dict(blocks.dtypes)["file"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _summaries(b.column("file"), b.column("block"), [_summary(np.frombuffer(x or b"", KINDS[id_bytes]), separator) for x in byte_rows(b, "data")])

    found = blocks.select("file", F.col("block").cast("long"), "data").mapInArrow(run, f"file {file_type}, block long, n long, tail long, inner array<long>")
    return stitched(written(found, "block-summaries"))


def stitched(found: DataFrame) -> DataFrame:
    """The documents of files from their blocks' summaries (a written table of file, block, n, tail, inner), by a prefix scan of two levels.

    The scan holds numbers only; the lengths in the blocks are joined afterwards."""
    lengths = found.select("file", "block", "inner")
    found = found.select("file", "block", "n", "tail", F.floor(F.col("block") / CHUNK).alias("chunk"), F.size("inner").alias("seps"))
    before = W.partitionBy("file", "chunk").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # positions count from the chunk's start here, from the file's start below
    found = found.withColumns({"s1": F.coalesce(F.sum("n").over(before), F.lit(0)), "d1": F.coalesce(F.sum("seps").over(before), F.lit(0))})
    found = found.withColumn("after", F.when(F.col("seps") > 0, F.col("s1") + F.col("n") - F.col("tail")))
    found = found.withColumn("e1", F.max("after").over(before))
    chunks = found.groupBy("file", "chunk").agg(F.sum("n").alias("cn"), F.sum("seps").alias("cd"), F.max("after").alias("ca"), F.max("block").alias("cb"))
    earlier = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumns({"s2": F.coalesce(F.sum("cn").over(earlier), F.lit(0)), "d2": F.coalesce(F.sum("cd").over(earlier), F.lit(0)), "final": F.max("cb").over(W.partitionBy("file"))})
    chunks = chunks.withColumn("e2", F.max(F.col("s2") + F.col("ca")).over(earlier)).select("file", "chunk", "s2", "d2", "e2", "final")
    joined = found.join(chunks, ["file", "chunk"]).join(lengths, ["file", "block"])
    carry = F.col("s2") + F.col("s1") - F.coalesce(F.col("s2") + F.col("e1"), F.col("e2"), F.lit(0))
    at_end = (F.col("block") == F.col("final")) & (F.col("tail") + F.when(F.col("seps") == 0, F.col("carry")).otherwise(0) > 0)
    joined = joined.withColumn("carry", carry)
    open_tail = F.when(at_end, F.array(F.struct((F.col("tail") + F.when(F.col("seps") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<n_tokens:bigint,closed:boolean>>"))
    whole = F.transform("inner", lambda x, i: F.struct((x + F.when(i == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed")))
    rows = joined.select("file", (F.col("d2") + F.col("d1")).alias("first"), F.posexplode(F.concat(whole, open_tail)).alias("i", "doc"))
    return rows.select("file", (F.col("first") + F.col("i")).alias("ordinal"), F.col("doc.n_tokens").alias("n_tokens"), F.col("doc.closed").alias("closed"))


def document_order(order: DataFrame) -> DataFrame:
    """file, ordinal, doc_id from the table that write_flat() gave."""
    rows = order.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id"))
    return rows.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")


def token_counts(order: DataFrame, folder: str, path: str | None = None, separator: int | None = None) -> DataFrame:
    """doc_id, n_tokens and closed of each document, by a scan of the files that write_flat() put in folder; order is its table, written.

    Only files that order names are opened. An empty table gives an empty result; a document without tokens counts 0."""
    eod = next(iter(codec(path or default_path()).special.values())) if separator is None else separator
    counts = scan_files(order.sparkSession, folder, eod, id_bytes_of(path, separator), names=order)
    counts = counts.withColumn("file", F.element_at(F.split("file", "/"), -1))
    return counts.join(document_order(order), ["file", "ordinal"]).select("doc_id", "n_tokens", "closed")
