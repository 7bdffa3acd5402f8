"""Line dedup: lines that many documents share go, but in the last of these documents.

Lines are exploded with their positions; a line's key is the line without white space at its ends and with
A-Z lower-cased. Keys long enough to count are hashed to 128 bits, the documents of each hash are counted
(first by hash and document, so that a line of every document doesn't meet in one task), and the positions of
lines over the threshold are gathered by text. Texts are put together again from the positions that stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import as_row, byte_rows, joined_by_weight, row_keys, written

#: Least code points of a key that counts, and least documents that make it go.
LEAST_CHARS, LEAST_DOCS = 40, 5

_CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """A line's key, None if it has fewer code points than least_chars."""
    key = line.strip().lower()  # of bytes: white space and letters of ASCII only
    return None if len(key) < least_chars or len(key.translate(None, _CONTINUATION)) < least_chars else key


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, k1, k2 (which tell rows apart), position from 0, h1, h2 (128 bits of the key) of each line that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, position, digests = [], [], []
            for i, text in enumerate(byte_rows(b, "text")):
                if text is None or len(text) < least_chars:
                    continue
                for at, line in enumerate(text.split(b"\n")):
                    key = line_key(line, least_chars)
                    if key is not None:
                        row.append(i)
                        position.append(at)
                        digests.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            of = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in ("doc_id", "k1", "k2")), pa.array(position, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "k1", "k2", "position", "h1", "h2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, position int, h1 long, h2 long")


def repeated_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h1, h2, keeper (the largest doc_id that has the line) and n_rows of each hash that least_docs documents have."""
    by_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    found = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"), F.sum("n").alias("n_rows"))
    return found.filter(F.col("n_docs") >= least_docs).drop("n_docs")


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs' columns, with n_lines, n_dropped and kept: the text without lines that least_docs documents share.

    Such a line stays in the document of the largest doc_id that has it, as often as it stands there. A null or
    empty text is one empty line; null becomes an empty kept. Rows with one doc_id are one document, and so are
    all rows without a doc_id; that one comes before all others. Columns of docs with the added names are
    replaced; all others stay, whatever their names. An empty table gives an empty result."""
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
    names = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    others = [c for c in names if c != "text"]
    lines = written(hashed_lines(docs, least_chars), "lines")
    repeated = written(repeated_lines(lines, least_docs), "repeated-lines")
    gone = joined_by_weight(lines, repeated, ["h1", "h2"], "n_rows").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # rows of equal doc_id and text lose the same positions: a set has each once
    gone = gone.groupBy("k1", "k2").agg(F.collect_set("position").alias("gone"))
    keyed = docs.select(*row_keys(), F.col("text").cast("string").alias("text"), as_row(docs, others))
    schema = T.StructType([*keyed.select("row", "text").schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, found in zip(byte_rows(b, "text"), b.column("gone"), strict=True):
                split = (text or b"").split(b"\n")
                n_lines.append(len(split))
                drop = set(found.values.to_numpy().tolist()) if found.is_valid else ()
                n_dropped.append(len(drop))
                kept.append(b"\n".join([x for i, x in enumerate(split) if i not in drop]) if drop else text or b"")
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema.fieldNames())

    out = keyed.join(gone, ["k1", "k2"], "left").select("row", "text", "gone").mapInArrow(run, schema)
    mine = {c: F.col("row").getField(c).alias(c) for c in others}
    return out.select(*[mine.get(c, F.col("text")) for c in names], *[f.name for f in added])
