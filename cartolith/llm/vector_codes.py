"""Vector code compression: product codes whose nearest entries are found by VA-file filtering.

A vector of integers is cut into parts; each part is coded by the nearest entry of its position's codebook.
The entries' coordinates are quantised to a few bits, the cells of an approximation file. A query, that is a
vector's part, gets a look-up table of the least and the largest squared gap to each cell of each coordinate;
their sums bound an entry's distance from below and above. Only entries whose lower bound doesn't pass the
smallest upper bound are refined by integer distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Bits of a cell, queries in one look-up table, and the largest absolute integer: distances stay below 2**62.
BITS, AT_ONCE, LARGEST = 3, 4096, 2**26


@dataclass
class Codebook:
    """Entries (entry, coordinate) of one part position, their cells, and the cells' bounds (cell, coordinate)."""

    entries: np.ndarray
    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(entries: np.ndarray, bits: int = BITS) -> Codebook:
        """Each coordinate is cut where its sorted values fall into equal shares; equal values share a cell."""
        n, width = entries.shape
        edges = np.sort(entries, axis=0)[np.arange(1, 1 << bits) * n // (1 << bits)]
        cells = (entries[:, None] >= edges[None]).sum(axis=1)
        low, high = np.full((1 << bits, width), LARGEST), np.full((1 << bits, width), -LARGEST)
        for j in range(width):
            np.minimum.at(low[:, j], cells[:, j], entries[:, j])
            np.maximum.at(high[:, j], cells[:, j], entries[:, j])
        return Codebook(entries, cells, low, high)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, (query, entry), of squared distances, from a look-up table for each query."""
        below, above = self.low[None] - queries[:, None], queries[:, None] - self.high[None]
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lower = np.zeros((len(queries), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(self.entries.shape[1]):
            lower += least[:, self.cells[:, j], j]
            upper += most[:, self.cells[:, j], j]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nearest entry, of equally near ones the first, and its squared distance."""
        codes, errors = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(queries), AT_ONCE):
            some = queries[at : at + AT_ONCE]
            lower, upper = self.bounds(some)
            row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
            exact = ((some[row] - self.entries[entry]) ** 2).sum(axis=1)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.minimum.reduceat(exact, first)
            hit = np.flatnonzero(exact == least[row])
            hit = hit[np.unique(row[hit], return_index=True)[1]]
            codes.append(entry[hit])
            errors.append(least)
        return np.concatenate(codes), np.concatenate(errors)


def integer_vectors(vectors: DataFrame, parts: int = PARTS, scale: float = SCALE) -> DataFrame:
    """vec_id, label and w = floor(scale * x) of usable vectors, filled with zeros to one length that parts divide.

    Unusable are vectors that are null or hold null or non-finite components. Integers beyond LARGEST, which
    takes components beyond 2**18 at scale 256, count as LARGEST."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    w = F.transform(x, lambda v: F.least(F.greatest(F.floor(v * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    rows = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), w.alias("w"))
    sizes = rows.agg(F.min(F.size("w")), F.max(F.size("w"))).first()
    whole = -(-(sizes[1] or 0) // parts) * parts
    if sizes[0] == whole or sizes[0] is None:
        return rows
    return rows.withColumn("w", F.concat("w", F.array_repeat(F.lit(0), F.lit(whole) - F.size("w"))))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("w").flatten().to_numpy().astype(np.int64)
    return flat.reshape(batch.num_rows, -1)


def _cut(w: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, coordinate)."""
    return w.reshape(len(w), parts, -1).transpose(1, 0, 2)


def _moved(rows: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The codebooks with each entry replaced by the floor of the mean of the parts that are nearest to it; unused entries stay.

    Tasks give sums and counts of each entry's coordinates; their totals, as many as the codebooks have numbers, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(books), *books[0].entries.shape), np.int64)
        counts = np.zeros(sums.shape[:2], np.int64)
        for b in batches:
            for part, queries in enumerate(_cut(_matrix(b), len(books))):
                code, _ = books[part].nearest(queries)
                np.add.at(sums[part], code, queries)
                counts[part] += np.bincount(code, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        at = [np.repeat(x, sums.shape[2]) for x in (part, entry, counts[part, entry])]
        place = np.tile(np.arange(sums.shape[2]), len(part))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at[0], at[1], place, at[2], sums[part, entry].ravel())], ["part", "entry", "place", "n", "s"])

    found = rows.select("w").mapInArrow(run, "part long, entry long, place long, n long, s long")
    total = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    entries = np.stack([b.entries for b in books])
    for r in total.collect():
        entries[r.part, r.entry, r.place] = int(r.s) // r.n
    return [Codebook.of(e) for e in entries]


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    """A codebook for each part position of integer_vectors(): it starts as the parts of the entries smallest vec_ids.

    Rows without a vec_id come last, rows of one vec_id in the order of their vectors. Fewer rows give as many
    entries, no rows no codebooks."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "w").limit(entries).select("w").collect()
    start = np.array([r.w for r in first], np.int64)
    books = [Codebook.of(e) for e in _cut(start, parts)] if start.size else []
    for _ in range(rounds if books else 0):
        books = _moved(rows, books)
    return books


def encode(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """rows of integer_vectors() with codes (an entry for each part) and error (squared distances, summed over the parts) in w's place.

    Without codebooks, that is for vectors without components, codes are empty and the error is 0."""
    names = [c for c in rows.columns if c != "w"]
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = np.zeros((b.num_rows, len(books)), np.int32), np.zeros(b.num_rows, np.int64)
            for part, queries in enumerate(_cut(_matrix(b), len(books)) if books else ()):
                codes[:, part], found = books[part].nearest(queries)
                error += found
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(books))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(error)], schema.fieldNames())

    return rows.mapInArrow(run, schema)
