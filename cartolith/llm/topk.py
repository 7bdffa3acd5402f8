"""Exact top-k by inner product, by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer term weights. Queries and candidates are dealt out as a grid: a task gets
blocks of queries, each with one share of the candidates, holds a block of queries and streams candidates
past it. It turns a batch of candidates into postings (for each term, the candidates that have it and their
weights) and scatters every term's postings, times the weights of the queries that have the term, into a
dense array of scores. Each batch gives its own best by partition selection, and these are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.llm.common import width, written

#: Queries in a block (on average half), least rows of a share of the candidates, and candidates and queries in one array of scores.
QUERY_BLOCK, SHARE, TASK_ROWS, TASK_QUERIES = 32_768, 8192, 1024, 128
_LEAST, _MOST = -(2**63), 2**63 - 1


def weights(batch: pa.RecordBatch, scale: float) -> np.ndarray:
    """Rows of integer weights: column w as it is or, where it holds floating-point numbers, floor(scale * x); shorter vectors are filled with 0.

    Where weights pass 2**62, the array holds exact Python integers."""
    lists = batch.column("w")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    terms = np.arange(int(sizes.max(initial=0)))
    inside = terms < sizes[:, None]
    found = flat[(offsets[:-1, None] + terms)[inside]]
    if found.dtype.kind == "i":
        values = found.astype(np.int64)
    elif np.abs(found).max(initial=0) * scale < 2.0**62:
        values = np.floor(scale * found).astype(np.int64)
    else:
        values = np.array([floor(Fraction(scale) * Fraction(x)) for x in found.tolist()], object)
    out = np.zeros((len(sizes), len(terms)), values.dtype)
    out[inside] = values
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, (rows, queries): a scatter of each term's postings into the scores of the queries that have it.

    Scores are exact; one beyond a long becomes the nearest long."""
    terms = min(queries.shape[1], rows.shape[1])
    largest = [max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in (queries, rows)]
    bound = largest[0] * largest[1] * max(1, terms)
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    queries, rows = queries.astype(kind), rows.astype(kind)
    scores = np.zeros((len(rows), len(queries)), kind)
    held = np.empty_like(scores)
    for t in range(terms):
        posting, asking = np.flatnonzero(rows[:, t]), np.flatnonzero(queries[:, t])
        if 2 * len(posting) * len(asking) > scores.size:  # long lists on both sides are scattered as dense ones
            np.multiply(rows[:, t, None], queries[None, :, t], out=held)
            scores += held
        elif len(posting) and len(asking):
            scores[np.ix_(posting, asking)] += rows[posting, t, None] * queries[None, asking, t]
    return (np.clip(scores, _LEAST, _MOST) if kind is object else scores).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query position, row position and score of each query's k best rows but its own; ties go to smaller ids.

    scores is (rows, queries); rows and own are row numbers of the rows and of the queries."""
    order = np.argsort(ids, kind="stable")
    scores, rows = scores[order], rows[order]
    others = rows[:, None] != own[None, :]
    taken = others
    if len(rows) > k:
        ranked = np.where(others, scores, _LEAST)
        least = np.partition(ranked, len(rows) - k, axis=0)[len(rows) - k]
        above, level = ranked > least, (ranked == least) & others
        taken = above | level & (np.cumsum(level, axis=0) <= k - above.sum(axis=0))
    row, query = np.nonzero(taken)
    return query, order[row], scores[row, query]


def firsts(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query."""
    order = np.lexsort((ids, ~score, query))  # ~score falls as score rises, and has no overflow
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[place < k], ids[place < k], score[place < k]


def top_k(vectors: DataFrame, asks: Column | str = "true", k: int = 5, scale: float = 256.0, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors that asks holds for, its k best of all rows but itself.

    vectors has vec_id and embedding. Rows with a null vec_id, or a vector that is null or holds null or
    non-finite components, take no part. Vectors of different lengths meet on their common terms. A vector
    without components scores 0. A row is told from all others by its own number: rows of one vec_id, wholly
    equal ones too, are queries of their own, each with its ranks, and candidates of each other. Scores are
    exact integers; one beyond a long counts as the nearest long, for its rank too. Other columns are left
    aside; an empty table or no row that asks gives an empty result."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    asking = F.coalesce(F.expr(asks) if isinstance(asks, str) else asks, F.lit(False)).alias("asks")
    plain = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), asking, x.alias("w"))
    largest = plain.agg(F.max(F.array_max(F.transform("w", F.abs)))).first()[0] or 0.0
    if largest * scale < 2**31 - 1:  # integers of half the size travel
        plain = plain.withColumn("w", F.transform("w", lambda v: F.floor(v * scale).cast("int")))
    # row numbers hold once they are written
    rows = written(plain.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter("asks")
    parts = width(vectors.sparkSession)
    blocks = max(1, -(-asked.count() // max(1, query_block // 2)))
    # of the candidates, so that all tasks have work, but no smaller than SHARE rows: each share gives its own best
    shares = max(1, min(-(-2 * parts // blocks), -(-rows.count() // SHARE)))
    hashed = F.xxhash64("row")
    left = asked.select(F.pmod(hashed, F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("side"), "row", "vec_id", "w")
    right = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(hashed, F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("side"), "row", "vec_id", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, own = None, [], None  # the cell that is being read, its queries' batches, and the queries as arrays

        def asks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return (*(whole.column(c).to_numpy() for c in ("row", "vec_id")), weights(whole, scale))

        def scored(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            w = weights(b, scale)
            rows, ids = (b.column(c).to_numpy() for c in ("row", "vec_id"))
            query_rows, query_ids, query_weights = own
            for q in range(0, len(query_ids), TASK_QUERIES):
                some = slice(q, q + TASK_QUERIES)
                found = []
                for r in range(0, len(ids), TASK_ROWS):
                    part = slice(r, r + TASK_ROWS)
                    query, row, score = best(accumulate(query_weights[some], w[part]), ids[part], rows[part], query_rows[some], k)
                    found.append((query, ids[r + row], score))
                if found:
                    query, vec, score = firsts(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x[some][query]) for x in (query_rows, query_ids)] + [pa.array(vec), pa.array(score)], ["query", "query_id", "vec_id", "score"])

        for b in batches:
            block, share, side = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "share", "side"))
            turns = np.flatnonzero((block[1:] != block[:-1]) | (share[1:] != share[:-1]) | (side[1:] != side[:-1])) + 1
            for s, e in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows], strict=True):
                if s == e:
                    continue
                if (now := (block[s], share[s])) != cell:
                    cell, held, own = now, [], None
                if side[s] == 0:
                    held.append(b.slice(s, e - s))
                elif held:
                    own = own or asks()
                    yield from scored(b.slice(s, e - s))

    cells = left.unionByName(right).repartition(parts, "block", "share").sortWithinPartitions("block", "share", "side")
    found = cells.mapInArrow(run, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
