"""Best partners of query vectors among many, as a grid of blocks.

A task meets a block of queries with a share of the frames. Products of matrices tell which pairs can be among the
best; only these are scored one by one, term after term in order, so that a score depends on its two vectors alone and
equal vectors tie. All frames are met and nothing is dropped that could be among the best.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.operators.shared import kept, width

#: Queries of a block, frames of a share, queries multiplied at once, and pairs scored at once.
QUERIES, FRAMES, ROWS, PAIRS = 2048, 32_768, 64, 65_536


def _matrix(column: pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and which components are there."""
    column = column.combine_chunks()
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    values, known = np.zeros((len(n), dims)), np.zeros((len(n), dims), bool)
    values[rows, at] = np.where(there, flat.to_numpy(zero_copy_only=False), 0.0)
    known[rows, at] = there
    return values, known


def _dots(x: np.ndarray, y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Dot products of pairs of rows over what both hold."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += np.where(known[:, i], x[:, i] * y[:, i], 0.0)
    return out


def _correlations(x: np.ndarray, y: np.ndarray, known: np.ndarray) -> np.ndarray:
    """functions.placing.correlation() of pairs of rows; minus infinity where that is null."""
    known = known & np.isfinite(x) & np.isfinite(y)
    n, sx, sy, xx, yy, xy = (np.zeros(len(x)) for _ in range(6))
    for i in range(x.shape[1]):
        a, b = np.where(known[:, i], x[:, i], 0.0), np.where(known[:, i], y[:, i], 0.0)
        n, sx, sy, xx, yy, xy = n + known[:, i], sx + a, sy + b, xx + a * a, yy + b * b, xy + a * b
    vx, vy = xx - sx * sx / n, yy - sy * sy / n
    return np.where((n >= 2) & (vx > 0) & (vy > 0), (xy - sx * sy / n) / np.sqrt(vx * vy), -np.inf)


def _plain(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to multiply, their lengths, and which of them numbers can't bound."""
    length = np.sqrt((x * x).sum(axis=1))
    odd = ~(length < 1e150)
    return np.where(odd[:, None], 0.0, x), np.where(odd, 0.0, length), odd


def _units(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for correlations: rows without their mean, of length one. Rows with gaps, or of hardly any variance, aren't bounded."""
    off = x - x.mean(axis=1, keepdims=True) if x.shape[1] else x
    length, whole = np.sqrt((off * off).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    odd = ~(known.all(axis=1) & (length > 1e-3 * whole) & (whole < 1e70) & (whole > 1e-70))
    return np.where(odd[:, None], 0.0, off / np.where(odd, 1.0, length)[:, None]), np.where(odd, 0.0, 1.0), odd


#: For each kind of score: rows to multiply, the scores of pairs, and how far both may be apart for rows of length one.
KINDS: dict[str, tuple[Callable, Callable, float]] = {"dot": (_plain, _dots, 1e-12), "correlation": (_units, _correlations, 1e-6)}


def best_pairs(frames: DataFrame, queries: DataFrame, per: list[str], k: int, kind: str, least: float, open_end: bool, others: bool = False) -> DataFrame:
    """query_id, per, id, score: of each query and group `per` at least the k best pairs whose score passes least (open_end: is above it), equal ones by id; NaN is above all.

    frames has id, vector and per; queries query_id and query. Each share of the frames gives its k best: the caller ranks them. others: no pair of equal ids."""
    frames = kept(frames.select("id", F.col("vector").cast("array<double>").alias("vector"), *per).filter("vector IS NOT NULL"), "frames")
    queries = kept(queries.select("query_id", F.col("query").cast("array<double>").alias("query")).filter("query IS NOT NULL"), "queries")
    n, m = frames.count(), queries.count()
    shares = max(1, -(-n // FRAMES))
    blocks = max(1, -(-m // QUERIES), min(-(-2 * width(frames.sparkSession) // shares), m // ROWS))
    numbers = lambda end: F.explode(F.sequence(F.lit(0), F.lit(end - 1)).cast("array<long>"))
    left = frames.select("*", F.pmod(F.xxhash64("id", "vector"), F.lit(shares)).alias("share"), numbers(blocks).alias("block"))
    right = queries.select("*", numbers(shares).alias("share"), F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)).alias("block"))
    rows, scores, slack = KINDS[kind]

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        codes = np.zeros(a.num_rows, np.int64)
        if per and a.num_rows:
            codes = a.select(per).to_pandas().groupby(per, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(codes, kind="stable")
        a, codes = a.take(pa.array(order)), codes[order]
        longest = [pc.max(pc.list_value_length(t.column(c))).as_py() or 0 for t, c in ((a, "vector"), (b, "query"))]
        (x, x_known), (y, y_known) = _matrix(a.column("vector"), max(longest)), _matrix(b.column("query"), max(longest))
        (u, u_len, u_odd), (v, v_len, v_odd) = rows(x, x_known), rows(y, y_known)
        ids, own = a.column("id").to_pandas().to_numpy(), b.column("query_id").to_pandas().to_numpy()
        place = np.unique(ids, return_inverse=True)[1]
        cuts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)]).tolist()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(v), ROWS):
            near = v[at : at + ROWS] @ u.T
            apart = slack * v_len[at : at + ROWS] * u_len.max(initial=0.0) + 1e-300
            some = v_odd[at : at + ROWS, None] | u_odd[None]
            same = own[at : at + ROWS, None] == ids[None] if others else None
            near[some] = -np.inf
            if others:
                near[same] = -np.inf
            for s, e in zip(cuts, [*cuts[1:], len(codes)], strict=True):
                part = near[:, s:e]
                kth = part.max(axis=1) if k == 1 else np.partition(part, e - s - k, axis=1)[:, e - s - k] if e - s > k else np.full(len(part), -np.inf)
                close = (part >= np.maximum(kth - 2 * apart, least - apart)[:, None]) & (part > -np.inf) | some[:, s:e]
                if others:
                    close &= ~same[:, s:e]
                i, j = np.nonzero(close)
                for p in range(0, len(i), PAIRS):
                    q, f = i[p : p + PAIRS] + at, j[p : p + PAIRS] + s
                    score = scores(x[f], y[q], x_known[f] & y_known[q])
                    good = (score > least if open_end else score >= least) | np.isnan(score)
                    found.append(_first(q[good], f[good], score[good], codes, place, k))
        q, f, score = _first(*(np.concatenate([np.empty(0, t), *[r[i] for r in found]]) for i, t in enumerate((np.int64, np.int64, float))), codes, place, k)
        out = {"query_id": b.column("query_id").take(pa.array(q)), **{c: a.column(c).take(pa.array(f)) for c in ("id", *per)}, "score": pa.array(score)}
        return pa.table(out)

    kinds = dict(frames.dtypes) | dict(queries.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("query_id", "id", *per)) + ", score double"
    return left.groupBy("share", "block").cogroup(right.groupBy("share", "block")).applyInArrow(met, schema)


def _first(q: np.ndarray, f: np.ndarray, score: np.ndarray, codes: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query and group."""
    order = np.lexsort((place[f], -score, ~np.isnan(score), codes[f], q))
    q, f, score = q[order], f[order], score[order]
    new = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (codes[f[1:]] != codes[f[:-1]]))[: len(q)])
    stay = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q)))) < k
    return q[stay], f[stay], score[stay]
