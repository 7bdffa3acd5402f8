"""Convex hulls as an aggregate that can be merged, and boxes of least area around clusters.

A hull of hulls is the hull of all their points. Each task drops, for all keys at once, the points well inside the
outermost ones of their key in eight directions, and takes hulls of keys that still have many. What stays of a key,
a few corners from each task, meets in one: a key may hold a third of all points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.operators.shared import width

#: Rows that a task takes at once, corners of a key past which a task takes their hull, and edges that are tried at once.
HELD, MANY, EDGES = 500_000, 256, 256


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (n, 2), counter-clockwise from the first by x and y, none on an edge between others.

    Points on one line give its two ends, equal points one."""
    p = np.unique(points, axis=0)
    if len(p) > 64:  # what lies well inside the hull of the outermost points in eight directions can't be a corner
        turn = np.arange(8) * np.pi / 4
        ring = hull(p[np.argmax(p @ np.stack([np.cos(turn), np.sin(turn)]), axis=0)])
        if len(ring) > 2:
            edge = np.roll(ring, -1, axis=0) - ring
            off = p[:, None] - ring[None]
            cross = edge[None, :, 0] * off[:, :, 1] - edge[None, :, 1] * off[:, :, 0]
            p = p[~(cross > 1e-9 * np.abs(edge).max() * np.abs(p).max()).all(axis=1)]
    if len(p) <= 2:
        return p

    def chain(order: list[list[float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for x, y in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append([x, y])
        return out[:-1]

    rows = p.tolist()
    return np.array(chain(rows) + chain(rows[::-1]))


def _outer(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which points may be corners of their group's hull, for groups that begin at start: those not well inside the outermost ones in eight directions."""
    size = np.diff(np.append(start, len(x)))
    of = np.repeat(np.arange(len(start)), size)
    ring = []
    for turn in np.arange(8) * np.pi / 4:
        off = np.cos(turn) * x + np.sin(turn) * y
        most = np.flatnonzero(off == np.maximum.reduceat(off, start)[of])
        ring.append(most[np.unique(of[most], return_index=True)[1]])  # the first of equal ones
    scale = np.maximum.reduceat(np.maximum(np.abs(x), np.abs(y)), start)
    inside, edges = np.ones(len(x), bool), np.zeros(len(start), np.int64)
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        ex, ey = x[b] - x[a], y[b] - y[a]
        least = 1e-9 * np.maximum(np.abs(ex), np.abs(ey)) * scale
        edges += (ex != 0) | (ey != 0)
        real = ((ex != 0) | (ey != 0))[of]
        inside &= ~real | (ex[of] * (y - y[a][of]) - ey[of] * (x - x[a][of]) > least[of])
    return ~inside | (edges < 3)[of]


def _part_hulls(points: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys, x, y: points among which are the corners of each key's hull, a few from each task."""
    rows = points.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y")).filter("abs(x) < double('infinity') AND abs(y) < double('infinity')")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= HELD:
                yield from thinned(held)
                held = []
        yield from thinned(held)

    def thinned(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in held):
            both = pa.Table.from_batches(held)
            order, start = _by_key(both, keys)
            x, y = (both.column(c).to_numpy()[order] for c in "xy")
            stay = np.flatnonzero(_outer(x, y, start))
            ends = np.searchsorted(stay, np.append(start, len(x)))
            parts = []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                part = stay[s:e]
                parts.append(part if len(part) <= MANY else part[_corners(x[part], y[part])])
            yield from both.take(pa.array(order[np.concatenate(parts)])).to_batches()

    return rows.mapInArrow(reduced, f"{_kinds(rows, keys)}x double, y double")


def _corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the first point at each corner of the hull."""
    corners = {tuple(c) for c in hull(np.stack([x, y], axis=1)).tolist()}
    return np.array([i for i, c in enumerate(zip(x.tolist(), y.tolist(), strict=True)) if c in corners and not corners.discard(c)])


def _by_key(rows: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their key, and where each key begins."""
    number = rows.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(number, kind="stable")
    return order, np.flatnonzero(np.append(True, np.diff(number[order]) != 0))


def _of_hulls(parts: DataFrame, keys: list[str], found: Callable[[np.ndarray], dict[str, list]], kinds: str) -> DataFrame:
    """keys and the columns that found() makes of the hull of each key's points, many keys in one task."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in (*batches, None):
            if b is not None and b.num_rows:
                same = kept and all(kept[0].column(c)[0] == b.column(c)[-1] or not kept[0].column(c)[0].is_valid and not b.column(c)[-1].is_valid for c in keys)
                kept.append(b)
                if same:
                    continue
            elif b is not None or not kept:
                continue
            both = pa.Table.from_batches(kept)
            order, start = _by_key(both, keys)
            if b is not None:  # the last key may go on
                kept = both.slice(int(start[-1])).combine_chunks().to_batches()
                order, start = order[: start[-1]], start[:-1]
            if not len(start):
                continue
            x, y = (both.column(c).to_numpy()[order] for c in "xy")
            stay = np.flatnonzero(_outer(x, y, start))
            ends = np.searchsorted(stay, np.append(start, len(x)))
            made: dict[str, list] = {c: [] for c in names}
            at: list[int] = []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                part = stay[s:e]
                more = found(hull(np.stack([x[part], y[part]], axis=1)))
                at += [int(order[part[0]])] * len(more[names[0]])
                for c in names:
                    made[c] += more[c]
            own = both.select(keys).take(pa.array(at, pa.int64()))
            out = pa.table({**{c: own.column(c) for c in keys}, **{c: pa.array(made[c], t) for c, t in zip(names, types, strict=True)}})
            yield from out.combine_chunks().to_batches()

    of = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    types = [of[k.split()[1]] for k in kinds.split(", ")]
    dealt = parts.repartition(width(parts.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, f"{_kinds(parts, keys)}{kinds}")


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{c}` {k}, " for c, k in df.select(*keys).dtypes)


def hulls(points: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys, place, x, y: the corners of the convex hull of each key's points, counter-clockwise from the first by x and y.

    Points without a finite x and y don't count; null keys are a key."""

    def corners(c: np.ndarray) -> dict[str, list]:
        return {"place": list(range(len(c))), "x": c[:, 0].tolist(), "y": c[:, 1].tolist()}

    return _of_hulls(_part_hulls(points, keys, x, y), keys, corners, "place int, x double, y double")


def least_box(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Direction, low and high ends (along it and across) of the rectangle of least area around a hull; one side lies on an edge. Of equal areas the first edge's counts.

    On a line the box lies along it, around a point along x."""
    edges = np.roll(corners, -1, axis=0) - corners if len(corners) > 2 else corners[1:] - corners[:1] if len(corners) == 2 else np.array([[1.0, 0.0]])
    edges = edges / np.hypot(edges[:, 0], edges[:, 1])[:, None]
    best = (np.inf, None)
    for at in range(0, len(edges), EDGES):
        some = edges[at : at + EDGES]
        along, across = corners @ some.T, corners @ np.stack([-some[:, 1], some[:, 0]])
        low, high = np.stack([along.min(axis=0), across.min(axis=0)]), np.stack([along.max(axis=0), across.max(axis=0)])
        area = (high - low).prod(axis=0)
        i = int(np.argmin(area))
        if area[i] < best[0]:
            best = (area[i], (some[i], low[:, i], high[:, i]))
    return best[1]


def yaw_boxes(points: DataFrame, keys: list[str], position: tuple[str, str, str], up: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """keys, points, center, extents and axes (three arrays, the last along up) of the upright box of least floor area around each key's points.

    Points without finite coordinates don't count. Where a footprint is a line or a point, so is the box's."""
    u = np.array(up, float) / np.linalg.norm(up)
    e1 = np.cross([1.0, 0.0, 0.0] if abs(u[0]) < 0.9 else [0.0, 1.0, 0.0], u)
    e1 /= np.linalg.norm(e1)
    e2 = np.cross(u, e1)
    dot = lambda a: sum((F.col(c).cast("double") * float(v) for c, v in zip(position, a, strict=True)), F.lit(0.0))
    good = points.filter(" AND ".join(f"abs(cast(`{c}` as double)) < double('infinity')" for c in position))
    heights = good.groupBy(*keys).agg(F.count("*").alias("points"), F.min(dot(u)).alias("low"), F.max(dot(u)).alias("high"))

    def boxed(corners: np.ndarray) -> dict[str, list]:
        way, low, high = least_box(corners)
        a1 = way[0] * e1 + way[1] * e2
        found = [*((low + high) / 2).tolist(), *(high - low).tolist(), a1.tolist(), np.cross(u, a1).tolist()]
        return {c: [v] for c, v in zip(("m1", "m2", "s1", "s2", "a1", "a2"), found, strict=True)}

    parts = _part_hulls(good, keys, dot(e1), dot(e2))
    boxes = _of_hulls(parts, keys, boxed, "m1 double, m2 double, s1 double, s2 double, a1 array<double>, a2 array<double>")
    same = [heights[c].eqNullSafe(boxes[c]) for c in keys]
    both = heights.join(boxes, same)
    up_axis = F.array(*[F.lit(float(v)) for v in u])
    middle = (F.col("low") + F.col("high")) / 2
    center = F.array(*[F.col("m1") * F.col("a1")[i] + F.col("m2") * F.col("a2")[i] + middle * float(u[i]) for i in range(3)])
    return both.select(*[heights[c] for c in keys], "points", center.alias("center"), F.array("s1", "s2", F.col("high") - F.col("low")).alias("extents"), F.array("a1", "a2", up_axis).alias("axes"))
