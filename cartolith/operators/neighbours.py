"""Nearest points by cells of a grid.

Cells lie in tiles. A tile holds its points and those of the cells around it, so nothing but its rim is sent twice, and
crowded tiles are dealt out as a grid of blocks. A task meets the points of a cell with those of its 27 cells in arrays:
what leaves it is the nearest of each place, not a row of each pair, and no table is broadcast that grows as points do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.operators.shared import dropped, kept, width

#: Cells of a tile's side, places and other points of a block, rows of a group, and distances held at once.
TILE, PLACES, OTHERS, ROWS, HELD = 8, 8192, 32_768, 50_000, 1 << 20
#: Tiles that are broadcast, and distances that are few enough to take all.
TILES, FEW = 50_000, 1 << 28
TILE_OF = ["t0", "t1", "t2"]
PART = [*TILE_OF, "share", "block"]


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(size))


def _local(c: str, size: float, tile: str) -> Column:
    """A cell's number in its tile: 1 to TILE, 0 and TILE + 1 beside it."""
    return _cell(c, size) - F.col(tile) * TILE + 1


def _packed(size: float) -> Column:
    """One number for a cell of a tile, in the order of x, y, z."""
    x, y, z = (_local(c, size, t) for c, t in zip("xyz", TILE_OF, strict=True))
    return (((x * (TILE + 2)) + y) * (TILE + 2) + z).cast("int").alias("cell")


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one range after the other."""
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _nearest(places: pa.Table, others: pa.Table, n: int) -> pa.Table:
    """x, y, z, neighbour, distance: of each place the n nearest of the others in the 27 cells around its own, ties to the smaller neighbour."""
    others = others.take(pc.sort_indices(others.column("neighbour")))
    part = np.zeros(places.num_rows + others.num_rows, np.int64)
    if len(part):
        part = pa.concat_tables([places.select(PART), others.select(PART)]).to_pandas().groupby(PART, sort=False).ngroup().to_numpy().astype(np.int64)
    line = TILE + 2
    key = part * line**3 + np.concatenate([t.column("cell").to_numpy().astype(np.int64) for t in (places, others)])
    mine, theirs = key[: places.num_rows], key[places.num_rows :]
    by = np.argsort(theirs, kind="stable")  # within a cell, by neighbour
    theirs = theirs[by]
    order = np.argsort(mine, kind="stable")
    at, there = (np.column_stack([t.column(c).to_numpy() for c in "xyz"]).reshape(-1, 3) for t in (places, others))
    cells, first = np.unique(mine[order], return_index=True)
    # a place's cell is never at a tile's rim, so neither end of a row of three leaves the tile
    rows = cells[:, None] + np.array([i * line * line + j * line for i in (-1, 0, 1) for j in (-1, 0, 1)])
    start, end = np.searchsorted(theirs, rows - 1, "left"), np.searchsorted(theirs, rows + 1, "right")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for c, (s, e) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(mine)], strict=True)):
        met = by[_ranges(start[c], end[c])]
        if not len(met):
            continue
        near = there[met]
        for r in range(s, e, max(1, HELD // len(met))):
            own = order[r : min(e, r + max(1, HELD // len(met)))]
            with np.errstate(over="ignore", under="ignore"):
                off = [(at[own, i, None] - near[None, :, i]) ** 2 for i in range(3)]
                distance = np.sqrt(off[0] + off[1] + off[2])
            last = np.partition(distance, n - 1, axis=1)[:, n - 1] if len(met) > n else np.full(len(own), np.inf)
            i, j = np.nonzero(distance <= last[:, None])
            d, j = distance[i, j], met[j]
            by_distance = np.lexsort((j, d, i))
            i, j, d = i[by_distance], j[by_distance], d[by_distance]
            rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
            found.append((own[i[rank < n]], j[rank < n], d[rank < n]))
    i, j, d = (np.concatenate([np.empty(0, t), *[f[k] for f in found]]) for k, t in enumerate((np.int64, np.int64, float)))
    return pa.table({**{c: pa.array(at[i, k]) for k, c in enumerate("xyz")}, "neighbour": others.column("neighbour").take(pa.array(j)), "distance": pa.array(d)})


def first_size(places: DataFrame, side: float, crowd: int) -> float:
    """The side of cells to start from: at most side, and so small that no cell holds more than crowd places.

    Powers of two divide exactly, so no cell is missed by rounding. Cells' numbers fit a double's digits, and the square of a side is above zero."""
    far = places.agg(F.max(F.greatest(*[F.abs(c) for c in "xyz"]))).first()[0]
    least = 2.0 ** max(math.frexp(far)[1] - 52, -500)
    size = max(2.0 ** math.floor(math.log2(side)), least)
    most = lambda: places.groupBy(*[_cell(c, size) for c in "xyz"]).count().agg(F.max("count")).first()[0]
    while size > least and most() > crowd:
        size /= 2
    return size


def nearest_in_cells(places: DataFrame, others: DataFrame, n: int, size: float) -> DataFrame:
    """x, y, z, best: of each place (x, y, z) that meets any, the n nearest of others (neighbour, x, y, z) in the 27 cells of that size around its own, as distance and neighbour in order."""
    asked = places.select("x", "y", "z", *[F.floor(_cell(c, size) / TILE).alias(t) for c, t in zip("xyz", TILE_OF, strict=True)])
    tiles = kept(asked.select(TILE_OF).distinct(), "tiles")
    ends = tiles.agg(F.count("*").alias("n"), *[f(t).alias(f"{e}{t}") for t in TILE_OF for e, f in (("l", F.min), ("h", F.max))]).first()
    sent = others.select("neighbour", "x", "y", "z")
    for c, t in zip("xyz", TILE_OF, strict=True):
        sent = sent.withColumn(t, F.explode(F.array_distinct(F.array(*[F.floor((_cell(c, size) + i) / TILE) for i in (-1, 0, 1)])))).filter(F.col(t).between(ends[f"l{t}"], ends[f"h{t}"]))
    # estimates of what explode makes are far too small: joins say themselves what they broadcast
    sent = kept(sent.join(F.broadcast(tiles) if ends["n"] <= TILES else tiles.hint("merge"), TILE_OF, "left_semi"), "sent")
    counted = asked.select(*TILE_OF, F.lit(1).alias("place")).unionByName(sent.select(*TILE_OF, F.lit(0).alias("place"))).groupBy(TILE_OF).agg(F.sum("place").alias("n"), F.sum(1 - F.col("place")).alias("m"))
    crowded = kept(counted.filter((F.col("n") > PLACES) | (F.col("m") > OTHERS)).select(*TILE_OF, F.ceil(F.col("n") / PLACES).alias("blocks"), F.ceil(F.col("m") / OTHERS).alias("shares")), "crowded")
    buckets = max(width(places.sparkSession), -(-(places.count() + sent.count()) // ROWS))
    parts = lambda end: F.greatest(F.coalesce(F.col(end), F.lit(1)), F.lit(1))
    each = lambda end: F.explode(F.sequence(F.lit(0).cast("long"), parts(end) - 1))
    dealt = lambda end, *by: F.pmod(F.xxhash64(*by), parts(end))
    # a row of crowded stands for more than PLACES or OTHERS rows
    left = asked.join(F.broadcast(crowded), TILE_OF, "left").withColumn("share", each("shares")).withColumn("block", dealt("blocks", "x", "y", "z"))
    right = sent.join(F.broadcast(crowded), TILE_OF, "left").withColumn("block", each("blocks")).withColumn("share", dealt("shares", "neighbour"))
    left, right = (df.select("x", "y", "z", *PART, _packed(size), *c, F.pmod(F.xxhash64(*PART), F.lit(buckets)).alias("bucket")) for df, c in ((left, []), (right, ["neighbour"])))
    schema = f"x double, y double, z double, neighbour {dict(others.dtypes)['neighbour']}, distance double"
    found = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(lambda a, b: _nearest(a, b, n), schema)
    best = kept(found.groupBy("x", "y", "z").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, n).alias("best")), "best")
    dropped(tiles, sent, crowded)
    return best
