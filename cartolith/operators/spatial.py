"""Voxels, level-of-detail choice, planes, occupancy grids, reachability and fused detections."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.functions import text as X
from cartolith.operators.components import connected_components
from cartolith.operators.shared import dropped, even_hash, kept, smallest

P = ("x", "y", "z")


def cols(position: tuple[str, str, str] = P) -> tuple[Column, Column, Column]:
    return tuple(F.col(c) for c in position)


def voxels(points: DataFrame, side: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), position: tuple[str, str, str] = P) -> DataFrame:
    """key, n and mean position of each occupied voxel."""
    keyed = points.select(G.voxel_key(cols(position), origin, side).alias("key"), *[F.col(c).alias(a) for c, a in zip(position, P, strict=True)])
    return keyed.groupBy("key").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in P])


def noise_threshold(grid: DataFrame, share: float = 0.15, most: int = 32) -> DataFrame:
    """threshold: one more than the largest count whose voxels, with all smaller ones, hold at most share of the points; at most `most`."""
    by = grid.groupBy("n").agg(F.count("*").alias("voxels"))
    running = by.withColumn("below", F.sum(F.col("n") * F.col("voxels")).over(W.orderBy("n")))  # one row for each count
    total = by.agg(F.sum(F.col("n") * F.col("voxels")).alias("all"))
    fits = running.join(F.broadcast(total)).filter(F.col("below") <= share * F.col("all"))
    return fits.agg(F.least(F.coalesce(F.max("n"), F.lit(0)) + 1, F.lit(most)).alias("threshold"))


def first_of_voxel(points: DataFrame, side: float, order: str, importance: Column | None = None, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), position: tuple[str, str, str] = P) -> DataFrame:
    """points with one row a voxel: the most important, ties (and without importance, all) to the lowest order."""
    key = G.voxel_key(cols(position), origin, side)
    rank = F.struct((F.lit(0.0) if importance is None else -importance).alias("i"), F.col(order).alias("o"))
    return points.withColumn("__k", key).groupBy("__k").agg(F.min_by(F.struct(*points.columns), rank).alias("__r")).select("__r.*")


def voxel_side(points: DataFrame, target: int, side: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), position: tuple[str, str, str] = P, rounds: int = 10, close: float = 0.03) -> float:
    """A side that leaves about target occupied voxels: the side grows as the square root of occupied over target.

    Each round is one distinct count; the driver holds one number."""
    for _ in range(rounds):
        n = points.select(G.voxel_key(cols(position), origin, side).alias("k")).distinct().count()
        if not n or abs(n - target) <= close * target:
            break
        side *= min(4.0, max(0.25, (n / target) ** 0.5))
    return side


def lod(points: DataFrame, target: int, order: str, side: float, importance: Column | None = None, mode: str = "auto", **how) -> DataFrame:
    """target points, or all if there are no more, by one of four modes.

    uniform: those of the smallest hash of order. importance: the most important. voxel_importance: the most
    important of each voxel, voxels being searched for from side until about target are occupied; what is over target is
    cut by the hash, never by importance. voxel_first: the first by order of each voxel, cut likewise. auto:
    voxel_importance where importance varies, else voxel_first. The voxel modes may leave somewhat fewer points than target."""
    if mode == "auto":
        ends = points.agg(F.min(importance).alias("low"), F.max(importance).alias("high")).first() if importance is not None else None
        mode = "voxel_importance" if ends is not None and ends["low"] is not None and ends["high"] - ends["low"] > 1e-6 else "voxel_first"
    if mode == "uniform":
        return smallest(points, even_hash(order), [order], target)
    if mode == "importance":
        return smallest(points, -importance, [order], target)
    if mode not in ("voxel_importance", "voxel_first"):
        raise ValueError(f"unknown mode {mode}")
    if points.count() <= target:
        return points
    found = kept(first_of_voxel(points, voxel_side(points, int(target * 1.05), side, **how), order, importance if mode == "voxel_importance" else None, **how), "lod")
    return smallest(found, even_hash(order), [order], target)


def decimated(splats: DataFrame, target: int, order: str, side: float, importance: Column, floor_share: float, scales: tuple[str, ...] = ("scale_0", "scale_1", "scale_2"), **how) -> DataFrame:
    """lod() by auto, whose splats still cover the surface: log scales are at least that of floor_share of the voxels' side; all splats as they are, if there are no more than target."""
    if splats.count() <= target:
        return splats
    least = math.log(voxel_side(splats, int(target * 1.05), side, **how) * floor_share)
    return lod(splats, target, order, side, importance, **how).withColumns({c: F.greatest(F.col(c), F.lit(least)) for c in scales})


def plane(points: DataFrame, order: str, threshold: float, hypotheses: int = 256, sample: int = 20_000, position: tuple[str, str, str] = P, up: tuple[float, float, float] | None = None, lean: float = 0.2) -> dict | None:
    """The dominant plane: point, normal, inliers, spread (variances along its two axes, the larger first); None if no three points span one.

    up: only planes count whose normal has less than lean along that unit vector, upright ones.

    Planes through seeded triples of a bounded sample are scored against that sample in one job; the best is
    then refitted to all its inliers from their moments. Only triples and moments reach the driver."""
    x, y, z = (F.col(c).cast("double") for c in position)
    drawn = kept(points.select(F.col(order).alias("o"), x.alias("x"), y.alias("y"), z.alias("z")).orderBy(F.xxhash64(order), order).limit(sample), "plane-sample")
    seeds = np.array([[r.x, r.y, r.z] for r in drawn.orderBy(F.xxhash64("o", F.lit(1)), "o").limit(3 * hypotheses).collect()])
    if len(seeds) < 3:
        return None
    trios = seeds[: len(seeds) // 3 * 3].reshape(-1, 3, 3)
    normals = np.cross(trios[:, 1] - trios[:, 0], trios[:, 2] - trios[:, 0])
    size = np.linalg.norm(normals, axis=1)
    good = size > 1e-12
    if up is not None:
        good &= np.abs(normals @ np.array(up, float)) < lean * size
    if not good.any():
        return None
    planes = [(*map(float, n / s), float(n / s @ t[0])) for n, s, t in zip(normals[good], size[good], trios[good], strict=True)]
    spark = points.sparkSession
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(planes)], "i int, a double, b double, c double, d double")
    near = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") - F.col("d")) <= threshold
    # both sides are bounded: `hypotheses` planes against `sample` points
    best = drawn.join(F.broadcast(table), near).groupBy("i", "a", "b", "c", "d").count().orderBy(F.desc("count"), "i").first()
    if best is None:
        return None
    a, b, c, d = best["a"], best["b"], best["c"], best["d"]
    for _ in range(2):
        m = points.filter(F.abs(a * x + b * y + c * z - d) <= threshold).agg(F.count("*").alias("n"), *[F.avg(p).alias(f"m{i}") for i, p in enumerate((x, y, z))], *[F.covar_pop(p, q).alias(f"c{i}{j}") for i, p in enumerate((x, y, z)) for j, q in enumerate((x, y, z)) if i <= j]).first()
        if m["n"] < 3:
            return None
        spread, axes = np.linalg.eigh(np.array([[m[f"c{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]))
        normal = axes[:, 0]
        normal = normal * (-1.0 if normal[np.abs(normal).argmax()] < 0 else 1.0)
        at = np.array([m["m0"], m["m1"], m["m2"]])
        (a, b, c), d = map(float, normal), float(normal @ at)
    return {"point": at.tolist(), "normal": normal.tolist(), "inliers": m["n"], "spread": [max(0.0, float(spread[2])), max(0.0, float(spread[1]))]}


def planes(points: DataFrame, order: str, threshold: float, most: int = 6, least: int = 50, position: tuple[str, str, str] = P) -> list[dict]:
    """Up to `most` planes, each found in what the ones before leave beyond twice the threshold."""
    found, rest = [], points
    for _ in range(most):
        p = plane(rest, order, threshold, position=position)
        if p is None or p["inliers"] < least:
            break
        found.append(p)
        rest = rest.filter(F.abs(G.plane_height(cols(position), p["point"], p["normal"])) > 2 * threshold)
    return found


def without_structure(points: DataFrame, floor: dict, walls: list[dict], band: float, wall_band: float, ceiling: float | None = None, position: tuple[str, str, str] = P) -> DataFrame:
    """Points above the floor's band, below the ceiling's, and off every wall."""
    height = G.plane_height(cols(position), floor["point"], floor["normal"])
    keep = height > 2 * band
    if ceiling is not None:
        keep = keep & (height < ceiling - 2 * band)
    for w in walls:
        keep = keep & (F.abs(G.plane_height(cols(position), w["point"], w["normal"])) >= wall_band)
    return points.filter(keep)


def occupancy(points: DataFrame, u: Column, v: Column, height: Column, side: float, low: float = 0.2, high: float = 1.5, known_to: float = 3.0, fill: int = 1, clearance: int = 1) -> DataFrame:
    """iu, iv, occupied, free of each known cell: cells with points up to known_to, grown by fill; free ones are further than clearance from any occupied."""
    cells = points.select(F.floor(u / side).alias("iu"), F.floor(v / side).alias("iv"), height.alias("h")).filter(F.col("h") <= known_to)
    cells = cells.groupBy("iu", "iv").agg(F.max(F.col("h").between(low, high)).alias("occupied"))
    occupied = cells.filter("occupied").select("iu", "iv")
    known = grown(cells.select("iu", "iv"), fill)
    blocked = grown(occupied, clearance)
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    out = known.join(mark(occupied, "o"), ["iu", "iv"], "left").join(mark(blocked, "b"), ["iu", "iv"], "left")
    return out.select("iu", "iv", F.coalesce("o", F.lit(False)).alias("occupied"), F.col("b").isNull().alias("free"))


def grown(cells: DataFrame, radius: int) -> DataFrame:
    """Cells within a disk of radius cells of any."""
    disk = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius])
    return cells.select("iu", "iv", F.explode(disk).alias("d")).select((F.col("iu") + F.col("d.i")).alias("iu"), (F.col("iv") + F.col("d.j")).alias("iv")).distinct()


def cell_edges(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """(a, b): neighbouring cells by number, each pair once; a number is iu * 2**31 + iv."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    number = lambda u, v: u.cast("long") * F.lit(1 << 31) + v.cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    out = cells.select(number(F.col("iu"), F.col("iv")).alias("a"), F.explode(around).alias("d"), "iu", "iv")
    out = out.select("a", number(F.col("iu") + F.col("d.i"), F.col("iv") + F.col("d.j")).alias("b"))
    return out.join(cells.select(number(F.col("iu"), F.col("iv")).alias("b")), "b", "left_semi").select("a", "b")


def regions(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """iu, iv, region (the smallest cell number in it) and cells of each connected region."""
    own = cells.select("iu", "iv", (F.col("iu").cast("long") * F.lit(1 << 31) + F.col("iv").cast("long")).alias("node"))
    linked = connected_components(cell_edges(cells, diagonal))
    out = own.join(linked, "node", "left").select("iu", "iv", F.coalesce("root", "node").alias("region"))
    return out.join(out.groupBy("region").agg(F.count("*").alias("cells")), "region")


def voxel_clusters(grid: DataFrame, reach: int = 1) -> DataFrame:
    """key, cluster of each voxel: voxels within reach steps along every axis are linked."""
    def part(shift: int) -> Column:
        return F.shiftright("key", shift).bitwiseAND((1 << 21) - 1)

    own = grid.select("key", part(42).alias("i"), part(21).alias("j"), part(0).alias("k"))
    half = [(a, b, c) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) for c in range(-reach, reach + 1) if (a, b, c) > (0, 0, 0)]
    around = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "abc", strict=True)]) for o in half])).alias("o")
    near = own.select(F.col("key").alias("a"), "i", "j", "k", around)
    to = [F.col(c) + F.col(f"o.{o}") for c, o in zip("ijk", "abc", strict=True)]
    inside = [c.between(0, (1 << 21) - 1) for c in to]
    near = near.filter(inside[0] & inside[1] & inside[2]).select("a", F.shiftleft(to[0], 42).bitwiseOR(F.shiftleft(to[1], 21)).bitwiseOR(to[2]).alias("b"))
    edges = near.join(own.select(F.col("key").alias("b")), "b", "left_semi")
    linked = connected_components(edges)
    return grid.join(linked, grid.key == linked.node, "left").select(*grid.columns, F.coalesce("root", "key").alias("cluster"))


def plausible_clusters(clusters: DataFrame, points_median: float, diagonal: float, least_voxels: int = 24, most: int = 40) -> DataFrame:
    """Each cluster's figures with the first check that rejects it (null: none), and rank by voxels among those that pass."""
    f = clusters.groupBy("cluster").agg(F.count("*").alias("voxels"), F.avg("n").alias("density"), *[(F.max(c) - F.min(c)).alias(f"e{c}") for c in P], *[F.avg(c).alias(c) for c in P])
    edge = F.greatest("ex", "ey", "ez")
    reject = F.when(F.col("voxels") < least_voxels, "few_voxels").when(F.col("density") < 0.25 * points_median, "sparse").when(~edge.between(0.012 * diagonal, 0.35 * diagonal), "size")
    f = f.withColumn("reject", reject)
    rank = F.row_number().over(W.partitionBy(F.col("reject").isNull()).orderBy(F.desc("voxels"), "cluster"))
    return f.withColumn("rank", F.when(F.col("reject").isNull() & (rank <= most), rank))


def distances(cells: DataFrame, starts: DataFrame, tile: int = 64) -> DataFrame:
    """iu, iv, steps of every cell that can be reached over 8 neighbours, by breadth-first search in tiles.

    A task holds one tile of tile x tile cells and a rim of its neighbours' cells, and spreads all steps that it
    knows as far as the tile goes. Rounds follow until no cell changes: as many as a path crosses tiles, not as
    it has steps. Each round is written; the driver sees how many cells changed."""
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    first = starts.select("iu", "iv", F.lit(0).alias("steps")).distinct()
    state = kept(cells.select("iu", "iv").distinct().join(first, ["iu", "iv"], "left").select("iu", "iv", "steps", F.col("steps").isNotNull().alias("changed")), "steps")

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        own = dict.fromkeys(zip(pdf.iu[pdf.own].tolist(), pdf.iv[pdf.own].tolist(), strict=True))
        known = {(u, v): int(s) for u, v, s in zip(pdf.iu.tolist(), pdf.iv.tolist(), pdf.steps.tolist(), strict=True) if s == s and s is not None}
        before = dict(known)
        heap = [(s, u, v) for (u, v), s in known.items()]
        heapq.heapify(heap)
        while heap:
            s, u, v = heapq.heappop(heap)
            if s > known[u, v]:
                continue
            for i, j in around:
                at = (u + i, v + j)
                if at in own and s + 1 < known.get(at, s + 2):
                    known[at] = s + 1
                    heapq.heappush(heap, (s + 1, *at))
        rows = [(u, v, known.get((u, v)), known.get((u, v)) != before.get((u, v))) for u, v in own]
        return pd.DataFrame(rows, columns=["iu", "iv", "steps", "changed"]).astype({"steps": "Int32"})

    kinds = dict(state.dtypes)
    while True:
        near = [F.struct(F.floor((F.col("iu") + i) / tile).alias("tu"), F.floor((F.col("iv") + j) / tile).alias("tv")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        dealt = state.select("*", F.explode(F.array_distinct(F.array(*near))).alias("t"))
        dealt = dealt.select("iu", "iv", "steps", "changed", "t.tu", "t.tv", ((F.floor(F.col("iu") / tile) == F.col("t.tu")) & (F.floor(F.col("iv") / tile) == F.col("t.tv"))).alias("own"))
        new = kept(dealt.groupBy("tu", "tv").applyInPandas(spread, f"iu {kinds['iu']}, iv {kinds['iv']}, steps int, changed boolean"), "steps")
        if new.filter("changed").isEmpty():
            return new.filter("steps IS NOT NULL").select("iu", "iv", "steps")
        dropped(state)
        state = new


def goal_state(goals: DataFrame, cells: DataFrame, main_region: int) -> DataFrame:
    """goals with state: free_navigable (a free cell of the main region), free_pocket (of another) or obstructed."""
    return goals.join(cells.select("iu", "iv", "region"), ["iu", "iv"], "left").withColumn("state", F.when(F.col("region").isNull(), "obstructed").when(F.col("region") == main_region, "free_navigable").otherwise("free_pocket")).drop("region")


def fuse(detections: DataFrame, confidence: str = "confidence", order: str = "order", near: float = 0.6, spread: float = 1.5) -> DataFrame:
    """One row an object from detections (query, center array, extent array, confidence, order).

    In order of confidence a detection joins the first object of its folded label whose first member it is near
    (closer than near times the mean of both longest sides) or overlaps; else it begins one. A detection without a
    usable box stays by itself. Labels are apart, and space is cut into slabs along x as wide as any
    box can reach: a chain of slabs that hold boxes is one task's run, so a common label doesn't meet in one task."""
    ok = (F.size("center") == 3) & (F.size("extent") == 3) & F.forall("center", lambda x: G.finite(x)) & F.forall("extent", lambda x: G.finite(x))
    rows = detections.withColumns({"label": X.label_fold(F.col("query")), "__ok": F.coalesce(ok, F.lit(False)), "__e": F.transform("extent", F.abs)})
    good = rows.filter("__ok")
    reach = 2 * (good.agg(F.max(F.array_max("__e"))).first()[0] or 1.0)
    # two boxes that can meet lie in the same slab along x or in neighbouring ones; runs of neighbouring occupied slabs are independent
    slab = F.floor(F.col("center")[0] / reach).cast("long")
    slabs = good.withColumn("__slab", slab).select("label", "__slab").distinct()
    w = W.partitionBy("label").orderBy("__slab")
    slabs = slabs.withColumn("__run", F.sum(F.when(F.col("__slab") - F.lag("__slab").over(w) <= 1, 0).otherwise(1)).over(w))
    good = good.withColumn("__slab", slab).join(slabs, ["label", "__slab"])
    flat = good.select("label", F.col("__run").alias("run"), *[F.col("center")[i].cast("double").alias(f"c{i}") for i in range(3)], *[F.col("__e")[i].cast("double").alias(f"e{i}") for i in range(3)], F.col(confidence).cast("double").alias("conf"), F.col(order).cast("long").alias("ord"))

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, ids = None, np.empty((64, 6)), []  # held: the first members' boxes, as many as there are ids, and room
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if (r.label, r.run) != now:
                    now, ids = (r.label, r.run), []
                reps = held[: len(ids)]
                box = np.array([r.c0, r.c1, r.c2, r.e0, r.e1, r.e2])
                if len(reps):
                    off = np.abs(reps[:, :3] - box[:3])
                    close = np.sqrt((off**2).sum(axis=1)) < near * (reps[:, 3:].max(axis=1) + box[3:].max()) / 2
                    hit = np.flatnonzero(close | (off <= (reps[:, 3:] + box[3:]) / 2).all(axis=1))
                    if len(hit):
                        out.append(ids[hit[0]])
                        continue
                if len(ids) == len(held):
                    held = np.concatenate([held, np.empty_like(held)])
                held[len(ids)] = box
                ids.append(r.ord)
                out.append(r.ord)
            yield b.assign(rep=out)[["label", "ord", "conf", "c0", "c1", "c2", "e0", "e1", "e2", "rep"]]

    placed = flat.repartition("label", "run").sortWithinPartitions("label", "run", F.desc("conf"), "ord").mapInPandas(group, "label string, ord long, conf double, c0 double, c1 double, c2 double, e0 double, e1 double, e2 double, rep long")
    weight = F.when(F.col("conf") > 0, F.col("conf")).otherwise(1e-6)
    low, high = [F.min(F.col(f"c{i}") - F.col(f"e{i}") / 2) for i in range(3)], [F.max(F.col(f"c{i}") + F.col(f"e{i}") / 2) for i in range(3)]
    out = placed.groupBy("label", "rep").agg(
        F.array(*[F.sum(weight * F.col(f"c{i}")) / F.sum(weight) for i in range(3)]).alias("center"), F.array(*[h - l for h, l in zip(high, low, strict=True)]).alias("extent"),
        F.max("conf").alias("confidence"), F.count("*").alias("n_members"), F.array_sort(F.collect_list("ord")).alias("members"), F.sqrt(sum(F.pow(F.max(f"c{i}") - F.min(f"c{i}"), F.lit(2)) for i in range(3))).alias("spread"),
        F.max(F.when(F.col("ord") == F.col("rep"), F.greatest("e0", "e1", "e2"))).alias("side"),
    )
    out = out.withColumn("review", (F.col("side") > 0) & (F.col("spread") > spread * F.col("side"))).drop("side")
    lone = rows.filter("NOT __ok").select("label", F.col(order).cast("long").alias("rep"), F.lit(None).cast("array<double>").alias("center"), F.lit(None).cast("array<double>").alias("extent"), F.col(confidence).cast("double").alias("confidence"), F.lit(1).cast("long").alias("n_members"), F.array(F.col(order).cast("long")).alias("members"), F.lit(0.0).alias("spread"), F.lit(False).alias("review"))
    return out.unionByName(lone)
