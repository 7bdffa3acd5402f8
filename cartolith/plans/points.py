"""Queries over points: bounds, voxels, boxes, z-buffers, ratios, histograms, grids, regions, planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.operators import aggregates as A
from cartolith.operators import joins as J
from cartolith.operators import spatial as S
from cartolith.operators import tables as T
from cartolith.plans.tables import POINTS_SQL, points, table

XYZ = ("x", "y", "z")
SIDE = 5.0


def robust_bounds(spark, d):
    out = A.robust_bounds(points(spark, d), XYZ)
    return out.select(*[F.round(f"{c}_{s}", 6).alias(f"{c}_{s}") for c in XYZ for s in ("low", "high")], F.round(F.col("dimensions")[0], 6).alias("longest"), "points")


BOUNDS = f"""
WITH {POINTS_SQL}, q AS (SELECT {", ".join(f"quantile_cont({c}, {p}) AS {c}_{s}" for c in XYZ for s, p in (("low", 0.02), ("high", 0.98)))}, count(*) AS points FROM points)
SELECT {", ".join(f"round({c}_{s}, 6) AS {c}_{s}" for c in XYZ for s in ("low", "high"))}, round(greatest({", ".join(f"{c}_high - {c}_low" for c in XYZ)}), 6) AS longest, points FROM q
"""

_KEY = "((least(greatest(floor(x / 5), 0), 2097151)::BIGINT << 42) | (least(greatest(floor(y / 5), 0), 2097151)::BIGINT << 21) | least(greatest(floor(z / 5), 0), 2097151)::BIGINT)"


def voxel_counts(spark, d):
    return S.voxels(points(spark, d), SIDE).select("key", "n", *[F.round(c, 9).alias(c) for c in XYZ])


VOXELS = f"WITH {POINTS_SQL} SELECT {_KEY} AS key, count(*) AS n, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM points GROUP BY 1"


def voxel_noise(spark, d):
    return S.noise_threshold(S.voxels(points(spark, d), SIDE)).select(F.col("threshold").cast("long").alias("threshold"))


NOISE = f"""
WITH {POINTS_SQL}, v AS (SELECT {_KEY} AS key, count(*) AS n FROM points GROUP BY 1), c AS (SELECT n, count(*) AS k FROM v GROUP BY 1),
r AS (SELECT n, sum(n * k) OVER (ORDER BY n) AS below, sum(n * k) OVER () AS whole FROM c)
SELECT least(coalesce(max(n) FILTER (below <= 0.15 * whole), 0) + 1, 32)::BIGINT AS threshold FROM r
"""


def first_in_voxel(spark, d):
    return S.first_of_voxel(points(spark, d).withColumn("o", F.struct("id", "frame", "x", "y")), SIDE, "o").groupBy("id").agg(F.count("*").alias("n"))


FIRST = f"""
WITH {POINTS_SQL}, f AS (SELECT id FROM points QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY id, frame, x, y) = 1) SELECT id, count(*) AS n FROM f GROUP BY 1
"""


def lod_choice(spark, d):
    """Laws rather than rows are checked: how many points stay and that each is of its own voxel."""
    p = points(spark, d).withColumn("id", F.xxhash64("id", "frame", "x", "y", "z"))
    return S.lod(p, 500, "id", SIDE, importance=F.col("y")).select("id", "x", "y", "z")


def inside_box(spark, d):
    c, s = 0.8, 0.6
    box = G.in_box((F.col("x"), F.col("y"), F.col("z")), [25.0, 40.0, 5.0], [30.0, 20.0, 8.0], [c, -s, 0, s, c, 0, 0, 0, 1], 0.1)
    return points(spark, d).filter(box).groupBy("frame").agg(F.count("*").alias("n"))


BOX = f"""
WITH {POINTS_SQL} SELECT frame, count(*) AS n FROM points
WHERE abs((x - 25) * 0.8 + (y - 40) * 0.6) <= 16.5 AND abs(-(x - 25) * 0.6 + (y - 40) * 0.8) <= 11.0 AND abs(z - 5) <= 4.4 GROUP BY 1
"""


def confident_points(spark, d):
    return T.above_percentile(points(spark, d), "frame", "y", 0.9).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("y"), 5).alias("total"))


CONFIDENT = f"""
WITH {POINTS_SQL}, t AS (SELECT frame, quantile_cont(y, 0.9) + 1e-6 AS t FROM points GROUP BY 1)
SELECT p.frame, count(*) AS n, round(sum(y), 5) AS total FROM points p JOIN t ON p.frame = t.frame WHERE y > t GROUP BY 1
"""


def visible(spark, d):
    p = points(spark, d)
    out = J.visible_points(p, (F.floor(F.col("x") / 4), F.floor(F.col("z") / 2)), F.col("y"))
    return out.groupBy(F.floor(F.col("x") / 4).alias("u"), F.floor(F.col("z") / 2).alias("v")).agg(F.count("*").alias("n"), F.round(F.min("y"), 6).alias("front"))


VISIBLE = f"""
WITH {POINTS_SQL}, p AS (SELECT *, floor(x / 4)::BIGINT AS u, floor(z / 2)::BIGINT AS v FROM points), f AS (SELECT u, v, min(y) AS front FROM p GROUP BY 1, 2)
SELECT u, v, count(*) AS n, round(any_value(front), 6) AS front FROM p JOIN f USING (u, v) WHERE y <= front * 1.08 GROUP BY 1, 2
"""


def block_medians(spark, d):
    p = points(spark, d).select(F.col("x").cast("long").alias("r"), F.col("frame").alias("c"), F.when(F.col("z") > 2, F.col("y")).otherwise(0.0).alias("v"))
    return A.block_median(p, [], "r", "c", "v", 8).select("block_row", "block_col", F.round("median", 6).alias("median"))


BLOCKS = f"""
WITH {POINTS_SQL} SELECT floor(x::BIGINT / 8)::BIGINT AS block_row, floor(frame / 8)::BIGINT AS block_col, round(median(CASE WHEN z > 2 THEN nullif(y, 0) END), 6) AS median FROM points GROUP BY 1, 2
HAVING median(CASE WHEN z > 2 THEN nullif(y, 0) END) IS NOT NULL
"""


def frame_ratios(spark, d):
    out = A.ratio_summary(points(spark, d), ["frame"], F.try_divide(F.col("y"), F.col("x")), 3)
    return out.select("frame", F.round("ratio", 10).alias("ratio"), F.round("rel_iqr", 6).alias("rel_iqr"), "n")


_RATIO = "r AS (SELECT frame, y / x AS ratio FROM points WHERE x > 0 AND y > 0), s AS (SELECT frame, median(ratio) AS ratio, (quantile_cont(ratio, 0.75) - quantile_cont(ratio, 0.25)) / abs(median(ratio)) AS rel_iqr, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 3)"
RATIOS = f"WITH {POINTS_SQL}, {_RATIO} SELECT frame, round(ratio, 10) AS ratio, round(rel_iqr, 6) AS rel_iqr, n FROM s"


def group_ratios(spark, d):
    f = A.ratio_summary(points(spark, d), ["frame"], F.try_divide(F.col("y"), F.col("x")), 3).withColumn("part", F.col("frame") % 7)
    out = A.ratio_of_groups(f, ["part"])
    return out.select("part", *[F.round(c, 10).alias(c) for c in ("ratio", "variation", "rel_iqr")], "frames")


GROUPS = f"""
WITH {POINTS_SQL}, {_RATIO} SELECT frame % 7 AS part, round(median(ratio), 10) AS ratio, round(CASE WHEN count(*) >= 2 THEN stddev_pop(ratio) / avg(ratio) ELSE 'infinity'::DOUBLE END, 10) AS variation,
  round(median(rel_iqr), 10) AS rel_iqr, count(*) AS frames FROM s GROUP BY 1
"""


def gated_ratios(spark, d):
    out = A.ratio_gate(points(spark, d), ["frame"], F.try_divide(F.col("y"), F.col("x")), 3, 0.25)
    return out.select("frame", "n", F.round("variation", 6).alias("variation"), "reason", "ok")


GATED = f"""
WITH {POINTS_SQL}, g AS (SELECT frame, count(*) AS n, stddev_pop(y / x) / avg(y / x) AS v FROM points WHERE x > 0 AND y > 0 GROUP BY 1)
SELECT frame, n, round(v, 6) AS variation, CASE WHEN n < 3 THEN 'too few ratios' WHEN v > 0.25 THEN 'ratios vary too much' END AS reason, NOT (n < 3 OR v > 0.25) AS ok FROM g
"""


def price_histogram(spark, d):
    return A.histogram(points(spark, d), "y", 60).select("bin", "n")


HIST = f"""
WITH {POINTS_SQL}, e AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM points)
SELECT least(floor((y - lo) / ((hi - lo) / 60)), 59)::BIGINT AS bin, count(*) AS n FROM points, e WHERE y BETWEEN lo AND hi GROUP BY 1
"""


def shelf(spark, d):
    p = points(spark, d).withColumn("y", F.when(F.col("y") > 60, 60.0 + F.col("y") % 1).otherwise(F.col("y")))  # what is over 60 stands in one layer
    return A.top_shelf(A.histogram(p, "y", 60), 60).select(F.round("height", 4).alias("height"), "n")


SHELF = f"""
WITH {POINTS_SQL}, p AS (SELECT CASE WHEN y > 60 THEN 60.0 + y % 1 ELSE y END AS y FROM points), e AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM p),
b AS (SELECT least(floor((y - lo) / ((hi - lo) / 60)), 59)::BIGINT AS bin, count(*) AS n FROM p, e WHERE y BETWEEN lo AND hi GROUP BY 1),
c AS (SELECT i AS bin, coalesce(n, 0) AS n FROM range(60) r(i) LEFT JOIN b ON b.bin = i), s AS (SELECT greatest(4 * median(n), 0.01 * sum(n)) AS bar FROM c),
t AS (SELECT max(bin) AS top FROM c, s WHERE n >= bar), f AS (SELECT coalesce(max(bin) + 1, 0) AS low FROM c, s, t WHERE bin < top AND n < bar / 2)
SELECT round(any_value(lo + (hi - lo) / 60 * m), 4) AS height, any_value(n)::BIGINT AS n FROM e, (SELECT sum(n * (bin + 0.5)) / sum(n) AS m, sum(n) AS n FROM c, t, f WHERE bin BETWEEN low AND top) HAVING any_value(n) IS NOT NULL
"""


def footprint(spark, d):
    out = A.footprint(points(spark, d), "x", "y")
    return out.select(*[F.round(c, 5).alias(c) for c in ("extent_u", "extent_v", "area")], "cells")


FOOTPRINT = f"""
WITH {POINTS_SQL}, e AS (SELECT quantile_cont(x, 0.01) AS u0, quantile_cont(x, 0.99) AS u1, quantile_cont(y, 0.01) AS v0, quantile_cont(y, 0.99) AS v1 FROM points),
c AS (SELECT u0, u1, v0, v1, count(DISTINCT (least(floor((x - u0) * 48 / (u1 - u0)), 47), least(floor((y - v0) * 48 / (v1 - v0)), 47))) AS cells FROM points, e WHERE x BETWEEN u0 AND u1 AND y BETWEEN v0 AND v1 GROUP BY ALL)
SELECT round(u1 - u0, 5) AS extent_u, round(v1 - v0, 5) AS extent_v, round(cells / 2304 * (u1 - u0) * (v1 - v0), 5) AS area, cells FROM c
"""


def moments_by_frame(spark, d):
    out = A.moments(points(spark, d), XYZ, ("y", "z", "x"), ["frame"])
    return out.select("frame", "n", *[F.round(c, 4).alias(c) for c in ("mean_a0", "mean_b2", "cov_01", "cov_12", "variance")])


MOMENTS = f"""
WITH {POINTS_SQL} SELECT frame, count(*) AS n, round(avg(x), 4) AS mean_a0, round(avg(x), 4) AS mean_b2, round(covar_pop(y, y), 4) AS cov_01, round(covar_pop(z, z), 4) AS cov_12,
  round(var_pop(x) + var_pop(y) + var_pop(z), 4) AS variance FROM points GROUP BY 1
"""


def _grid(spark, d):
    """All line items on the floor of quantity and price; those whose price in cents is a multiple of 1009 stand up as obstacles."""
    p = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.when(F.round(F.col("l_extendedprice") * 100).cast("long") % 1009 == 0, 1.0).otherwise(0.0).alias("z"))
    return S.occupancy(p, F.col("x"), F.col("y"), F.col("z"), 2.0, fill=1, clearance=1)


def occupancy(spark, d):
    return _grid(spark, d)


_DISK = "(VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) k(i, j)"
_CELLS = "c AS (SELECT floor(l_quantity / 2)::BIGINT AS iu, floor(l_extendedprice / 1000 / 2)::BIGINT AS iv, bool_or(round(l_extendedprice * 100)::BIGINT % 1009 = 0) AS o FROM lineitem GROUP BY 1, 2)"
OCCUPANCY = f"""
WITH {_CELLS},
n AS (SELECT DISTINCT iu + i AS iu, iv + j AS iv FROM c, {_DISK}), b AS (SELECT DISTINCT iu + i AS iu, iv + j AS iv FROM c, {_DISK} WHERE o)
SELECT n.iu, n.iv, coalesce(c.o, false) AS occupied, b.iu IS NULL AS free FROM n LEFT JOIN c USING (iu, iv) LEFT JOIN b USING (iu, iv)
"""


def free_regions(spark, d):
    return S.regions(_grid(spark, d).filter("free").select("iu", "iv"))


REGIONS = f"""
WITH RECURSIVE {_CELLS},
n AS (SELECT DISTINCT iu + i AS iu, iv + j AS iv FROM c, {_DISK}), b AS (SELECT DISTINCT iu + i AS iu, iv + j AS iv FROM c, {_DISK} WHERE o),
f AS (SELECT iu, iv, iu * 2147483648 + iv AS id FROM n ANTI JOIN b USING (iu, iv)),
e AS (SELECT a.id AS a, z.id AS b FROM f a JOIN f z ON abs(a.iu - z.iu) <= 1 AND abs(a.iv - z.iv) <= 1),
w(id, root) AS (SELECT id, id FROM f UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id WHERE w.root < e.b),
r AS (SELECT id, min(root) AS region FROM w GROUP BY 1)
SELECT iu, iv, region, count(*) OVER (PARTITION BY region) AS cells FROM f JOIN r USING (id)
"""


def reach_steps(spark, d):
    free = _grid(spark, d).filter("free")
    return S.distances(free, free.orderBy("iu", "iv").limit(1))


REACH = f"""
WITH RECURSIVE {_CELLS},
n AS (SELECT DISTINCT iu + i AS iu, iv + j AS iv FROM c, {_DISK}), b AS (SELECT DISTINCT iu + i AS iu, iv + j AS iv FROM c, {_DISK} WHERE o),
f AS (SELECT iu, iv FROM n ANTI JOIN b USING (iu, iv)),
s AS (SELECT iu, iv FROM f ORDER BY iu, iv LIMIT 1),
w(iu, iv, steps) AS (SELECT iu, iv, 0 FROM s UNION SELECT f.iu, f.iv, w.steps + 1 FROM w JOIN (SELECT * FROM f, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE i <> 0 OR j <> 0) f ON f.iu + f.i = w.iu AND f.iv + f.j = w.iv WHERE w.steps < 120)
SELECT iu, iv, min(steps)::INT AS steps FROM w GROUP BY 1, 2
"""


def clusters(spark, d):
    grid = S.voxels(points(spark, d), SIDE)
    return S.voxel_clusters(grid).groupBy("cluster").agg(F.count("*").alias("voxels"), F.sum("n").alias("points"))


def main_plane(spark, d):
    p = points(spark, d).withColumn("id", F.xxhash64("id", "frame", "x", "y", "z"))
    found = S.planes(p.withColumn("z", F.col("z") / 10), "id", 0.05, most=2)
    return spark.createDataFrame([(i, *[round(x, 3) for x in q["normal"]], int(q["inliers"])) for i, q in enumerate(found)], "plane int, nx double, ny double, nz double, inliers long")


def boxes_by_frame(spark, d):
    out = A.principal_box(points(spark, d), XYZ, ["frame"])
    return out.select("frame", *[F.round(F.col("extent")[i], 4).alias(f"e{i}") for i in range(3)], *[F.round(F.col("center")[i], 4).alias(f"c{i}") for i in range(3)])


def neighbours(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return J.nearest_neighbours(p, "id", XYZ, 3, 8.0).select("id", F.col("rank").cast("long").alias("rank"), "neighbour", F.round("distance", 6).alias("distance"))


NEIGHBOURS = """
WITH p AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, s_nationkey::DOUBLE AS y FROM supplier),
r AS (SELECT a.id, b.id AS neighbour, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM p a JOIN p b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM r)
SELECT id, rank, neighbour, round(distance, 6) AS distance FROM k WHERE rank <= 3
"""


def part_neighbours(spark, d):
    """Of all parts, by size and price, some far from all others."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.pow(F.col("p_retailprice") / 400, F.lit(4)).alias("y"), F.lit(0.0).alias("z"))
    return J.nearest_neighbours(p, "id", XYZ, 2, 0.5, crowd=16).select("id", F.col("rank").cast("long").alias("rank"), "neighbour", F.round("distance", 6).alias("distance"))


PART_NEIGHBOURS = """
WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, pow(p_retailprice / 400, 4) AS y FROM part),
r AS (SELECT a.id, b.id AS neighbour, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM p a JOIN p b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM r)
SELECT id, rank, neighbour, round(distance, 6) AS distance FROM k WHERE rank <= 2
"""


def lod_uniform(spark, d):
    return S.lod(points(spark, d), 5000, "id", SIDE, mode="uniform").select("id", "frame")


_EVEN = "('0x' || substr(md5(id::VARCHAR), 1, 13))::BIGINT"
LOD_UNIFORM = f"WITH {POINTS_SQL} SELECT id, frame FROM points ORDER BY {_EVEN}, id LIMIT 5000"


def lod_importance(spark, d):
    """The dearest line items per unit of tax: many share a tax rate."""
    return S.lod(points(spark, d), 3000, "id", SIDE, importance=F.floor("y") * F.col("conf"), mode="importance").select("id", "frame")


LOD_IMPORTANCE = f"WITH {POINTS_SQL} SELECT id, frame FROM points ORDER BY -(floor(y) * conf), {_EVEN}, id LIMIT 3000"


def scale_decisions(spark, d):
    f = A.ratio_summary(points(spark, d), ["frame"], F.try_divide(F.col("y"), F.col("x")), 3).withColumn("part", F.col("frame") % 20)
    g = A.ratio_of_groups(f, ["part"])
    prev = g.select((F.col("part") + 1).alias("part"), F.struct("ratio", "variation").alias("previous"))
    both = g.select("part", F.struct("ratio", "variation").alias("current"), "frames").join(prev, "part", "left")
    decided = A.scale_decision((F.col("part") / 10).cast("double"), F.col("current"), F.coalesce("previous", F.struct(F.lit(None).cast("double").alias("ratio"), F.lit(None).cast("double").alias("variation"))), F.col("frames") * 100)
    return both.withColumn("s", decided).select("part", F.round("s.scale", 5).alias("scale"), "s.applied", "s.reason")


DECISIONS = f"""
WITH {POINTS_SQL}, {_RATIO},
g AS (SELECT frame % 20 AS part, median(ratio) AS ratio, CASE WHEN count(*) >= 2 THEN stddev_pop(ratio) / avg(ratio) ELSE 'infinity'::DOUBLE END AS variation, count(*) AS frames FROM s GROUP BY 1),
b AS (SELECT g.part, g.part / 10 AS geometric, g.frames * 100 AS support, CASE WHEN g.ratio > 0 AND p.ratio > 0 THEN g.ratio / p.ratio END AS metric,
      g.variation < 0.15 AND coalesce(p.variation, 'infinity'::DOUBLE) < 0.15 AS steady FROM g LEFT JOIN g p ON p.part + 1 = g.part),
z AS (SELECT *, CASE WHEN metric IS NULL THEN 'anchor_unavailable' WHEN NOT steady THEN 'within_submap_cov_high' WHEN geometric <= 0 THEN 'geom_degenerate'
      WHEN abs(ln(metric / geometric)) < 0.5 THEN 'agree' WHEN support < 400 THEN 'disagree_thin_overlap' ELSE 'disagree_rich_overlap' END AS reason FROM b)
SELECT part, round(CASE WHEN applied THEN metric ELSE geometric END, 5) AS scale, applied, reason FROM (SELECT *, reason IN ('geom_degenerate', 'agree', 'disagree_thin_overlap') AS applied FROM z)
"""


QUERIES = {f.__name__: f for f in (robust_bounds, voxel_counts, voxel_noise, first_in_voxel, lod_choice, lod_uniform, lod_importance, inside_box, confident_points, visible, block_medians, frame_ratios, group_ratios, gated_ratios, price_histogram, shelf, footprint, moments_by_frame, occupancy, free_regions, reach_steps, clusters, main_plane, boxes_by_frame, neighbours, part_neighbours, scale_decisions)}

ORACLES = {
    "robust_bounds": BOUNDS, "voxel_counts": VOXELS, "voxel_noise": NOISE, "first_in_voxel": FIRST, "inside_box": BOX, "confident_points": CONFIDENT, "visible": VISIBLE,
    "block_medians": BLOCKS, "frame_ratios": RATIOS, "group_ratios": GROUPS, "gated_ratios": GATED, "price_histogram": HIST, "footprint": FOOTPRINT, "shelf": SHELF, "scale_decisions": DECISIONS, "moments_by_frame": MOMENTS,
    "occupancy": OCCUPANCY, "free_regions": REGIONS, "reach_steps": REACH, "neighbours": NEIGHBOURS, "part_neighbours": PART_NEIGHBOURS, "lod_uniform": LOD_UNIFORM, "lod_importance": LOD_IMPORTANCE,
}
