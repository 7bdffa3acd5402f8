"""Queries over routes, footprints, cameras and stitched clouds: costs, paths and way-points on the line items' floor, upright boxes of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import cameras
from cartolith.operators import hulls as H
from cartolith.operators import routes as R
from cartolith.operators import tables as T
from cartolith.plans.points import _CELLS, _DISK, _grid
from cartolith.plans.tables import POINTS_SQL, points, rounded, table


def _floor(spark, d):
    """Free cells; the start, the first of them; and the goals: the far end of each column."""
    free = _grid(spark, d).filter("free").select("iu", "iv")
    return free, free.orderBy("iu", "iv").limit(1), free.groupBy("iu").agg(F.max("iv").alias("iv"))


def route_costs(spark, d):
    free, start, _ = _floor(spark, d)
    return R.costs(free, start).withColumn("cost", F.round(R.cost(), 6))


_FREE = f"""{_CELLS},
n AS (SELECT DISTINCT iu + i AS iu, iv + j AS iv FROM c, {_DISK}), b AS (SELECT DISTINCT iu + i AS iu, iv + j AS iv FROM c, {_DISK} WHERE o),
f AS MATERIALIZED (SELECT iu, iv FROM n ANTI JOIN b USING (iu, iv)), s AS (SELECT iu, iv FROM f ORDER BY iu, iv LIMIT 1),
k(i, j) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)),
m AS MATERIALIZED (SELECT f.iu, f.iv, f.iu - i AS ju, f.iv - j AS jv, (i = 0 OR j = 0)::BIGINT AS straight, (i <> 0 AND j <> 0)::BIGINT AS diagonal FROM f, k),
w(iu, iv, straight, diagonal) USING KEY (iu, iv) AS (SELECT iu, iv, 0::BIGINT, 0::BIGINT FROM s UNION
  SELECT iu, iv, (best).s, (best).d FROM (SELECT m.iu, m.iv, arg_min({{'s': w.straight + m.straight, 'd': w.diagonal + m.diagonal}}, w.straight + m.straight + (w.diagonal + m.diagonal) * sqrt(2.0)) AS best
    FROM w JOIN m ON w.iu = m.ju AND w.iv = m.jv GROUP BY m.iu, m.iv) x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.iu = x.iu AND r.iv = x.iv AND r.straight + r.diagonal * sqrt(2.0) <= (best).s + (best).d * sqrt(2.0))),
p AS MATERIALIZED (SELECT w.iu, w.iv, w.straight, w.diagonal, (min([x.iu, x.iv]))[1] AS from_u, (min([x.iu, x.iv]))[2] AS from_v
  FROM w LEFT JOIN m ON w.iu = m.iu AND w.iv = m.iv LEFT JOIN w x ON x.iu = m.ju AND x.iv = m.jv AND x.straight = w.straight - m.straight AND x.diagonal = w.diagonal - m.diagonal GROUP BY ALL)"""

COSTS = f"WITH RECURSIVE {_FREE} SELECT *, round(straight + diagonal * sqrt(2.0), 6) AS cost FROM p"


def route_paths(spark, d):
    free, start, goals = _floor(spark, d)
    return R.paths(R.costs(free, start), goals)


PATHS = f"""
WITH RECURSIVE {_FREE},
g AS (SELECT iu, max(iv) AS iv FROM f GROUP BY iu),
t(goal_u, goal_v, back, iu, iv) AS (SELECT g.iu, g.iv, 0::BIGINT, g.iu, g.iv FROM g JOIN p USING (iu, iv) UNION ALL
  SELECT goal_u, goal_v, back + 1, from_u, from_v FROM t JOIN p USING (iu, iv) WHERE from_u IS NOT NULL)
SELECT * FROM t
"""


def route_way_points(spark, d):
    """One row a goal: whether it can be reached, the cost, the path's cells and the way-points as text."""
    out = R.routes(*_floor(spark, d))
    text = F.array_join(F.transform("way_points", lambda x: F.concat_ws(":", x["iu"], x["iv"])), " ")
    return out.select("goal_u", "goal_v", "reached", F.round("cost", 6).alias("cost"), "cells", text.alias("way_points"))


def yaw_boxes(spark, d):
    out = H.yaw_boxes(points(spark, d), ["frame"], ("x", "y", "z"))
    sides = [rounded(f(F.col("extents")[0], F.col("extents")[1]), 4) for f in (F.greatest, F.least)]
    return out.select("frame", "points", sides[0].alias("long"), sides[1].alias("short"), rounded(F.col("extents")[2], 4).alias("height"), rounded(F.col("extents")[0] * F.col("extents")[1], 3).alias("area"))


# quantities are whole numbers: a hull's corners are the lowest and the highest points of them
BOXES = f"""
WITH {POINTS_SQL}, t AS MATERIALIZED (SELECT frame, x, max(y) AS hi, min(y) AS lo FROM points GROUP BY ALL),
e AS (SELECT a.frame, b.x - a.x AS dx, b.hi - a.hi AS dy FROM t a JOIN t b ON a.frame = b.frame AND a.x < b.x
      WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.frame = a.frame AND (b.x - a.x) * (c.hi - a.hi) - (b.hi - a.hi) * (c.x - a.x) > 1e-9)
  UNION ALL SELECT a.frame, b.x - a.x, b.lo - a.lo FROM t a JOIN t b ON a.frame = b.frame AND a.x < b.x
      WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.frame = a.frame AND (b.x - a.x) * (c.lo - a.lo) - (b.lo - a.lo) * (c.x - a.x) < -1e-9)
  UNION ALL SELECT frame, 0, 1 FROM (SELECT frame, x, hi, lo, min(x) OVER f AS x0, max(x) OVER f AS x1 FROM t WINDOW f AS (PARTITION BY frame)) WHERE x IN (x0, x1) AND hi > lo),
u AS (SELECT row_number() OVER () AS i, frame, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM e),
r AS (SELECT i, u.frame, max(x * ux + y * uy) - min(x * ux + y * uy) AS a, max(y * ux - x * uy) - min(y * ux - x * uy) AS b
      FROM u JOIN (SELECT frame, x, hi AS y FROM t UNION ALL SELECT frame, x, lo FROM t) q ON u.frame = q.frame GROUP BY ALL),
o AS (SELECT frame, arg_min([a, b], a * b) AS s FROM r GROUP BY frame),
h AS (SELECT frame, count(*) AS points, max(z) - min(z) AS height FROM points GROUP BY frame)
SELECT frame, points, round(greatest(s[1], s[2]), 4) AS long, round(least(s[1], s[2]), 4) AS short, round(height, 4) AS height, round(s[1] * s[2], 3) AS area FROM o JOIN h USING (frame)
"""

def camera_parts(spark, d):
    """Customers as projection matrices, taken apart: intrinsics, the camera's first axis and its place."""
    c = table(spark, d, "customer")
    a, n, k = F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double"), F.col("c_custkey").cast("double")
    matrix = F.array(n + 1, F.lit(0.3), a, k, (n - 12) / 10, F.lit(2.0), F.lit(0.7), -k, F.lit(0.2), a / 5, F.lit(1.5), n)
    parts = cameras.camera_parts(matrix)
    out = c.select("c_custkey", parts.alias("p")).filter("p.status IS NULL")
    return out.select("c_custkey", *[F.round(F.col("p.k")[i], 6).alias(f"k{i}") for i in (0, 1, 2, 4, 5)], F.round("p.scale", 6).alias("scale"), *[(F.round(F.col("p.r")[3 * i], 6) + 0.0).alias(f"r{i}") for i in range(3)], *[(F.round(F.col("p.t")[i], 4) + 0.0).alias(f"t{i}") for i in range(3)])


CAMERAS = """
WITH c AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS n, c_custkey::DOUBLE AS k FROM customer),
d AS (SELECT *, (n + 1) * (2 * 1.5 - 0.7 * a / 5) - 0.3 * ((n - 12) / 10 * 1.5 - 0.7 * 0.2) + a * ((n - 12) / 10 * a / 5 - 2 * 0.2) AS det FROM c),
s AS (SELECT *, CASE WHEN det < 0 THEN -1.0 ELSE 1.0 END AS s FROM d),
m AS (SELECT c_custkey, [s * (n + 1), s * 0.3, s * a] AS m1, [s * (n - 12) / 10, s * 2, s * 0.7] AS m2, [s * 0.2, s * a / 5, s * 1.5] AS m3, [s * k, -s * k, s * n] AS p FROM s),
x AS (SELECT *, sqrt(list_dot_product(m3, m3)) AS k33, list_transform(m3, lambda v: v / sqrt(list_dot_product(m3, m3))) AS r3 FROM m),
y AS (SELECT *, list_dot_product(m2, r3) AS k23, list_dot_product(m1, r3) AS k13, list_transform([1, 2, 3], lambda i: m2[i] - list_dot_product(m2, r3) * r3[i]) AS l2 FROM x),
z AS (SELECT *, sqrt(list_dot_product(l2, l2)) AS k22, list_transform(l2, lambda v: v / sqrt(list_dot_product(l2, l2))) AS r2 FROM y),
w AS (SELECT *, list_dot_product(m1, r2) AS k12, list_transform([1, 2, 3], lambda i: m1[i] - list_dot_product(m1, r2) * r2[i] - k13 * r3[i]) AS l1 FROM z),
v AS (SELECT *, sqrt(list_dot_product(l1, l1)) AS k11, list_transform(l1, lambda v: v / sqrt(list_dot_product(l1, l1))) AS r1, p[3] / k33 AS tz FROM w),
u AS (SELECT *, (p[2] - k23 * tz) / k22 AS ty FROM v), t AS (SELECT *, (p[1] - k12 * ty - k13 * tz) / k11 AS tx FROM u)
SELECT c_custkey, round(k11 / k33, 6) AS k0, round(k12 / k33, 6) AS k1, round(k13 / k33, 6) AS k2, round(k22 / k33, 6) AS k4, round(k23 / k33, 6) AS k5, round(k33, 6) AS scale,
  round(r1[1], 6) + 0.0 AS r0, round(r1[2], 6) + 0.0 AS r1, round(r1[3], 6) + 0.0 AS r2, round(-(r1[1] * tx + r2[1] * ty + r3[1] * tz), 4) + 0.0 AS t0, round(-(r1[2] * tx + r2[2] * ty + r3[2] * tz), 4) + 0.0 AS t1, round(-(r1[3] * tx + r2[3] * ty + r3[3] * tz), 4) + 0.0 AS t2
FROM t
"""


def stitched_points(spark, d):
    """Line items as points of suppliers' scans: an order is a submap, a line a frame; fulfilled returns only close loops."""
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("scan"), F.col("l_orderkey").alias("submap"), F.col("l_linenumber").alias("frame"), (F.col("l_returnflag") == "R").alias("loop"), "l_quantity")
    return T.stitched(p, "scan", "submap", "frame", "loop").groupBy("scan").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"))


STITCHED = """
WITH r AS (SELECT l_suppkey AS scan, l_orderkey AS submap, l_linenumber AS frame, l_quantity FROM lineitem WHERE l_returnflag <> 'R'),
p AS (SELECT *, dense_rank() OVER (PARTITION BY scan, submap ORDER BY frame) AS place, min(submap) OVER (PARTITION BY scan) AS first FROM r)
SELECT scan, count(*) AS n, sum(l_quantity)::BIGINT AS total FROM p WHERE submap = first OR place > 1 GROUP BY 1
"""

QUERIES = {f.__name__: f for f in (route_costs, route_paths, route_way_points, yaw_boxes, camera_parts, stitched_points)}
ORACLES = {"route_costs": COSTS, "route_paths": PATHS, "yaw_boxes": BOXES, "camera_parts": CAMERAS, "stitched_points": STITCHED}
