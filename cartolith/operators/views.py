"""Views of a scene: what cameras see of clusters, which camera basis fits, depth pictures, walls and cells nearby; gravity, up axes, ground frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.operators import aggregates as A
from cartolith.operators import spatial
from cartolith.operators.folds import folded
from cartolith.operators.shared import exact_percentiles, with_each

VIEW = ["view", "c2w", "fx", "fy", "cx", "cy", "width", "height"]


def seen(points: DataFrame, views: DataFrame) -> DataFrame:
    """points (x, y, z and others) times views (VIEW; c2w is a row-major 4x4 in OpenCV's basis) with u, v, depth; null unless in front of the camera."""
    both = with_each(points, views.select(*VIEW))
    d = [F.col(c) - F.col("c2w")[4 * i + 3] for i, c in enumerate("xyz")]
    cam = [d[0] * F.col("c2w")[k] + d[1] * F.col("c2w")[4 + k] + d[2] * F.col("c2w")[8 + k] for k in range(3)]
    both = both.withColumns({"cam_x": cam[0], "cam_y": cam[1], "depth": F.when(cam[2] > 1e-6, cam[2])})
    return both.withColumns({"u": F.col("fx") * F.col("cam_x") / F.col("depth") + F.col("cx"), "v": F.col("fy") * F.col("cam_y") / F.col("depth") + F.col("cy")}).drop("cam_x", "cam_y")


def _inside() -> Column:
    return F.coalesce((F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height")), F.lit(False))


def poses(views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Views of which no two see the same, each the earliest of those that do, and (view, member): the views that each stands for."""
    alike = views.groupBy(*VIEW[1:]).agg(F.min("view").alias("view"), F.collect_list("view").alias("members"))
    return alike.select(*VIEW), alike.select("view", F.explode("members").alias("member"))


def places(points: DataFrame, *keys: str) -> DataFrame:
    """keys, x, y, z, n: the distinct points and how many there are of each."""
    return points.groupBy(*keys, "x", "y", "z").agg(F.count("*").alias("n"))


def _share() -> Column:
    """The share of points that are inside."""
    return F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).cast("double") / F.sum("n")


def cluster_views(points: DataFrame, views: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, view, box (x0, y0, x1, y1), inside_frac (of the points in front), area and median depth, where a view sees any of a cluster."""
    few, members = poses(views)
    rows = seen(places(points, cluster), few).filter("depth IS NOT NULL").withColumn("inside", _inside())
    within = lambda f, c: f(F.when(F.col("inside"), F.col(c)))
    out = rows.groupBy(cluster, "view").agg(_share().alias("inside_frac"), F.percentile("depth", F.lit(0.5), F.col("n")).alias("depth"), *[within(f, c).alias(n) for n, f, c in (("x0", F.min, "u"), ("y0", F.min, "v"), ("x1", F.max, "u"), ("y1", F.max, "v"))]).filter("inside_frac > 0")
    area = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    return out.join(members, "view").select(cluster, F.col("member").alias("view"), F.array("x0", "y0", "x1", "y1").alias("box"), "inside_frac", area.alias("area"), "depth")


def best_views(hits: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Of each cluster the view of the highest inside_frac times area; ties to the earlier view."""
    score = F.col("inside_frac") * F.col("area")
    return hits.groupBy(cluster).agg(F.max_by(F.struct(*[c for c in hits.columns if c != cluster]), F.struct(score, -F.col("view"))).alias("b")).select(cluster, "b.*")


def view_basis(points: DataFrame, views: DataFrame) -> DataFrame:
    """basis (opengl or opencv) and the largest share of points that any view has in frame under it, the best basis first.

    views' c2w are read as they are for opencv, and with y and z turned for opengl."""
    turned = F.transform("c2w", lambda x, i: F.when((i < 12) & ((i % 4 == 1) | (i % 4 == 2)), -x).otherwise(x))
    points, views = places(points), poses(views)[0]
    rows = [seen(points, views.withColumn("c2w", turned) if basis == "opengl" else views).withColumn("inside", _inside()).groupBy("view").agg(_share().alias("share")).agg(F.max("share").alias("share")).select(F.lit(basis).alias("basis"), F.lit(place).alias("place"), "share") for place, basis in enumerate(("opengl", "opencv"))]
    return rows[0].unionByName(rows[1]).orderBy(F.desc("share"), "place").select("basis", "share")


def depth_picture(points: DataFrame, views: DataFrame) -> DataFrame:
    """view, row, col, depth: the nearest point of each pixel, pixels being rounded half to even."""
    few, members = poses(views)
    rows = seen(places(points), few).filter("depth IS NOT NULL").select("view", F.bround("v").cast("int").alias("row"), F.bround("u").cast("int").alias("col"), "depth", "width", "height")
    pixels = rows.filter("row >= 0 AND row < height AND col >= 0 AND col < width").groupBy("view", "row", "col").agg(F.min("depth").alias("depth"))
    return pixels.join(members, "view").select(F.col("member").alias("view"), "row", "col", "depth")


def nearest_wall(points: DataFrame, walls: DataFrame, id_col: str) -> DataFrame:
    """id, wall, distance: the nearest wall whose footprint holds the point's projection.

    walls: wall, point, normal, axis_u, axis_v (arrays of 3) and u0, u1, v0, v1 along the axes from point."""
    both = with_each(points.select(id_col, "x", "y", "z"), walls)
    along = lambda a: sum(((F.col(c) - F.col("point")[i]) * F.col(a)[i] for i, c in ((1, "y"), (2, "z"))), (F.col("x") - F.col("point")[0]) * F.col(a)[0])
    both = both.withColumns({"off": F.abs(along("normal")), "du": along("axis_u"), "dv": along("axis_v")}).filter("du BETWEEN u0 AND u1 AND dv BETWEEN v0 AND v1")
    return both.groupBy(id_col).agg(F.min_by("wall", F.struct("off", "wall")).alias("wall"), F.min("off").alias("distance"))


def nearest_cell(goals: DataFrame, cells: DataFrame, goal: str) -> DataFrame:
    """goal, iu, iv, distance: the nearest free cell's middle to each goal (u, v); goals are the few."""
    both = with_each(cells.select("iu", "iv", "cu", "cv"), goals.select(goal, "u", "v"))
    d = G.norm(F.col("cu") - F.col("u"), F.col("cv") - F.col("v"))
    return both.withColumn("d", d).groupBy(goal).agg(F.min_by(F.struct("iu", "iv"), F.struct("d", "iu", "iv")).alias("c"), F.min("d").alias("distance")).select(goal, "c.iu", "c.iv", "distance")


def gravity(poses: DataFrame) -> DataFrame:
    """gx, gy, gz, note: the mean of cameras' down axes (second column of row-major 4x4 poses) as a direction; null if they cancel out, a note if x leads."""
    mean = poses.agg(*[F.avg(F.col("pose")[4 * i + 1]).alias(f"m{i}") for i in range(3)])
    n = G.norm(*[F.col(f"m{i}") for i in range(3)])
    g = [F.when(n >= 1e-9, F.col(f"m{i}") / n) for i in range(3)]
    return mean.select(*[c.alias(f"g{a}") for c, a in zip(g, "xyz", strict=True)]).withColumn("note", F.when(F.abs("gx") > F.greatest(F.abs("gy"), F.abs("gz")), "gravity leads along x"))


def up_axis(points: DataFrame) -> DataFrame:
    """axis: y or z, whichever the points span less; y if alike."""
    r = points.agg((F.max("y") - F.min("y")).alias("y"), (F.max("z") - F.min("z")).alias("z"))
    return r.select(F.when(F.col("y") <= F.col("z"), "y").otherwise("z").alias("axis"))


def ground_frame(points: DataFrame, order: str, up: tuple[float, float, float], threshold: float, least_inliers: int = 200, least_share: float = 0.02, least_room: float = 0.5) -> dict:
    """up_axis, floor_height, ceiling_height, span, inliers, known and note of a scene, from its floor.

    The floor is the dominant plane of the lowest 40 % along up. Heights are along its normal. The ceiling is the
    topmost dense shelf, unless that is nearer to the floor than a share of the span. A floor of few points leaves
    the vertical unknown, and a ceiling's absence is told."""
    along = lambda n: sum((F.col(c) * float(n[i]) for i, c in ((1, "y"), (2, "z"))), F.col("x") * float(n[0]))
    bar = exact_percentiles(points, {"h": along(up)}, [0.4])[1]["h"][0]
    total = points.count()
    if bar is None or total < 32:
        return {"known": False, "note": "too few points"}
    floor = spatial.plane(points.filter(along(up) <= bar), order, threshold)
    if floor is None:
        return {"known": False, "note": "no floor"}
    n = np.array(floor["normal"]) * (1 if np.dot(floor["normal"], up) >= 0 else -1)
    height = along(n)
    at = float(n @ np.array(floor["point"]))
    inliers = points.filter(F.abs(height - at) <= threshold).count()
    low, high = exact_percentiles(points, {"h": height}, [0.01, 0.99])[1]["h"]
    shelf = A.top_shelf(A.histogram(points.select(height.alias("h")), "h", 60), 60).first()
    room = shelf and shelf["height"] - at >= least_room * (high - low)
    weak = "too few points on the floor" if inliers < least_inliers else "the floor is too small a share" if inliers / total < least_share else None
    note = weak or (None if room else "no ceiling")
    return {"up_axis": n.tolist(), "floor_height": at, "ceiling_height": shelf["height"] if room else None, "span": high - low, "inliers": inliers, "known": weak is None, "note": note}


def alignment(points: DataFrame, up: tuple[float, float, float], scale: float = 1.0, floor: Column | None = None) -> np.ndarray:
    """The 4x4 that turns up to +z, scales, puts the floor's median (without floor points, the lowest point) at z = 0 and the mean at x = y = 0."""
    a = np.array(up, float) / np.linalg.norm(up)
    c, v = a[2], np.cross(a, [0, 0, 1.0])
    if c < -1 + 1e-8:
        turn = np.diag([1.0, -1.0, -1.0])
    else:
        k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        turn = np.eye(3) + k + k @ k / (1 + c)
    m = scale * turn
    row = lambda i: sum((F.col(p) * float(m[i, j]) for j, p in ((1, "y"), (2, "z"))), F.col("x") * float(m[i, 0]))
    means = points.agg(F.avg(row(0)).alias("x"), F.avg(row(1)).alias("y"), F.min(row(2)).alias("low")).first()
    ground = exact_percentiles(points.filter(floor), {"z": row(2)}, [0.5])[1]["z"][0] if floor is not None else None
    out = np.eye(4)
    out[:3, :3] = m
    out[:3, 3] = [-(means["x"] or 0.0), -(means["y"] or 0.0), -(ground if ground is not None else means["low"] or 0.0)]
    return out


def footprint_fill(points: DataFrame, u: str, v: str) -> DataFrame:
    """cells, bins, fill: the share of a square grid over the points' rectangle that holds any; as many bins a side as sqrt(n / 6), 6 to 24."""
    ends = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{s}") for c, k in ((u, "u"), (v, "v")) for f, s in ((F.min, "0"), (F.max, "1"))]).first()
    bins = int(min(24, max(6, (ends["n"] / 6) ** 0.5)))
    cell = [F.least(F.floor((F.col(c) - ends[f"{k}0"]) / max(ends[f"{k}1"] - ends[f"{k}0"], 1e-12) * bins), F.lit(bins - 1)) if ends["n"] else F.lit(0) for c, k in ((u, "u"), (v, "v"))]
    return points.agg(F.count_distinct(*cell).alias("cells")).select("cells", F.lit(bins).alias("bins"), (F.col("cells") / bins**2).alias("fill"))


def weighted_center(splats: DataFrame, least: float = 0.35) -> DataFrame:
    """x, y, z: the mean position by opacity (a logit as a share) of splats whose opacity reaches least."""
    w = 1 / (1 + F.exp(-F.col("opacity")))
    return splats.withColumn("w", w).filter(F.col("w") >= least).agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in "xyz"])


def determinant_counts(rows: DataFrame, matrix: Column, near: float = 1e-6) -> DataFrame:
    """n, negative, near_zero, not_finite of 3x3 determinants."""
    d = rows.select(G.determinant([matrix[i] for i in range(9)]).alias("d"))
    ok = G.finite(F.col("d"))
    return d.agg(F.count("*").alias("n"), F.count_if(ok & (F.col("d") < 0)).alias("negative"), F.count_if(ok & (F.abs("d") < near)).alias("near_zero"), F.count_if(~ok).alias("not_finite"))


def log_batches(events: DataFrame, run: str, ts: str, order: str, most: int = 20, seconds: float = 2.0) -> DataFrame:
    """events with seq (from 0 in order) and batch: a log that is flushed at `most` events or once `seconds` have passed since a batch's first."""

    def step(state: tuple | None, t: float) -> tuple[tuple, tuple]:
        seq, batch, n, first = state or (-1, -1, most, t)
        if n >= most or t - first >= seconds:
            batch, n, first = batch + 1, 0, t
        return (seq + 1, batch, n + 1, first), (seq + 1, batch)

    timed = events.select(run, F.col(ts).cast("timestamp").cast("double").alias("__t"), order)
    return folded(timed, run, ["__t", order], ["__t"], step, "seq int, batch int").select(run, order, "seq", "batch")


def mission_states(rounds: DataFrame, complete_gap: int = 3, stall_gap: int = 5) -> DataFrame:
    """rounds (mission, round, wanted, found arrays) with known, confidence, stalled and status after each.

    A mission is done when all that it wants is found, or when, still active, it has found half and complete_gap
    rounds brought none of its names; after stall_gap such rounds it is recovering. stalled counts rounds since a
    round last named something it wants; a find starts it anew."""

    def step(state: tuple | None, wanted: list | None, found: list | None) -> tuple[tuple, tuple]:
        known, stalled, status = state or (frozenset(), 0, "active")
        wanted = wanted or []
        hits = set(wanted) & set(found or [])
        fresh, known = bool(hits - known), known | hits
        share = len(known) / max(1, len(wanted))
        if status != "completed":
            stalled = 0 if fresh else stalled if hits else stalled + 1
            awake = "active" if fresh else status
            if wanted and len(known) >= len(wanted) or awake == "active" and stalled >= complete_gap and known and share >= 0.5:
                status = "completed"
            else:
                status = "recovering" if stalled >= stall_gap else awake
        return (known, stalled, status), (len(known), share, stalled, status)

    return folded(rounds.select("mission", "round", "wanted", "found"), "mission", ["round"], ["wanted", "found"], step, "known int, confidence double, stalled int, status string").drop("wanted", "found")


def idle_sessions(events: DataFrame, session: str, ts: str, now: Column, seconds: float) -> DataFrame:
    """Sessions whose last event is more than seconds before now."""
    return events.groupBy(session).agg(F.max(F.col(ts).cast("timestamp")).alias("last")).filter(now.cast("double") - F.col("last").cast("double") > seconds)


def foreign_messages(messages: DataFrame, order: str) -> DataFrame:
    """messages (connection, session) with refused: its session isn't the one that the connection began with."""
    first = F.first("session").over(W.partitionBy("connection").orderBy(order))
    return messages.withColumn("refused", ~F.col("session").eqNullSafe(first))
