"""Tracks over frames: lifting 2D tracks to space, depth windows, smoothing, arc-length resampling, bodies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.operators.pairs import best_pairs
from cartolith.operators.shared import kept


def lifted(samples: DataFrame, cameras: DataFrame) -> DataFrame:
    """samples (object, frame, u, v, depth, ...) with x, y, z in the world, by each frame's own camera (frame, fx, fy, cx, cy, pose).

    pose is a row-major 4x4 from camera to world. Samples without a camera or a finite depth are left out."""
    cam = samples.join(cameras, "frame").filter(G.finite(F.col("depth")))
    p = [(F.col("u") - F.col("cx")) * F.col("depth") / F.col("fx"), (F.col("v") - F.col("cy")) * F.col("depth") / F.col("fy"), F.col("depth")]
    world = G.transformed(tuple(p), [F.col("pose")[i] for i in range(16)])
    out = cam.select(*samples.columns, *[c.alias(n) for c, n in zip(world, ("x", "y", "z"), strict=True)])
    return out.filter(G.finite(F.col("x"), F.col("y"), F.col("z")))


def track_summary(lifts: DataFrame, key: str, frame: str = "frame", moves: float = 0.05) -> DataFrame:
    """key, n, rms, max_excursion (about the centroid), max_displacement (from the first), motion: moving, static, or unknown below two lifts."""
    w = W.partitionBy(key)
    first = [F.first(c).over(w.orderBy(frame)).alias(f"first_{c}") for c in "xyz"]
    mean = [F.avg(c).over(w).alias(f"mean_{c}") for c in "xyz"]
    rows = lifts.select(key, "x", "y", "z", *first, *mean)
    off = G.distance(tuple(F.col(c) for c in "xyz"), tuple(F.col(f"mean_{c}") for c in "xyz"))
    moved = G.distance(tuple(F.col(c) for c in "xyz"), tuple(F.col(f"first_{c}") for c in "xyz"))
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.sqrt(F.avg(off * off)).alias("rms"), F.max(off).alias("max_excursion"), F.max(moved).alias("max_displacement"))
    enough = F.col("n") >= 2
    return out.select(key, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("rms", "max_excursion", "max_displacement")], F.when(~enough, "unknown").when(F.col("max_displacement") > moves, "moving").otherwise("static").alias("motion"))


def window_depth(places: DataFrame, pixels: DataFrame, least_conf: Column | float, reach: int = 2) -> DataFrame:
    """places (object, frame, u, v) with depth (the median), n and conf of the sound pixels within reach of the rounded place; null where there are none.

    pixels has frame, row, col, depth and conf; sound ones have finite positive depth and at least least_conf.
    Each place is spread over its window's pixels, so both sides meet by equality."""
    u, v = F.bround("u").cast("int"), F.bround("v").cast("int")
    steps = lambda c, name: F.explode(F.sequence(c - reach, c + reach)).alias(name)
    spread = places.select("*", steps(u, "col")).select("*", steps(v, "row"))
    sound = pixels.filter(G.finite(F.col("depth")) & (F.col("depth") > 0) & (F.col("conf") >= least_conf))
    met = spread.join(sound, ["frame", "row", "col"]).groupBy("object", "frame").agg(F.median("depth").alias("depth"), F.count("*").alias("n"), F.avg("conf").alias("conf"))
    return places.join(met, ["object", "frame"], "left")


def gated_depth(rows: DataFrame, key: list[str], share: float = 0.4) -> DataFrame:
    """key, depth: the median of depths whose confidence reaches the key's own percentile."""
    bar = rows.groupBy(*key).agg(F.percentile("conf", share).alias("bar"))
    return rows.join(bar, key).filter(F.col("conf") >= F.col("bar")).groupBy(*key).agg(F.median("depth").alias("depth"))


def body_scale(joints: DataFrame, key: list[str], least_m: float = 0.15, least_n: int = 3) -> DataFrame:
    """key, scale: the median ratio of scene to metre offsets over joints at least least_m out; keys with fewer than least_n are left out."""
    good = joints.filter((F.col("meters") >= least_m) & G.finite(F.col("scene")))
    return good.groupBy(*key).agg(F.median(F.col("scene") / F.col("meters")).alias("scale"), F.count("*").alias("n")).filter(F.col("n") >= least_n).select(*key, "scale")


def bone_variation(bones: DataFrame, person: str, bone: str, length: str) -> DataFrame:
    """person, mean and largest variation (population deviation over mean) of bone lengths over frames."""
    each = bones.groupBy(person, bone).agg(F.try_divide(F.stddev_pop(length), F.avg(length)).alias("cv"))
    return each.groupBy(person).agg(F.avg("cv").alias("mean_cv"), F.max("cv").alias("max_cv"))


def anchored_bodies(joints: DataFrame, scales: DataFrame) -> DataFrame:
    """joints (person, frame, joint, root and offset arrays) in the world at one scale for all: the median of the frames' estimates, 1 without any.

    valid tells whether all of a frame's joints are finite."""
    one = scales.filter(G.finite(F.col("scale"))).agg(F.coalesce(F.median("scale"), F.lit(1.0)).alias("body_scale"))
    placed = joints.join(F.broadcast(one)).withColumn("world", F.transform(F.arrays_zip("root", "offset"), lambda s: s["root"] + s["offset"] * F.col("body_scale")))
    sound = F.forall("world", lambda x: G.finite(x))
    return placed.withColumn("valid", F.min(sound).over(W.partitionBy("person", "frame")))


def spread_positions(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows at even places of one timeline, the first and last among them; all rows if there are no more than k.

    Rows are numbered in parts that keep the order, so no task holds the timeline."""
    numbered, n = numbered_rows(rows, order)
    if n <= k:
        return numbered.drop("position")
    places = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 else [0]
    return numbered.filter(F.col("position").isin(places)).drop("position")


def numbered_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with position from 0 in order, and how many there are: range parts are numbered apart and shifted by what is before them."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt = kept(dealt, "numbered")
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:  # one entry a partition
        starts.append((part, total))
        total += n
    table = rows.sparkSession.createDataFrame(starts, "part int, start long")
    within = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(table), "part").withColumn("position", F.col("start") + within).drop("part", "start"), total


def resampled(paths: DataFrame, key: str, order: str, step: float, position: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """key, sample, position: each polyline at even arc lengths of about step, its ends among them (two samples at least)."""
    w = W.partitionBy(key).orderBy(order)
    move = G.norm(*[F.col(c) - F.lag(c).over(w) for c in position])
    rows = paths.withColumn("s", F.sum(F.coalesce(move, F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    ahead = [F.lead(c).over(w).alias(f"next_{c}") for c in ("s", *position)]
    rows = rows.select(key, order, "s", *position, *ahead, F.max("s").over(W.partitionBy(key)).alias("total"))
    n = F.greatest(F.bround(F.col("total") / step).cast("int") + 1, F.lit(2))
    gap = F.col("total") / (n - 1)
    # of each piece the samples from its start up to, but not including, its end; the last one belongs to the last piece
    low, high = F.ceil(F.try_divide(F.col("s"), gap) - 1e-9), F.ceil(F.try_divide(F.col("next_s"), gap) - 1e-9) - 1
    last = F.col("next_s") == F.col("total")
    high = F.when(last, n - 1).otherwise(high)
    pieces = rows.filter(F.col("next_s") > F.col("s")).withColumns({"low": low.cast("int"), "high": high.cast("int"), "gap": gap}).filter("low <= high")
    at = pieces.select("*", F.explode(F.sequence("low", "high")).alias("sample"))
    t = F.least(F.greatest((F.col("sample") * F.col("gap") - F.col("s")) / (F.col("next_s") - F.col("s")), F.lit(0.0)), F.lit(1.0))
    return at.select(key, "sample", *[(F.col(c) + t * (F.col(f"next_{c}") - F.col(c))).alias(c) for c in position])


def smoothed(rows: DataFrame, key: str, ts: str, value: str, cutoff: float = 1.0, beta: float = 0.01, d_cutoff: float = 1.0) -> DataFrame:
    """key, ts, value and smooth: a low-pass whose cutoff grows with speed (the 1-euro filter), after gaps were filled linearly.

    Each key's series runs through a task in order and is held one at a time; nulls at its ends take the nearest value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        x, t = pdf[value].astype(float).interpolate(limit_direction="both").to_numpy(), pdf[ts].to_numpy(float)
        out, speed = x.copy(), 0.0
        for i in range(1, len(x)):
            dt = max(t[i] - t[i - 1], 1e-9)
            share = lambda c: 1 / (1 + 1 / (2 * np.pi * c * dt))  # noqa: B023, E731
            speed += share(d_cutoff) * ((x[i] - out[i - 1]) / dt - speed)
            out[i] = out[i - 1] + share(cutoff + beta * abs(speed)) * (x[i] - out[i - 1])
        return pd.DataFrame({key: pdf[key], ts: t, value: pdf[value], "smooth": out})

    kinds = dict(rows.dtypes)
    return rows.select(key, ts, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {ts} double, {value} {kinds[value]}, smooth double")


def matched_frames(queries: DataFrame, frames: DataFrame, least: float) -> DataFrame:
    """query, frame, corr: the frame whose samples correlate best with the query's; none below least; ties to the smaller frame."""
    named = frames.select(F.col("frame").alias("id"), F.col("samples").alias("vector"))
    best = best_pairs(named, queries.select(F.col("query").alias("query_id"), F.col("samples").alias("query")), [], 1, "correlation", least, False)
    scored = best.select(F.col("query_id").alias("query"), F.col("id").alias("frame"), F.col("score").alias("corr"))
    return scored.groupBy("query").agg(F.max_by("frame", F.struct("corr", -F.col("frame"))).alias("frame"), F.max("corr").alias("corr"))


def recovered_numbers(rows: DataFrame, anchors: DataFrame, key: str, frame: str = "frame", most: int | None = None) -> DataFrame:
    """key, frame, fed, exact, error: the number at which each row's frame was fed, frame + delta of the last anchor (key, frame, delta) at or before it.

    Before the first anchor delta is 0. exact tells whether the anchors on both sides agree; error, that deltas
    fall. fed is cut to most."""
    none = F.lit(None).cast("long")
    both = rows.select(key, frame, none.alias("delta"), F.lit(1).alias("side")).unionByName(anchors.select(key, frame, F.col("delta").cast("long"), F.lit(0).alias("side")))
    w = W.partitionBy(key).orderBy(frame, "side")
    back = W.partitionBy(key).orderBy(F.desc(frame), "side")
    before = F.coalesce(F.last("delta", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    after = F.last("delta", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumns({"before": before, "after": after}).filter("side = 1")
    fed = F.col(frame) + F.col("before")
    return out.select(key, frame, (fed if most is None else F.least(fed, F.lit(most))).alias("fed"), (F.col("before") == F.coalesce("after", "before")).alias("exact"), F.when(F.col("after") < F.col("before"), "deltas fall").alias("error"))
