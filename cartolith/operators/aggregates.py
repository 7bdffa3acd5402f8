"""Aggregations: bounds, ratios and their spread, histograms, alignment, fused boxes, tallies."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.functions.time import micros
from cartolith.operators.shared import exact_percentiles
from cartolith.operators.tracks import numbered_rows


def robust_bounds(points: DataFrame, position: tuple[str, ...], low: float = 0.02, high: float = 0.98, key: list[str] | None = None) -> DataFrame:
    """Low and high linear percentiles of each axis over finite points, the extents largest first, and the count."""
    finite = points.filter(G.finite(*[F.col(c) for c in position]))
    if not key:  # one group of all rows: no task holds it
        n, ends = exact_percentiles(finite, {c: F.col(c) for c in position}, [low, high])
        flat = [ends[c][i] for c in position for i in (0, 1)]
        sizes = sorted((ends[c][1] - ends[c][0] for c in position), reverse=True) if n else None
        schema = ", ".join(f"{c}_{side} double" for c in position for side in ("low", "high"))
        return points.sparkSession.createDataFrame([(*flat, sizes, n)], f"{schema}, dimensions array<double>, points long")
    ends = [F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"__{c}") for c in position]
    out = finite.groupBy(*key).agg(*ends, F.count("*").alias("points"))
    cols = [F.col(f"__{c}")[i].alias(f"{c}_{side}") for c in position for i, side in enumerate(("low", "high"))]
    return out.select(*key, *cols, F.sort_array(F.array(*[F.col(f"__{c}")[1] - F.col(f"__{c}")[0] for c in position]), False).alias("dimensions"), "points")


def ratio_summary(rows: DataFrame, key: list[str], ratio: Column, least: int = 1) -> DataFrame:
    """Median, relative inter-quartile range and count of finite positive ratios; keys with fewer than least are left out."""
    good = rows.select(*key, ratio.alias("ratio")).filter(G.finite(F.col("ratio")) & (F.col("ratio") > 0))
    q = good.groupBy(*key).agg(F.percentile("ratio", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return q.select(*key, F.col("q")[1].alias("ratio"), F.try_divide(F.col("q")[2] - F.col("q")[0], F.abs(F.col("q")[1])).alias("rel_iqr"), "n")


def ratio_of_groups(frames: DataFrame, key: list[str]) -> DataFrame:
    """From ratio_summary's rows by frame: the median of their medians and their variation (infinite below two frames)."""
    variation = F.when(F.count("*") >= 2, F.try_divide(F.stddev_pop("ratio"), F.avg("ratio"))).otherwise(float("inf"))
    return frames.groupBy(*key).agg(F.median("ratio").alias("ratio"), variation.alias("variation"), F.median("rel_iqr").alias("rel_iqr"), F.count("*").alias("frames"))


def ratio_gate(rows: DataFrame, key: list[str], ratio: Column, least: int = 3, most_variation: float = 0.15) -> DataFrame:
    """ok with the mean's variation, or the reason against: too few ratios, or too much variation."""
    good = rows.select(*key, ratio.alias("ratio")).filter(G.finite(F.col("ratio")) & (F.col("ratio") > 0))
    out = good.groupBy(*key).agg(F.count("*").alias("n"), F.try_divide(F.stddev_pop("ratio"), F.avg("ratio")).alias("variation"))
    reason = F.when(F.col("n") < least, "too few ratios").when(F.col("variation") > most_variation, "ratios vary too much")
    return out.withColumns({"reason": reason, "ok": reason.isNull()})


def scale_decision(geometric: Column, current: Column, previous: Column, support: Column, gate: float = 0.5, most_variation: float = 0.15, thin: int = 400) -> Column:
    """struct(scale, applied, reason, untrusted, degenerate) from a geometric scale and two anchors (struct ratio, variation).

    The anchors' ratio is used when both are usable and steady and it agrees with geometry, or geometry is
    degenerate or rests on thin support; on disagreement with rich support geometry stays, marked untrusted."""
    usable = G.finite(current["ratio"], previous["ratio"]) & (current["ratio"] > 0) & (previous["ratio"] > 0)
    metric = F.when(usable, current["ratio"] / previous["ratio"])
    steady = (F.coalesce(current["variation"], F.lit(math.inf)) < most_variation) & (F.coalesce(previous["variation"], F.lit(math.inf)) < most_variation)
    degenerate = ~G.finite(geometric) | (geometric <= 0)
    off = F.abs(F.ln(metric / geometric))

    def made(scale: Column, applied: bool, reason: str, untrusted: bool = False, bad: bool = False) -> Column:
        return F.struct(scale.alias("scale"), F.lit(applied).alias("applied"), F.lit(reason).alias("reason"), F.lit(untrusted).alias("untrusted"), F.lit(bad).alias("degenerate"))

    return (
        F.when(metric.isNull(), made(geometric, False, "anchor_unavailable"))
        .when(~G.finite(metric), made(geometric, False, "anchor_nonfinite"))
        .when(~steady, made(geometric, False, "within_submap_cov_high"))
        .when(degenerate, made(metric, True, "geom_degenerate", bad=True))
        .when(off < gate, made(metric, True, "agree"))
        .when(support < thin, made(metric, True, "disagree_thin_overlap", bad=True))
        .otherwise(made(geometric, False, "disagree_rich_overlap", untrusted=True))
    )


def block_median(pixels: DataFrame, key: list[str], row: str, col: str, value: str, side: int) -> DataFrame:
    """The median of each side x side block's non-zero values; blocks without any are left out."""
    return pixels.groupBy(*key, F.floor(F.col(row) / side).alias("block_row"), F.floor(F.col(col) / side).alias("block_col")).agg(F.median(F.nullif(F.col(value), F.lit(0))).alias("median")).filter("median IS NOT NULL")


def histogram(rows: DataFrame, value: str, bins: int, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """bin, n, low, high over the range between two linear percentiles; empty bins are left out."""
    bounds = exact_percentiles(rows, {value: F.col(value)}, [low, high])[1][value]
    ends = [F.lit(x).cast("double").alias(c) for x, c in zip(bounds, ("low", "high"), strict=True)]
    placed = rows.select(F.col(value).cast("double").alias("v"), *ends).filter("v >= low AND v <= high")
    width = (F.col("high") - F.col("low")) / bins
    bin_ = F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), width)), F.lit(bins - 1)).cast("long")
    return placed.groupBy(F.coalesce(bin_, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))


def top_shelf(hist: DataFrame, bins: int) -> DataFrame:
    """height, n of a histogram's topmost shelf: the highest bin over max(4 medians, 1 % of rows), grown over bins of half that."""
    rows = hist.agg(F.sum("n").alias("all"), F.collect_list(F.struct("bin", "n")).alias("h"), F.first("low").alias("low"), F.first("high").alias("high"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.aggregate(F.filter(F.col("h"), lambda b: b["bin"] == i), F.lit(0).cast("long"), lambda a, b: a + b["n"]))
    rows = rows.withColumn("c", counts)
    ordered = F.sort_array("c")
    middle = (ordered[(bins - 1) // 2] + ordered[bins // 2]) / 2
    rows = rows.withColumn("bar", F.greatest(4 * middle, 0.01 * F.col("all")))
    rows = rows.withColumn("top", F.array_max(F.filter(F.transform("c", lambda n, i: F.when(n >= F.col("bar"), i)), lambda i: i.isNotNull()))).filter("top IS NOT NULL")
    low = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (i < F.col("top")) & (F.col("c")[i] < F.col("bar") / 2)))
    rows = rows.withColumn("from", F.coalesce(low + 1, F.lit(0)))
    inside = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (i >= F.col("from")) & (i <= F.col("top")))
    n = F.aggregate(inside, F.lit(0).cast("long"), lambda a, i: a + F.col("c")[i])
    mid = F.aggregate(inside, F.lit(0.0), lambda a, i: a + F.col("c")[i] * (i + 0.5)) / n
    return rows.select((F.col("low") + (F.col("high") - F.col("low")) / bins * mid).alias("height"), n.alias("n"))


def moments(pairs: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], key: list[str] | None = None) -> DataFrame:
    """Means, cross-covariances and a's variance of paired points, in one pass: what alignment needs, 16 numbers a key."""
    cols = [F.avg(c).alias(f"mean_{s}{i}") for s, cs in (("a", a), ("b", b)) for i, c in enumerate(cs)]
    cols += [F.covar_pop(x, y).alias(f"cov_{i}{j}") for i, y in enumerate(b) for j, x in enumerate(a)]
    return pairs.groupBy(*(key or [])).agg(F.count("*").alias("n"), *cols, (F.var_pop(a[0]) + F.var_pop(a[1]) + F.var_pop(a[2])).alias("variance"))


def similarity_of(m: dict) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Scale, rotation and shift that bring a onto b best, from one row of moments(); None if degenerate."""
    if not m["n"] or not m["variance"] or m["variance"] < 1e-18:
        return None
    cov = np.array([[m[f"cov_{i}{j}"] for j in range(3)] for i in range(3)])
    u, d, vt = np.linalg.svd(cov)
    sign = np.diag([1.0, 1.0, -1.0 if np.linalg.det(u) * np.linalg.det(vt) < 0 else 1.0])
    r = u @ sign @ vt
    s = float((np.diag(d) @ sign).trace() / m["variance"])
    return s, r, np.array([m[f"mean_b{i}"] for i in range(3)]) - s * r @ np.array([m[f"mean_a{i}"] for i in range(3)])


def consistency(pairs: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], order: list[str], window: int = 20) -> dict:
    """Of paired trajectory points: the fitted scale, residual rmse and median, extent, and the variation of windowed scales.

    Only moments, 16 numbers each for the whole and for every half-overlapping window, leave the executors as rows;
    windows are fitted in tasks."""
    fit = similarity_of(moments(pairs, a, b).first().asDict())
    if fit is None:
        return {"warning": "alignment degenerate"}
    s, r, t = fit
    off = [s * (float(r[i, 0]) * F.col(a[0]) + float(r[i, 1]) * F.col(a[1]) + float(r[i, 2]) * F.col(a[2])) + float(t[i]) - F.col(b[i]) for i in range(3)]
    spread = F.greatest(*[F.max(c) - F.min(c) for c in b])
    out = pairs.withColumn("residual", G.norm(*off)).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow("residual", F.lit(2)))).alias("rmse"), F.median("residual").alias("median"), spread.alias("extent")).first().asDict()
    out["scale"] = s
    if out["n"] > window:
        step = max(1, window // 2)
        placed = numbered_rows(pairs, order)[0].withColumnRenamed("position", "__at")
        first, last = F.greatest(F.lit(0), F.ceil((F.col("__at") - window + 1) / step)), F.least(F.floor(F.col("__at") / step), F.lit((out["n"] - window) // step))
        spans = placed.withColumn("__window", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))))

        def scales(batches):
            for pdf in batches:
                fits = [similarity_of(row) for row in pdf.to_dict("records")]
                yield pdf[["n"]].assign(scale=[f[0] if f else float("nan") for f in fits])

        v = moments(spans, a, b, ["__window"]).mapInPandas(scales, "n long, scale double").filter("NOT isnan(scale)").agg(F.stddev_pop("scale").alias("s"), F.avg("scale").alias("m")).first()
        out["windowed_scale_cv"] = v["s"] / abs(v["m"]) if v["m"] else None
    return out


def tally(calls: DataFrame, key: str, cost: str, tokens: list[str]) -> DataFrame:
    """Of each key: calls, sums, cost (null if none is priced) and basis full, partial or unreported."""
    priced = F.count(cost)
    basis = F.when(priced == F.count("*"), "full").when(priced > 0, "partial").otherwise("unreported")
    return calls.groupBy(key).agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in tokens], F.round(F.sum(cost), 6).alias("cost"), basis.alias("basis"))


def latency_summary(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Linear p50 and p95 of y and its least-squares slope over x."""
    return rows.groupBy(key).agg(F.percentile(y, F.lit(0.5)).alias("p50"), F.percentile(y, F.lit(0.95)).alias("p95"), F.regr_slope(y, x).alias("slope"), F.count("*").alias("n"))


def catalogue(names: DataFrame, rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Of each named stream: rows (0 if it has none), first and last time, span in seconds (0 if it has none)."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    span = (micros("last") - micros("first")) / 1e6
    return names.join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), "first", "last", F.coalesce(span, F.lit(0.0)).alias("span_s"))


def counts_map(rows: DataFrame, name: str) -> DataFrame:
    """One row: a map from name to how often it occurs."""
    return rows.groupBy(name).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "count")))).alias("counts"))


def track_summary(samples: DataFrame, key: str, order: str, position: tuple[str, str, str], visible: str, moving: float = 0.05) -> DataFrame:
    """Of each track: mean position over visible samples (over all if none is), largest distance from the first, moving."""
    w = W.partitionBy(key).orderBy(order)
    first = [F.first(c).over(w) for c in position]
    off = samples.withColumn("__off", G.norm(*[F.col(c) - f for c, f in zip(position, first, strict=True)]))
    mean = [F.coalesce(F.avg(F.when(F.col(visible), F.col(c))), F.avg(c)).alias(c) for c in position]
    return off.groupBy(key).agg(*mean, F.max("__off").alias("displacement"), (F.max("__off") > moving).alias("moving"), F.count("*").alias("samples"))


def footprint(points: DataFrame, u: str, v: str, cells: int = 48) -> DataFrame:
    """p1 to p99 extents and the occupied area, from the share of a grid's cells that hold a point."""
    ends = exact_percentiles(points, {"u": F.col(u), "v": F.col(v)}, [0.01, 0.99])[1]
    ends = [F.lit(ends[c][i]).cast("double").alias(f"{c}{i}") for c in "uv" for i in (0, 1)]
    p = points.select(F.col(u).alias("pu"), F.col(v).alias("pv"), *ends).filter("pu BETWEEN u0 AND u1 AND pv BETWEEN v0 AND v1")
    cell = [F.least(F.floor(F.try_divide((F.col(f"p{c}") - F.col(f"{c}0")) * cells, F.col(f"{c}1") - F.col(f"{c}0"))), F.lit(cells - 1)) for c in "uv"]
    n = p.groupBy("u0", "u1", "v0", "v1").agg(F.count_distinct(*cell).alias("cells"))
    return n.select((F.col("u1") - F.col("u0")).alias("extent_u"), (F.col("v1") - F.col("v0")).alias("extent_v"), (F.col("cells") / cells**2 * (F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("area"), "cells")


def principal_box(points: DataFrame, position: tuple[str, str, str], key: list[str]) -> DataFrame:
    """Of each key: a box along the principal axes: center, extent (largest axis first), axes (rows). A task turns 9 moments of a key into axes."""
    x, y, z = position
    m = points.groupBy(*key).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(position)], *[F.covar_pop(p, q).alias(f"c{i}{j}") for i, p in enumerate(position) for j, q in enumerate(position) if i <= j])

    def axes(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                values, vectors = np.linalg.eigh(np.array([[r[f"c{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]))
                a = vectors.T[np.argsort(-values)]
                a = a * np.where(a[np.arange(3), np.abs(a).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
                a[2] = np.cross(a[0], a[1])
                rows.append(a.ravel().tolist())
            yield pdf[key].assign(axes=rows)

    kinds = dict(points.dtypes)
    found = m.mapInPandas(axes, ", ".join([f"{c} {kinds[c]}" for c in key] + ["axes array<double>"]))
    along = [F.col("axes")[3 * i] * F.col(x) + F.col("axes")[3 * i + 1] * F.col(y) + F.col("axes")[3 * i + 2] * F.col(z) for i in range(3)]
    ends = points.join(found, key).groupBy(*key, "axes").agg(*[f(a).alias(f"{n}{i}") for i, a in enumerate(along) for n, f in (("lo", F.min), ("hi", F.max))])
    mid = [(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 for i in range(3)]
    center = F.array(*[sum((F.col("axes")[3 * i + k] * mid[i] for i in (1, 2)), F.col("axes")[k] * mid[0]) for k in range(3)])
    return ends.select(*key, center.alias("center"), F.array(*[F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(3)]).alias("extent"), "axes")
