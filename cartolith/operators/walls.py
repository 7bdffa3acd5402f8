"""Walls of a room: upright planes that are filled surfaces, found one after another."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.operators.shared import exact_percentiles
from cartolith.operators.spatial import P, cols, plane

# Cells along a side of the grid that fill is told by, at least and at most, points a cell that it is made for, and points that it takes.
LEAST_CELLS, MOST_CELLS, POINTS_A_CELL, LEAST_POINTS = 6, 24, 6.0, 8


def fill(points: DataFrame, u: Column, v: Column) -> float:
    """The share of the cells of a grid over the points' bounds that have points; the grid is finer the more points there are. 0 for a line and for few points."""
    flat = points.select(u.alias("u"), v.alias("v"))
    e = flat.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for c in "uv" for i, f in enumerate((F.min, F.max))]).first()
    if e["n"] < LEAST_POINTS or min(e["u1"] - e["u0"], e["v1"] - e["v0"]) < 1e-9:
        return 0.0
    cells = int(min(MOST_CELLS, max(LEAST_CELLS, math.sqrt(e["n"] / POINTS_A_CELL))))
    at = [F.least(F.floor((F.col(c) - e[f"{c}0"]) * cells / (e[f"{c}1"] - e[f"{c}0"])), F.lit(cells - 1)) for c in "uv"]
    return flat.select(*at).distinct().count() / cells**2


def walls(points: DataFrame, order: str, up: tuple[float, float, float], threshold: float, most: int = 6, least: int | None = None, lean: float = 0.2, least_aspect: float = 0.12, least_fill: float = 0.5, position: tuple[str, str, str] = P) -> list[dict]:
    """Up to most walls, those of more points first: id, point, normal (towards more of the points), u and v (along the wall and up), bounds (1st and 99th percentile along each), thickness, inliers.

    In each round the upright plane of most points within threshold is refitted, and all within twice the threshold is taken
    out, whatever comes of it. It is a wall if it has least points (0.5 % of all, 200 at least, unless given), is upright
    still, no mere stripe (least_aspect, of its spread across to that along) and filled (least_fill). Rounds end when no upright plane has
    enough points, or after three times most. A round is a few passes over the points; the driver sees moments and counts.
    Points without finite coordinates don't count."""
    axes = cols(position)
    rest = points.filter(F.forall(F.array(*[c.cast("double") for c in axes]), lambda c: G.finite(c)))
    upward = np.array(up, float) / np.linalg.norm(up)
    whole, n = rest, rest.count()
    least = max(200, n // 200) if least is None else least
    found: list[dict] = []
    for _ in range(3 * most):
        p = plane(rest, order, threshold, hypotheses=600, position=position, up=tuple(upward), lean=lean) if len(found) < most else None
        if p is None or p["inliers"] < max(3, least):
            break
        normal, at = np.array(p["normal"]), np.array(p["point"])
        off = G.plane_height(axes, p["point"], p["normal"])
        inside = rest.filter(F.abs(off) <= threshold)
        rest = rest.filter(F.abs(off) > 2 * threshold)
        if abs(float(normal @ upward)) >= lean or math.sqrt(p["spread"][1]) < least_aspect * math.sqrt(p["spread"][0]) or p["spread"][0] <= 0:
            continue
        if whole.agg(F.sum(F.signum(off))).first()[0] < 0:
            normal = -normal
        u = np.cross(upward, normal)
        u /= np.linalg.norm(u)
        v = np.cross(normal, u)
        along = [sum((float(a[i]) * (axes[i].cast("double") - float(at[i])) for i in (1, 2)), float(a[0]) * (axes[0].cast("double") - float(at[0]))) for a in (u, v)]
        if fill(inside, *along) < least_fill:
            continue
        ends = exact_percentiles(inside, {"u": along[0], "v": along[1]}, [0.01, 0.99])[1]
        found.append({"point": at.tolist(), "normal": normal.tolist(), "u": u.tolist(), "v": v.tolist(), "bounds": [ends["u"], ends["v"]], "thickness": 2 * threshold, "inliers": p["inliers"]})
    found.sort(key=lambda w: -w["inliers"])
    return [{"id": f"wall_{i}", **w} for i, w in enumerate(found)]
