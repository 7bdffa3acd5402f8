"""Splat tables: clamping and flooring scales, levels of detail and their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.operators.shared import exact_percentiles

SCALES = ("scale_0", "scale_1", "scale_2")
NORMALS = ("nx", "ny", "nz")
#: Fixed value: the smallest linear scale that a logarithm is taken of.
SCALE_FLOOR = 1e-12


def clamped_scales(splats: DataFrame, percentile: float = 99.0) -> tuple[DataFrame, dict]:
    """splats with log scales cut to a percentile of all finite linear scales, and what was done: clamp_value, clamped, before, after.

    Outside (0, 100), or without a finite positive percentile, nothing is cut."""
    linear = [F.exp(c) for c in SCALES]
    sizes = splats.select(F.explode(F.array(*linear)).alias("v")).filter(G.finite(F.col("v")))
    limit = exact_percentiles(sizes, {"v": F.col("v")}, [percentile / 100])[1]["v"][0] if 0 < percentile < 100 else None
    over = F.greatest(*linear) > limit if limit else F.lit(False)
    told = splats.agg(F.count_if(over).alias("n"), F.max(F.greatest(*linear)).alias("before")).first()
    info = {"clamp_value": limit, "clamped": told["n"], "before": told["before"], "after": min(limit, told["before"]) if limit and told["before"] else told["before"]}
    if not limit:
        return splats, info
    return splats.withColumns({c: F.ln(F.greatest(F.least(F.exp(c), F.lit(limit)), F.lit(SCALE_FLOOR))) for c in SCALES}), info


def floored_scales(splats: DataFrame, voxel: float) -> DataFrame:
    """splats none of whose log scales is below that of half a voxel, so that one splat a voxel leaves no holes."""
    return splats.withColumns({c: F.greatest(F.col(c), F.ln(F.lit(voxel * 0.5))) for c in SCALES})


def without_zero_normals(splats: DataFrame) -> DataFrame:
    """splats without their normals if all of them are zero."""
    zero = splats.agg(F.bool_and(F.expr(" AND ".join(f"{c} = 0" for c in NORMALS))).alias("z")).first()["z"]
    return splats.drop(*NORMALS) if zero else splats


def planned_levels(sources: DataFrame, budgets: list[int]) -> DataFrame:
    """sources (source, n) with each budget that shrinks them by more than 1.3, in order."""
    each = sources.select("*", F.explode(F.array(*[F.lit(int(b)) for b in sorted(budgets)])).alias("budget"))
    return each.filter(F.col("n") > 1.3 * F.col("budget"))


def level_index(levels: DataFrame, default: int) -> DataFrame:
    """source, default_level (the smallest budget that reaches the default, else the largest), levels as an ordered array of structs."""
    rows = levels.groupBy("source", "n").agg(F.sort_array(F.collect_list("budget")).alias("budgets"), F.min(F.when(F.col("budget") >= default, F.col("budget"))).alias("reach"), F.max("budget").alias("top"))
    return rows.select("source", F.col("n").alias("gaussians"), F.coalesce("reach", "top").alias("default_level"), F.transform("budgets", lambda b: F.struct(b.alias("budget"), (b / F.col("n")).alias("share"))).alias("levels"))


def planned_sources(levels: DataFrame, budget: Column) -> DataFrame:
    """Of each source's levels (source, budget) the largest within a view's budget, else the smallest."""
    fits = F.max(F.when(F.col("budget") <= budget, F.col("budget")))
    return levels.groupBy("source").agg(F.coalesce(fits, F.min("budget")).alias("level"))
