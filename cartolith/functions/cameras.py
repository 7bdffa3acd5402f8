"""Cameras and poses taken apart: intrinsics, rotation and place of a projection matrix; the rotation nearest to a matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.functions.placing import bound, dot, scaled

#: Fixed value: the last entry of a 4 x 4 projection is nothing against its largest, where it is below this share of it.
AT_INFINITY = 1e-12


def camera_parts(matrix: Column, to_world: bool = True) -> Column:
    """struct(k, r, t, scale, status) of a projection matrix (row-major, 3 x 4 or 4 x 4): K [R | t] up to a factor.

    k is the upper triangle of intrinsics, row-major 9, with a positive diagonal that ends in 1, scale what it was divided
    by. r is a proper rotation and t a place: from world to camera, or, to_world, from camera to world. P and -P are one camera, of
    which that of a proper rotation is taken. status is null, or tells why the parts are null: shape, not finite, at infinity (a 4 x 4 matrix
    that can't be divided by its last entry), singular."""

    def unit(v: Column) -> Column:
        return scaled(v, 1 / F.sqrt(dot(v, v)))

    def parts(p: Column) -> Column:
        row = lambda i: F.slice(p, 4 * i + 1, 3)
        sign = F.when(G.determinant([p[4 * i + j] for i in range(3) for j in range(3)]) < 0, -1.0).otherwise(1.0)
        first = F.struct(*[scaled(row(i), sign).alias(f"m{i + 1}") for i in range(3)], scaled(F.array(p[3], p[7], p[11]), sign).alias("p"))

        def third(s: Column) -> Column:
            r3 = unit(s["m3"])
            return bound(F.struct(s["m1"].alias("m1"), s["m2"].alias("m2"), s["p"].alias("p"), r3.alias("r3"), F.sqrt(dot(s["m3"], s["m3"])).alias("k33"), dot(s["m2"], r3).alias("k23"), dot(s["m1"], r3).alias("k13")), second)

        def second(s: Column) -> Column:
            left = F.array(*[s["m2"][i] - s["r3"][i] * s["k23"] for i in range(3)])
            return bound(F.struct(*[s[c].alias(c) for c in ("m1", "p", "r3", "k33", "k23", "k13")], F.sqrt(dot(left, left)).alias("k22"), unit(left).alias("r2")), last)

        def last(s: Column) -> Column:
            k12 = dot(s["m1"], s["r2"])
            left = F.array(*[s["m1"][i] - s["r2"][i] * k12 - s["r3"][i] * s["k13"] for i in range(3)])
            return bound(F.struct(*[s[c].alias(c) for c in ("p", "r3", "r2", "k33", "k23", "k13", "k22")], k12.alias("k12"), F.sqrt(dot(left, left)).alias("k11"), unit(left).alias("r1")), place)

        def place(s: Column) -> Column:
            z = s["p"][2] / s["k33"]
            y = (s["p"][1] - s["k23"] * z) / s["k22"]
            x = (s["p"][0] - s["k12"] * y - s["k13"] * z) / s["k11"]
            r = [s[f"r{i + 1}"][j] for i in range(3) for j in range(3)]
            turned = [r[3 * j + i] for i in range(3) for j in range(3)]
            home = [-(turned[3 * i] * x + turned[3 * i + 1] * y + turned[3 * i + 2] * z) for i in range(3)]
            k = [s["k11"], s["k12"], s["k13"], F.lit(0.0), s["k22"], s["k23"], F.lit(0.0), F.lit(0.0), s["k33"]]
            return F.struct(F.array(*[v / s["k33"] for v in k]).alias("k"), F.array(*(turned if to_world else r)).alias("r"), F.array(*(home if to_world else [x, y, z])).alias("t"), s["k33"].alias("scale"), F.lit(None).cast("string").alias("status"))

        return bound(first, third)

    def refusal(why: str) -> Column:
        none = F.lit(None).cast("array<double>")
        return F.struct(none.alias("k"), none.alias("r"), none.alias("t"), F.lit(None).cast("double").alias("scale"), F.lit(why).alias("status"))

    def judged(m: Column) -> Column:
        largest = F.array_max(F.transform(m, F.abs))
        whole = F.when(F.size(m) == 16, F.transform(F.slice(m, 1, 12), lambda v: v / m[15])).otherwise(m)
        rows = [F.slice(m, 4 * i + 1, 3) for i in range(3)]
        volume = F.abs(G.determinant([m[4 * i + j] for i in range(3) for j in range(3)]))
        flat = volume <= 1e-12 * F.sqrt(dot(rows[0], rows[0]) * dot(rows[1], rows[1]) * dot(rows[2], rows[2]))
        return (
            F.when(F.forall(m, lambda v: G.finite(v)) != F.lit(True), refusal("not finite"))
            .when((F.size(m) == 16) & (F.abs(F.element_at(m, -1)) < AT_INFINITY * largest), refusal("at infinity"))
            .when(flat, refusal("singular")).otherwise(bound(whole, parts))
        )

    sized = F.coalesce(F.size(matrix).isin(12, 16), F.lit(False))
    doubles = F.coalesce(matrix.cast("array<double>"), F.array().cast("array<double>"))
    return F.when(~sized, refusal("shape")).otherwise(bound(F.transform(doubles, lambda v: F.coalesce(v, F.lit(float("nan")))), judged))


def nearest_rotation(matrices: Column) -> Column:
    """struct(r, off, status): the proper rotation nearest to a 3 x 3 matrix (row-major 9), and how far off the matrix is from it (the norm of the difference).

    It comes from singular vectors, all of a batch's matrices in one call. status: null, or shape, not finite, or singular (two singular values vanish,
    so that no rotation is the nearest), and then r and off are null."""

    @F.pandas_udf("r array<double>, off double, status string")
    def run(matrices: pd.Series) -> pd.DataFrame:
        status = np.array([None] * len(matrices), object)
        whole = np.tile(np.eye(3), (len(matrices), 1, 1))
        for i, m in enumerate(matrices):
            if m is None or len(m) != 9:
                status[i] = "shape"
            elif not np.isfinite(np.array([np.nan if v is None else v for v in m], float)).all():
                status[i] = "not finite"
            else:
                whole[i] = np.array(m, float).reshape(3, 3)
        u, s, v = np.linalg.svd(whole)
        u[:, :, 2] *= np.sign(np.linalg.det(u @ v))[:, None]
        r = u @ v
        good = np.array([x is None for x in status], bool)
        status[good & (s[:, 1] <= 1e-12 * s[:, 0])] = "singular"
        off = np.sqrt(((whole - r) ** 2).sum(axis=(1, 2)))
        good = np.array([x is None for x in status], bool)
        return pd.DataFrame({"r": [x.ravel().tolist() if g else None for x, g in zip(r, good, strict=True)], "off": [float(o) if g else None for o, g in zip(off, good, strict=True)], "status": status})

    return run(matrices)
