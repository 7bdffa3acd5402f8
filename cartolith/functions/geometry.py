"""Geometry on columns: points are three scalar columns (or an array at the edges), rotations row-major arrays of 9."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def norm(*cols: Column) -> Column:
    return F.sqrt(sum((c * c for c in cols[1:]), cols[0] * cols[0]))


def distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return norm(*(x - y for x, y in zip(a, b, strict=True)))


def angle(a: tuple[Column, ...], at: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The angle at a vertex in degrees; null where a side has no length."""
    u, v = [x - y for x, y in zip(a, at, strict=True)], [x - y for x, y in zip(b, at, strict=True)]
    dot = u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    cosine = F.try_divide(dot, norm(*u) * norm(*v))
    # greatest and least pass over nulls
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def wrapped(a: Column) -> Column:
    """An angle in (-pi, pi]."""
    turn = 2 * math.pi
    low = F.pmod(a + math.pi, F.lit(turn)) - math.pi
    return F.when(low == -math.pi, F.lit(math.pi)).otherwise(low)


def wrapped_number(turn: float) -> float:
    """As wrapped(), of a number."""
    out = (turn + math.pi) % (2 * math.pi) - math.pi
    return math.pi if out == -math.pi else out


def in_box(p: tuple[Column, Column, Column], center: list[float], extent: list[float], rotation: list[float] | None = None, margin: float = 0.0) -> Column:
    """Whether a point lies in an oriented box; extents are full lengths, rotation's columns are the axes."""
    d = [c - F.lit(float(o)) for c, o in zip(p, center, strict=True)]
    r = rotation or [1, 0, 0, 0, 1, 0, 0, 0, 1]
    inside = F.lit(True)
    for k in range(3):
        along = sum((d[i] * float(r[3 * i + k]) for i in range(1, 3)), d[0] * float(r[k]))
        inside = inside & (F.abs(along) <= max(extent[k] * (1 + margin) / 2, 1e-9))
    return inside


def transformed(p: tuple[Column, Column, Column], m: list[Column] | list[float], homography: bool = False) -> list[Column]:
    """A point under a row-major 4x4 matrix; a homography also divides by the fourth coordinate."""
    out = [sum((p[j] * m[4 * i + j] for j in range(1, 3)), p[0] * m[4 * i]) + m[4 * i + 3] for i in range(4 if homography else 3)]
    return [c / out[3] for c in out[:3]] if homography else out


def matrix_of(qx: Column, qy: Column, qz: Column, qw: Column) -> list[Column]:
    """The row-major rotation of a quaternion, which is normalised first."""
    n = F.sqrt(qx * qx + qy * qy + qz * qz + qw * qw)
    x, y, z, w = qx / n, qy / n, qz / n, qw / n
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def quaternion_of(m: list[Column]) -> Column:
    """struct(x, y, z, w) of a row-major rotation, by the largest of trace and diagonal; w is not negative in the first branch."""
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m

    def made(x: Column, y: Column, z: Column, w: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))

    trace = m00 + m11 + m22
    s = F.sqrt(F.greatest(trace + 1, F.lit(0.0))) * 2
    a = F.sqrt(F.greatest(1 + m00 - m11 - m22, F.lit(0.0))) * 2
    b = F.sqrt(F.greatest(1 + m11 - m00 - m22, F.lit(0.0))) * 2
    c = F.sqrt(F.greatest(1 + m22 - m00 - m11, F.lit(0.0))) * 2
    return (
        F.when(trace > 0, made((m21 - m12) / s, (m02 - m20) / s, (m10 - m01) / s, s / 4))
        .when((m00 > m11) & (m00 > m22), made(a / 4, (m01 + m10) / a, (m02 + m20) / a, (m21 - m12) / a))
        .when(m11 > m22, made((m01 + m10) / b, b / 4, (m12 + m21) / b, (m02 - m20) / b))
        .otherwise(made((m02 + m20) / c, (m12 + m21) / c, c / 4, (m10 - m01) / c))
    )


def determinant(m: list[Column]) -> Column:
    a, b, c, d, e, f, g, h, i = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def projected(p: tuple[Column, Column, Column], fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """Pixel u, v and depth of a camera-space point; null where it isn't in front."""
    depth = F.when(p[2] > 1e-9, p[2])
    return fx * p[0] / depth + cx, fy * p[1] / depth + cy, depth


def unprojected(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> list[Column]:
    return [(u - cx) * depth / fx, (v - cy) * depth / fy, depth]


def focal_length(height: int, vertical_fov: Column) -> Column:
    """Pixels, from the vertical field of view in degrees."""
    return F.lit(height / 2.0) / F.tan(F.radians(vertical_fov) / 2)


def corners(center: Column, extent: Column) -> Column:
    """The 8 corners of an axis-aligned box, bit k of the number telling the side along axis k."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.array(*[center[k] + extent[k] / 2 * F.when(F.shiftright(i, k).bitwiseAND(1) == 1, 1.0).otherwise(-1.0) for k in range(3)]),
    )


def plane_height(p: tuple[Column, Column, Column], point: list[float], normal: list[float]) -> Column:
    return sum(((p[k] - point[k]) * normal[k] for k in (1, 2)), (p[0] - point[0]) * normal[0])


def clipped_box(box: Column, width: Column, height: Column) -> Column:
    """A 2D box [x0, y0, x1, y1] cut to the image; null if it isn't four numbers or nothing is left."""
    x0, y0 = F.greatest(box[0], F.lit(0.0)), F.greatest(box[1], F.lit(0.0))
    x1, y1 = F.least(box[2], width), F.least(box[3], height)
    return F.when((F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull()) & (x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y1))


def metric_state(kind: Column, scale: Column, source: Column) -> Column:
    """struct(units, scale, scale_source, metric_state): metres only with an anchor of finite positive scale and a source."""
    ok = F.coalesce((kind == "anchor") & finite(scale) & (scale > 0) & (F.length(F.trim(source)) > 0), F.lit(False))
    return F.struct(
        F.when(ok, "m").otherwise("scene units").alias("units"),
        F.when(ok, scale).otherwise(1.0).alias("scale"),
        F.when(ok, source).alias("scale_source"),
        F.when(ok, "metric").otherwise("up_to_scale").alias("metric_state"),
    )


def anchor_scale(known: Column, measured: Column, least: float = 1e-9) -> Column:
    """known / measured; null where either is not finite, not positive or tiny."""
    return F.when(finite(known, measured) & (known > 0) & (measured > least), known / measured)


def splat_importance(opacity: Column, scales: tuple[Column, Column, Column]) -> Column:
    """Opacity (a logit) as a share, times the mean log scale's area."""
    return 1 / (1 + F.exp(-opacity)) * F.exp(2 * (scales[0] + scales[1] + scales[2]) / 3)


def scaled_splat(scale: float) -> dict[str, Column]:
    """Splat columns under a uniform scale: positions are multiplied, log scales get its logarithm added."""
    return {c: F.col(c) * scale for c in ("x", "y", "z")} | {c: F.col(c) + math.log(scale) for c in ("scale_0", "scale_1", "scale_2")}


def voxel(c: Column, origin: float, side: float, bits: int = 21) -> Column:
    return F.least(F.greatest(F.floor((c - origin) / side), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def voxel_key(p: tuple[Column, Column, Column], origin: tuple[float, float, float], side: float) -> Column:
    """Three cell numbers of 21 bits each in one long."""
    x, y, z = (voxel(c, o, side) for c, o in zip(p, origin, strict=True))
    return F.shiftleft(x, 42).bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(z)


def geometric_mean(signals: Column, least: float = 1e-6) -> Column:
    """Of the non-null entries, each at least `least`; 1 if there are none."""
    known = F.filter(signals, lambda x: x.isNotNull())
    logs = F.aggregate(F.transform(known, lambda x: F.ln(F.greatest(x, F.lit(least)))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, F.exp(logs / F.size(known))).otherwise(1.0)


def covariance_factor(quality: Column, most: float = 100.0) -> Column:
    return F.least(F.greatest(F.pow(F.lit(100.0), 1 - quality), F.lit(1.0)), F.lit(most))


def minutes_billed(seconds: Column, price: int = 25) -> Column:
    """Started minutes times the price of one."""
    return (F.ceil(seconds / 60) * price).cast("long")
