"""Column functions that place things: directions and rotations, camera rows, scales and units, fits and their quality.

Vectors are arrays of 3 doubles, rotations row-major arrays of 9, matrices row-major arrays of 16."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith.functions import geometry as G

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
#: Fixed value: the first spherical harmonic's constant.
SH0 = 0.28209479177387814


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), in which value is computed once however often it is named: without this, expressions double with each step."""
    return F.transform(F.array(value), then)[0]


def xyz(v: Column) -> tuple[Column, Column, Column]:
    return v[0], v[1], v[2]


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Column, b: Column) -> Column:
    return bound(a, lambda u: bound(b, lambda v: F.array(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def length(v: Column) -> Column:
    return bound(v, lambda x: F.sqrt(dot(x, x)))


def unit(v: Column) -> Column:
    """A vector of length 1; null if it has none."""
    return bound(v, lambda x: bound(F.sqrt(dot(x, x)), lambda n: F.when(n > 0, scaled(x, 1 / n))))


def constant(*values: float) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def point_error(p: Column) -> Column:
    """What is wrong with a point: not three numbers, or not finite; null if nothing."""
    return F.when(p.isNull() | (F.size(p) != 3), "not three numbers").when(~F.forall(p, lambda x: G.finite(x)), "not finite")


def measured(a: Column, b: Column, scale: Column, least: float = 1e-9) -> Column:
    """struct(distance, units, error): metres if scale is finite and positive, else scene units; an error for bad or equal points."""
    bad = F.coalesce(point_error(a), point_error(b))
    length = F.sqrt(F.pow(a[0] - b[0], F.lit(2)) + F.pow(a[1] - b[1], F.lit(2)) + F.pow(a[2] - b[2], F.lit(2)))
    known = G.finite(scale) & (scale > 0)
    error = F.when(bad.isNotNull(), bad).when(length <= least, "the points are the same")
    return F.struct(F.when(error.isNull(), length * F.when(known, scale).otherwise(1.0)).alias("distance"), F.when(known, "m").otherwise("scene units").alias("units"), error.alias("error"))


def length_text(value: Column, scale: Column) -> Column:
    """A length in prose: metres with an anchored scale, else marked as relative."""
    known = G.finite(scale) & (scale > 0)
    return F.when(value.isNull(), F.lit(None).cast("string")).when(known, F.format_string("%.2f m", value * scale)).otherwise(F.format_string("%.2f units (relative, uncalibrated)", value))


def placement_facts(gap: Column, height: Column, wall: Column, ceiling: Column, band: float) -> Column:
    """Where a thing stands: on or off the floor, against a wall, up to the ceiling, and how tall it is."""
    near = 2.0 * band
    facts = F.array(
        F.when(gap <= near, "on the floor").otherwise(F.format_string("off the floor — bottom %.2f above it", gap)),
        F.when(wall <= near, "against a wall"), F.when(ceiling <= near, "reaches the ceiling"), F.format_string("%.2f tall", height),
    )
    return F.filter(facts, lambda x: x.isNotNull())


def quality_tier(label: Column) -> Column:
    """good, usable, or else low."""
    folded = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(folded.isin("good", "usable"), folded).otherwise("low")


def camera_rotation(forward: Column, up: Column) -> Column:
    """Camera to world, columns right, down, forward; null if forward runs along up."""

    def columns(f: Column, right: Column) -> Column:
        return bound(unit(cross(f, right)), lambda down: F.array(*[c for i in range(3) for c in (right[i], down[i], f[i])]))

    return bound(unit(forward), lambda f: bound(unit(cross(f, up)), lambda right: F.when(right.isNotNull(), columns(f, right))))


def look_at(position: Column, target: Column, up: Column) -> Column:
    """struct(x, y, z, w) of a camera at position that looks at target down its -Z, with +Y up.

    At the target itself it looks down; along up, a roll is chosen."""
    ahead = F.zip_with(target, position, lambda t, p: t - p)

    def facing(f: Column, u: Column) -> Column:
        side, other = cross(f, u), cross(f, constant(0, 0, 1))
        right = unit(F.when(length(side) >= 1e-9**0.5, side).when(length(other) >= 1e-9**0.5, other).otherwise(constant(1, 0, 0)))
        return bound(right, lambda r: bound(unit(cross(r, f)), lambda t: F.array(*[c for i in range(3) for c in (r[i], t[i], -f[i])])))

    turned = bound(unit(up), lambda u: bound(F.when(length(ahead) < 1e-6, scaled(u, F.lit(-1.0))).otherwise(unit(ahead)), lambda f: facing(f, u)))
    return bound(turned, lambda m: G.quaternion_of([m[i] for i in range(9)]))


def opencv_pose(rotation: Column) -> Column:
    """A rotation of a camera that looks down -Z with +Y up, as one that looks down +Z with +Y down."""
    return F.array(*[rotation[3 * i + k] * (1.0 if k == 0 else -1.0) for i in range(3) for k in range(3)])


def intrinsics(width: Column, height: Column, vertical_fov: Column) -> Column:
    """[fx, fy, cx, cy] of square pixels and a centred axis, from the vertical field of view in degrees; null beyond (0, 180)."""
    f = height / 2.0 / F.tan(F.radians(vertical_fov) / 2)
    return F.when((vertical_fov > 0) & (vertical_fov < 180), F.array(f, f, width / 2.0, height / 2.0))


def rescaled_intrinsics(k: Column, from_size: Column, to_size: Column) -> Column:
    """[fx, fy, cx, cy] after an image is resized from [width, height] to another."""
    sx, sy = to_size[0] / from_size[0], to_size[1] / from_size[1]
    return F.array(k[0] * sx, k[1] * sy, k[2] * sx, k[3] * sy)


def shortest_arc(a: Column, b: Column) -> Column:
    """The rotation of least angle that turns a's direction into b's; opposite directions turn about an axis square to a."""

    def plain(w: Column, k: Column) -> Column:
        return F.array(
            1 - k * (w[1] * w[1] + w[2] * w[2]), k * w[0] * w[1] - w[2], k * w[0] * w[2] + w[1],
            k * w[0] * w[1] + w[2], 1 - k * (w[0] * w[0] + w[2] * w[2]), k * w[1] * w[2] - w[0],
            k * w[0] * w[2] - w[1], k * w[1] * w[2] + w[0], 1 - k * (w[0] * w[0] + w[1] * w[1]),
        )

    def half(u: Column) -> Column:
        first, second = cross(u, constant(1, 0, 0)), cross(u, constant(0, 1, 0))
        axis = unit(F.when(length(first) >= 1e-6, first).otherwise(second))
        return bound(axis, lambda n: F.array(*[2 * n[i] * n[j] - (1.0 if i == j else 0.0) for i in range(3) for j in range(3)]))

    def turn(u: Column, v: Column) -> Column:
        return bound(dot(u, v), lambda c: F.when(c > 1 - 1e-8, constant(*IDENTITY)).when(c < -1 + 1e-8, half(u)).otherwise(bound(cross(u, v), lambda w: bound(1 / (1 + c), lambda k: plain(w, k)))))

    return bound(unit(a), lambda u: bound(unit(b), lambda v: turn(u, v)))


def metric_scale(given: Column, ref_extent: Column, ref_meters: Column, ref_name: Column) -> Column:
    """struct(scale, source, metric): a given factor, else a reference object's known size, else 1 and not metric."""
    ref = G.finite(ref_extent, ref_meters) & (ref_extent > 1e-9) & (ref_meters > 0)
    tag = F.concat(F.lit("user:ref_object"), F.coalesce(F.concat(F.lit(":"), F.nullif(ref_name, F.lit(""))), F.lit("")))
    return F.struct(
        F.when(given > 0, given).when(ref, ref_meters / ref_extent).otherwise(1.0).alias("scale"),
        F.when(given > 0, "user:factor").when(ref, tag).otherwise("none").alias("source"), F.coalesce((given > 0) | ref, F.lit(False)).alias("metric"),
    )


def export_scale(user: Column, anchor: Column, pointer: Column) -> Column:
    """struct(scale, source, refused): the user's factor, an explicit anchor, the scene's pointer, or a refusal."""
    ok = [G.finite(c) & (c > 0) for c in (user, anchor, pointer)]
    pick = lambda a, b, c, d: F.when(ok[0], a).when(ok[1], b).when(ok[2], c).otherwise(d)
    return F.struct(pick(user, anchor, pointer, F.lit(None).cast("double")).alias("scale"), pick(F.lit("user"), F.lit("anchor"), F.lit("pointer"), F.lit(None).cast("string")).alias("source"), (~(ok[0] | ok[1] | ok[2])).alias("refused"))


#: Metres that stand for a median capture height and a vertical extent where no scale is known.
NOMINAL_HEIGHT, NOMINAL_EXTENT = 1.5, 2.6


def report_units(anchor: Column, anchor_key: Column, capture_height: Column, extent: Column) -> Column:
    """struct(units, basis, report_per_unit): an anchor's metres, else fractions of the capture height, else of the vertical extent."""
    a, h = F.coalesce(anchor > 0, F.lit(False)), F.coalesce(capture_height > 0, F.lit(False))
    return F.struct(
        F.when(a, "m").otherwise("relative").alias("units"),
        F.when(a, F.concat(F.lit("anchor:"), F.coalesce(anchor_key, F.lit("derived_latest")))).when(h, "capture_height_fraction").otherwise("extent_fraction").alias("basis"),
        F.when(a, anchor).when(h, 1 / capture_height).otherwise(1 / F.greatest(extent, F.lit(1e-9))).alias("report_per_unit"),
    )


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays over places where both are finite; null below two places or without variance."""
    names = ["n", "x", "y", "xx", "yy", "xy"]
    start = F.struct(*[F.lit(0.0).alias(c) for c in names])

    def add(acc: Column, s: Column) -> Column:
        x, y = s["x"], s["y"]
        more = dict(zip(names, (F.lit(1.0), x, y, x * x, y * y, x * y), strict=True))
        return F.when(G.finite(x, y), F.struct(*[(acc[c] + more[c]).alias(c) for c in names])).otherwise(acc)

    def finish(t: Column) -> Column:
        sxx, syy = t["xx"] - t["x"] * t["x"] / t["n"], t["yy"] - t["y"] * t["y"] / t["n"]
        return F.when((t["n"] >= 2) & (sxx > 0) & (syy > 0), (t["xy"] - t["x"] * t["y"] / t["n"]) / F.sqrt(sxx * syy))

    return F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), start, add, finish)


def determinant4(m: Column) -> Column:
    """Of a 4x4 matrix, by pairs of 2x2 minors of its upper and lower rows."""
    upper = {(i, j): m[i] * m[4 + j] - m[j] * m[4 + i] for i in range(4) for j in range(i + 1, 4)}
    lower = {(i, j): m[8 + i] * m[12 + j] - m[8 + j] * m[12 + i] for i in range(4) for j in range(i + 1, 4)}
    terms = [((0, 1), (2, 3), 1), ((0, 2), (1, 3), -1), ((0, 3), (1, 2), 1), ((1, 2), (0, 3), 1), ((1, 3), (0, 2), -1), ((2, 3), (0, 1), 1)]
    return sum((upper[a] * lower[b] * s for a, b, s in terms[1:]), upper[terms[0][0]] * lower[terms[0][1]])


def unit_determinant(m: Column, least: float = 1e-12) -> Column:
    """struct(matrix, error): a homography scaled to determinant 1; an error if it is not finite, singular or turns space inside out."""
    largest = F.array_max(F.transform(m, lambda x: F.abs(x)))
    fine = F.forall(m, lambda x: G.finite(x)) & (largest > 0)

    def judged(shrunk: Column, det: Column) -> Column:
        error = F.when(~F.coalesce(fine, F.lit(False)), "zero or not finite").when(det < 0, "negative determinant").when(F.abs(det) < least, "singular")
        return bound(error, lambda e: F.struct(F.when(e.isNull(), F.transform(shrunk, lambda x: x / F.pow(det, F.lit(0.25)))).alias("matrix"), e.alias("error")))

    return bound(bound(largest, lambda top: F.transform(m, lambda x: x / top)), lambda shrunk: bound(determinant4(shrunk), lambda det: judged(shrunk, det)))


def rgb_of_sh(c: Column) -> Column:
    return 0.5 + SH0 * c


def sh_of_rgb(c: Column) -> Column:
    return (c - 0.5) / SH0


def logit(p: Column, least: float = 1e-6) -> Column:
    """Of a probability, which is kept away from 0 and 1 by least."""
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return F.ln(q / (1 - q))


def spacing(diagonal: Column, n: Column) -> Column:
    """The distance between neighbours if n points filled a cube of that diagonal evenly."""
    return diagonal / F.cbrt(F.greatest(n.cast("double"), F.lit(1.0)))


def _by_extent(extent: Column) -> Column:
    """Axis numbers, the longest first; ties to the smaller axis."""
    ranked = F.array_sort(F.array(*[F.struct((-extent[i]).alias("e"), F.lit(i).alias("i")) for i in range(3)]))
    return F.transform(ranked, lambda s: s["i"])


def asset_fit(low: Column, high: Column, center: Column, extent: Column, rotation: Column, up: Column) -> Column:
    """struct(scale, rotation, translation, fitted) that puts an asset's box [low, high] into an oriented box.

    Axes are matched longest to longest, the frame is kept right-handed, and one scale serves all axes: the
    smallest matched ratio. With an up direction the bottoms meet; without one (null) the centres do."""
    e_t = F.transform(extent, lambda x: F.greatest(x, F.lit(1e-9)))
    e_a = F.zip_with(high, low, lambda h, l: F.greatest(h - l, F.lit(1e-9)))

    def along(m: Column, size: Column, u: Column) -> Column:
        """Half the extent of a box of that size and rotation along a direction."""
        return sum((F.abs(m[k] * u[0] + m[3 + k] * u[1] + m[6 + k] * u[2]) * size[k] / 2 for k in (1, 2)), F.abs(m[0] * u[0] + m[3] * u[1] + m[6] * u[2]) * size[0] / 2)

    def mapped(t: Column, a: Column) -> Column:
        # column k of the map is the box axis whose rank equals that of the asset's axis k
        axis = [F.element_at(t, F.array_position(a, F.lit(k)).cast("int")) for k in range(3)]
        m = F.array(*[F.element_at(rotation, (axis[k] + 3 * i + 1).cast("int")) for i in range(3) for k in range(3)])
        return bound(m, lambda m: bound(F.when(G.determinant([m[i] for i in range(9)]) < 0, -1.0).otherwise(1.0), lambda turn: F.transform(m, lambda c, i: F.when(i % 3 == 2, c * turn).otherwise(c))))

    def placed(et: Column, ea: Column, m: Column, scale: Column) -> Column:
        fitted = F.transform(ea, lambda x: x * scale)
        middle = F.zip_with(low, high, lambda l, h: (l + h) / 2)
        at = bound(middle, lambda c: F.array(*[center[i] - scale * (m[3 * i] * c[0] + m[3 * i + 1] * c[1] + m[3 * i + 2] * c[2]) for i in range(3)]))
        snapped = bound(unit(up), lambda u: F.when(u.isNotNull(), bound(along(rotation, et, u) - bound(fitted, lambda f: along(m, f, u)), lambda drop: F.zip_with(at, u, lambda x, y: x - y * drop))).otherwise(at))
        return F.struct(scale.alias("scale"), m.alias("rotation"), snapped.alias("translation"), fitted.alias("fitted"))

    def fit(et: Column, ea: Column, t: Column, a: Column) -> Column:
        ratios = F.zip_with(F.transform(t, lambda i: F.element_at(et, i + 1)), F.transform(a, lambda i: F.element_at(ea, i + 1)), lambda x, y: x / y)
        return bound(mapped(t, a), lambda m: bound(F.array_min(ratios), lambda scale: placed(et, ea, m, scale)))

    return bound(e_t, lambda et: bound(e_a, lambda ea: bound(_by_extent(et), lambda t: bound(_by_extent(ea), lambda a: fit(et, ea, t, a)))))


def fit_tier(offset_share: Column, volume_ratio: Column) -> Column:
    """good if the centroid is within 20 % of the diagonal and the volumes' ratio within [0.2, 3]; usable if one holds; else low."""
    near, alike = (offset_share <= 0.2).cast("int"), volume_ratio.between(0.2, 3.0).cast("int")
    return F.when(near + alike == 2, "good").when(near + alike == 1, "usable").otherwise("low")


def rigid(m: Column) -> Column:
    """error of a pose's rotation (row-major 9): not finite, or a determinant that isn't positive; null if it can be made proper."""
    parts = [m[i] for i in range(9)]
    return F.when(~G.finite(*parts), "not finite").when(G.determinant(parts) <= 0, "improper")


def up_direction(override: Column, gravity: Column, extents: Column) -> Column:
    """struct(up, source): a given direction, else gravity's opposite, else y or z, whichever the scene spans less (ties: y)."""
    return F.struct(
        F.coalesce(unit(override), unit(scaled(gravity, F.lit(-1.0))), F.when(extents[1] <= extents[2], constant(0, 1, 0)).otherwise(constant(0, 0, 1))).alias("up"),
        F.when(unit(override).isNotNull(), "override").when(unit(gravity).isNotNull(), "pose_gravity").otherwise("extent").alias("source"),
    )


TURN = 2 * math.pi
