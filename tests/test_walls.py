"""Walls of planted rooms, and what only looks like one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.operators import walls as Wa


def scene(spark, parts, tilt=0.0, noise=300, seed=1):
    rng = np.random.default_rng(seed)
    p = np.concatenate([*parts, rng.uniform([-0.5, -0.5, 0], [6.5, 4.5, 2.6], (noise, 3))])
    p += rng.normal(0, 0.004, p.shape)
    c, s = np.cos(tilt), np.sin(tilt)
    turn = np.array([[1, 0, 0], [0, c, -s], [0, s, c]])
    rows = [(i, *x) for i, x in enumerate((p @ turn.T).tolist())] + [(10**6, None, 0.0, 0.0), (10**6 + 1, float("nan"), 0.0, 0.0)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(4), turn


def room(rng):
    floor = rng.random((6000, 3)) * [6, 4, 0]
    table = rng.random((1500, 3)) * [1.2, 0.8, 0] + [2, 1.5, 0.72]
    west, north = rng.random((3000, 3)) * [0, 4, 2.6], rng.random((4000, 3)) * [6, 0, 2.6] + [0, 4, 0]
    return floor, table, west, north


@pytest.mark.parametrize("tilt", [0.0, 0.24])
def test_exactly_the_planted_walls(spark, tilt):
    floor, table, west, north = room(np.random.default_rng(2))
    df, turn = scene(spark, [floor, table, west, north], tilt)
    up = turn @ [0, 0, 1]
    got = Wa.walls(df, "id", tuple(up), 0.03)
    assert [w["id"] for w in got] == ["wall_0", "wall_1"] and got[0]["inliers"] > 3900 and 2900 < got[1]["inliers"] < 3500
    for w, inward, size in zip(got, ([0, -1, 0], [1, 0, 0]), (6, 4), strict=True):
        n, u, v = (np.array(w[c]) for c in ("normal", "u", "v"))
        assert n @ (turn @ inward) > 0.999 and np.allclose(np.cross(u, v), n) and abs(u @ up) < 1e-9  # towards the room, right-handed, u level
        (u0, u1), (v0, v1) = w["bounds"]
        assert u1 - u0 == pytest.approx(0.98 * size, abs=0.15) and v1 - v0 == pytest.approx(0.98 * 2.6, abs=0.1) and w["thickness"] == 0.06


def test_stripes_bands_and_few_points_are_no_walls(spark):
    rng = np.random.default_rng(3)
    floor = rng.random((4000, 3)) * [6, 4, 0]
    pole = rng.random((1500, 3)) * [0.02, 0.02, 2.6] + [1, 1, 0]  # a stripe
    bands = np.concatenate([rng.random((700, 3)) * [5, 0, 0.05] + [0, 3, z] for z in (0.3, 2.4)])  # two bands of one upright plane
    few = rng.random((120, 3)) * [0, 2, 2] + [5, 0, 0]
    df, _ = scene(spark, [floor, pole, bands, few], noise=50)
    assert Wa.walls(df, "id", (0, 0, 1), 0.03) == []
    wide = [w for w in Wa.walls(df, "id", (0, 0, 1), 0.03, least_fill=0.0) if abs(w["normal"][1]) > 0.99]
    assert len(wide) == 1 and wide[0]["inliers"] > 1300  # the bands, once fill isn't asked for


def test_no_walls_without_points(spark):
    df, _ = scene(spark, [np.zeros((0, 3))], noise=2)
    assert Wa.walls(df, "id", (0, 0, 1), 0.03) == [] and Wa.walls(df.limit(0), "id", (0, 0, 1), 0.03) == []


def test_fill_against_numpy(spark):
    rng = np.random.default_rng(4)
    for n in (5, 9, 700, 5000):
        p = rng.normal(0, 1, (n, 2))
        cells = int(np.clip(np.sqrt(n / 6.0), 6, 24))
        want = 0.0 if n < 8 else float((np.histogram2d(p[:, 0], p[:, 1], bins=cells)[0] > 0).mean())
        assert Wa.fill(spark.createDataFrame(p.tolist(), "u double, v double"), F.col("u"), F.col("v")) == pytest.approx(want, abs=1e-9)
    assert Wa.fill(spark.createDataFrame([(float(i), 1.0) for i in range(50)], "u double, v double"), F.col("u"), F.col("v")) == 0.0
