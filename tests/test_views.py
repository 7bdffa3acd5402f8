"""Ground frames, alignment and missions on planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.operators import views as V


def room(spark, tilt):
    """A floor of 6 x 4, a ceiling 2.6 above it, and a table; turned about x by tilt."""
    rng = np.random.default_rng(1)
    floor = np.column_stack([rng.random((900, 2)) * [6, 4], rng.normal(0, 0.003, 900)])
    top = np.column_stack([rng.random((900, 2)) * [6, 4], 2.6 + rng.normal(0, 0.003, 900)])
    table = np.column_stack([1 + rng.random((100, 2)), np.full(100, 0.72)])
    c, s = np.cos(tilt), np.sin(tilt)
    p = np.concatenate([floor, top, table]) @ np.array([[1, 0, 0], [0, c, -s], [0, s, c]]).T
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double"), np.array([0, -s, c])


def test_ground_frame_of_a_tilted_room(spark):
    points, up = room(spark, 0.24)
    got = V.ground_frame(points, "id", (0.0, 0.0, 1.0), 0.03)
    assert got["known"] and got["note"] is None and np.allclose(got["up_axis"], up, atol=0.01)
    assert got["floor_height"] == pytest.approx(0, abs=0.02) and got["ceiling_height"] == pytest.approx(2.6, abs=0.06) and got["inliers"] >= 850
    open_air = V.ground_frame(points.filter("id < 900"), "id", (0.0, 0.0, 1.0), 0.03)
    assert open_air["ceiling_height"] is None and open_air["note"] == "no ceiling"
    assert not V.ground_frame(points.limit(5), "id", (0.0, 0.0, 1.0), 0.03)["known"]
    m = V.alignment(points, tuple(up), 2.0, F.col("id") < 900)
    p = np.array([[r.x, r.y, r.z, 1.0] for r in points.orderBy("id").collect()]) @ m.T
    assert abs(np.median(p[:900, 2])) < 1e-9 and np.allclose(p[:, :2].mean(axis=0), 0) and p[900:1800, 2].mean() == pytest.approx(5.2, abs=0.02)


def test_gravity_of_poses(spark):
    level = [float(x) for x in (1, 0, 0, 0, 0, 0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1)]
    got = V.gravity(spark.createDataFrame([(level,), (level,)], "pose array<double>")).first()
    assert (got.gx, got.gy, got.gz, got.note) == (0.0, 0.0, -1.0, None)
    back = [-x for x in level]
    assert V.gravity(spark.createDataFrame([(level,), (back,)], "pose array<double>")).first().gx is None


def test_missions(spark):
    wants = ["a", "b", "c", "d"]
    finds = {"all": [["a"], ["b", "x"], ["c", "d"], []], "half": [["a", "b"], [], [], ["x"], []], "lost": [[], [], [], [], [], ["a"], []], "known": [["a"], ["a"], ["a"], ["a"], ["a"]]}
    df = spark.createDataFrame([(m, i, wants, f) for m, fs in finds.items() for i, f in enumerate(fs)], "mission string, round long, wanted array<string>, found array<string>")
    got = {}
    for r in V.mission_states(df).orderBy("mission", "round").collect():
        got.setdefault(r.mission, []).append((r.known, r.stalled, r.status))
    assert got["all"] == [(1, 0, "active"), (2, 0, "active"), (4, 0, "completed"), (4, 0, "completed")]
    assert got["half"] == [(2, 0, "active"), (2, 1, "active"), (2, 2, "active"), (2, 3, "completed"), (2, 3, "completed")]
    assert got["lost"][4] == (0, 5, "recovering") and got["lost"][5] == (1, 0, "active") and got["lost"][6] == (1, 1, "active")
    assert [s for *_, s in got["known"]] == ["active"] * 5 and got["known"][-1][1] == 0
