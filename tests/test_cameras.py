"""Cameras taken apart, nearest rotations, stitched clouds and bounded results."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from cartolith.functions import cameras
from cartolith.functions.text import presented, presented_results
from cartolith.operators import tables


def rotation(rng):
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    return q * np.sign(np.linalg.det(q))


def test_cameras_come_back(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for i in range(60):
        k = np.array([[rng.uniform(200, 900), rng.normal(0, 5), 320], [0, rng.uniform(200, 900), 240], [0, 0, 1]])
        r, t, factor = rotation(rng), rng.normal(0, 3, 3), rng.choice([-1, 1]) * rng.uniform(0.01, 50)
        p = factor * k @ np.hstack([r, t[:, None]])
        if i % 2:
            p = np.vstack([p, [0, 0, 0, 1]]) * rng.choice([-2.0, 0.5])
            factor = factor if p[3, 3] > 0 else factor
        rows.append((i, p.ravel().tolist()))
        want[i] = (k, r, t, abs(factor))
    df = spark.createDataFrame(rows, "i int, m array<double>")
    for r in df.select("i", cameras.camera_parts(F.col("m")).alias("w"), cameras.camera_parts(F.col("m"), to_world=False).alias("c")).collect():
        k, turn, t, scale = want[r.i]
        assert r.w.status is None and np.allclose(np.array(r.c.k).reshape(3, 3), k, atol=1e-8) and np.allclose(np.array(r.c.r).reshape(3, 3), turn, atol=1e-9) and np.allclose(r.c.t, t, atol=1e-8)
        assert np.isclose(r.c.scale, scale) and np.allclose(np.array(r.w.r).reshape(3, 3), turn.T, atol=1e-9) and np.allclose(r.w.t, -turn.T @ t, atol=1e-8)


def test_cameras_that_are_refused(spark):
    good = np.hstack([np.eye(3), np.ones((3, 1))])
    far = np.vstack([good, [0, 0, 1, 1e-14]])
    flat = np.array([[1.0, 2, 3, 4], [2, 4, 6, 8], [0, 0, 1, 0]])
    rows = [(0, good.ravel().tolist()), (1, None), (2, [1.0] * 11), (3, [float("nan")] * 12), (4, far.ravel().tolist()), (5, flat.ravel().tolist()), (6, [None] * 16), (7, [0.0] * 12), (8, [])]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, m array<double>").select("i", cameras.camera_parts(F.col("m")).alias("p")).collect()}
    assert [got[i].status for i in range(9)] == [None, "shape", "shape", "not finite", "at infinity", "singular", "not finite", "singular", "shape"]
    assert got[0].k == [1, 0, 0, 0, 1, 0, 0, 0, 1] and got[0].t == [-1, -1, -1] and all(got[i].k is None and got[i].scale is None for i in range(1, 9))


def test_nearest_rotations(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rotation(rng) + rng.normal(0, 0.2, (3, 3))).ravel().tolist()) for i in range(40)] + [(40, (-np.eye(3)).ravel().tolist())]
    odd = [(100, None), (101, [1.0] * 8), (102, [float("inf")] * 9), (103, [None] * 9), (104, [0.0] * 9), (105, [1.0] + [0.0] * 8)]
    got = {r.i: r.n for r in spark.createDataFrame(rows + odd, "i int, m array<double>").repartition(3).select("i", cameras.nearest_rotation(F.col("m")).alias("n")).collect()}
    for i, m in rows:
        r, m = np.array(got[i].r).reshape(3, 3), np.array(m).reshape(3, 3)
        assert got[i].status is None and np.allclose(r @ r.T, np.eye(3), atol=1e-12) and np.isclose(np.linalg.det(r), 1) and np.isclose(got[i].off, np.linalg.norm(m - r))
        for _ in range(30):  # no other rotation nearby is nearer
            turn = np.linalg.qr(np.eye(3) + rng.normal(0, 0.05, (3, 3)))[0]
            turn *= np.sign(np.diag(turn))
            other = r @ turn
            assert np.linalg.det(other) < 0 or np.linalg.norm(m - other) >= got[i].off - 1e-9
    assert [got[i].status for i in range(100, 106)] == ["shape", "shape", "not finite", "not finite", "singular", "singular"] and got[104].r is None and got[104].off is None


def test_stitched_against_a_loop(spark):
    rng = random.Random(3)
    loops = {(s, m): rng.random() < 0.3 for s in range(3) for m in range(6)}
    rows = [(s, m, rng.choice([2, 3, 5, 7]), loops[s, m] if rng.random() < 0.9 or loops[s, m] else None, i) for i in range(400) for s, m in [(rng.randrange(3), rng.randrange(6))]]
    for overlap in (0, 1, 2):
        got = {r.i for r in tables.stitched(spark.createDataFrame(rows, "scan int, submap int, frame int, loop boolean, i int"), "scan", "submap", "frame", "loop", overlap).collect()}
        want = set()
        regular = [r for r in rows if not r[3]]
        for s, m, f, _, i in regular:
            first = min(x[1] for x in regular if x[0] == s)
            frames = sorted({x[2] for x in regular if x[:2] == (s, m)})
            if m == first or frames.index(f) >= overlap:
                want.add(i)
        assert got == want


def test_presented_results(spark):
    rng = random.Random(4)
    for budget in (60, 300, 1000, 12_000):
        for _ in range(40):
            result = {"scene": "s" * rng.randrange(20), "objects": [{"id": i, "name": "é" * rng.randrange(30)} for i in range(rng.randrange(60))], "ids": list(range(rng.randrange(40)))}
            text = presented(result, budget)
            back = json.loads(text)
            if "error" in back:
                assert len(json.dumps(result)) > budget
                smallest = {**result, max(("objects", "ids"), key=lambda k: len(result[k])): []}
                assert len(json.dumps(smallest)) + 260 > budget
                continue
            assert len(text) <= budget
            if "_truncated" in back:
                cut = back["_truncated"]
                assert cut["total"] == len(result[cut["field"]]) == max(len(result["objects"]), len(result["ids"])) and cut["shown"] == len(back[cut["field"]]) < cut["total"]
                assert back[cut["field"]] == result[cut["field"]][: cut["shown"]]
            else:
                assert back == result
    texts = [json.dumps({"a": list(range(100))}), "[1, 2]", "not json", None, "x" * 200, json.dumps([0] * 100)]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(presented_results(F.col("t"), 180).alias("p")).collect()]
    assert json.loads(got[0]).keys() == {"a", "_truncated"} and got[1:4] == ["[1, 2]", "not json", None] and all("result_too_large" in x for x in got[4:])
