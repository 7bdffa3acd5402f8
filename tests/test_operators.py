import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.operators import aggregates as A
from cartolith.operators import joins as J
from cartolith.operators import ledger as L
from cartolith.operators import spatial as S
from cartolith.operators import tables as T
from cartolith.operators import windows as Wn
from cartolith.operators.components import connected_components

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def events(spark, offsets, user=1):
    return spark.createDataFrame([(i, user, at(s), "click") for i, s in enumerate(offsets)], "event_id long, user_id long, ts timestamp, event_type string")


def test_visits_gap_is_exclusive(spark):
    rows = Wn.visits(events(spark, [0, 1799, 1799 + 1800, 1799 + 1800 + 1801])).orderBy("event_id").collect()
    assert [r.visit for r in rows] == [1, 1, 2, 3]


def test_known_visits(spark):
    r = Wn.visit_summary(events(spark, [0, 60, 1920, 87000, 87000])).first()
    assert (r.requests, r.visits, r.returned_at) == (5, 3, at(87000))


def test_thin_against_a_loop(spark):
    rng = random.Random(3)
    want, rows = [], []
    for user in range(5):
        ts, last = sorted(rng.uniform(0, 200) for _ in range(150)), None
        for s in ts:
            s = round(s, 3)
            rows.append((len(rows), user, at(s), "x"))
            if last is None or s - last >= 2.0 - 1e-4:
                want.append((user, at(s)))
                last = s
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string")
    got = {(r.user_id, r.ts) for r in Wn.thin(df, "user_id", "ts", 2.0).collect()}
    assert got == set(want)


@pytest.mark.parametrize("tie,match", [("left", 0), ("right", 1)])
def test_nearest_time(spark, tie, match):
    q = events(spark, [1.0, 2.0, 9.0])
    t = spark.createDataFrame([(i, 1, at(s), "p") for i, s in enumerate([0.99, 1.01, 2.03, 5.0])], q.schema)
    rows = J.nearest_time(q, t, "user_id", "ts", 0.02, tie).orderBy("event_id").collect()
    assert [r.match and r.match.event_id for r in rows] == [match, None, None]
    empty = J.nearest_time(q, t.filter("false"), "user_id", "ts", 1.0).collect()
    assert all(r.match is None and r.gap_s is None for r in empty)


def test_interpolation_is_clamped(spark):
    q = events(spark, [-5, 1, 30])
    t = spark.createDataFrame([(1, at(0), 10.0), (1, at(4), 20.0)], "user_id long, ts timestamp, value double")
    assert [r.interpolated for r in J.interpolated(q, t, "user_id", "ts", "value").orderBy("event_id").collect()] == [10.0, 12.5, 20.0]


def circle(spark, n=300, decay=1.0):
    rows, angle = [], 0.0
    for i in range(n):
        rows.append(("a", i * 0.2, 5 * math.cos(angle), 5 * math.sin(angle), 0.0))
        angle += 2 * math.pi / n * decay ** (i / n)
    return spark.createDataFrame(rows, "traj string, ts double, tx double, ty double, tz double")


def test_trajectory_quality(spark):
    good = Wn.trajectory_quality(circle(spark), "traj").first()
    assert good.level == "high_confidence" and good.reasons == []
    drift = Wn.trajectory_quality(circle(spark, decay=1 / 30), "traj").first()
    assert drift.level == "out_of_class" and drift.reasons == ["step trend"]
    short = Wn.trajectory_quality(circle(spark, 20), "traj").first()
    assert short.level == "out_of_class" and short.reasons == ["too few poses"]


def test_consistency_recovers_a_similarity(spark):
    rows = []
    for i in range(60):
        p = np.array([math.cos(i / 5), math.sin(i / 5), i / 20])
        c, s = math.cos(0.7), math.sin(0.7)
        q = 0.5 * np.array([c * p[0] - s * p[1], s * p[0] + c * p[1], p[2]]) + [1.5, -0.5, 0.25]
        rows.append((i, *map(float, q), *map(float, p)))
    df = spark.createDataFrame(rows, "i int, ax double, ay double, az double, bx double, by double, bz double")
    out = A.consistency(df, ("ax", "ay", "az"), ("bx", "by", "bz"), ["i"])
    assert out["scale"] == pytest.approx(2.0) and out["rmse"] == pytest.approx(0, abs=1e-9) and out["windowed_scale_cv"] == pytest.approx(0, abs=1e-9)


def test_chunks_hold_something_new(spark):
    rows = Wn.chunks(events(spark, range(19)), "user_id", ["event_id"], 8, 1)
    got = {k: [r.position for r in g] for k, g in itertools.groupby(rows.orderBy("chunk", "position").collect(), key=lambda r: r.chunk)}
    assert got == {0: list(range(9)), 1: list(range(8, 17)), 2: [16, 17, 18]}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fuse_known_pair(spark):
    rows = [("desk", [0.0, 0.0, 0.0], [1.0] * 3, 0.8, 0), ("desks", [0.5, 0.0, 0.0], [1.0] * 3, 0.2, 1), ("desk", [9.0, 0.0, 0.0], [1.0] * 3, 0.5, 2), ("desk", None, None, 0.9, 3)]
    df = spark.createDataFrame(rows, "query string, center array<double>, extent array<double>, confidence double, order long")
    got = {r.rep: r for r in S.fuse(df).collect()}
    assert set(got) == {0, 2, 3} and got[0].n_members == 2 and got[0].center == pytest.approx([0.1, 0, 0]) and got[0].extent == pytest.approx([1.5, 1, 1]) and got[0].confidence == 0.8
    assert got[3].center is None and not got[0].review


def test_fuse_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["cup", "cups", "desk"]), [rng.uniform(0, 30), rng.uniform(0, 2), 0.0], [rng.uniform(0.2, 1.5)] * 3, round(rng.random(), 2), i) for i in range(200)]
    reps, want = [], {}
    for q, c, e, conf, i in sorted(rows, key=lambda r: (-r[3], r[4])):
        label = q.rstrip("s")
        for j, (l2, c2, e2) in reps:
            off = [abs(a - b) for a, b in zip(c, c2, strict=True)]
            if l2 == label and (math.dist(c, c2) < 0.6 * (max(e) + max(e2)) / 2 or all(o <= (a + b) / 2 for o, a, b in zip(off, e, e2, strict=True))):
                want[i] = j
                break
        else:
            reps.append((i, (label, c, e)))
            want[i] = i
    df = spark.createDataFrame(rows, "query string, center array<double>, extent array<double>, confidence double, order long")
    got = {m: r.rep for r in S.fuse(df).collect() for m in r.members}
    assert got == want


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(size=(80, 3)), rng.normal(size=(5, 3)) * 30])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double, z double")
    got = {(r.id, r.rank): r.neighbour for r in J.nearest_neighbours(df, "id", ("x", "y", "z"), 4, 0.5).collect()}
    for i in range(len(p)):
        d = np.linalg.norm(p - p[i], axis=1)
        d[i] = np.inf
        assert [got[i, k + 1] for k in range(4)] == np.argsort(d, kind="stable")[:4].tolist()


def room(spark):
    rng = np.random.default_rng(0)
    floor = np.column_stack([rng.uniform(0, 6, 2000), rng.uniform(0, 4, 2000), rng.normal(0, 0.005, 2000)])
    wall = np.column_stack([rng.normal(0, 0.005, 900), rng.uniform(0, 4, 900), rng.uniform(0, 2.6, 900)])
    box = rng.uniform([2, 1, 0.3], [3, 2, 0.9], (400, 3))
    p = np.concatenate([floor, wall, box])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double, z double")


def test_planes_and_structure(spark):
    df = room(spark)
    found = S.planes(df, "id", 0.02, most=2)
    assert abs(found[0]["normal"][2]) > 0.999 and found[0]["inliers"] > 1900 and abs(found[1]["normal"][0]) > 0.999
    rest = S.without_structure(df, found[0], found[1:], 0.05, 0.05)
    assert 380 <= rest.count() <= 420
    assert S.plane(df.limit(2), "id", 0.02) is None


def test_grid_and_routes(spark):
    cells = [(u, v) for u in range(8) for v in range(8) if u != 4 or v == 7] + [(20, 20)]
    free = spark.createDataFrame(cells, "iu long, iv long")
    r = S.regions(free)
    assert sorted(x.cells for x in r.select("region", "cells").distinct().collect()) == [1, 57]
    steps = {(x.iu, x.iv): x.steps for x in S.distances(free, spark.createDataFrame([(0, 0)], "iu long, iv long")).collect()}
    assert steps[(7, 0)] == 14 and (20, 20) not in steps
    main = r.orderBy(F.desc("cells")).first().region
    goals = spark.createDataFrame([(1, 1), (20, 20), (4, 0)], "iu long, iv long")
    assert {(g.iu, g.state) for g in S.goal_state(goals, r, main).collect()} == {(1, "free_navigable"), (20, "free_pocket"), (4, "obstructed")}


def test_lod_and_voxels(spark):
    df = room(spark)
    out = S.lod(df, 300, "id", 0.2, importance=F.col("z"))
    assert out.count() == 300 and out.select("id").distinct().count() == 300
    grid = S.voxels(df, 0.25, (-1.0, -1.0, -1.0))
    assert grid.agg(F.sum("n")).first()[0] == 3300
    labels = S.voxel_clusters(grid)
    assert labels.select("cluster").distinct().count() >= 1


def test_principal_box(spark):
    df = room(spark).filter("id >= 2900").withColumn("k", F.lit(1))
    r = A.principal_box(df, ("x", "y", "z"), ["k"]).first()
    assert r.center == pytest.approx([2.5, 1.5, 0.6], abs=0.1) and min(r.extent) > 0.5
    assert np.linalg.det(np.array(r.axes).reshape(3, 3)) == pytest.approx(1)


def test_in_box_and_bounds(spark):
    df = spark.createDataFrame([(x / 10, y / 10, 0.0) for x in range(41) for y in range(31)], "x double, y double, z double")
    b = A.robust_bounds(df, ("x", "y", "z"), 0.0, 1.0).first()
    assert b.dimensions == [4.0, 3.0, 0.0]
    n = df.filter(G.in_box((F.col("x"), F.col("y"), F.col("z")), [2.0, 1.5, 0.0], [2.0, 1.0, 0.0])).count()
    assert n == 21 * 11


def test_scale_decision(spark):
    def run(geom, cur, prev, support):
        s = lambda v: F.struct(F.lit(v[0]).cast("double").alias("ratio"), F.lit(v[1]).cast("double").alias("variation"))
        return spark.range(1).select(A.scale_decision(F.lit(geom), s(cur), s(prev), F.lit(support)).alias("d")).first().d

    assert run(1.0, (2.0, 0.1), (2.1, 0.1), 9).reason == "agree"
    assert run(1.0, (None, None), (2.1, 0.1), 9).reason == "anchor_unavailable"
    assert run(1.0, (2.0, 0.2), (2.1, 0.1), 9).reason == "within_submap_cov_high"
    assert run(-1.0, (2.0, 0.1), (1.0, 0.1), 9).scale == 2.0
    assert run(1.0, (4.0, 0.1), (1.0, 0.1), 9).degenerate and run(1.0, (4.0, 0.1), (1.0, 0.1), 900).untrusted


def test_empty_query_set_gives_nothing(spark):
    df = spark.createDataFrame([("Desk ",), (None,)], "query string")
    assert T.of_queries(df, []).count() == 0 and T.of_queries(df, ["desk"]).count() == 1


def commands(spark, rows):
    full = [(i, "u", op, amount, ref and "job", ref, idem, ttl, float(now)) for i, (op, amount, ref, idem, ttl, now) in enumerate(rows)]
    return spark.createDataFrame(full, L.COMMANDS)


def test_ledger_holds_and_settles(spark):
    out = L.fold(commands(spark, [("ensure", 200, None, None, None, 0), ("hold", 60, "a", None, None, 1), ("hold", 60, "a", None, None, 2), ("settle", 45, "a", None, None, 3), ("settle", 45, "a", None, None, 4)]))
    rows = out.orderBy("seq").collect()
    assert [(r.status, r.available) for r in rows] == [("ok", 200), ("ok", 140), ("replay", 140), ("ok", 155), ("replay", 155)]
    assert L.balances(out).first().balance == 155


def test_ledger_fails_closed_and_expires(spark):
    racing = [("ensure", 1, None, None, None, 0)] + [("hold", 1, f"r{i}", None, None, 1) for i in range(16)]
    assert L.fold(commands(spark, racing)).filter("op = 'hold' AND status = 'ok'").count() == 1
    spends = [("ensure", 3, None, None, None, 0)] + [("spend", 1, None, f"s{i}", None, 1) for i in range(12)] + [("spend", 1, None, "s0", None, 2)]
    out = L.fold(commands(spark, spends)).collect()
    assert sum(r.status == "ok" and r.op == "spend" for r in out) == 3 and out[-1].status == "replay"
    subs = [("ensure", 10, None, None, None, 0), ("grant", 50, None, "g", 100, 0), ("spend", 20, None, "s", None, 1), ("spend", 20, None, "t", None, 200), ("settle", 5, "x", None, None, 201), ("hold", 4, "y", None, None, 202), ("settle", 200, "y", None, None, 203)]
    rows = L.fold(commands(spark, subs)).orderBy("seq").collect()
    assert [(r.op, r.status, r.kind, r.delta) for r in rows][2:] == [("spend", "ok", "spend", -20), ("spend", "insufficient_credits", None, 0), ("settle", "no_hold", None, 0), ("hold", "ok", "expire", -30), ("hold", "ok", "hold", 0), ("settle", "ok", "settle", -110)]
    assert rows[-1].uncollected == 90 and rows[-1].available == -100


def test_ledger_order_of_checks_and_shared_references(spark):
    rows = [
        ("a", "hold", -1, "r", None, None, 0), ("a", "hold", 1, "r", None, None, 0), ("a", "spend", -1, None, "s", None, 0), ("a", "topup", 1, "r", None, None, 0),
        ("a", "ensure", 100, None, None, None, 1), ("b", "ensure", 100, None, None, None, 1), ("a", "hold", 30, "r", None, None, 2), ("b", "hold", 50, "r", None, None, 3),
        ("b", "topup", 20, "r", None, None, 4), ("b", "topup", 51, "r", None, None, 5), ("a", "topup", -60, "r", None, None, 6), ("b", "void", 0, "r", None, None, 7), ("a", "topup", 1, "r", None, None, 8), ("b", "hold", 50, "r", None, None, 9),
        ("b", "settle", -5, "r", None, None, 10), ("c", "grant", -101, None, "g", None, 11), ("c", "hold", 0, "q", None, None, 11), ("c", "grant", 5, None, "h", None, 12), ("c", "grant", 5, None, "h", None, 13),
        ("d", "ensure_unlimited", 0, None, None, None, 1), ("d", "hold", 900, "z", None, None, 2), ("d", "settle", 900, "z", None, None, 3), ("d", "spend", 7, None, "u", None, 4),
    ]
    full = [(i, u, op, amount, ref and "job", ref, idem, ttl, float(now)) for i, (u, op, amount, ref, idem, ttl, now) in enumerate(rows)]
    got = L.fold(spark.createDataFrame(full, L.COMMANDS)).orderBy("seq").collect()
    assert [(r.seq, r.user_id, r.status, r.available) for r in got] == [
        (0, "a", "invalid_amount", None), (1, "a", "no_account", None), (2, "a", "invalid_amount", None), (3, "a", "no_hold", None), (4, "a", "ok", 100), (5, "b", "ok", 100), (6, "a", "ok", 70), (7, "b", "replay", 100),
        (8, "a", "ok", 50), (9, "a", "insufficient_credits", 50), (10, "a", "constraint", 50), (11, "a", "ok", 100), (12, "a", "hold_not_open", 100), (13, "b", "ok", 50),
        (14, "b", "ok", 100), (15, "c", "constraint", None), (16, "c", "no_account", None), (17, "c", "ok", 5), (18, "c", "replay", 5), (19, "d", "ok", 0), (20, "d", "ok", -900), (21, "d", "ok", 0), (22, "d", "ok", 0),
    ]
    assert {r.user_id: r.balance for r in L.balances(L.fold(spark.createDataFrame(full, L.COMMANDS))).collect()} == {"a": 100, "b": 100, "c": 5, "d": 0}


def test_reference_resolution(spark):
    o = spark.createDataFrame([("det:0", 0, 0.9, False, None, "desk"), ("det:1", 1, 0.5, False, "desk chair", "chair"), ("det:2", 2, 0.99, True, None, "lamp")], "uid string, position long, confidence double, dismissed boolean, human_label string, query string")
    refs = spark.createDataFrame([("det:2",), ("1",), ("desk",), ("lamp",)], "ref string")
    assert {r.ref: r.uid for r in T.resolved_reference(o, refs).collect()} == {"det:2": "det:2", "1": "det:1", "desk": "det:0", "lamp": None}
