"""Routes and upright boxes against brute force."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.operators import hulls as H
from cartolith.operators import routes as R
from cartolith.plans import navigation

CELL = "iu long, iv long"


def grid(seed, size=26, blocked=0.42):
    rng = random.Random(seed)
    return {(u - 5, v - 9) for u in range(size) for v in range(size) if rng.random() > blocked}


def search(free, starts):
    """Dijkstra's search over the whole grid with exact numbers of steps."""
    found, heap = {}, [(0.0, 0, 0, c) for c in starts if c in free]
    while heap:
        _, s, d, (u, v) = heapq.heappop(heap)
        if (u, v) in found:
            continue
        found[u, v] = (s, d)
        for i, j in R.AROUND:
            if (u + i, v + j) in free and (u + i, v + j) not in found:
                x, y = s + (0 in (i, j)), d + (0 not in (i, j))
                heapq.heappush(heap, (x + y * math.sqrt(2), x, y, (u + i, v + j)))
    return found


def before(found, cell):
    u, v = cell
    s, d = found[cell]
    return min(((u + i, v + j) for i, j in R.AROUND if found.get((u + i, v + j)) == (s - (0 in (i, j)), d - (0 not in (i, j)))), default=None)


def walked(found, goal):
    path = [goal]
    while before(found, path[-1]):
        path.append(before(found, path[-1]))
    return path


def shortened(free, path):
    def clear(a, b):
        steps = max(math.ceil(math.hypot(b[0] - a[0], b[1] - a[1]) / 0.5), 1)
        return all((math.floor(a[0] + 0.5 + k / steps * (b[0] - a[0])), math.floor(a[1] + 0.5 + k / steps * (b[1] - a[1]))) in free for k in range(steps + 1))

    kept, i = [path[0]], 0
    while i < len(path) - 1:
        i = next(j for j in range(len(path) - 1, i, -1) if j == i + 1 or clear(path[i], path[j]))
        kept.append(path[i])
    return kept


@pytest.mark.parametrize("tile,starts", [(8, [(3, 3)]), (5, [(0, 0), (15, 11), (99, 99)]), (64, [(3, 3)])])
def test_costs_against_one_search(spark, tile, starts):
    free = grid(1) | set(starts[:2])
    free -= {(99, 99)}
    got = R.costs(spark.createDataFrame(sorted(free), CELL).repartition(3), spark.createDataFrame(starts, CELL), tile).collect()
    found = search(free, starts)
    assert {(r.iu, r.iv): (r.straight, r.diagonal) for r in got} == found and len(got) == len(found) < len(free)
    assert all(((r.from_u, r.from_v) if r.from_u is not None else None) == before(found, (r.iu, r.iv)) for r in got)


@pytest.mark.parametrize("goals_at_once,ahead", [(50_000, 256), (3, 4)])
def test_routes_against_loops(spark, monkeypatch, goals_at_once, ahead):
    monkeypatch.setattr(R, "GOALS", goals_at_once)
    free = grid(2) | {(3, 3)}
    pocket = {(u, v) for u in range(40, 43) for v in range(3)}  # sealed off
    cells = spark.createDataFrame(sorted(free | pocket), CELL)
    found = search(free, [(3, 3)])
    goals = [*random.Random(3).sample(sorted(found), 25), (3, 3), (41, 1), (500, 500), (3, 3)]
    asked = spark.createDataFrame(goals, CELL)
    costs = R.costs(cells, spark.createDataFrame([(3, 3)], CELL), 8)
    along = R.paths(costs, asked, 8)
    rows = {}
    for r in along.collect():
        rows.setdefault((r.goal_u, r.goal_v), {})[r.back] = (r.iu, r.iv)
    want = {g: walked(found, g) for g in goals if g in found}
    assert {g: [p[i] for i in range(len(p))] for g, p in rows.items()} == want
    points = {}
    for r in R.way_points(along, cells, ahead).collect():
        points.setdefault((r.goal_u, r.goal_v), {})[r.place] = (r.iu, r.iv)
    assert {g: [p[i] for i in sorted(p)] for g, p in points.items()} == {g: shortened(free, p[::-1]) for g, p in want.items()}


def test_routes_report_what_cannot_be_reached(spark):
    free = {(u, 0) for u in range(6)} | {(u, 9) for u in range(3)}
    out = {(r.goal_u, r.goal_v): r for r in R.routes(spark.createDataFrame(sorted(free), CELL), spark.createDataFrame([(0, 0)], CELL), spark.createDataFrame([(5, 0), (0, 0), (1, 9), (7, 7)], CELL)).collect()}
    assert out[5, 0].reached and out[5, 0].cost == 5.0 and out[5, 0].cells == 6 and [tuple(w) for w in out[5, 0].way_points] == [(0, 0), (5, 0)]
    assert out[0, 0].cost == 0.0 and [tuple(w) for w in out[0, 0].way_points] == [(0, 0)]
    for g in ((1, 9), (7, 7)):
        assert not out[g].reached and out[g].cost is None and out[g].cells == 0 and out[g].way_points is None
    none = spark.createDataFrame([], CELL)
    assert R.costs(none, none).count() == 0 and R.routes(none, none, none).count() == 0


def test_query_of_way_points(spark):
    d = "/root/testdata/sf0.001"
    cells, start, goals = navigation._floor(spark, d)
    free = {tuple(r) for r in cells.collect()}
    found = search(free, [tuple(start.first())])
    got = navigation.route_way_points(spark, d).collect()
    assert {(r.goal_u, r.goal_v) for r in got} == {tuple(r) for r in goals.collect()} and any(len(r.way_points.split()) > 2 for r in got if r.reached)
    for r in got:
        goal = (r.goal_u, r.goal_v)
        if goal not in found:
            assert not r.reached and r.way_points is None or r.way_points == ""
            continue
        path = walked(found, goal)[::-1]
        assert r.cells == len(path) and abs(r.cost - found[goal][0] - found[goal][1] * math.sqrt(2)) < 1e-6
        assert r.way_points == " ".join(f"{u}:{v}" for u, v in shortened(free, path))


# hulls and boxes


def corners_by_loop(points):
    """A point is a corner unless it lies in a triangle or on a segment of others: by the half plane test over all directions between points."""
    p = sorted(set(points))
    out = []
    for a in p:
        rest = [q for q in p if q != a]
        angles = sorted(math.atan2(q[1] - a[1], q[0] - a[0]) for q in rest)
        gaps = [y - x for x, y in zip(angles, angles[1:], strict=False)] + [angles[0] + 2 * math.pi - angles[-1]] if angles else [7]
        if max(gaps) > math.pi + 1e-9 or len(rest) == 0:
            out.append(a)
    return out


@pytest.mark.parametrize("kind", ["random", "lattice", "circle", "line", "one", "two"])
def test_hull_against_directions(kind):
    rng = np.random.default_rng(4)
    points = {
        "random": rng.normal(0, 5, (300, 2)), "lattice": rng.integers(-4, 5, (400, 2)).astype(float), "circle": np.stack([np.cos(np.arange(90) / 14.0), np.sin(np.arange(90) / 14.0)], axis=1),
        "line": np.stack([np.arange(100.0), 2 * np.arange(100.0)], axis=1), "one": np.ones((5, 2)), "two": np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]),
    }[kind]
    got = H.hull(points)
    assert sorted(map(tuple, got.tolist())) == corners_by_loop(list(map(tuple, points.tolist())))
    if len(got) > 2:
        edge = np.roll(got, -1, axis=0) - got
        assert (edge[:, 0] * np.roll(edge[:, 1], -1) - edge[:, 1] * np.roll(edge[:, 0], -1) > 0).all() and tuple(got[0]) == min(map(tuple, got.tolist()))


@pytest.mark.parametrize("held", [500_000, 3])
def test_hulls_of_keys(spark, monkeypatch, held):
    monkeypatch.setattr(H, "HELD", held)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2]), rng.gauss(0, 1), rng.gauss(0, 3)) for _ in range(3000)]
    rows += [("c", 1, 0.5, 0.5)] * 100 + [("d", 1, float("nan"), 0.0), ("d", 1, None, 0.0), ("d", 1, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "k string, m int, x double, y double").repartition(7)
    got = {}
    for r in H.hulls(df, ["k", "m"], F.col("x"), F.col("y")).collect():
        got.setdefault((r.k, r.m), {})[r.place] = (r.x, r.y)
    want = {}
    for k, m, x, y in rows:
        if k != "d":
            want.setdefault((k, m), []).append((x, y))
    assert set(got) == set(want)
    for key, p in want.items():
        assert [got[key][i] for i in range(len(got[key]))] == list(map(tuple, H.hull(np.array(p)).tolist()))


def test_boxes_are_least(spark):
    rng = np.random.default_rng(6)
    rows, true = [], {}
    for k in range(6):
        yaw, size = rng.uniform(0, np.pi), np.array([1.4, 0.9, 0.7]) * (1 + k)
        local = (rng.random((400, 3)) - 0.5) * size
        local[:4, :2] = np.array([[1, 1], [1, -1], [-1, 1], [-1, -1]]) * size[:2] / 2
        turn = np.array([[np.cos(yaw), -np.sin(yaw), 0], [np.sin(yaw), np.cos(yaw), 0], [0, 0, 1]])
        center = rng.normal(0, 10, 3)
        true[k] = (center, size, local, turn)
        rows += [(k, *p) for p in (local @ turn.T + center).tolist()]
    rows += [(90, float(i), 2.0 * i, 1.0) for i in range(5)] + [(91, 3.0, 4.0, 5.0)] * 3 + [(92, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double, z double").repartition(5)
    got = {r.k: r for r in H.yaw_boxes(df, ["k"], ("x", "y", "z")).collect()}
    assert set(got) == {*range(6), 90, 91}
    for k, (_, size, _, _) in true.items():
        r = got[k]
        assert r.points == 400 and np.allclose(sorted(r.extents[:2]), sorted(size[:2]), atol=1e-9) and r.extents[2] <= size[2]
        p, axes = np.array([x[1:] for x in rows if x[0] == k]), np.array(r.axes)
        assert np.allclose(axes @ axes.T, np.eye(3)) and np.linalg.det(axes) > 0
        off = (p - np.array(r.center)) @ axes.T
        assert (np.abs(off) <= np.array(r.extents) / 2 + 1e-9).all()
        area = r.extents[0] * r.extents[1]
        for a in np.linspace(0, np.pi / 2, 500):  # no rectangle at another angle is smaller
            x, y = p[:, 0] * np.cos(a) + p[:, 1] * np.sin(a), p[:, 1] * np.cos(a) - p[:, 0] * np.sin(a)
            assert (x.max() - x.min()) * (y.max() - y.min()) >= area - 1e-9
    assert np.allclose(got[90].extents, [math.hypot(4, 8), 0, 0]) and np.allclose(got[91].extents, 0) and np.allclose(got[91].center, [3, 4, 5])


def test_boxes_stand_on_any_up(spark):
    rng = np.random.default_rng(7)
    up = np.array([0.3, -0.5, 0.8])
    p = rng.normal(0, 1, (200, 3)) * [1, 2, 3]
    r = H.yaw_boxes(spark.createDataFrame([(None, *x) for x in p.tolist()], "k string, x double, y double, z double"), ["k"], ("x", "y", "z"), tuple(up)).first()
    axes = np.array(r.axes)
    assert r.k is None and np.allclose(axes[2], up / np.linalg.norm(up)) and np.allclose(axes @ axes.T, np.eye(3)) and np.linalg.det(axes) > 0
    assert (np.abs((p - np.array(r.center)) @ axes.T) <= np.array(r.extents) / 2 + 1e-9).all()
