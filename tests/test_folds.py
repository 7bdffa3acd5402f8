"""Folds in order, exact smallest rows, level of detail and neighbours, each against a loop."""

import glob
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.operators import folds, joins, scene, shared, spatial, views
from cartolith.operators.components import connected_components


def test_a_long_key_is_folded_with_one_state(spark):
    """A million rows of one key beside small ones, in falling order: the state is one number, and rows come out one for one."""
    rows = spark.range(1_000_000).select(F.when(F.col("id") < 999_990, 0).otherwise(F.col("id")).alias("k"), (-F.col("id")).alias("o"), F.lit(1).alias("v"), F.array("id").alias("other"))

    def step(state, v):
        now = (state or 0) + v
        return now, (now,)

    out = folds.folded(rows.repartition(7), "k", ["o"], ["v"], step, "total long")
    ends = out.groupBy("k").agg(F.max("total").alias("most"), F.count("*").alias("n"), F.min(F.col("total") - F.col("o")).alias("low"), F.max(F.col("total") - F.col("o")).alias("high")).orderBy("k").collect()
    assert [(r.k, r.most, r.n) for r in ends] == [(0, 999_990, 999_990), *((k, 1, 1) for k in range(999_990, 1_000_000))]
    assert out.columns == ["k", "o", "v", "other", "total"] and ends[0].low == ends[0].high == 999_990


def test_null_keys_and_no_rows(spark):
    schema = "k string, o int, v double"
    rows = spark.createDataFrame([(None, 2, 2.0), (None, 1, 1.0), ("a", 1, None), ("a", 2, 5.0)], schema)
    step = lambda s, v: ((s or 0.0) + (v or 0.0), ((s or 0.0) + (v or 0.0),))
    assert {(r.k, r.o, r.t) for r in folds.folded(rows, "k", ["o"], ["v"], step, "t double").collect()} == {(None, 1, 1.0), (None, 2, 3.0), ("a", 1, 0.0), ("a", 2, 5.0)}
    assert folds.folded(rows.limit(0), "k", ["o"], ["v"], step, "t double").count() == 0


def test_headings_turn_by_no_more_than_allowed(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, rng.uniform(-9, 9)])) for k in "ab" for i in range(200)]
    got = {(r.k, r.i): r.heading for r in folds.limited_headings(spark.createDataFrame(rows, "k string, i int, raw double").repartition(5), "k", ["i"], "raw", 0.3).collect()}
    last = {}
    for k, i, raw in rows:
        if raw is None:
            assert got[k, i] is None
            continue
        turn = math.atan2(math.sin(raw - last.get(k, raw)), math.cos(raw - last.get(k, raw)))
        last[k] = last.get(k, raw) + max(-0.3, min(0.3, turn))
        assert got[k, i] == pytest.approx(last[k], abs=1e-9)


def test_ceiling_and_log_batches_against_loops(spark):
    rng = random.Random(3)
    calls = [(rng.choice("xyz"), i, rng.choice([None, *map(float, range(9))])) for i in range(400)]
    got = {r.i: r.allowed for r in scene.under_ceiling(spark.createDataFrame(calls, "s string, i long, c double").repartition(6), "s", "i", "c", 60.0).collect()}
    spent, times = {}, sorted(rng.uniform(0, 300) for _ in range(400))
    for s, i, c in calls:
        fits = c is not None and spent.get(s, 0) + c <= 60
        assert got[i] == fits
        spent[s] = spent.get(s, 0) + (c if fits else 0)
    events = spark.createDataFrame([(rng.choice("pq"), t, i) for i, t in enumerate(times)], "run string, t double, i long")
    out = {r.i: (r.seq, r.batch) for r in views.log_batches(events.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))), "run", "ts", "i", 5, 4.0).collect()}
    state = {}
    for r in events.orderBy("i").collect():
        t = int(r.t * 1e6) / 1e6
        seq, batch, n, first = state.get(r.run, (-1, -1, 5, 0.0))
        if n >= 5 or t - first >= 4.0:
            batch, n, first = batch + 1, 0, t
        state[r.run] = (seq + 1, batch, n + 1, first)
        assert out[r.i] == (seq + 1, batch)


@pytest.mark.parametrize("kind", ["spread", "skewed", "ties", "one value", "odd"])
@pytest.mark.parametrize("n", [0, 1, 37, 499, 500, 900])
def test_smallest_against_a_sort(spark, monkeypatch, kind, n):
    monkeypatch.setattr(shared, "SORTED", 20)
    monkeypatch.setattr(shared, "BINS", 8)
    rng = random.Random(4)
    value = {"spread": lambda: rng.uniform(-5, 5), "skewed": lambda: math.exp(rng.uniform(-300, 300)), "ties": lambda: float(rng.randrange(4)), "one value": lambda: 7.0, "odd": lambda: rng.choice([None, float("nan"), float("inf"), 1.0, -1e308, 1e308])}[kind]
    rows = [(i, value()) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v double").repartition(3)
    hashed = {r.i: r.h for r in df.select("i", shared.even_hash("i").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[1] if r[1] is not None and math.isfinite(r[1]) else 1.7e308, hashed[r[0]], r[0]))
    got = shared.smallest(df, F.col("v"), ["i"], n)
    assert sorted(r.i for r in got.collect()) == sorted(i for i, _ in order[:n]) and got.columns == ["i", "v"]


def cloud(spark, n=4000):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, p), float(w)) for i, (p, w) in enumerate(zip(rng.normal(0, 1, (n, 3)), rng.exponential(1, n), strict=True))]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double, w double").repartition(4)


def test_level_of_detail_modes(spark, monkeypatch):
    monkeypatch.setattr(shared, "SORTED", 50)
    rows, df = cloud(spark)
    ids = lambda **how: {r.id for r in spatial.lod(df, 500, "id", 0.3, **how).collect()}
    hashed = {r.id: r.h for r in df.select("id", shared.even_hash("id").alias("h")).collect()}
    assert ids(mode="uniform") == set(sorted(hashed, key=hashed.get)[:500])
    assert ids(mode="importance", importance=F.col("w")) == {r[0] for r in sorted(rows, key=lambda r: -r[4])[:500]}
    assert len(ids(importance=F.col("w"))) == 500 and ids(importance=F.lit(0.9)) == ids(mode="voxel_first") == ids()
    side = spatial.voxel_side(df, 525, 0.3)
    best = {}
    for i, x, y, z, w in rows:
        cell = tuple(max(0, math.floor(c / side)) for c in (x, y, z))
        best[cell] = max(best.get(cell, (-1.0, 0)), (w, -i))
    top = {-i for _, i in best.values()}
    assert ids(mode="voxel_importance", importance=F.col("w")) == set(sorted(top, key=hashed.get)[:500])
    covered = lambda found: len({tuple(math.floor(c / 0.5) for c in rows[i][1:4]) for i in found})
    assert covered(ids(importance=F.col("w"), origin=(-6.0, -6.0, -6.0))) > covered(ids(mode="uniform"))  # voxels cover more than chance
    assert spatial.lod(df, 4000, "id", 0.3).count() == spatial.lod(df, 10_000, "id", 0.3, mode="uniform").count() == 4000
    with pytest.raises(ValueError, match="mode"):
        spatial.lod(df, 5, "id", 0.3, mode="best")


def test_decimated_splats_still_cover(spark):
    _, df = cloud(spark, 1000)
    splats = df.withColumns({f"scale_{i}": F.lit(-9.0) + F.col("w") for i in range(3)})
    out = spatial.decimated(splats, 200, "id", 0.3, F.col("w"), 0.5).collect()
    least = math.log(spatial.voxel_side(splats, 210, 0.3) * 0.5)
    assert len(out) <= 200 and all(r.scale_0 == pytest.approx(max(least, -9.0 + r.w)) for r in out)
    assert spatial.decimated(splats, 1000, "id", 0.3, F.col("w"), 0.5).filter("scale_0 < -8.99").count() > 0


def near(rows, k):
    out = {}
    for i, *p in rows:
        found = sorted((math.dist(p, q), j) for j, *q in rows if j != i)[:k]
        out |= {(i, r + 1): (j, d) for r, (d, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("kind", ["one far", "dense", "one place", "few", "two groups"])
def test_neighbours_at_any_distance(spark, kind):
    rng = random.Random(6)
    rows = {
        "one far": [(i, rng.random(), rng.random(), 0.0) for i in range(6)] + [(9, 1e6, 0.0, 0.0)],
        "dense": [(i, rng.gauss(0, 1e-3), rng.gauss(0, 1e-3), 0.0) for i in range(150)] + [(500 + i, rng.uniform(0, 9), 0.0, 0.0) for i in range(20)],
        "one place": [(i, 1.0, 2.0, 3.0) for i in range(120)] + [(200, 1.0, 2.0, 4.0)], "few": [(1, 0.0, 0.0, 0.0), (2, 5.0, 0.0, 0.0)],
        "two groups": [(i, rng.random() + 1e5 * (i % 2), rng.random(), rng.random()) for i in range(80)],
    }[kind]
    odd = [(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0), (902, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "id long, x double, y double, z double")
    got = joins.nearest_neighbours(df, "id", ("x", "y", "z"), 3, 1.0, crowd=20).collect()
    want = near(rows, 3)
    assert {(r.id, r.rank): r.neighbour for r in got} == {key: v[0] for key, v in want.items()} and len(got) == len(want)
    assert all(r.distance == pytest.approx(want[r.id, r.rank][1], rel=1e-9, abs=1e-12) for r in got)


def test_neighbours_of_nothing(spark):
    for rows in ([], [(1, 0.0, 0.0, 0.0)]):
        assert joins.nearest_neighbours(spark.createDataFrame(rows, "id long, x double, y double, z double"), "id", ("x", "y", "z"), 3, 1.0).count() == 0


def test_rounds_leave_nothing_behind(spark):
    """Of the tables that components write only the last is left until the process ends."""
    at = shared.folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{at}/edges-*"))
    connected_components(spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).count()
    assert len(set(glob.glob(f"{at}/edges-*")) - before) == 1


def test_each_with_each_is_bounded_by_bytes(spark, monkeypatch):
    few = spark.range(40).select(F.col("id").alias("f"), F.repeat(F.lit("x"), 500).alias("wide"))
    many = spark.range(100).select(F.col("id").alias("m"))
    for most in (32 << 20, 5000):
        monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
        both = shared.with_each(many, few)
        assert ("BroadcastNestedLoopJoin" in both._jdf.queryExecution().toString()) == (most > 5000)
        assert both.select("m", "f").distinct().count() == both.count() == 4000
