"""Operators that must not hold a table, a group or a side in one place: with their limits set low, against plain loops."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import arrays as A
from cartolith.operators import aggregates as G
from cartolith.operators import ledger as L
from cartolith.operators import scene as S
from cartolith.operators import shared
from cartolith.operators import spatial
from cartolith.operators import splats
from cartolith.operators import tracks as T
from cartolith.sources import archives, recordings


@pytest.mark.parametrize("most", [100_000, 6])
def test_exact_percentiles(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "SORTED", most)
    monkeypatch.setattr(shared, "BINS", 16)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 400), np.full(300, 0.25), rng.pareto(0.7, 300)])
    y = rng.integers(0, 3, 1000).astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double").repartition(5)
    shares = [0.0, 0.005, 0.31, 0.5, 0.98, 1.0]
    n, got = shared.exact_percentiles(df, {"x": F.col("x"), "y": F.col("y")}, shares)
    assert n == 1000 and got["x"] == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12) and got["y"] == pytest.approx(np.quantile(y, shares).tolist())
    assert shared.exact_percentiles(df.limit(0), {"x": F.col("x")}, [0.5]) == (0, {"x": [None]})
    assert G.robust_bounds(df.limit(0), ("x", "y")).first().points == 0


def test_each_meets_each_in_blocks(spark, monkeypatch):
    many, few = spark.range(50).withColumnRenamed("id", "a"), spark.range(33).withColumnRenamed("id", "b")
    want = {(a, b) for a in range(50) for b in range(33)}
    for most in (20_000, 250):
        monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
        got = [tuple(r) for r in shared.with_each(many, few).select("a", "b").collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("tile", [4, 64])
def test_distances_over_tiles(spark, tile):
    rng = random.Random(2)
    cells = {(u, v) for u in range(-9, 14) for v in range(-5, 12) if rng.random() < 0.7} | {(0, 0)}
    best, heap = {(0, 0): 0}, [(0, 0, 0)]
    while heap:
        s, u, v = heapq.heappop(heap)
        for at in ((u + i, v + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if at in cells and at not in best:
                best[at] = s + 1
                heapq.heappush(heap, (s + 1, *at))
    df = spark.createDataFrame(sorted(cells), "iu long, iv long")
    got = spatial.distances(df, spark.createDataFrame([(0, 0)], "iu long, iv long"), tile).collect()
    assert {(r.iu, r.iv): r.steps for r in got} == best


def test_numbering_in_parts(spark):
    rows = [(i * 7 % 100,) for i in range(100)]
    numbered, n = T.numbered_rows(spark.createDataFrame(rows, "k long").repartition(7), ["k"])
    assert n == 100 and all(r.k == r.position for r in numbered.collect())
    assert T.spread_positions(spark.createDataFrame(rows, "k long"), ["k"], 200).count() == 100


def test_smoothing_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(i) / 10, None if i in (0, 4, 5, 19) else float(v)) for k in ("a", "b") for i, v in enumerate(rng.normal(0, 1, 20).cumsum())]
    got = {(r.k, round(r.t, 1)): r.smooth for r in T.smoothed(spark.createDataFrame(rows, "k string, t double, v double"), "k", "t", "v", 1.2, 0.05).collect()}
    for key in ("a", "b"):
        known = [(t, v) for k, t, v in rows if k == key and v is not None]
        x = np.interp([t for k, t, _ in rows if k == key], *zip(*known, strict=True))
        last, speed = x[0], 0.0
        assert got[key, 0.0] == pytest.approx(x[0])
        for i in range(1, 20):
            share = lambda c: 1 / (1 + 1 / (2 * np.pi * c * 0.1))
            speed += share(1.0) * ((x[i] - last) / 0.1 - speed)
            last += share(1.2 + 0.05 * abs(speed)) * (x[i] - last)
            assert got[key, round(i / 10, 1)] == pytest.approx(last)


def test_resampling_against_interpolation(spark):
    rng = np.random.default_rng(4)
    paths = {k: rng.normal(0, 3, (n, 2)).cumsum(axis=0) for k, n in (("a", 12), ("b", 2), ("c", 7))}
    paths["c"][3] = paths["c"][2]  # a stop
    df = spark.createDataFrame([(k, i, float(x), float(y)) for k, p in paths.items() for i, (x, y) in enumerate(p)], "k string, i long, x double, y double")
    got = T.resampled(df, "k", "i", 1.3).collect()
    for k, p in paths.items():
        s = np.append(0, np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1)))
        at = np.linspace(0, s[-1], max(round(s[-1] / 1.3) + 1, 2))
        mine = sorted((r.sample, r.x, r.y) for r in got if r.k == k)
        assert [m[0] for m in mine] == list(range(len(at)))
        assert np.allclose([m[1] for m in mine], np.interp(at, s, p[:, 0])) and np.allclose([m[2] for m in mine], np.interp(at, s, p[:, 1]))


def test_bodies_share_one_scale(spark):
    joints = spark.createDataFrame([("p", 0, 0, [1.0, 0.0, 0.0], [1.0, 1.0, 1.0]), ("p", 0, 1, [1.0, 0.0, 0.0], [float("nan"), 0.0, 0.0]), ("p", 1, 0, [0.0, 0.0, 0.0], [2.0, 0.0, 0.0])], "person string, frame long, joint long, root array<double>, offset array<double>")
    scales = spark.createDataFrame([(0, 2.0), (1, 4.0), (2, float("inf")), (3, 3.0)], "frame long, scale double")
    got = {(r.frame, r.joint): (r.world, r.valid) for r in T.anchored_bodies(joints, scales).collect()}
    assert got[0, 0] == ([4.0, 3.0, 3.0], False) and got[1, 0] == ([6.0, 0.0, 0.0], True)


def test_cited_frames_fall_back(spark):
    c = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 2)], "submap long, frame long, place long")
    none = spark.createDataFrame([(9, 9, 0)], c.schema)
    assert [(r.submap, r.frame) for r in S.cited_frames(none, c, 2).orderBy("place").collect()] == [(1, 0), (1, 1)]
    assert [(r.submap, r.frame) for r in S.cited_frames(spark.createDataFrame([(2, 0, 5), (1, 1, 7), (2, 0, 9)], c.schema), c, 2).orderBy("place").collect()] == [(2, 0), (1, 1)]


def test_layers_parse_or_are_null(spark):
    df = spark.createDataFrame([('{"objects": [{"id": "a"}]}',), ("{broken",), ('{"other": 1}',), (None,)], "m string")
    assert [r.p is not None for r in df.select(S.parsed_layer(F.col("m"), "objects array<struct<id:string>>").alias("p")).collect()] == [True, False, False, False]


def test_clamping_leaves_tame_scales(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0)] * 3, "scale_0 double, scale_1 double, scale_2 double")
    assert splats.clamped_scales(df, 100.0)[1]["clamp_value"] is None and splats.clamped_scales(df, 100.0)[1]["clamped"] == 0
    out, info = splats.clamped_scales(df, 50.0)
    assert info["clamp_value"] == pytest.approx(1.0) and info["clamped"] == 3 and out.first().scale_2 == pytest.approx(0.0)


def test_pictures_are_found_by_bytes(spark):
    odd = bytes([0x0F, 0xFD, 0x8A, 0x00, 0xFF, 0xD8, 0xFF, 0xE0])
    df = spark.createDataFrame([(1, bytearray(odd)), (2, bytearray(b"\xff\xd7")), (3, None)], "id long, payload binary")
    assert [(r.id, bytes(r.payload)) for r in recordings.pictures(df).collect()] == [(1, odd[4:])]


@pytest.mark.parametrize("version", [1, 2, 3])
def test_packed_splats_with_harmonics(version):
    rng = np.random.default_rng(version)
    n, degree = 5, 2
    head = np.array([archives.MAGIC, version, n], "<u4").tobytes() + bytes([degree, 12, 0, 0])
    place = rng.integers(-(2**20), 2**20, (n, 3))
    packed = rng.normal(0, 1, (n, 3)).astype("<f2").tobytes() if version == 1 else b"".join(int(v).to_bytes(3, "little", signed=True) for v in place.ravel())
    q = rng.normal(0, 1, (n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    turn = b""
    for x in q:  # x, y, z, w
        if version < 3:
            x = x * np.sign(x[3])
            turn += bytes(np.clip(np.round((x[:3] + 1) * 127.5), 0, 255).astype(np.uint8).tolist())
            continue
        k = int(np.argmax(np.abs(x)))
        x = x * np.sign(x[k])
        word = k
        for i in [i for i in range(4) if i != k]:
            word = word << 10 | (x[i] < 0) << 9 | round(abs(x[i]) * np.sqrt(2) * 511)
        turn += int(word).to_bytes(4, "little")
    rest = rng.integers(0, 256, (n, 8, 3), np.uint8)
    raw = head + packed + bytes(n * 7) + turn + rest.tobytes()
    (first, cols, got), = archives.unpacked(raw)
    assert first == 0 and got.shape == (n, 24) and np.allclose(got[:, 8 + 3], (rest[:, 3, 1] - 128.0) / 128)
    assert not cols["nx"].any() and np.allclose(cols["f_dc_0"], -0.5 / 0.15) and np.allclose(cols["scale_1"], -10)
    if version > 1:
        assert np.allclose(np.stack([cols[c] for c in "xyz"], axis=1), place / 4096)
    wxyz = np.stack([cols[f"rot_{i}"] for i in range(4)], axis=1)
    assert np.allclose(np.abs((wxyz[:, [1, 2, 3, 0]] * q).sum(axis=1)), 1, atol=0.02 if version < 3 else 1e-5)
    with pytest.raises(ValueError):
        list(archives.unpacked(raw[:-1]))


def test_transposes_by_column(spark):
    df = spark.createDataFrame([([[1, 2, 3], [4, 5, 6], [7, 8, 9]],)], "m array<array<int>>")
    assert df.select(A.transposed(F.col("m")).alias("t")).first().t == [[1, 4, 7], [2, 5, 8], [3, 6, 9]]


def test_components_of_users(spark):
    rows = [(1, "a", "hold", 1, "j", "r"), (2, "b", "void", 0, "j", "r"), (3, "c", "hold", 1, "j", "s"), (4, "b", "hold", 1, "j", "t"), (5, "d", "settle", 1, "j", "t")]
    df = spark.createDataFrame([(*r, None, None, 0.0) for r in rows], L.COMMANDS)
    assert {r.user_id: r.component for r in L.components_of(df).collect()} == {"a": "a", "b": "a", "d": "a"}
