"""What the fourth round's review found: neighbours of many points, on small tables against a loop."""

import numpy as np
import pyarrow as pa
import pytest

from cartolith.operators import joins, neighbours


def loop(ids, at, k, step=1):
    """id, rank, neighbour of all pairs, ties to the smaller id; of every step-th point only."""
    out = {}
    for i in range(0, len(ids), step):
        with np.errstate(over="ignore"):
            off = (at - at[i]) ** 2
            off = np.sqrt(off[:, 0] + off[:, 1] + off[:, 2])
        near = [ids[j] for j in np.lexsort((ids, off))[: k + 1] if j != i][:k]
        out |= {(ids[i], r + 1): j for r, j in enumerate(near)}
    return out


def found(spark, ids, at, k, side, crowd):
    df = spark.createDataFrame([(i, *p) for i, p in zip(ids.tolist(), at.tolist(), strict=True)], "id long, x double, y double, z double").repartition(3)
    rows = joins.nearest_neighbours(df, "id", ("x", "y", "z"), k, side, crowd).collect()
    got = {(r.id, r.rank): r.neighbour for r in rows}
    assert len(got) == len(rows)
    return got


def test_neighbours_broadcast_no_table_that_grows(spark):
    """The 27 cells of each of 20,000 points in a plane were broadcast, 540,000 rows by an estimate of far less: more than 48 MB (an empty table takes a page, 32 MB)."""
    rng = np.random.default_rng(4)
    ids, at = rng.permutation(20_000), np.column_stack([rng.uniform(-10, 100, 20_000).round(4), rng.integers(0, 25, 20_000), np.zeros(20_000)])
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48m")
    try:
        got = found(spark, ids, at, 3, 8.0, 512)
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)
    assert len(got) == 60_000
    want = loop(ids, at, 3, 97)
    assert {key: got[key] for key in want} == want


@pytest.mark.parametrize("kind", ["lattice", "crowds", "far apart"])
def test_neighbours_by_blocks(spark, monkeypatch, kind):
    """Tiles dealt out in blocks of a few points, with no short cut but for the last: ties at a cell's very side, copies, cells too crowded to be cut, large numbers."""
    for limit, value in (("PLACES", 7), ("OTHERS", 11), ("ROWS", 60), ("TILES", 3)):
        monkeypatch.setattr(neighbours, limit, value)
    monkeypatch.setattr(joins, "FEW", 5000)
    rng = np.random.default_rng(5)
    at = {
        "lattice": np.stack(np.meshgrid(np.arange(-6, 6), np.arange(-5, 4), [0.0, 1.0]), -1).reshape(-1, 3).astype(float),
        "crowds": np.concatenate([rng.normal(0, 1e-4, (60, 3)), np.repeat(rng.normal(0, 30, (20, 3)), 5, axis=0), 3.0 + np.arange(40)[:, None] * [2.0**-20, 0, 0], [[1e12, 0, 0]]]),
        "far apart": np.concatenate([rng.normal(0, 1, (50, 3)), rng.normal(0, 1, (30, 3)) + 1e12, [[1e200, 0, 0], [-1e200, 1, 0], [1.5e308, 0, 0], [-1.5e308, 0, 0]]]),
    }[kind]
    ids = rng.permutation(len(at))
    assert found(spark, ids, at, 3, 1.0, 4) == loop(ids, at, 3)


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_nearest_of_a_group_of_tiles(monkeypatch, held):
    """Rows of several tiles in one group, a tile sent twice as two shares: each part meets its own rows only."""
    monkeypatch.setattr(neighbours, "HELD", held)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 80, (200, 3)) / 10
    part = rng.integers(0, 3, 200)
    cell = (np.floor(x).astype(int) + 1) @ [100, 10, 1]
    columns = {**{c: x[:, i] for i, c in enumerate("xyz")}, **dict.fromkeys(("t0", "t1", "t2"), np.zeros(200, np.int64)), "share": part, "block": part * 0, "cell": cell}
    got = neighbours._nearest(pa.table(columns), pa.table(columns | {"neighbour": np.arange(200)}), 3).to_pylist()
    want = []
    for i in range(200):
        met = np.flatnonzero((part == part[i]) & (np.abs(np.floor(x) - np.floor(x[i])) <= 1).all(axis=1))
        off = np.sqrt(((x[met] - x[i]) ** 2).sum(axis=1))
        want += [(*x[i], m) for m in met[np.lexsort((met, off))][:3]]
    assert sorted((r["x"], r["y"], r["z"], r["neighbour"]) for r in got) == sorted(want)
