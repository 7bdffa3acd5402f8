"""NPZ archives against numpy: ranges, deflated members, refusals, writing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.sources import npz


@pytest.fixture
def source(spark):
    spark.dataSource.register(npz.NpzSource)
    return spark.read.format("npz")


def arrays(n=5000):
    rng = np.random.default_rng(1)
    return {"positions": rng.normal(size=(n, 3)).astype("f4"), "colors": rng.integers(0, 256, (n, 3)).astype("u1"), "poses": rng.normal(size=(n, 4, 4)), "frame": np.arange(n).astype(">i4"), "good": rng.random(n) < 0.5}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives_are_read_in_ranges(spark, source, tmp_path, monkeypatch, save):
    a = arrays()
    save(tmp_path / "a.npz", **a)
    df = source.option("path", str(tmp_path / "a.npz")).option("rows", "700").load()
    assert df.schema.simpleString() == "struct<positions:array<float>,colors:array<smallint>,poses:array<double>,frame:int,good:boolean>"
    assert df.rdd.getNumPartitions() == (8 if save is np.savez else 1)
    rows = sorted(df.collect(), key=lambda r: r.frame)
    for c, x in a.items():
        assert np.array_equal(np.array([r[c] for r in rows], x.dtype), x.reshape(len(x), -1) if x.ndim > 1 else x)


def test_only_wanted_columns_are_read(spark, source, tmp_path):
    a = arrays(50)
    np.savez(tmp_path / "a.npz", other=np.zeros((7, 2)), **a)
    with pytest.raises(Exception, match="unequal lengths"):
        source.option("path", str(tmp_path / "a.npz")).load()
    df = source.option("path", str(tmp_path / "a.npz")).option("columns", "frame,positions").load()
    assert df.columns == ["frame", "positions"] and df.count() == 50
    lone = spark.read.format("npz").schema("good boolean").option("path", str(tmp_path / "a.npz")).load()
    assert lone.filter("good").count() == int(a["good"].sum())
    with pytest.raises(Exception, match="has no nothing"):
        source.option("path", str(tmp_path / "a.npz")).option("columns", "nothing").load()


def test_refusals(source, tmp_path):
    np.savez(tmp_path / "a.npz", **arrays(500))
    whole = (tmp_path / "a.npz").read_bytes()
    (tmp_path / "cut.npz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "text.npz").write_bytes(b"not an archive")
    np.savez(tmp_path / "objects.npz", a=np.array([{}, None], dtype=object))
    np.savez(tmp_path / "columns.npz", a=np.asfortranarray(np.zeros((4, 3))))
    for name, why in (("cut", "cut short"), ("text", "not an NPZ file"), ("objects", "isn't supported"), ("columns", "no rows to read")):
        with pytest.raises(ValueError, match=why):
            npz.members(str(tmp_path / f"{name}.npz"))
    (tmp_path / "points.bin").write_bytes(b"\0" * 29)
    with pytest.raises(ValueError, match="cut short"):
        npz.flat_members(str(tmp_path / "points.bin"), 2)


def test_old_buffers_are_read_and_moved_back(spark, source, tmp_path):
    a = arrays(1000)
    (tmp_path / "points.bin").write_bytes(a["positions"].tobytes() + a["colors"].tobytes())
    df = source.option("path", str(tmp_path / "points.bin")).option("flat", "1000").option("rows", "300").load()
    moved = df.select(F.zip_with("positions", F.array(*map(F.lit, (1.0, 2.0, 3.0))), lambda p, c: (p + c).cast("float")).alias("p"), "colors").collect()
    assert df.rdd.getNumPartitions() == 4
    got = sorted((tuple(r.p), tuple(r.colors)) for r in moved)
    assert np.allclose([g[0] for g in got], sorted((a["positions"] + np.array([1, 2, 3], "f4")).tolist()), atol=1e-5)


@pytest.mark.parametrize("deflated", ["true", "false"])
def test_round_trip(spark, source, tmp_path, monkeypatch, deflated):
    a = arrays(3000)
    df = spark.createDataFrame([(int(f), p.tolist(), bool(g)) for f, p, g in zip(a["frame"], a["positions"], a["good"], strict=True)], "frame int, positions array<float>, good boolean").repartition(3)
    df.write.format("npz").option("path", str(tmp_path / "out")).option("deflated", deflated).mode("append").save()
    back = source.option("path", str(tmp_path / "out")).load()
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect())) and len(list((tmp_path / "out").glob("*.npz"))) == 3


def test_a_file_for_each_frame(spark, source, tmp_path):
    a = arrays(600)
    df = spark.createDataFrame([(int(f) % 5, p.tolist(), bool(g)) for f, p, g in zip(a["frame"], a["positions"], a["good"], strict=True)], "frame int, points array<float>, mask boolean")
    by = lambda d: d.write.format("npz").option("path", str(tmp_path / "frames")).option("by", "frame").mode("append").save()
    by(df.repartition(3, "frame").sortWithinPartitions("frame"))
    for k in range(5):
        with np.load(tmp_path / "frames" / f"{k}.npz") as z:
            assert sorted(map(tuple, z["points"].tolist())) == sorted(map(tuple, a["positions"][a["frame"] % 5 == k].tolist())) and z["mask"].sum() == a["good"][a["frame"] % 5 == k].sum()
    with pytest.raises(Exception, match="must follow each other"):
        by(df.coalesce(1))
