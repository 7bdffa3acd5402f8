import gzip
import json
import math
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.sources import archives, exports, ply, recordings, trajectories


def test_tum_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# comment\n\n2.0 1 2 3 0 0 0 1\n1.0 1 2 3 0 0 0 1 extra\n9 9\n")
    df = trajectories.read_tum(spark, str(tmp_path / "in"))
    assert [r.ts for r in df.orderBy("ts").collect()] == [1.0, 2.0] and trajectories.read_tum(spark, str(tmp_path / "in"), exact=True).count() == 1
    trajectories.write_tum(df.withColumn("traj_id", F.lit("t")), str(tmp_path / "out"))
    assert trajectories.read_tum(spark, str(tmp_path / "out" / "traj_id=t")).count() == 2


def test_unique_names(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 1.0, 1), ("a", 1.000001, 2), ("a", 2.5, 3)], "k string, ts double, i int")
    names = [r.name for r in trajectories.unique_names(df, "k", "ts", "i").orderBy("i").collect()]
    assert names == ["1.000000", "1.000001", "1.000002", "2.500000"]


def recording(path, pose):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE _streams (name TEXT, config TEXT)")
        db.executemany("INSERT INTO _streams VALUES (?, ?)", [("cam", json.dumps({"codec_id": "jpeg"})), ("gone", "{}")])
        db.execute("CREATE TABLE cam (id INTEGER, ts REAL, value BLOB, pose_x REAL, pose_y REAL, pose_z REAL, pose_qx REAL, pose_qy REAL, pose_qz REAL, pose_qw REAL, tags TEXT)")
        db.execute("CREATE TABLE cam_blob (id INTEGER, data BLOB)")
        for i in range(12):
            p = [i * 0.1, 0, 0, 0, 0, 0, 1] if pose else [None] * 7
            db.execute(f"INSERT INTO cam VALUES ({', '.join('?' * 11)})", (i, i / 15, b"", *p, ""))
            db.execute("INSERT INTO cam_blob VALUES (?, ?)", (i, b"head" * 2 + b"\xff\xd8picture" + struct.pack(">7d", 5.0 + i, 0, 0, 0, 0, 0, 1)))


@pytest.mark.parametrize("pose,first", [(True, 0.0), (False, 5.0)])
def test_recordings(spark, tmp_path, pose, first):
    recording(tmp_path / "r.db", pose)
    rows = recordings.read_recordings(spark, str(tmp_path / "r.db"))
    cat = {r.stream: r for r in recordings.stream_catalogue(rows).collect()}
    assert cat["cam"].n == 12 and cat["cam"].codec == "jpeg" and cat["gone"].n == 0 and cat["gone"].span_s == 0
    poses = recordings.poses(rows.filter("stream = 'cam'"))
    got = poses.orderBy("ts").collect()
    assert len(got) == 12 and got[0].pose[0] == first
    assert recordings.manifest(poses).first().usable
    assert recordings.pictures(rows.filter("stream = 'cam'")).first().payload[:2] == b"\xff\xd8"


def test_ply_round_trip(spark, tmp_path):
    spark.dataSource.register(ply.PlySource)
    df = spark.range(1000).select(*[(F.col("id") * k).cast("float").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))], (F.col("id") % 256).cast("short").alias("red"))
    df.repartition(3).write.format("ply").option("bytes", "red").mode("append").save(str(tmp_path / "cloud"))
    back = spark.read.format("ply").option("rows", "100").load(str(tmp_path / "cloud"))
    assert back.count() == 1000 and back.rdd.getNumPartitions() >= 9 and back.filter("y <> 2 * x OR z <> 3 * x OR red <> cast(x as int) % 256").count() == 0
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty uchar red\nend_header\n1.5 7\n2.5 8\n")
    assert [tuple(r) for r in spark.read.format("ply").load(str(tmp_path / "a.ply")).collect()] == [(1.5, 7), (2.5, 8)]
    assert ply.missing_properties(str(tmp_path / "a.ply"), ["x", "opacity"]) == ["opacity"]


@pytest.mark.parametrize("data", [b"nope", b"ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nend_header\nxx", b"ply\nformat binary_big_endian 1.0\nend_header\n"])
def test_bad_ply(tmp_path, data):
    (tmp_path / "b.ply").write_bytes(data)
    with pytest.raises(ValueError):
        ply.header(str(tmp_path / "b.ply"))


def test_zip_checks(spark, tmp_path):
    for name, members in (("good", ["meta.json", "frames/1.jpg"]), ("unsafe", ["../x", "meta.json"]), ("short", ["meta.json"])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for m in members:
                z.writestr(m, "12345")
    (tmp_path / "no.zip").write_bytes(b"text")
    got = {r.path.rsplit("/")[-1]: r for r in archives.check_zips(spark, str(tmp_path / "*.zip"), ["meta.json"], ["frames/"]).collect()}
    assert got["good.zip"].error is None and got["good.zip"].bytes == 10 and got["unsafe.zip"].error == "unsafe member ../x" and got["short.zip"].error == "missing frames/" and got["no.zip"].error == "not a zip"


def test_messages(spark):
    head = json.dumps({"op": "x", "blobs": [2, 3]}).encode()
    good = struct.pack(">I", len(head)) + head + b"abcde"
    df = spark.createDataFrame([(good,), (good + b"!",), (b"\0",), (struct.pack(">I", 99) + b"{}",)], "data binary")
    got = [r.m for r in df.select(archives.decoded_message(F.col("data")).alias("m")).collect()]
    assert bytes(got[0].body) == b"abcde" and [g.error for g in got] == [None, "sizes do not add up", "too short", "header past the end"]


def test_reassembly(spark):
    rows = [("a", 1, True, b"lo"), ("a", 0, False, b"hel"), ("b", 0, False, b"x"), ("b", 2, True, b"y"), ("c", 0, False, b"z")]
    got = {r.k: r for r in archives.reassembled(spark.createDataFrame(rows, "k string, seq int, last boolean, fragment binary"), "k").collect()}
    assert bytes(got["a"].data) == b"hello" and got["b"].data is None and got["b"].error == got["c"].error == "parts missing or out of order"
    assert archives.reassembled(spark.createDataFrame(rows, "k string, seq int, last boolean, fragment binary"), "k", most_bytes=4).filter("error = 'too large'").count() == 1


@pytest.mark.parametrize("version", [1, 2, 3])
def test_packed_splats(spark, tmp_path, version):
    n, bits = 3, 12
    xyz = np.array([[0, 1, -1], [2.5, -3.25, 4], [0.5, 0.25, -0.125]])
    place = xyz.astype("<f2").tobytes() if version == 1 else b"".join(int(v * (1 << bits)).to_bytes(3, "little", signed=True) for v in xyz.ravel())
    turn = np.full((n, 4), 0, np.uint8)
    turn[:, 3] = 3 << 6  # the largest is w, the others 0
    raw = struct.pack("<III", 0x5053474E, version, n) + bytes([0, bits, 0, 0]) + place + bytes([0, 128, 255]) + bytes([128] * 9) + bytes([160] * 9) + (turn.tobytes() if version == 3 else bytes([128, 127, 128] * n))
    (tmp_path / "s.spz").write_bytes(gzip.compress(raw))
    rows = archives.read_spz(spark, str(tmp_path / "s.spz")).orderBy("i").collect()
    assert [[r.x, r.y, r.z] for r in rows] == xyz.tolist() and rows[0].scale_0 == 0.0
    assert rows[0].opacity == pytest.approx(math.log((1 / 512) / (1 - 1 / 512)), rel=1e-5) and rows[2].opacity > 6 and rows[0].rot_0 == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValueError):
        list(archives.unpacked(raw[:-1]))


def test_keyframes_and_grounding(spark):
    c, s = math.cos(0.3), math.sin(0.3)
    eye, turned = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0]
    poses = spark.createDataFrame([("a", 0, 0.0, None, [0.0] * 3, eye, None), ("a", 1, 0.1, 7, [1.0, 0.0, 0.0], turned, [1.0, 1.0, 2.0, 2.0])], "scan_id string, global_idx long, ts double, frame_id long, t array<double>, m array<double>, intrinsics array<double>")
    rows = exports.keyframes(poses).orderBy("index").collect()
    assert rows[0].action == pytest.approx([1, 0, 0, 0, 0, 0.3], abs=1e-6) and rows[1].action == [0.0] * 6 and rows[0]["observation.intrinsics"] == [0.0] * 4 and rows[1].source_frame_id == 7
    frames = spark.createDataFrame([("a", 0, i, False) for i in range(3)] + [("a", 1, 0, True)] + [("a", 2, i, False) for i in range(2)], "scan_id string, submap_id int, frame_idx int, is_lc boolean")
    index = exports.frame_index(frames)
    assert {(r.submap_id, r.frame_idx): r.global_idx for r in index.collect()} == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (2, 0): 3, (2, 1): 4}
    objects = spark.createDataFrame([("a", 0, "Laptop"), ("a", 1, "monitor"), ("a", 2, "ghost")], "scan_id string, object_id long, query string")
    evidence = spark.createDataFrame([("a", 0, 0, 1, None), ("a", 0, 2, 0, [9.0] * 4), ("a", 2, 99, 0, None)], "scan_id string, object_id long, submap_id int, frame_idx int, box array<double>")
    seen = spark.createDataFrame([("a", 0, 0, 1, "laptop", [1.0] * 4), ("a", 1, 0, 1, " LAPTOP", [2.0] * 4)], "scan_id string, seq int, submap_id int, frame_idx int, query string, box array<double>")
    rel = spark.createDataFrame([("a", "Laptop", "monitor", "near", 0.5)], "scan_id string, a string, b string, relation string, distance double")
    got = {r.query: r for r in exports.grounding(objects, evidence, seen, index, rel).collect()}
    assert [(f.global_idx, f.box) for f in got["Laptop"].frames] == [(1, [2.0] * 4), (3, [9.0] * 4)] and got["ghost"].frames == [] and got["monitor"].relations[0].other_id == 0
    first = spark.createDataFrame([("a", "Laptop", 0, 1), ("a", "monitor", 1, 9)], "scan_id string, query string, object_id long, frame long")
    notes = exports.annotations(first, rel, spark.createDataFrame([("a", 11)], "scan_id string, n long")).collect()
    assert {(n.kind, n["from"], n.to) for n in notes} == {("object", 0, 4), ("object", 6, 10), ("relation", 0, 10)}
