"""Exports: keyframe tables, grounding and annotation records, robot-learning episodes, track records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.functions import geometry as G


def frame_index(frames: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Each frame that isn't of a loop closure with its place in its scan, by submap and frame."""
    w = W.partitionBy(scan).orderBy("submap_id", "frame_idx")
    return frames.filter("NOT is_lc").withColumn("global_idx", (F.row_number().over(w) - 1).cast("long"))


def keyframes(poses: DataFrame, scan: str = "scan_id") -> DataFrame:
    """The keyframe table from poses (scan, global_idx, ts, frame_id, t array of 3, m row-major rotation of 9, intrinsics of 4 or null).

    state is translation and xyzw rotation; action the translation and rotation vector to the next frame, in
    this frame's axes, zeros for the last; missing intrinsics are zeros, a missing frame_id the index."""
    w = W.partitionBy(scan).orderBy("global_idx")
    m, t = [F.col("m")[i] for i in range(9)], [F.col("t")[i] for i in range(3)]
    n, u = [F.lead("m").over(w)[i] for i in range(9)], [F.lead("t").over(w)[i] for i in range(3)]
    d = [u[i] - t[i] for i in range(3)]
    move = [m[k] * d[0] + m[3 + k] * d[1] + m[6 + k] * d[2] for k in range(3)]
    turn = [sum((m[3 * k + i] * n[3 * k + j] for k in (1, 2)), m[i] * n[j]) for i in range(3) for j in range(3)]
    rows = poses.withColumns({"__move": F.array(*move), "__turn": F.array(*turn), "__last": F.lead("global_idx").over(w).isNull()})
    r = [F.col("__turn")[i] for i in range(9)]
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (r[0] + r[4] + r[8] - 1) / 2)))
    factor = F.when(angle < 1e-8, F.lit(0.5)).otherwise(angle / (2 * F.sin(angle)))
    axis = [(r[7] - r[5]) * factor, (r[2] - r[6]) * factor, (r[3] - r[1]) * factor]
    q = G.quaternion_of(m)
    action = F.when(F.col("__last"), F.array_repeat(F.lit(0.0), 6)).otherwise(F.concat("__move", F.array(*axis)))
    return rows.select(
        F.col(scan), F.col("global_idx").alias("index"), F.col("global_idx").alias("frame_index"), F.lit(0).cast("long").alias("episode_index"),
        F.col("ts").cast("float").alias("timestamp"), F.coalesce(F.col("frame_id"), F.col("global_idx")).cast("float").alias("source_frame_id"),
        F.concat("t", F.array(q["x"], q["y"], q["z"], q["w"])).cast("array<float>").alias("observation.state"), action.cast("array<float>").alias("action"),
        F.coalesce("intrinsics", F.array_repeat(F.lit(0.0), 4)).cast("array<float>").alias("observation.intrinsics"),
    )


def grounding(objects: DataFrame, evidence: DataFrame, detections: DataFrame, index: DataFrame, relations: DataFrame, scan: str = "scan_id") -> DataFrame:
    """One record an object: id, query, frames (its evidence that the index knows, with its own box or else the last detection's), relations to other objects.

    objects (scan, object_id, query), evidence (scan, object_id, submap_id, frame_idx, box), detections (scan, seq,
    submap_id, frame_idx, query, box), relations (scan, a, b, relation, distance)."""
    name = F.lower(F.trim("query"))
    last = detections.filter("box IS NOT NULL").groupBy(scan, "submap_id", "frame_idx", name.alias("name")).agg(F.max_by("box", "seq").alias("det_box"))
    e = evidence.join(objects.select(scan, "object_id", name.alias("name")), [scan, "object_id"]).join(index.select(scan, "submap_id", "frame_idx", "global_idx"), [scan, "submap_id", "frame_idx"])
    e = e.join(last, [scan, "submap_id", "frame_idx", "name"], "left")
    frames = e.groupBy(scan, "object_id").agg(F.array_sort(F.collect_list(F.struct("global_idx", F.coalesce("box", "det_box").alias("box")))).alias("frames"))
    both = relations.select(scan, F.col("a").alias("name"), F.col("b").alias("other"), "relation", "distance").unionByName(relations.select(scan, F.col("b").alias("name"), F.col("a").alias("other"), "relation", "distance"))
    named = objects.select(scan, "object_id", F.col("query").alias("name"))
    other = objects.select(scan, F.col("object_id").alias("other_id"), F.col("query").alias("other"))
    rel = both.join(named, [scan, "name"]).join(other, [scan, "other"]).filter("other_id <> object_id")
    rel = rel.groupBy(scan, "object_id").agg(F.array_sort(F.collect_list(F.struct("other_id", "relation", "distance"))).alias("relations"))
    empty = F.array().cast("array<struct<other_id:bigint,relation:string,distance:double>>")
    out = objects.join(frames, [scan, "object_id"], "left").join(rel, [scan, "object_id"], "left")
    return out.select(scan, "object_id", "query", F.coalesce("frames", F.array().cast(dict(frames.dtypes)["frames"])).alias("frames"), F.coalesce(F.col("relations").cast("array<struct<other_id:bigint,relation:string,distance:double>>"), empty).alias("relations"))


def annotations(first_frames: DataFrame, relations: DataFrame, length: DataFrame, scan: str = "scan_id", reach: int = 3) -> DataFrame:
    """Windows of frames to caption: around each object's first frame, and for each relation over both objects' windows.

    first_frames (scan, query, object_id, frame) may have several objects of a query: a relation takes the first."""
    w = first_frames.join(length, scan).select(scan, "query", "object_id", F.greatest(F.lit(0), F.col("frame") - reach).alias("from"), F.least(F.col("n") - 1, F.col("frame") + reach).alias("to"))
    one = w.groupBy(scan, "query").agg(F.min_by(F.struct("from", "to"), "object_id").alias("w"))
    a, b = one.select(scan, F.col("query").alias("a"), F.col("w").alias("wa")), one.select(scan, F.col("query").alias("b"), F.col("w").alias("wb"))
    r = relations.join(a, [scan, "a"]).join(b, [scan, "b"])
    r = r.select(scan, F.lit("relation").alias("kind"), F.concat_ws(" ", "a", "relation", "b").alias("text"), F.least("wa.from", "wb.from").alias("from"), F.greatest("wa.to", "wb.to").alias("to"))
    return w.select(scan, F.lit("object").alias("kind"), F.col("query").alias("text"), "from", "to").unionByName(r)


def tasks(episodes: DataFrame, text: str, order: str) -> DataFrame:
    """task_index and text of the distinct texts, in order of first appearance."""
    first = episodes.groupBy(text).agg(F.min(order).alias("__first"))
    return first.withColumn("task_index", (F.row_number().over(W.orderBy("__first", text)) - 1).cast("long")).drop("__first")  # distinct instructions: few rows


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines in which missing values are written as null."""
    rows.write.option("ignoreNullFields", "false").json(path)
