"""Trajectory and index text files: `ts tx ty tz qx qy qz qw` by line, and `ts path`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """traj_id (the file's path) and the fields of every line that is neither blank nor a comment."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("traj_id"), F.trim("value").alias("line"))
    return lines.filter("line <> '' AND NOT line LIKE '#%'").select("traj_id", F.split("line", r"\s+").alias("f"))


def read_tum(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """traj_id and the eight numbers of lines with at least eight fields (exact: with eight). Order by ts where order matters."""
    lines = _lines(spark, path)
    lines = lines.filter(F.size("f") == 8 if exact else F.size("f") >= 8)
    return lines.select("traj_id", *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(FIELDS)])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """traj_id, ts, path of lines with two fields or more."""
    return _lines(spark, path).filter(F.size("f") >= 2).select("traj_id", F.col("f")[0].cast("double").alias("ts"), F.col("f")[1].alias("path"))


def write_tum(rows: DataFrame, path: str, traj: str = "traj_id") -> None:
    """One folder of text files a trajectory, `%.6f` fields; lines within a file are in order of ts."""
    line = F.concat_ws(" ", *[F.format_string("%.6f", F.col(c).cast("double")) for c in FIELDS])
    rows.repartition(F.col(traj)).sortWithinPartitions(traj, "ts").select(F.col(traj), line.alias("value")).write.partitionBy(traj).text(path)


def unique_names(frames: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """frames with name, `%.6f` of ts; of frames in the same microsecond the later ones take the next free microseconds.

    In order of ts a frame's number is at least its own microsecond and one more than the frame's before: the
    running maximum of (microsecond - position) plus position."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(ts, order)
    micro, at = F.bround(F.col(ts) * 1e6).cast("long"), F.row_number().over(w)
    number = F.max("__off").over(w) + F.col("__at")
    placed = frames.withColumn("__at", at).withColumn("__off", micro - F.col("__at"))
    return placed.withColumn("name", F.format_string("%d.%06d", F.floor(number / 1_000_000), number % 1_000_000)).drop("__at", "__off")
