"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master (only) gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='cartolith-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's own retention rule clears it
        return


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: lineage ends there, and lost executors don't matter.

    The table goes when the driver's process ends, or before with dropped()."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of kept() that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._kept_at)


def width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition()."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bytes, as text, up to which a table is broadcast to meet every row of another.
BROADCAST_BYTES = 32 << 20


def with_each(many: DataFrame, few: DataFrame) -> DataFrame:
    """Each row of many with each row of few.

    few is written and its rows' bytes are added up. Up to BROADCAST_BYTES it is broadcast; beyond that both are
    dealt out as a grid of blocks that meet by equality, so that no task holds all of few."""
    few = kept(few, "few")
    # 16 bytes a column stand for what numbers, offsets and the row itself take
    size = few.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16 * len(few.columns))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return many.join(F.broadcast(few))
    blocks = -(-2 * size // BROADCAST_BYTES)
    shares = max(1, width(many.sparkSession) // blocks)
    left = many.withColumns({"__share": F.pmod(F.xxhash64(*many.columns), F.lit(shares)), "__block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))})
    right = few.withColumns({"__share": F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")), "__block": F.pmod(F.xxhash64(*few.columns), F.lit(blocks))})
    return left.join(right, ["__share", "__block"]).drop("__share", "__block")


#: Bins of one narrowing pass, and values of an order statistic's bin that are sorted at last.
BINS, SORTED = 4096, 100_000


def exact_percentiles(rows: DataFrame, values: dict[str, Column], shares: list[float]) -> tuple[int, dict[str, list[float | None]]]:
    """Rows, and of each named value the exact linear percentiles, without holding the values anywhere.

    Histograms narrow the range of each order statistic until its bin is small; the driver sees bins' counts and
    the values of small bins. Values must be finite; nulls don't count."""
    names = list(values)
    flat = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), values[c].cast("double").alias("v")) for i, c in enumerate(names)])).alias("s")).select("s.i", "s.v")
    ends = rows.agg(F.count("*").alias("n"), *[f(values[c].cast("double")).alias(f"{p}{i}") for i, c in enumerate(names) for p, f in (("n", F.count), ("l", F.min), ("h", F.max))]).first()
    wanted: dict[tuple[int, int], tuple[float, float, int]] = {}  # (value, rank): (low, high, values below low)
    for i in range(len(names)):
        for s in shares:
            at = (ends[f"n{i}"] - 1) * s
            for rank in {int(at), min(int(at) + 1, ends[f"n{i}"] - 1)}:
                if ends[f"n{i}"]:
                    wanted[i, rank] = (ends[f"l{i}"], ends[f"h{i}"], 0)
    found: dict[tuple[int, int], float] = {}
    while wanted:
        for key, (low, high, _) in list(wanted.items()):
            if low == high:
                found[key] = low
                del wanted[key]
        spans = sorted({(i, low, high) for (i, _), (low, high, _) in wanted.items()})
        if not spans:
            break
        table = rows.sparkSession.createDataFrame([(k, i, low, high) for k, (i, low, high) in enumerate(spans)], "k int, i int, low double, high double")
        inside = flat.join(F.broadcast(table), "i").filter("v BETWEEN low AND high")
        place = F.least(F.floor((F.col("v") - F.col("low")) / ((F.col("high") - F.col("low")) / BINS)), F.lit(BINS - 1))
        bins = inside.groupBy("k", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counted: dict[int, list] = {}
        for r in bins.orderBy("k", "bin").collect():
            counted.setdefault(r["k"], []).append(r)
        small = []
        for (i, rank), (low, high, below) in list(wanted.items()):
            k = spans.index((i, low, high))
            for r in counted[k]:
                if rank < below + r["n"]:
                    wanted[i, rank] = (r["lo"], r["hi"], below)
                    if r["lo"] != r["hi"] and r["n"] <= SORTED // max(1, len(spans)):
                        small.append((i, rank))
                    break
                below += r["n"]
        if small:
            spots = sorted({(i, *wanted[i, rank][:2]) for i, rank in small})
            table = rows.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(spots)], "k int, i int, low double, high double")
            held: dict[int, list[float]] = {}
            for r in flat.join(F.broadcast(table), "i").filter("v BETWEEN low AND high").select("k", "v").collect():
                held.setdefault(r["k"], []).append(r["v"])
            for i, rank in small:
                low, high, below = wanted.pop((i, rank))
                found[i, rank] = sorted(held[spots.index((i, low, high))])[rank - below]
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        out[c] = []
        for s in shares:
            at = (ends[f"n{i}"] - 1) * s
            if not ends[f"n{i}"]:
                out[c].append(None)
                continue
            low, high = found[i, int(at)], found[i, min(int(at) + 1, ends[f"n{i}"] - 1)]
            out[c].append(low + (at - int(at)) * (high - low))
    return ends["n"], out


def even_hash(*by: str) -> Column:
    """A number in [0, 1) of 52 bits of md5 over the columns' texts."""
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in by]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def smallest(rows: DataFrame, by: Column, order: list[str], n: int) -> DataFrame:
    """The n rows of the smallest finite by, of equal ones those of the smaller even_hash() of order, then those first by order; all rows, if there are no more.

    Histograms narrow the range that the last of them lies in until few rows are left there, so no task gets n rows.
    rows are read once a round. Rows whose by is null or not finite come last."""
    held = rows.withColumn("__by", F.coalesce(F.when(F.abs(by.cast("double")) < float("inf"), by.cast("double")), F.lit(1.7e308)))
    ends = held.agg(F.count("*").alias("n"), F.min("__by").alias("low"), F.max("__by").alias("high")).first()
    if ends["n"] <= n:
        return rows
    (m, low, high), below = ends, 0  # the last row to stay is one of m whose by lies in low to high, and follows below rows of smaller by
    while m > SORTED and low < high:
        # halves first: the ends' difference may be too large for a double
        share = (F.col("__by") / 2 - low / 2) / (high / 2 - low / 2)
        place = F.least(F.floor(share * BINS), F.lit(BINS - 1))
        for r in held.filter(F.col("__by").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("__by").alias("low"), F.max("__by").alias("high")).orderBy("bin").collect():
            if n <= below + r["n"]:
                m, low, high = r["n"], r["low"], r["high"]
                break
            below += r["n"]
    inside = held.filter(F.col("__by").between(low, high))
    if m > SORTED and "__tied" not in rows.columns:  # all of one by
        rest = smallest(inside.drop("__by").withColumn("__tied", F.lit(True)), even_hash(*order), order, n - below).drop("__tied")
    else:
        rest = inside.orderBy("__by", even_hash(*order), *order).limit(n - below).drop("__by")
    return held.filter(F.col("__by") < low).drop("__by").unionByName(rest)
