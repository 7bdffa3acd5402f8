"""What the training-data operators share: tables in the cluster's shared folder and word arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of bytes outside space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="cartolith-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session is gone already; the cluster's retention rule clears the folder
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and gives the planner exact sizes.

    The folder goes when the driver's process ends, or before with dropped()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables from written() that nothing will read again."""
    for df in tables:
        _drop(df.sparkSession, df._written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than one in HOT of all rows is hot: fewer than HOT keys can be.
HOT = 10_000


def joined_by_weight(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """left joined with right, which holds each of keys at most once and in column rows how many rows of left have it.

    Hot keys, fewer than HOT of them, are broadcast, so that no task gets all rows of one; the others meet in a
    shuffle. Null keys don't match. left is read twice."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot, cold = (right.filter(x).drop(rows) for x in (F.col(rows) * HOT > F.lit(total), F.col(rows) * HOT <= F.lit(total)))
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition()."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def byte_rows(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads low-order structure over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of a text given as uint8."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _SPACE[raw]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[0::2], turn[1::2]


class _WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, 42)
        return found


_KNOWN = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word's bytes. Equal hashes don't prove equal words: use them to find candidates only."""
    if len(_KNOWN) > REMEMBERED:
        _KNOWN.clear()
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size word hashes, by doubling: runs of 1, 2, 4 ... are joined and mixed."""
    have, now = 1, words
    while have < size:
        step = min(have, size - have)
        if len(now) <= step:
            return np.empty(0, np.uint64)
        now = mixed(now[:-step] * np.uint64(0x9E3779B97F4A7C15) + now[step:] + np.uint64(step))
        have += step
    return now


def word_ids(words: list[bytes], ordered: bool = False) -> tuple[np.ndarray, int]:
    """A number for each word, the same for equal words only, and how many there are; ordered: in the words' order."""
    distinct = dict.fromkeys(words)
    number = {w: i for i, w in enumerate(sorted(distinct) if ordered else distinct)}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), len(number)


def run_ranks(ids: np.ndarray, size: int) -> np.ndarray:
    """The rank of each run of size ids among all runs, in lexicographic order; equal runs, and only they, share one."""
    have, now = 1, ids
    while have < size:
        step = min(have, size - have)
        if len(now) <= step:
            return np.empty(0, np.int64)
        now = np.unique(now[:-step] * (int(now.max()) + 1) + now[step:], return_inverse=True)[1]
        have += step
    return now


def covered(flags: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of size words whose start is flagged."""
    step = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(flags)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def col(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(docs: DataFrame, names: list[str]) -> Column:
    """The named columns as one struct called row, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[col(c) for c in names]).alias("row")


def of_row(names: list[str]) -> list[Column]:
    """What as_row() packed, as columns again."""
    return [F.col("row").getField(c).alias(c) for c in names]


def row_keys() -> list[Column]:
    """k1 and k2, 128 bits of doc_id and text that tell rows apart; rows that share both share them."""
    return [F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.lit(0), F.col("text").cast("string")).alias(k) for seed, k in ((1, "k1"), (2, "k2"))]


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits of md5 over the parts joined by ':'; DuckDB can compute it too."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
