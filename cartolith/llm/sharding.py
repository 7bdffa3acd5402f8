"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group and go to one shard. What is packed is a bounded number of items,
whatever the table's size: each group that is large against a shard is an item of its own, and the rest
are gathered by a hash of the text into UNITS units. Items, largest first, go to the shard where the dot
product of the item with the residual capacity is highest. Only the items' three sums reach the driver:
UNITS units and at most 3 * UNITS large groups, with their pieces.

A group that is larger than half a shard's capacity can't be balanced whole; its rows are numbered and dealt
out in pieces by their numbers, and the column split tells so.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import WORD, written

#: Units that the small groups are gathered into.
UNITS = 8192
#: Rows numbered within one task.
SLOT_ROWS = 50_000
#: Weights of bytes, tokens and rows in the dot product. Bytes lead, as the law that holds is theirs.
WEIGHTS = (8.0, 1.0, 1.0)
#: How far, in shares of a shard, bytes may be over the mean for the sake of tokens and rows.
SLACK = 0.01


def pack(items: np.ndarray, shards: int, weights: tuple[float, float, float] = WEIGHTS, slack: float = SLACK) -> np.ndarray:
    """The shard of each item, a row of bytes, tokens and rows; ties go to the smaller shard.

    An item goes where its dot product with the residual capacity is highest, of the shards whose bytes stay
    within the mean and slack; if there is none, of all."""
    capacity = np.maximum(items.sum(axis=0) / shards, 1e-12)
    loads = items / capacity * np.sqrt(weights)
    room = (1 + slack) * np.sqrt(weights[0])
    residual = np.tile(np.sqrt(weights), (shards, 1))
    where = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -loads.max(axis=1))):
        match = residual @ loads[i]
        fits = residual[:, 0] - loads[i, 0] >= np.sqrt(weights[0]) - room
        where[i] = s = int(np.argmax(np.where(fits, match, -np.inf) if fits.any() else residual[:, 0]))
        residual[s] -= loads[i]
    return where


def shard(docs: DataFrame, shards: int = 16, units: int = UNITS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), tokens, split.

    size is the text's UTF-8 bytes plus 1 (null text: 1). The law that holds is `bytes`: sizes near equal.
    slot counts from 0 without gaps within a shard. tokens is the text's words. split is true where a group of
    equal texts was too large for one shard. A null text counts as an empty one, for its group too. Rows with
    equal or null doc_id each keep a row. Other columns of docs are left aside; an empty table gives an empty
    result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.xxhash64(text).alias("grp"),
        # the number becomes a row's identity once it is written: (task, row of that task)
        F.monotonically_increasing_id().alias("number"),
    )
    rows = written(rows, "shard-rows")
    loads = [F.sum("size").cast("double").alias("size"), F.sum("tokens").cast("double").alias("tokens"), F.count("*").cast("double").alias("rows")]
    total = rows.agg(*loads).first()
    total = [max(x or 0.0, 1.0) for x in total]
    groups = rows.groupBy("grp").agg(*loads)
    share = F.greatest(*[F.col(c) / t for c, t in zip(("size", "tokens", "rows"), total, strict=True)])
    pieces = F.when(share > 0.5 / shards, F.ceil(share * 16 * shards)).otherwise(1).cast("int")
    large = written(groups.filter(share > 1.0 / units).withColumn("pieces", pieces), "large-groups")
    # at most 3 * units groups pass the bound above, so this side's size is proven
    marked = rows.join(F.broadcast(large.select("grp", "pieces")), "grp", "left")
    unit = F.when(F.col("pieces").isNull(), F.pmod("grp", F.lit(units)))
    # each task deals its rows of a group in turn, and begins elsewhere than the others
    turn = F.pmod(F.xxhash64(F.shiftright("number", 33)), F.col("pieces")) + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    piece = F.when(F.col("pieces") > 1, F.pmod(turn, "pieces").cast("int")).otherwise(0)
    marked = marked.select("doc_id", "size", "text_crc32", "tokens", "number", unit.alias("unit"), F.when(F.col("pieces").isNotNull(), F.col("grp")).alias("own"), piece.alias("piece"), F.coalesce(F.col("pieces") > 1, F.lit(False)).alias("split"))
    items = marked.groupBy("unit", "own", "piece").agg(*loads).orderBy("unit", "own", "piece").collect()
    where = pack(np.array([[r["size"], r["tokens"], r["rows"]] for r in items], float).reshape(-1, 3), shards)
    schema = T.StructType([T.StructField("unit", T.LongType()), T.StructField("own", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    placed = docs.sparkSession.createDataFrame([(r["unit"], r["own"], r["piece"], int(s)) for r, s in zip(items, where, strict=True)], schema)
    m, p = marked.alias("m"), F.broadcast(placed).alias("p")
    same = F.col("m.unit").eqNullSafe(F.col("p.unit")) & F.col("m.own").eqNullSafe(F.col("p.own")) & (F.col("m.piece") == F.col("p.piece"))
    sharded = m.join(p, same).select("doc_id", "size", "text_crc32", "tokens", "number", "split", "shard")
    return _slots(sharded, max(1, int(total[2]) // SLOT_ROWS)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens", "split"
    )


def _slots(rows: DataFrame, buckets: int) -> DataFrame:
    """Numbers the rows of each shard from 0: within hash buckets, then from where each bucket starts."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(buckets)))
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "number")) - 1
    numbered = rows.withColumn("within", within)
    return numbered.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("within")).cast("long"))
