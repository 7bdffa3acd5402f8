"""Queries that run as streams or as batches of upserts over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartolith.operators.shared import folder, kept
from cartolith.plans.tables import table
from cartolith.sources.versions import VersionedTable
from cartolith.streaming import stateful


def _drained(stream, name):
    """What a stream over all that is there gives, as a table."""
    at = f"{folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def _events(spark, d):
    # a pattern, as a stream of a single file by its name is refused
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


def stream_windows(spark, d):
    """Windows of 4 + 1 events of each user; a purchase ends a session and flushes its unfinished window."""
    rows = _events(spark, d).withColumn("stop", F.col("event_type") == "purchase")
    return _drained(stateful.windows(rows, "user_id", "event_id", 4, 1, stop="stop"), "windows").withColumn("members", F.array_join("members", ","))


WINDOWS = """
WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS stop FROM events),
s AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS session FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY event_id) - 1 AS pos, count(*) OVER g AS m, bool_or(stop) OVER g AS stopped FROM s WINDOW g AS (PARTITION BY user_id, session)),
w AS (SELECT user_id, session, m, stopped, unnest(range(0, m)) AS k FROM r WHERE pos = 0),
k AS (SELECT user_id, session, k, m < 4 * k + 5 AS partial FROM w WHERE m >= 4 * k + 5 OR (stopped AND m - 4 * k >= 2)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session, k) - 1 AS "window" FROM k)
SELECT n.user_id, n."window", string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS members, n.partial
FROM n JOIN r ON n.user_id = r.user_id AND n.session = r.session AND r.pos BETWEEN 4 * n.k AND 4 * n.k + 4 GROUP BY ALL
"""


def stream_key_frames(spark, d):
    """Of each user the events whose value is more than 40 from the last one that was admitted; errors count as badly tracked and are admitted always."""
    rows = _events(spark, d).withColumn("tracked", F.when(F.col("event_type") == "error", 3).otherwise(50))
    return _drained(stateful.key_frames(rows, "user_id", "event_id", "value", "tracked", 40.0), "key-frames")


KEY_FRAMES = """
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, value, event_type = 'error' AS lost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
k(user_id, event_id, value, i, last, admitted) AS (SELECT user_id, event_id, value, i, value, true FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.value, e.i, CASE WHEN lost OR abs(e.value - last) > 40 THEN e.value ELSE last END, lost OR abs(e.value - last) > 40 FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i + 1)
SELECT user_id, event_id, value FROM k WHERE admitted
"""


def upserted_orders(spark, d):
    """Orders merged by customer in three batches, one of them twice: the latest order's key and price, and the last urgent priority."""
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("at"), "o_orderkey", "o_totalprice", F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority")).alias("urgent"), "o_orderstatus")
    rows = kept(rows, "orders")
    target = VersionedTable(spark, f"{folder(spark)}/upserted-{uuid.uuid4().hex}", ["o_custkey"], ["at", "o_orderkey"], buckets=16, filled=True)
    for number, status in enumerate(("F", "O", "O", "P")):
        target.upsert(rows.filter(F.col("o_orderstatus") == status).drop("o_orderstatus"), ("orders", min(number, 1 + number // 3)))
    return target.read().select("o_custkey", "o_orderkey", "o_totalprice", "urgent")


UPSERTED = """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, [epoch_us(o_orderdate), o_orderkey] AS place, CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS urgent FROM orders WHERE o_orderstatus IN ('F', 'O', 'P'))
SELECT o_custkey, arg_max(o_orderkey, place) AS o_orderkey, arg_max(o_totalprice, place) AS o_totalprice, arg_max(urgent, place) FILTER (WHERE urgent IS NOT NULL) AS urgent FROM r GROUP BY 1
"""

QUERIES = {f.__name__: f for f in (stream_windows, stream_key_frames, upserted_orders)}
ORACLES = {"stream_windows": WINDOWS, "stream_key_frames": KEY_FRAMES, "upserted_orders": UPSERTED}
