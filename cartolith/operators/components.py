"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.operators.shared import dropped, kept


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): each node of edges (a, b) with the smallest node it is linked to.

    Rounds grow with the logarithm of the longest chain. Each is written to the shared folder; the driver
    sees a row count and a checksum."""
    now = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == state:
            break
        state = seen
        for large in (True, False):
            around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else now
            least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
            met = around.join(least, "a")
            if large:
                turned = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            else:
                turned = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(met.select("a", F.col("least").alias("b")))
            last, now = now, kept(turned.filter("a <> b").distinct(), "edges")
            dropped(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)
