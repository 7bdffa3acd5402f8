"""Similarity search over vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.functions import arrays as A
from cartolith.operators.pairs import best_pairs


def _with_literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def best_match(frames: DataFrame, vector: list[float], id_col: str = "vec_id", column: str = "embedding", floor: float = 0.0) -> DataFrame:
    """id, score of the frame of largest cosine above floor, the first of equal ones; one row, with nulls and floor if there is none."""
    scored = frames.select(F.col(id_col).alias("id"), A.cosine(F.col(column), _with_literal(vector)).alias("score")).filter(F.col("score") > floor)
    best = scored.agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.coalesce(F.max("score"), F.lit(floor)).alias("score"))
    return best


def nearest_by_distance(frames: DataFrame, vector: list[float], allowed: Column, id_col: str = "vec_id", column: str = "embedding", ceiling: float = 1000.0) -> DataFrame:
    """id, distance of the closest allowed frame nearer than ceiling."""
    scored = frames.filter(allowed).select(F.col(id_col).alias("id"), A.euclid(F.col(column), _with_literal(vector)).alias("distance")).filter(F.col("distance") < ceiling)
    return scored.agg(F.min_by("id", F.struct("distance", "id")).alias("id"), F.min("distance").alias("distance"))


def centroids(frames: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """key, the unit-length mean of unit vectors as an array, and how many there are; components are summed apart, so a key's vectors never meet in one row."""
    unit = frames.select(key, F.posexplode(F.transform(column, lambda x: F.try_divide(x.cast("double"), A.length(F.col(column))))).alias("i", "v"))
    mean = unit.groupBy(key, "i").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    whole = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("mean"), F.max("n").alias("n"))
    return whole.select(key, F.transform("mean", lambda x: F.try_divide(x, A.length(F.col("mean")))).alias("mean"), "n")


def same_place(frames: DataFrame, anchors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """key, score: the mean cosine of each key's vectors to its anchor's mean, computed from both means alone."""
    own = centroid_sums(frames, key, column)
    to = centroids(anchors, key, column).select(key, F.col("mean").alias("anchor"))
    return own.join(to, key).select(key, A.dot(F.col("mean"), F.col("anchor")).alias("score"))


def centroid_sums(frames: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """key, mean of unit vectors (not normalised again)."""
    unit = frames.select(key, F.posexplode(F.transform(column, lambda x: F.try_divide(x.cast("double"), A.length(F.col(column))))).alias("i", "v"))
    mean = unit.groupBy(key, "i").agg(F.avg("v").alias("v"))
    return mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("mean"))


def scored_top(frames: DataFrame, queries: DataFrame, per: list[str], threshold: float, k: int, id_col: str = "vec_id", column: str = "embedding", others: bool = False) -> DataFrame:
    """query_id, id, score: of each query and group `per` of frames, the k best dot products above threshold.

    queries has query_id and query; others: a query's own row (id equal to query_id) takes no part."""
    named = frames.select(F.col(id_col).alias("id"), F.col(column).alias("vector"), *per)
    both = best_pairs(named, queries, per, k, "dot", threshold, True, others)
    w = W.partitionBy("query_id", *per).orderBy(F.desc("score"), "id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", *per, "id", "score", F.col("rank").cast("long").alias("rank"))


def loop_closures(best: DataFrame, threshold: float, most: int) -> DataFrame:
    """The `most` smallest of best scores below a threshold, ascending."""
    return best.filter(F.col("score") < threshold).orderBy("score", "id").limit(most)
