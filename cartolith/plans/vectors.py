"""Queries over embeddings: best matches, centroids, same place, top-k, loop closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import arrays as A
from cartolith.operators import similarity as V
from cartolith.plans.tables import table

_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _query(e):
    return e.filter("vec_id = 0").first()["embedding"]


def best_frame(spark, d):
    e = table(spark, d, "embeddings")
    return V.best_match(e.filter("vec_id <> 0 AND label <> 9"), _query(e)).select("id", F.round("score", 6).alias("score"))


BEST = "WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, q WHERE vec_id <> 0 AND label <> 9 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 1"


def retrieved_frame(spark, d):
    e = table(spark, d, "embeddings")
    return V.nearest_by_distance(e, _query(e), (F.col("label") != 2) & (F.col("vec_id") != 0)).select("id", F.round("distance", 6).alias("distance"))


RETRIEVED = "WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, q WHERE vec_id <> 0 AND label <> 2 ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), vec_id LIMIT 1"


def label_centroids(spark, d):
    return V.centroids(table(spark, d, "embeddings"), "label").select("label", "n", F.posexplode("mean").alias("i", "v")).select("label", "n", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


CENTROIDS = """
WITH u AS (SELECT label, unnest(range(64)) AS i, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings),
m AS (SELECT label, i, avg(embedding[i + 1]::DOUBLE / len) AS v, count(*) AS n FROM u GROUP BY 1, 2)
SELECT label, n, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS v FROM m
"""


def same_place(spark, d):
    e = table(spark, d, "embeddings")
    return V.same_place(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "label").select("label", F.round("score", 6).alias("score"))


PLACE = """
WITH u AS (SELECT label, vec_id % 2 AS side, unnest(range(64)) AS i, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings),
m AS (SELECT label, side, i, avg(embedding[i + 1]::DOUBLE / len) AS v FROM u GROUP BY ALL), n AS (SELECT label, side, i, v, sqrt(sum(v * v) OVER (PARTITION BY label, side)) AS len FROM m)
SELECT a.label, round(sum(a.v * b.v / b.len), 6) AS score FROM n a JOIN n b ON a.label = b.label AND a.i = b.i AND a.side = 0 AND b.side = 1 GROUP BY 1
"""


def scored_frames(spark, d):
    """Rows whose id is divisible by 20 against every row."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.scored_top(e, q, ["label"], 0.05, 3).select("query_id", "label", "id", F.round("score", 6).alias("score"), "rank")


SCORED = """
WITH s AS (SELECT q.vec_id AS query_id, e.label, e.vec_id AS id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0)
SELECT query_id, label, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM s WHERE score > 0.05
QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY s.score DESC, id) <= 3
"""


def loop_closures(spark, d):
    """Rows whose id is divisible by 20 against every row but their own."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    best = V.scored_top(e, q, [], -2.0, 1, others=True)
    return V.loop_closures(best, 0.45, 10).select("query_id", "id", F.round("score", 6).alias("score"))


CLOSURES = """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1)
SELECT query_id, id, round(score, 6) AS score FROM b WHERE score < 0.45 ORDER BY b.score, id LIMIT 10
"""


def ranked_labels(spark, d):
    e = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _query(e)])
    return e.select("vec_id", F.round(A.cosine(F.col("embedding"), q), 6).alias("cosine"), F.round(A.euclid(F.col("embedding"), q), 6).alias("distance"))


RANKED = "WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, q"

QUERIES = {f.__name__: f for f in (best_frame, retrieved_frame, label_centroids, same_place, scored_frames, loop_closures, ranked_labels)}
ORACLES = {"best_frame": BEST, "retrieved_frame": RETRIEVED, "label_centroids": CENTROIDS, "same_place": PLACE, "scored_frames": SCORED, "loop_closures": CLOSURES, "ranked_labels": RANKED}
