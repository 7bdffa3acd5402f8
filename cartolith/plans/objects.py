"""Queries over inventories: labels, relevance, references, pairs, fused detections, top-k, set operations, text terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import text as X
from cartolith.operators import joins as J
from cartolith.operators import spatial as S
from cartolith.operators import tables as T
from cartolith.plans.tables import OBJECTS_SQL, objects, table


def object_counts(spark, d):
    return objects(spark, d).groupBy(X.label_fold(F.concat("query", F.lit("s"))).alias("label")).agg(F.count("*").alias("n"), F.round(F.max("confidence"), 4).alias("top")).select("label", "n", "top")


COUNTS = f"WITH {OBJECTS_SQL} SELECT CASE WHEN query || 's' LIKE '%ss' THEN query || 's' ELSE query END AS label, count(*) AS n, round(max(confidence), 4) AS top FROM objects GROUP BY 1"


def folded_labels(spark, d):
    w = F.transform(F.split(F.col("text"), " "), lambda x: x)
    words = table(spark, d, "documents").select(F.explode(w).alias("w")).distinct()
    return words.select("w", X.label_fold(F.col("w")).alias("folded"), X.stem(F.col("w")).alias("stem"))


FOLDED = r"""
WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents),
t AS (SELECT w, trim(regexp_replace(lower(w), '[ \t\n\r\f\v]+', ' ', 'g')) AS s, lower(w) AS l FROM w)
SELECT w, CASE s WHEN 'shelves' THEN 'shelf' WHEN 'boxes' THEN 'box' ELSE CASE WHEN length(s) > 3 AND s LIKE '%s' AND s NOT LIKE '%ss' THEN left(s, length(s) - 1) ELSE s END END AS folded,
  CASE WHEN l LIKE '%ss' THEN l WHEN l LIKE '%ies' AND length(l) >= 6 THEN left(l, length(l) - 3) || 'y' WHEN l LIKE '%ing' AND length(l) >= 6 THEN left(l, length(l) - 3)
    WHEN l LIKE '%es' AND length(l) >= 5 THEN left(l, length(l) - 2) WHEN l LIKE '%ed' AND length(l) >= 5 THEN left(l, length(l) - 2)
    WHEN l LIKE '%s' AND length(l) >= 4 THEN left(l, length(l) - 1) ELSE l END AS stem FROM t
"""


def text_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


TERMS = """
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS l FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN l LIKE '%ss' THEN l WHEN l LIKE '%ies' AND length(l) >= 6 THEN left(l, length(l) - 3) || 'y' WHEN l LIKE '%ing' AND length(l) >= 6 THEN left(l, length(l) - 3)
    WHEN l LIKE '%es' AND length(l) >= 5 THEN left(l, length(l) - 2) WHEN l LIKE '%ed' AND length(l) >= 5 THEN left(l, length(l) - 2)
    WHEN l LIKE '%s' AND length(l) >= 4 THEN left(l, length(l) - 1) ELSE l END AS term FROM t WHERE length(l) >= 3)
SELECT term, count(*) AS docs FROM s GROUP BY 1
"""

QUESTION = "Where are the small rings next to red widgets?"


def relevant_objects(spark, d):
    o = objects(spark, d).withColumn("score", X.relevance(X.terms(F.lit(QUESTION)), X.terms(F.col("query")), X.terms(F.col("scan"))))
    return o.orderBy(F.desc("score"), F.desc("confidence"), "position").limit(8).select("position", "query", "score")


RELEVANT = f"""
WITH {OBJECTS_SQL}, q AS (SELECT unnest(['where', 'are', 'the', 'small', 'ring', 'next', 'red', 'widget']) AS t),
n AS (SELECT position, query, confidence, lower(scan) AS c, string_split(query, ' ') AS w FROM objects),
s AS (SELECT position, query, confidence, sum(CASE WHEN list_contains(w, t) THEN 3.0
  WHEN len(list_filter(w, lambda x: length(x) >= 3 AND ((length(t) >= 4 AND contains(x, t)) OR (length(x) >= 4 AND contains(t, x))))) > 0 THEN 1.5
  WHEN c = t THEN 1.0 WHEN (length(t) >= 4 AND contains(c, t)) OR (length(c) >= 4 AND contains(t, c)) THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM n, q GROUP BY ALL)
SELECT position, query, score FROM s ORDER BY score DESC, confidence DESC, position LIMIT 8
"""


def close_pairs(spark, d):
    return J.near_pairs(objects(spark, d), "query", ("x", "y", "z"), "confidence", "position").select("a", "b", F.round("distance", 6).alias("distance"), "relation")


PAIRS = f"""
WITH {OBJECTS_SQL}, t AS (SELECT * FROM objects ORDER BY confidence DESC, position LIMIT 24),
p AS (SELECT a.position AS a, b.position AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS distance FROM t a JOIN t b
  ON a.query <> b.query AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.position < b.position)))
SELECT a, b, round(distance, 6) AS distance, CASE WHEN distance < 1.5 THEN 'near' WHEN distance < 3 THEN 'medium' ELSE 'far' END AS relation FROM p ORDER BY p.distance, a, b LIMIT 40
"""


def best_per_query(spark, d):
    return T.best_by(objects(spark, d), ["query"], F.desc("confidence"), "position").select("query", "position", "confidence")


BEST = f"WITH {OBJECTS_SQL} SELECT query, position, confidence FROM objects QUALIFY row_number() OVER (PARTITION BY query ORDER BY confidence DESC, position) = 1"


def top_per_query(spark, d):
    return T.best_by(objects(spark, d), ["query"], F.desc("confidence"), F.desc("position"), k=5).select("query", "position")


TOP = f"WITH {OBJECTS_SQL} SELECT query, position FROM objects QUALIFY row_number() OVER (PARTITION BY query ORDER BY confidence DESC, position DESC) <= 5"


def queried_objects(spark, d):
    return T.of_queries(objects(spark, d), [" Small Ring ", "RED WIDGET"]).select("position", "query")


QUERIED = f"WITH {OBJECTS_SQL} SELECT position, query FROM objects WHERE lower(trim(query)) IN ('small ring', 'red widget')"


def visible_inventory(spark, d):
    o = T.numbered(objects(spark, d), ["position"], "scan", F.col("position") % 5 == 0)
    return o.select("scan", "uid", "position", X.display_label(F.when(F.col("position") % 2 == 0, F.col("human_label")), F.col("query")).alias("label"))


INVENTORY = f"""
WITH {OBJECTS_SQL}, n AS (SELECT *, 'det:' || (row_number() OVER (PARTITION BY scan ORDER BY position) - 1) AS uid FROM objects)
SELECT scan, uid, position, CASE WHEN position % 2 = 0 THEN human_label ELSE query END AS label FROM n WHERE position % 5 <> 0
"""


def resolved_references(spark, d):
    o = objects(spark, d).select(F.concat(F.lit("det:"), "position").alias("uid"), "position", "confidence", (F.col("position") % 9 == 0).alias("dismissed"), F.lit(None).cast("string").alias("human_label"), "query")
    refs = spark.createDataFrame([("det:7",), ("12",), ("small ring",), ("Widget",), ("det:99999999",), ("nothing like it",)], "ref string")
    return T.resolved_reference(o, refs).select("ref", "uid")


REFERENCES = f"""
WITH {OBJECTS_SQL}, r AS (SELECT unnest(['det:7', '12', 'small ring', 'Widget', 'det:99999999', 'nothing like it']) AS ref),
l AS (SELECT ref, 'det:' || position AS uid, row_number() OVER (PARTITION BY ref ORDER BY confidence + CASE WHEN query = lower(ref) THEN 10 ELSE 0 END DESC, position) AS rn
  FROM r JOIN objects ON position % 9 <> 0 AND (contains(query, lower(ref)) OR contains(lower(ref), query)) WHERE NOT regexp_matches(lower(ref), '^(det:)?[0-9]+$'))
SELECT r.ref, coalesce(l.uid, CASE WHEN regexp_matches(r.ref, '^(det:)?[0-9]+$') AND try_cast(replace(r.ref, 'det:', '') AS BIGINT) IN (SELECT position FROM objects) THEN 'det:' || replace(r.ref, 'det:', '') END) AS uid
FROM r LEFT JOIN l ON r.ref = l.ref AND l.rn = 1
"""


def listed_objects(spark, d):
    return T.listed(objects(spark, d).select("position", "confidence"), [F.desc("confidence"), F.asc("position")], 10)


LISTED = f"WITH {OBJECTS_SQL} SELECT position, confidence, (SELECT count(*) FROM objects) AS total, (SELECT count(*) FROM objects) > 10 AS truncated FROM objects ORDER BY confidence DESC, position LIMIT 10"


def searched_names(spark, d):
    return T.exact_then_partial(objects(spark, d).select("position", "query", "confidence"), "query", "ring", [F.desc("confidence"), F.asc("position")], 15).select("position", "query", F.col("tier").cast("long").alias("tier"))


SEARCHED = f"WITH {OBJECTS_SQL} SELECT position, query, CASE WHEN query = 'ring' THEN 0 ELSE 1 END::BIGINT AS tier FROM objects WHERE contains(query, 'ring') ORDER BY 3, confidence DESC, position LIMIT 15"


def reserved_queries(spark, d):
    return T.reserved_slots(objects(spark, d).select("query", "position", "confidence"), "query", F.col("query").contains("ring"), [F.desc("confidence"), F.asc("position")], 12).select("query", "position")


RESERVED = f"""
WITH {OBJECTS_SQL}, o AS (SELECT query, position, confidence, contains(query, 'ring') AS s FROM objects QUALIFY row_number() OVER (PARTITION BY query ORDER BY contains(query, 'ring') DESC, confidence DESC, position) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY confidence DESC, position) AS k FROM o)
SELECT query, position FROM r ORDER BY CASE WHEN s AND k <= 6 THEN 0 WHEN NOT s THEN 1 ELSE 2 END, k LIMIT 12
"""


def sampled_objects(spark, d):
    return T.hash_sample(objects(spark, d).select("position", "query"), "position", 100, seed=3)


SAMPLED = f"WITH {OBJECTS_SQL} SELECT position, query FROM objects ORDER BY md5('3:' || position), position LIMIT 100"


def new_detections(spark, d):
    o = objects(spark, d).select("query", (F.col("position") % 5).alias("submap"), "position")
    return T.newly_seen(o.filter("position >= 1000"), o.filter("position < 1000"), ["query", "submap"]).groupBy("query", "submap").agg(F.count("*").alias("n"))


NEW = f"""
WITH {OBJECTS_SQL}, o AS (SELECT query, position % 5 AS submap, position FROM objects)
SELECT query, submap, count(*) AS n FROM o WHERE position >= 1000 AND (query, submap) NOT IN (SELECT (query, submap) FROM o WHERE position < 1000) GROUP BY 1, 2
"""


def query_changes(spark, d):
    o = objects(spark, d).select("scan", F.concat("query", F.lit("/"), "human_label").alias("query"))
    return T.changed(o.filter("scan <> 'ECONOMY'").select("query"), o.filter("scan <> 'PROMO'").select("query"))


CHANGES = f"""
WITH {OBJECTS_SQL}, a AS (SELECT query || '/' || human_label AS query FROM objects WHERE scan <> 'ECONOMY'), b AS (SELECT query || '/' || human_label AS query FROM objects WHERE scan <> 'PROMO')
SELECT query, 'added' AS change FROM (SELECT query FROM b EXCEPT SELECT query FROM a) UNION ALL SELECT query, 'removed' FROM (SELECT query FROM a EXCEPT SELECT query FROM b)
"""


def active_queries(spark, d):
    o = objects(spark, d).select("query", "scan")
    return T.active_union(*[o.filter(F.col("scan") == s).select("query") for s in ("ECONOMY", "STANDARD")])


ACTIVE = f"WITH {OBJECTS_SQL} SELECT query FROM objects WHERE scan = 'ECONOMY' UNION SELECT query FROM objects WHERE scan = 'STANDARD'"


def unknown_parts(spark, d):
    refs = table(spark, d, "lineitem").select((F.col("l_partkey") * 3).alias("position")).distinct()
    return T.unknown_references(refs, objects(spark, d), "position")


UNKNOWN = f"WITH {OBJECTS_SQL} SELECT DISTINCT l_partkey * 3 AS position FROM lineitem WHERE l_partkey * 3 NOT IN (SELECT position FROM objects)"


def retained_scans(spark, d):
    return T.retained(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)


RETAINED = "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3"


def fused_objects(spark, d):
    o = objects(spark, d).select("query", F.array("x", "y", "z").alias("center"), F.array(*[F.lit(v) for v in (0.3, 0.3, 0.3)]).alias("extent"), "confidence", F.col("position").alias("order"))
    return S.fuse(o).select("label", "rep", "n_members", F.round("confidence", 4).alias("confidence"), F.round("spread", 5).alias("spread"), "review", *[F.round(F.col("center")[i], 5).alias(f"c{i}") for i in range(3)])


def part_sizes(spark, d):
    o = objects(spark, d)
    return o.orderBy(F.desc("confidence"), "position").limit(8).select("position", F.bround("x", 3).alias("x"), X.extent_label(F.array("x", "y", "z")).alias("label"))


SIZES = f"""
WITH {OBJECTS_SQL}, t AS (SELECT * FROM objects ORDER BY confidence DESC, position LIMIT 8)
SELECT position, round_even(x, 3) AS x, array_to_string(list_transform(list_reverse_sort([x, y, z]), lambda v: printf('%.2f', v)), ' × ') AS label FROM t
"""


def document_captions(spark, d):
    t = table(spark, d, "documents")
    text = F.col("text")
    return t.select("doc_id", X.caption(F.when(F.col("doc_id") % 3 == 0, text), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.when(F.col("doc_id") % 4 == 0, F.col("lang")), F.lit(" "), F.col("lang")).alias("caption"), X.safe_part(F.concat("source", F.lit("/"), "lang", F.lit(" x"))).alias("part"), X.is_identifier(F.col("source")).alias("identifier"))


CAPTIONS = r"""
WITH t AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN nullif(trim(text), '') END AS title, CASE WHEN doc_id % 2 = 0 THEN source END AS b, CASE WHEN doc_id % 4 = 0 THEN lang END AS m FROM documents)
SELECT doc_id, coalesce(title, nullif(trim(concat_ws(' ', b, m)), ''), lang) AS caption, regexp_replace(source || '/' || lang || ' x', '[^A-Za-z0-9._-]', '_', 'g') AS part, regexp_matches(source, '^[A-Za-z_][A-Za-z0-9_]*$') AS identifier FROM t
"""


def page_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.first_number(F.col("url")).alias("number"), X.plain_name(F.col("url")).alias("name"), X.without_measures(F.col("url")).alias("prose"))


PAGES = r"""
SELECT page_id, try_cast(regexp_extract(string_split(url, '/')[-1], '(\d+(?:\.\d+)?)', 1) AS DOUBLE) AS number, left(trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')), 36) AS name,
  CASE WHEN NOT regexp_matches(lower(url), '\d\s*(mm|cm|km|m|metres?|meters?|inch(es)?|ft|feet)\b') THEN trim(url) END AS prose FROM pages
"""

QUERIES = {f.__name__: f for f in (object_counts, folded_labels, text_terms, relevant_objects, close_pairs, best_per_query, top_per_query, queried_objects, visible_inventory, resolved_references, listed_objects, searched_names, reserved_queries, sampled_objects, new_detections, query_changes, active_queries, unknown_parts, retained_scans, fused_objects, part_sizes, document_captions, page_names)}

ORACLES = {
    "object_counts": COUNTS, "folded_labels": FOLDED, "text_terms": TERMS, "relevant_objects": RELEVANT, "close_pairs": PAIRS, "best_per_query": BEST, "top_per_query": TOP, "queried_objects": QUERIED,
    "visible_inventory": INVENTORY, "resolved_references": REFERENCES, "listed_objects": LISTED, "searched_names": SEARCHED, "reserved_queries": RESERVED, "sampled_objects": SAMPLED, "new_detections": NEW,
    "query_changes": CHANGES, "active_queries": ACTIVE, "unknown_parts": UNKNOWN, "retained_scans": RETAINED, "part_sizes": SIZES, "document_captions": CAPTIONS, "page_names": PAGES,
}
