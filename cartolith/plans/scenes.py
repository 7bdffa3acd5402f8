"""Queries over scene tables, tracks and splats: lookups, budgets, gates, layers, jobs, depth windows, levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.operators import scene as S
from cartolith.operators import splats as L
from cartolith.operators import tracks as T
from cartolith.operators import views as V
from cartolith.operators.shared import kept
from cartolith.plans.tables import OBJECTS_SQL, objects, table


def _r(c, name, digits=6):
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def frame_budget(spark, d):
    """Twelve frames to look at: preferred nations, then parts by confidence, then suppliers."""
    preferred = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("submap"), F.col("n_nationkey").alias("place"))
    o = objects(spark, d).select("confidence", F.col("position").alias("place"), (F.col("position") % 9 - 1).alias("submap"), (F.col("position") % 5).alias("frame"))
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("place"), F.col("s_suppkey").alias("submap"), F.lit(1).alias("frame"))
    return S.evidence_frames(preferred, o, t, 12)


BUDGET = f"""
WITH {OBJECTS_SQL}, t AS (SELECT 0 AS tier, 0.0 AS f, n_nationkey AS place, n_nationkey AS submap, 0 AS frame FROM nation WHERE n_regionkey = 2
  UNION ALL SELECT 1, -confidence, position, position % 9 - 1, position % 5 FROM objects UNION ALL SELECT 2, 0.0, s_suppkey, s_suppkey, 1 FROM supplier),
b AS (SELECT * FROM t WHERE submap >= 0 AND frame >= 0 QUALIFY row_number() OVER (PARTITION BY submap, frame ORDER BY tier, f, place) = 1)
SELECT submap::BIGINT AS submap, frame::BIGINT AS frame, (row_number() OVER (ORDER BY tier, f, place, submap, frame) - 1)::INT AS rank FROM b QUALIFY row_number() OVER (ORDER BY tier, f, place, submap, frame) <= 12
"""


def cited(spark, d):
    c = table(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("submap"), (F.col("s_suppkey") % 3).alias("frame"), F.col("s_suppkey").alias("place"))
    asked = table(spark, d, "nation").select((F.col("n_nationkey") % 9).cast("long").alias("submap"), F.lit(1).cast("long").alias("frame"), F.col("n_nationkey").cast("long").alias("place"))
    return S.cited_frames(asked, c, 3)


CITED = """
WITH c AS (SELECT DISTINCT s_suppkey % 7 AS submap, s_suppkey % 3 AS frame FROM supplier), a AS (SELECT (n_nationkey % 9)::BIGINT AS submap, 1::BIGINT AS frame, min(n_nationkey)::BIGINT AS place FROM nation GROUP BY 1)
SELECT a.submap, a.frame, a.place FROM a JOIN c ON a.submap = c.submap AND a.frame = c.frame
"""


def related_terms(spark, d):
    p = table(spark, d, "part")
    r = p.select("p_name", "p_partkey").join(p.select(F.col("p_name").alias("other"), (F.col("p_partkey") + 7).alias("p_partkey")), "p_partkey")
    return S.relation_terms(r.select(F.col("p_name").alias("a"), F.col("other").alias("b"), F.when(F.col("p_partkey") % 2 == 0, "standing").alias("relation"))).select("name", F.array_join("terms", " ").alias("terms"))


_STEM = "CASE WHEN w LIKE '%ss' THEN w WHEN w LIKE '%ies' AND length(w) >= 6 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, length(w) - 3) WHEN w LIKE '%es' AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN w LIKE '%ed' AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) >= 4 THEN left(w, length(w) - 1) ELSE w END"
RELATED = f"""
WITH r AS (SELECT p.p_name AS a, q.p_name AS b, p.p_partkey % 2 = 0 AS q FROM part p JOIN part q ON p.p_partkey = q.p_partkey + 7), e AS (SELECT a AS name, b AS partner, q FROM r UNION ALL SELECT b, a, q FROM r),
w AS (SELECT name, unnest(list_concat(list_filter(regexp_split_to_array(lower(partner), '[^a-z0-9]+'), lambda x: length(x) >= 3), CASE WHEN q THEN ['standing'] ELSE [] END)) AS w FROM e)
SELECT lower(name) AS name, array_to_string(list_sort(list_distinct(list({_STEM}))), ' ') AS terms FROM w GROUP BY 1
"""


def mentioned_terms(spark, d):
    said = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws(" ", F.lit("Boxes stored in"), "n_name", F.lit("near"), "s_name").alias("sentence"))
    return S.prose_terms(said, table(spark, d, "nation").select(F.col("n_name").alias("name"))).select("name", F.array_join("terms", " ").alias("terms"))


MENTIONED = f"""
WITH s AS (SELECT lower('Boxes stored in ' || n_name || ' near ' || s_name) AS low FROM supplier JOIN nation ON s_nationkey = n_nationkey), m AS (SELECT lower(trim(n_name)) AS name, low FROM s JOIN nation ON contains(low, lower(trim(n_name)))),
w AS (SELECT name, unnest(list_filter(regexp_split_to_array(low, '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS w FROM m)
SELECT name, array_to_string(list_sort(list_distinct(list({_STEM}))), ' ') AS terms FROM w GROUP BY 1
"""


def scene_lookup(spark, d):
    """Where the red ring is, and the scene's counts."""
    o = objects(spark, d).withColumn("center", F.array("x", "y", "z"))
    found = S.located(o, " RED ring").select("query", _r(F.col("center")[0], "x"), _r("confidence", "confidence"))
    counts = S.snapshot(o, table(spark, d, "supplier").select(F.col("s_nationkey").alias("submap")))
    return counts.crossJoin(F.broadcast(found)).withColumn("top_confidence", F.round("top_confidence", 6))


LOOKUP = f"""
WITH {OBJECTS_SQL}, f AS (SELECT query, round(x, 6) AS x, round(confidence, 6) AS confidence FROM objects WHERE contains(query, 'red ring') ORDER BY query = 'red ring' DESC, objects.confidence DESC, position LIMIT 1)
SELECT (SELECT count(*) FROM objects) AS objects, (SELECT count(DISTINCT query) FROM objects) AS queries, (SELECT round(max(confidence), 6) FROM objects) AS top_confidence, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS submaps, (SELECT count(*) FROM supplier) AS frames, f.* FROM f
"""


def focused(spark, d):
    asks = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), F.lit("Small Ring"))).otherwise(F.col("n_name")).alias("name")).distinct()
    o = objects(spark, d).withColumn("center", F.array("x", "y", "z"))
    return S.focus(o, F.col("query"), asks).select("name", _r(F.col("center")[1], "y"))


FOCUSED = f"""
WITH {OBJECTS_SQL}, a AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN ' Small Ring' ELSE n_name END AS name FROM nation),
o AS (SELECT * FROM objects QUALIFY row_number() OVER (PARTITION BY lower(trim(query)) ORDER BY confidence DESC, position) = 1) SELECT name, round(y, 6) + 0.0 AS y FROM a LEFT JOIN o ON lower(trim(name)) = lower(trim(query))
"""


def tool_calls(spark, d):
    """Every event as a tool call: the tool it means, why it is refused, and whether it repeats."""
    e = table(spark, d, "events")
    args = F.when(F.col("event_id") % 5 == 0, "{bad").when(F.col("event_id") % 3 == 0, '{"query": 1}').otherwise('{"query": 1, "scene": 2}')
    calls = S.once_each(e.select(F.col("event_id").alias("call"), F.concat(F.lit(" "), F.upper("event_type")).alias("tool"), args.alias("args"), F.when(F.col("event_id") % 4 != 0, F.col("user_id") * 10 + F.floor("value").cast("long") % 10).alias("idem")), "idem", "call")
    tools = spark.createDataFrame([("look", ["view", "click"], ["query", "scene"]), ("buy", ["purchase"], ["query"])], "name string, aliases array<string>, required array<string>")
    return S.known_or_refused(calls, tools).select("call", "name", "error", F.array_join("missing", ",").alias("missing"), "replay")


CALLS = """
WITH c AS (SELECT event_id AS call, lower(event_type) AS tool, CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN event_id % 4 <> 0 THEN user_id * 10 + floor(value)::BIGINT % 10 END AS idem FROM events),
n AS (SELECT *, CASE WHEN tool IN ('look', 'view', 'click') THEN 'look' WHEN tool IN ('buy', 'purchase') THEN 'buy' END AS name, idem IS NOT NULL AND row_number() OVER (PARTITION BY idem ORDER BY call) > 1 AS replay FROM c)
SELECT call, name, CASE WHEN name IS NULL THEN 'unknown_tool' WHEN a = 2 THEN 'invalid_args' WHEN name = 'look' AND a = 1 THEN 'missing_args' END AS error, CASE WHEN name = 'look' AND a = 1 THEN 'scene' END AS missing, replay FROM n
"""


def spend_ceiling(spark, d):
    e = table(spark, d, "events").filter("value IS NOT NULL").select("user_id", "event_id", F.abs(F.floor("value")).alias("cost"))
    return S.under_ceiling(e, "user_id", "event_id", "cost", 500.0).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.sum(F.when(F.col("allowed"), F.col("cost"))).alias("spent"))


CEILING = """
WITH RECURSIVE e AS (SELECT user_id, abs(floor(value)) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL),
s(user_id, i, spent, n) AS (SELECT user_id, 0, 0.0::DOUBLE, 0 FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT e.user_id, e.i, s.spent + CASE WHEN s.spent + e.cost <= 500 THEN e.cost ELSE 0 END, s.n + (s.spent + e.cost <= 500)::INT FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, max(n)::BIGINT AS allowed, CASE WHEN max(n) > 0 THEN max(spent)::BIGINT END AS spent FROM s GROUP BY 1
"""


def layer_changes(spark, d):
    """A curated layer, stale keys, orphan files, and an inventory that isn't replaced where a captured object is."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("key"), F.when(F.col("p_size") < 10, "low").otherwise("good").alias("tier"), F.lit(None).cast("array<string>").alias("caveats"), F.col("p_type").alias("scene"), F.when(F.col("p_partkey") % 97 == 0, "captured").otherwise("detected").alias("provenance"))
    kept = S.curated(p, exclude=["Brand#1"], box_only=False, caveats={"Brand#2": "seen once"})
    rows = [("curated", kept), ("caveats", kept.filter(F.size("caveats") > 0)), ("stale", S.stale_assets(p.select((F.col("key") * 2).alias("key")), p)), ("orphans", S.orphan_files(p.select(F.col("key").alias("path")), p.select((F.col("key") * 3).alias("path")))), ("replaced", S.replaced_inventory(p, p))]
    out = None
    for what, df in rows:
        one = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


CHANGES = """
WITH k AS (SELECT * FROM part WHERE p_brand <> 'Brand#1' AND p_size >= 10)
SELECT 'curated' AS what, count(*) AS n FROM k UNION ALL SELECT 'caveats', count(*) FROM k WHERE p_brand = 'Brand#2'
UNION ALL SELECT 'stale', count(*) FROM (SELECT p_partkey * 2 AS key FROM part EXCEPT SELECT p_partkey FROM part) UNION ALL SELECT 'orphans', count(*) FROM part WHERE p_partkey NOT IN (SELECT p_partkey * 3 FROM part)
UNION ALL SELECT 'replaced', count(*) FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_partkey % 97 = 0)
"""


def latest_records(spark, d):
    """Export slots by order priority, the jobs that are active, and the group that each request reads."""
    o = table(spark, d, "orders")
    slots = S.export_slots(o.select(F.col("o_orderpriority").alias("format"), F.lit(1).alias("bytes"), F.col("o_custkey").alias("points"), (F.col("o_orderkey") % 100).alias("source_points"), F.struct("o_orderdate", "o_orderkey").alias("at")))
    jobs = S.active_jobs(o.select(F.col("o_orderpriority").alias("scene"), (F.col("o_custkey") % 50).cast("string").alias("job"), F.concat(F.lit("export:"), "o_orderstatus").alias("kind"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("state"), F.struct("o_orderdate", "o_orderkey").alias("at")), "export:")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("scene"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("g"), F.col("n_regionkey").cast("string"))).alias("wanted"))
    groups = table(spark, d, "region").filter("r_regionkey < 3").crossJoin(n.select("scene")).select("scene", F.concat(F.lit("g"), F.col("r_regionkey").cast("string")).alias("key"))
    pointers = n.select("scene", F.when(F.col("scene").cast("int") % 2 == 0, "g1").alias("pointer"))
    g = S.resolved_group(n, groups, pointers)
    rows = slots.select(F.concat(F.lit("slot "), "format").alias("what"), F.concat_ws("/", F.col("points").cast("string"), F.col("decimated").cast("string")).alias("value"))
    rows = rows.unionByName(jobs.groupBy("scene").agg(F.count("*").alias("n")).select(F.concat(F.lit("jobs "), "scene").alias("what"), F.col("n").cast("string").alias("value")))
    return rows.unionByName(g.select(F.concat(F.lit("group "), "scene").alias("what"), F.concat_ws("/", "group", F.col("degraded").cast("string")).alias("value")))


LATEST = """
WITH s AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
j AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'g' || n_regionkey WHEN n_nationkey % 2 = 0 THEN 'g1' END AS pick FROM nation)
SELECT 'slot ' || o_orderpriority AS what, o_custkey || '/' || (o_custkey < o_orderkey % 100)::VARCHAR AS value FROM s
UNION ALL SELECT 'jobs ' || o_orderpriority, count(*)::VARCHAR FROM j WHERE o_orderstatus = 'O' GROUP BY 1
UNION ALL SELECT 'group ' || n_nationkey, CASE WHEN pick IN ('g0', 'g1', 'g2') THEN pick ELSE 'original' END || '/' || (pick IS NOT NULL AND pick NOT IN ('g0', 'g1', 'g2'))::VARCHAR FROM n
"""


def trusted_suppliers(spark, d):
    s = table(spark, d, "supplier")
    rows = s.select("s_suppkey", F.when(s.s_suppkey % 2 == 0, "high").alias("level"), (s.s_suppkey % 3 != 0).alias("allowed"), F.when(s.s_suppkey % 5 != 0, s.s_name).alias("reference"), F.when(s.s_suppkey % 7 == 0, "blur").alias("warning"), F.when(s.s_acctbal > 0, s.s_acctbal).otherwise(float("nan")).alias("scale"))
    return S.trusted_scale(rows).select("s_suppkey", F.array_join("reasons", "; ").alias("reasons"), "trusted")


TRUSTED = """
WITH r AS (SELECT s_suppkey, list_filter([CASE WHEN s_suppkey % 2 <> 0 THEN 'confidence is not high' END, CASE WHEN s_suppkey % 3 = 0 THEN 'not allowed' END, CASE WHEN s_suppkey % 5 = 0 THEN 'no reference' END,
  CASE WHEN s_suppkey % 7 = 0 THEN 'warned' END, CASE WHEN s_acctbal <= 0 THEN 'scale is not finite and positive' END], lambda x: x IS NOT NULL) AS r FROM supplier)
SELECT s_suppkey, array_to_string(r, '; ') AS reasons, len(r) = 0 AS trusted FROM r
"""


def best_crops(spark, d):
    c = table(spark, d, "lineitem").select("l_suppkey", F.col("l_discount").alias("clip"), F.col("l_tax").alias("seg"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), "l_quantity")
    ranked = S.ranked_by_tiebreak(S.cropped_best(c, ["l_suppkey"]).withColumn("part", F.col("l_suppkey") % 2), "part", 30)
    return ranked.select("l_suppkey", _r("score", "score"), F.col("tie_score").isNull().alias("skipped"))


CROPS = """
WITH b AS (SELECT l_suppkey, max(l_discount * l_tax) AS score FROM lineitem GROUP BY 1) SELECT l_suppkey, round(score, 6) + 0.0 AS score, count(*) OVER (PARTITION BY l_suppkey % 2) > 30 AS skipped FROM b
"""


def _samples(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("object"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frame"), F.col("l_quantity").alias("u"), (F.col("l_tax") * 100).alias("v"), (F.col("l_discount") + 0.01).alias("depth"))


def lifted_tracks(spark, d):
    """Line items as 2D samples of suppliers' tracks, lifted by one camera a frame that stands off along x."""
    s = _samples(spark, d)
    pose = F.array(*[F.lit(float(x)) if x is not None else F.col("frame") % 5 * 1.0 for x in (0, -1, 0, None, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1)])
    cams = s.select("frame").distinct().select("frame", F.lit(50.0).alias("fx"), F.lit(40.0).alias("fy"), F.lit(25.0).alias("cx"), F.lit(4.0).alias("cy"), pose.alias("pose"))
    out = T.track_summary(T.lifted(s, cams), "object", moves=4.0)
    return out.select("object", "n", *[_r(c, c, 5) for c in ("rms", "max_excursion", "max_displacement")], "motion")


LIFTED = """
WITH s AS (SELECT l_suppkey AS object, l_orderkey * 8 + l_linenumber AS frame, -((l_tax * 100 - 4) * (l_discount + 0.01) / 40) + (l_orderkey * 8 + l_linenumber) % 5 AS x, (l_quantity - 25) * (l_discount + 0.01) / 50 + 2 AS y, l_discount + 0.01 + 3 AS z FROM lineitem),
w AS (SELECT *, avg(x) OVER o AS mx, avg(y) OVER o AS my, avg(z) OVER o AS mz, first(x) OVER f AS fx, first(y) OVER f AS fy, first(z) OVER f AS fz FROM s WINDOW o AS (PARTITION BY object), f AS (PARTITION BY object ORDER BY frame)),
g AS (SELECT object, count(*) AS n, sqrt(avg(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) AS rms, max(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) AS e, max(sqrt(pow(x - fx, 2) + pow(y - fy, 2) + pow(z - fz, 2))) AS m FROM w GROUP BY 1)
SELECT object, n, CASE WHEN n >= 2 THEN round(rms, 5) END AS rms, CASE WHEN n >= 2 THEN round(e, 5) END AS max_excursion, CASE WHEN n >= 2 THEN round(m, 5) END AS max_displacement, CASE WHEN n < 2 THEN 'unknown' WHEN m > 4 THEN 'moving' ELSE 'static' END AS motion FROM g
"""


def depth_windows(spark, d):
    """Suppliers' places in a picture of line items: the median depth of sound pixels around, and of the surer ones alone."""
    px = table(spark, d, "lineitem").groupBy(F.lit(0).alias("frame"), (F.col("l_partkey") % 40).cast("int").alias("row"), F.col("l_quantity").cast("int").alias("col")).agg((F.max("l_extendedprice") / 1000 - 2).alias("depth"), F.max("l_tax").alias("conf"))
    places = table(spark, d, "supplier").select(F.col("s_suppkey").alias("object"), F.lit(0).alias("frame"), (F.col("s_suppkey") % 50 + 0.5).alias("u"), (F.col("s_nationkey") * 1.0).alias("v"))
    out = T.window_depth(places, px, 0.02).select("object", _r("depth", "depth"), "n", _r("conf", "conf"))
    gated = T.gated_depth(px, ["col"]).select(F.col("col").cast("long").alias("object"), _r("depth", "gated"))
    return out.join(gated, "object", "left")


WINDOWS = """
WITH px AS (SELECT (l_partkey % 40)::INT AS r, l_quantity::INT AS c, max(l_extendedprice) / 1000 - 2 AS depth, max(l_tax) AS conf FROM lineitem GROUP BY 1, 2),
m AS (SELECT s_suppkey AS object, median(depth) AS depth, count(*) AS n, avg(conf) AS conf FROM supplier JOIN px ON abs(c - round_even(s_suppkey % 50 + 0.5, 0)) <= 2 AND abs(r - s_nationkey) <= 2 AND depth > 0 AND conf >= 0.02 GROUP BY 1),
b AS (SELECT c, quantile_cont(conf, 0.4) AS bar FROM px GROUP BY 1), g AS (SELECT px.c, median(depth) AS gated FROM px JOIN b ON px.c = b.c WHERE conf >= bar GROUP BY 1)
SELECT s_suppkey AS object, round(m.depth, 6) + 0.0 AS depth, m.n, round(m.conf, 6) + 0.0 AS conf, round(gated, 6) + 0.0 AS gated FROM supplier LEFT JOIN m ON object = s_suppkey LEFT JOIN g ON g.c = s_suppkey
"""


def body_measures(spark, d):
    """Suppliers' parts as bodies: their scale, and how much bones' lengths vary."""
    x = table(spark, d, "lineitem")
    scale = T.body_scale(x.select("l_suppkey", F.col("l_discount").alias("meters"), (F.col("l_extendedprice") / 10000).alias("scene"), F.lit(1).alias("k")).withColumn("meters", F.col("meters") + 0.1), ["l_suppkey"])
    bones = T.bone_variation(x, "l_suppkey", "l_linenumber", "l_quantity")
    return bones.join(scale, "l_suppkey", "left").select("l_suppkey", _r("mean_cv", "mean_cv"), _r("max_cv", "max_cv"), _r("scale", "scale"))


BODIES = """
WITH b AS (SELECT l_suppkey, stddev_pop(l_quantity) / avg(l_quantity) AS cv FROM lineitem GROUP BY l_suppkey, l_linenumber), v AS (SELECT l_suppkey, avg(cv) AS m, max(cv) AS x FROM b GROUP BY 1),
s AS (SELECT l_suppkey, median(l_extendedprice / 10000 / (l_discount + 0.1)) AS scale FROM lineitem WHERE l_discount + 0.1 >= 0.15 GROUP BY 1 HAVING count(*) >= 3)
SELECT v.l_suppkey, round(m, 6) + 0.0 AS mean_cv, round(x, 6) + 0.0 AS max_cv, round(scale, 6) + 0.0 AS scale FROM v LEFT JOIN s USING (l_suppkey)
"""


def resampled_paths(spark, d):
    """Users' values over hours as polylines, at even arc lengths of about 40."""
    e = table(spark, d, "events").filter("value IS NOT NULL").select("user_id", F.struct("ts", "event_id").alias("at"), (F.unix_micros(F.col("ts").cast("timestamp")) % 86400000000 / 3.6e9).alias("x"), F.col("value").alias("y"))
    out = T.resampled(e, "user_id", "at", 40.0)
    return out.groupBy("user_id").agg(F.count("*").alias("n"), _r(F.sum("x"), "x", 3), _r(F.sum("y"), "y", 3), _r(F.max_by("y", "sample"), "last", 4))


RESAMPLED = """
WITH e AS (SELECT user_id, ts, event_id, epoch_us(ts) % 86400000000 / 3.6e9 AS x, value AS y FROM events WHERE value IS NOT NULL),
m AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM m),
a AS (SELECT user_id, s, x, y, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, max(s) OVER (PARTITION BY user_id) AS total FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, greatest(round_even(total / 40, 0)::BIGINT + 1, 2) AS n FROM a), h AS (SELECT *, total / (n - 1) AS gap FROM g WHERE s2 > s),
k AS (SELECT *, unnest(range(ceil(s / gap - 1e-9)::BIGINT, CASE WHEN s2 = total THEN n ELSE ceil(s2 / gap - 1e-9)::BIGINT END)) AS i FROM h),
t AS (SELECT *, least(greatest((i * gap - s) / (s2 - s), 0), 1) AS t FROM k)
SELECT user_id, count(*) AS n, round(sum(x + t * (x2 - x)), 3) + 0.0 AS x, round(sum(y + t * (y2 - y)), 3) + 0.0 AS y, round(arg_max(y + t * (y2 - y), i), 4) + 0.0 AS last FROM t GROUP BY 1
"""


def timeline_spread(spark, d):
    return T.spread_positions(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 13).select("event_id")


SPREAD = """
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events) SELECT event_id FROM n WHERE p IN (SELECT round_even(i * (n - 1) / 12, 0)::BIGINT FROM range(13) t(i))
"""


def matching_frames(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.slice("v", 1, 32).alias("samples"))
    return T.matched_frames(q, e.select(F.col("vec_id").alias("frame"), F.slice("v", 33, 32).alias("samples")), 0.3).select("query", "frame", _r("corr", "corr"))


MATCHING = """
WITH q AS (SELECT vec_id AS query, embedding[1:32]::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0), f AS (SELECT vec_id AS frame, embedding[33:64]::DOUBLE[] AS b FROM embeddings),
m AS (SELECT query, frame, a, b, list_avg(a) AS ma, list_avg(b) AS mb FROM q, f),
c AS (SELECT query, frame, (list_dot_product(a, b) / 32 - ma * mb) / sqrt((list_dot_product(a, a) / 32 - ma * ma) * (list_dot_product(b, b) / 32 - mb * mb)) AS corr FROM m)
SELECT query, frame, round(corr, 6) + 0.0 AS corr FROM c WHERE corr >= 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY corr DESC, frame) = 1
"""


def fed_numbers(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("frame"), "event_type")
    a = e.filter("event_type = 'purchase'").select("user_id", "frame", F.floor(F.col("frame") / 50).alias("delta"))
    return T.recovered_numbers(e.drop("event_type"), a, "user_id", most=2000)


FED = """
WITH w AS (SELECT user_id, event_id AS frame, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id // 50 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS b,
  min(CASE WHEN event_type = 'purchase' THEN event_id // 50 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM events)
SELECT user_id, frame, least(frame + b, 2000) AS fed, b = coalesce(a, b) AS exact, NULL::VARCHAR AS error FROM w
"""


def _splats(spark, d):
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", *[F.lit(0.0).alias(c) for c in L.NORMALS], F.ln(F.col("l_extendedprice") / 1000).alias("scale_0"), F.ln(F.col("l_quantity")).alias("scale_1"), F.ln(F.col("l_tax") + 0.01).alias("scale_2"))


def splat_clamp(spark, d):
    """Line items as splats: scales cut at the 99th percentile and raised to half a voxel."""
    out, info = L.clamped_scales(_splats(spark, d))
    out = L.without_zero_normals(L.floored_scales(out, 0.1))
    total = out.agg(*[_r(F.sum(c), c, 2) for c in L.SCALES])
    return total.select("*", F.round(F.lit(info["clamp_value"]), 6).alias("limit"), F.lit(info["clamped"]).cast("long").alias("clamped"), F.lit("nx" in out.columns).alias("normals"))


CLAMP = """
WITH s AS (SELECT l_extendedprice / 1000 AS a, l_quantity AS b, l_tax + 0.01 AS c FROM lineitem), q AS (SELECT quantile_cont(exp(ln(v)), 0.99) AS t FROM (SELECT a AS v FROM s UNION ALL SELECT b FROM s UNION ALL SELECT c FROM s))
SELECT round(sum(ln(greatest(least(a, t), 0.05))), 2) AS scale_0, round(sum(ln(greatest(least(b, t), 0.05))), 2) AS scale_1, round(sum(ln(greatest(least(c, t), 0.05))), 2) + 0.0 AS scale_2, round(any_value(t), 6) AS limit, count(*) FILTER (greatest(a, b, c) > t) AS clamped, false AS normals FROM s, q
"""


def level_plans(spark, d):
    """Suppliers' line items as sources: which levels are worth building, the default one, and what a view of 20 gets."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("n"))
    levels = L.planned_levels(n, [400, 10, 25, 100])
    index = L.level_index(levels, 50)
    return index.join(L.planned_sources(levels, F.lit(20)), "source").select("source", "gaussians", F.col("default_level").cast("long").alias("default_level"), F.size("levels").cast("long").alias("levels"), F.col("level").cast("long").alias("level"))


LEVELS = """
WITH n AS (SELECT l_suppkey AS source, count(*) AS n FROM lineitem GROUP BY 1), l AS (SELECT source, n, b FROM n, (VALUES (10), (25), (100), (400)) t(b) WHERE n > 1.3 * b)
SELECT source, n AS gaussians, coalesce(min(b) FILTER (b >= 50), max(b))::BIGINT AS default_level, count(*) AS levels, coalesce(max(b) FILTER (b <= 20), min(b))::BIGINT AS level FROM l GROUP BY 1, 2
"""

def seen_clusters(spark, d):
    """Parts by type as clusters before suppliers' cameras: the view that shows most of each, and the basis that fits."""
    p = objects(spark, d).select(F.col("scan").alias("cluster"), "x", "y", "z")
    eye = [F.col("s_suppkey") % 4 * 1.0, F.col("s_suppkey") % 3 * 1.0, F.lit(-2.0) - F.col("s_suppkey") % 5]
    pose = F.array(*[c.cast("double") for i in range(3) for c in (*[F.lit(float(i == k)) for k in range(3)], eye[i])], *[F.lit(float(k == 3)) for k in range(4)])
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("view"), pose.alias("c2w"), F.lit(90.0).alias("fx"), F.lit(90.0).alias("fy"), F.lit(160.0).alias("cx"), F.lit(120.0).alias("cy"), F.lit(320).alias("width"), F.lit(240).alias("height"))
    best = kept(V.best_views(V.cluster_views(p, v)), "best-views")
    # pictures of the views that are some cluster's best
    px = V.depth_picture(p, v.join(best.select("view").distinct(), "view", "left_semi")).groupBy("view").agg(F.count("*").alias("pixels"), _r(F.sum("depth"), "total", 3))
    basis = V.view_basis(p, v).limit(1)
    return best.join(px, "view").crossJoin(F.broadcast(basis)).select("cluster", "view", _r("inside_frac", "inside_frac"), _r("area", "area", 3), _r("depth", "depth"), "pixels", "total", "basis", _r("share", "share"))


SEEN = f"""
WITH {OBJECTS_SQL}, v AS (SELECT s_suppkey AS view, (s_suppkey % 4)::DOUBLE AS ex, (s_suppkey % 3)::DOUBLE AS ey, -2.0 - s_suppkey % 5 AS ez FROM supplier),
c AS (SELECT scan AS cluster, view, z - ez AS depth, 90 * (x - ex) / (z - ez) + 160 AS u, 90 * (y - ey) / (z - ez) + 120 AS w FROM objects, v),
i AS (SELECT *, u >= 0 AND u < 320 AND w >= 0 AND w < 240 AS inside FROM c),
g AS (SELECT cluster, view, avg(inside::INT::DOUBLE) AS f, median(depth) AS depth, greatest(max(u) FILTER (inside) - min(u) FILTER (inside), 1) * greatest(max(w) FILTER (inside) - min(w) FILTER (inside), 1) AS area FROM i GROUP BY 1, 2 HAVING avg(inside::INT) > 0),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY f * area DESC, view) = 1),
p AS (SELECT view, round_even(w, 0) AS r, round_even(u, 0) AS k, min(depth) AS depth FROM i WHERE round_even(w, 0) BETWEEN 0 AND 239 AND round_even(u, 0) BETWEEN 0 AND 319 GROUP BY 1, 2, 3), q AS (SELECT view, count(*) AS pixels, sum(depth) AS total FROM p GROUP BY 1),
s AS (SELECT max(a) AS share FROM (SELECT avg(inside::INT::DOUBLE) AS a FROM i GROUP BY view))
SELECT cluster, b.view, round(f, 6) AS inside_frac, round(area, 3) AS area, round(depth, 6) AS depth, pixels, round(total, 3) AS total, 'opencv' AS basis, round(share, 6) AS share FROM b JOIN q ON b.view = q.view, s
"""


def nearest_things(spark, d):
    """Suppliers' nearest wall of four and the free cell nearest to each nation."""
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 5).alias("y"), F.lit(1.0).alias("z"))
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    walls = spark.range(4).select(F.col("id").alias("wall"), F.array(F.col("id") * 3.0, F.lit(0.0), F.lit(0.0)).alias("point"), vec(1, 0, 0).alias("normal"), vec(0, 1, 0).alias("axis_u"), vec(0, 0, 1).alias("axis_v"), F.lit(0.0).alias("u0"), (F.col("id") + 2.0).alias("u1"), F.lit(0.0).alias("v0"), F.lit(2.0).alias("v1"))
    w = V.nearest_wall(s, walls, "s_suppkey")
    cells = s.select(F.floor("x").alias("iu"), F.floor("y").alias("iv")).distinct().select("iu", "iv", (F.col("iu") + 0.5).alias("cu"), (F.col("iv") + 0.5).alias("cv"))
    c = V.nearest_cell(table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") / 3).alias("u"), (F.col("n_regionkey") * 1.0).alias("v")), cells, "n_nationkey")
    return w.select(F.concat(F.lit("wall of "), "s_suppkey").alias("what"), F.col("wall").cast("string").alias("which"), _r("distance", "distance")).unionByName(c.select(F.concat(F.lit("cell of "), "n_nationkey").alias("what"), F.concat_ws(",", "iu", "iv").alias("which"), _r("distance", "distance")))


NEAREST = """
WITH s AS (SELECT s_suppkey, s_acctbal / 1000 AS x, s_nationkey / 5 AS y FROM supplier), w AS (SELECT s_suppkey, i, abs(x - 3 * i) AS d FROM s, range(4) t(i) WHERE y BETWEEN 0 AND i + 2 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(x - 3 * i), i) = 1),
c AS (SELECT DISTINCT floor(x)::BIGINT AS iu, floor(y)::BIGINT AS iv FROM s),
n AS (SELECT n_nationkey, iu, iv, sqrt(pow(iu + 0.5 - n_nationkey / 3, 2) + pow(iv + 0.5 - n_regionkey, 2)) AS d FROM nation, c QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY d, iu, iv) = 1)
SELECT 'wall of ' || s_suppkey AS what, i::VARCHAR AS which, round(d, 6) + 0.0 AS distance FROM w UNION ALL SELECT 'cell of ' || n_nationkey, iu || ',' || iv, round(d, 6) + 0.0 FROM n
"""


def cloud_facts(spark, d):
    """Line items as a cloud: its up axis, how full its footprint is, its opaque centre, and determinants' signs."""
    x = table(spark, d, "lineitem")
    p = x.select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), (F.col("l_tax") * 100 - 4).alias("opacity"))
    one, zero = F.lit(1.0), F.lit(0.0)
    m = F.array(F.col("x") - 25, zero, one, zero, F.col("z"), zero, zero, zero, one)
    c = V.weighted_center(p)
    return V.up_axis(p).crossJoin(V.footprint_fill(p, "x", "z")).crossJoin(c).crossJoin(V.determinant_counts(p.withColumn("m", m), F.col("m"))).select("axis", "cells", "bins", _r("fill", "fill"), *[_r(k, k) for k in "xyz"], "n", "negative", "near_zero", "not_finite")


FACTS = """
WITH p AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, 1 / (1 + exp(-(l_tax * 100 - 4))) AS w FROM lineitem), e AS (SELECT min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1, max(y) - min(y) AS ry, count(*) AS n, greatest(6, least(24, floor(sqrt(count(*) / 6))))::INT AS bins FROM p),
c AS (SELECT count(DISTINCT (least(floor((x - x0) / (x1 - x0) * bins), bins - 1), least(floor((z - z0) / (z1 - z0) * bins), bins - 1))) AS cells FROM p, e), w AS (SELECT sum(x * w) / sum(w) AS x, sum(y * w) / sum(w) AS y, sum(z * w) / sum(w) AS z FROM p WHERE w >= 0.35),
d AS (SELECT count(*) AS n, count(*) FILTER ((x - 25) * z < 0) AS negative, count(*) FILTER (abs((x - 25) * z) < 1e-6) AS near_zero FROM p)
SELECT CASE WHEN ry <= z1 - z0 THEN 'y' ELSE 'z' END AS axis, cells, bins, round(cells / bins ** 2, 6) AS fill, round(w.x, 6) AS x, round(w.y, 6) AS y, round(w.z, 6) AS z, d.n, negative, near_zero, 0::BIGINT AS not_finite FROM e, c, w, d
"""


def log_and_sessions(spark, d):
    """Users' events as a log that is flushed in batches, idle users, and events whose type isn't that of the user's first."""
    e = table(spark, d, "events")
    b = V.log_batches(e, "user_id", "ts", "event_id", 4, 3600.0).groupBy("user_id").agg(F.max("seq").cast("long").alias("last_seq"), F.max("batch").cast("long").alias("last_batch"))
    newest = e.agg(F.max("ts")).first()[0]
    idle = V.idle_sessions(e, "user_id", "ts", F.lit(newest).cast("timestamp"), 7200.0).select("user_id", F.lit(True).alias("idle"))
    foreign = V.foreign_messages(e.select(F.col("user_id").alias("connection"), F.col("event_type").alias("session"), F.struct("ts", "event_id").alias("at")), "at").groupBy(F.col("connection").alias("user_id")).agg(F.count_if("refused").alias("refused"))
    return b.join(idle, "user_id", "left").join(foreign, "user_id").select("user_id", "last_seq", "last_batch", F.coalesce("idle", F.lit(False)).alias("idle"), "refused")


LOGS = """
WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, first(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events),
b(user_id, i, batch, n, first) AS (SELECT user_id, i, 0, 1, t FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, CASE WHEN b.n >= 4 OR e.t - b.first >= 3600 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 4 OR e.t - b.first >= 3600 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 4 OR e.t - b.first >= 3600 THEN e.t ELSE b.first END FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1),
m AS (SELECT user_id, max(i) - 1 AS last_seq, max(batch)::BIGINT AS last_batch FROM b GROUP BY 1), x AS (SELECT user_id, max(t) AS last, count(*) FILTER (event_type <> f) AS refused FROM e GROUP BY 1)
SELECT user_id, last_seq, last_batch, (SELECT max(t) FROM e) - last > 7200 AS idle, refused FROM m JOIN x USING (user_id)
"""


QUERIES = {f.__name__: f for f in (frame_budget, cited, related_terms, mentioned_terms, scene_lookup, focused, tool_calls, spend_ceiling, layer_changes, latest_records, trusted_suppliers, best_crops, lifted_tracks, depth_windows, body_measures, resampled_paths, timeline_spread, matching_frames, fed_numbers, splat_clamp, level_plans, seen_clusters, nearest_things, cloud_facts, log_and_sessions)}
ORACLES = {
    "frame_budget": BUDGET, "cited": CITED, "related_terms": RELATED, "mentioned_terms": MENTIONED, "scene_lookup": LOOKUP, "focused": FOCUSED, "tool_calls": CALLS, "spend_ceiling": CEILING, "layer_changes": CHANGES, "latest_records": LATEST, "trusted_suppliers": TRUSTED,
    "best_crops": CROPS, "lifted_tracks": LIFTED, "depth_windows": WINDOWS, "body_measures": BODIES, "timeline_spread": SPREAD, "resampled_paths": RESAMPLED, "matching_frames": MATCHING, "fed_numbers": FED, "splat_clamp": CLAMP, "level_plans": LEVELS, "seen_clusters": SEEN, "nearest_things": NEAREST, "cloud_facts": FACTS, "log_and_sessions": LOGS,
}
