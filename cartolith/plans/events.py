"""Queries over the event stream: visits, thinning, replay, nearest and interpolated times, chunks, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions import text as X
from cartolith.functions.time import micros
from cartolith.operators import aggregates as A
from cartolith.operators import joins as J
from cartolith.operators import tables as T
from cartolith.operators import windows as Wn
from cartolith.plans.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _of(spark: SparkSession, d: str, kind: str, *cols: str) -> DataFrame:
    return _events(spark, d).filter(F.col("event_type") == kind).select("event_id", "user_id", "ts", *cols)


def visits_by_user(spark, d):
    return Wn.visit_summary(_events(spark, d), gap_s=6 * 3600.0, return_s=86400.0)


VISITS = """
WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM g),
s AS (SELECT user_id, visit, count(*) AS n, min(ts) AS start, max(ts) AS fin FROM v GROUP BY ALL),
f AS (SELECT *, min(start) OVER (PARTITION BY user_id) AS first FROM s),
k AS (SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1)
SELECT f.user_id, sum(n)::BIGINT AS requests, count(*) AS visits, any_value(kinds) AS kinds, min(start) AS first_seen, max(fin) AS last_seen,
  min(CASE WHEN visit > 1 AND date_diff('microsecond', first, start) >= 86400000000 THEN start END) AS returned_at
FROM f JOIN k ON f.user_id = k.user_id GROUP BY f.user_id
"""


def visit_rows(spark, d):
    return Wn.visits(_events(spark, d), gap_s=6 * 3600.0).select("event_id", "user_id", "visit")


VISIT_ROWS = """
WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS visit FROM g
"""


def replay_delays(spark, d):
    return Wn.replay(_events(spark, d), "user_id").select("event_id", "user_id", "seq", F.round("delay_s", 6).alias("delay_s"))


REPLAY = """
SELECT event_id, user_id, row_number() OVER w - 1 AS seq,
  round(greatest(0.12, least(2.5, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) / 1e6, 0.12))), 6) AS delay_s
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


def thinned(spark, d):
    return Wn.thin(_events(spark, d), "user_id", "ts", 43200.0).select("event_id", "user_id", "ts")


THINNED = """
WITH RECURSIVE k(user_id, ts) AS (
  SELECT user_id, min(ts) FROM events GROUP BY user_id
  UNION ALL
  SELECT k.user_id, min(e.ts) FROM k JOIN events e ON e.user_id = k.user_id AND date_diff('microsecond', k.ts, e.ts) >= 43199999900 GROUP BY k.user_id, k.ts)
SELECT e.event_id, e.user_id, e.ts FROM events e JOIN k ON e.user_id = k.user_id AND e.ts = k.ts
"""


def _nearest(spark, d, tie, tolerance):
    left = _of(spark, d, "click")
    right = _of(spark, d, "purchase", "value")
    out = J.nearest_time(left, right, "user_id", "ts", tolerance, tie)
    return out.select("event_id", F.col("match.event_id").alias("match_id"), F.round("gap_s", 6).alias("gap_s"))


def nearest_purchase(spark, d):
    return _nearest(spark, d, "left", 36000.0)


def nearest_purchase_late(spark, d):
    return _nearest(spark, d, "right", 18000.0)


def _nearest_sql(tie: str, tolerance: int) -> str:
    return f"""
WITH l AS (SELECT * FROM events WHERE event_type = 'click'), r AS (SELECT * FROM events WHERE event_type = 'purchase'),
p AS (SELECT l.event_id, r.event_id AS match_id, abs(date_diff('microsecond', l.ts, r.ts)) AS gap,
  row_number() OVER (PARTITION BY l.event_id ORDER BY abs(date_diff('microsecond', l.ts, r.ts)), r.ts {tie}, r.event_id) AS rn
  FROM l LEFT JOIN r ON l.user_id = r.user_id)
SELECT event_id, CASE WHEN gap <= {tolerance}000000 THEN match_id END AS match_id, round(gap / 1e6, 6) AS gap_s FROM p WHERE rn = 1
"""


def interpolated_value(spark, d):
    out = J.interpolated(_of(spark, d, "purchase"), _of(spark, d, "view", "value"), "user_id", "ts", "value")
    return out.select("event_id", F.round("interpolated", 6).alias("interpolated"))


INTERPOLATED = """
WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT * FROM events WHERE event_type = 'view'),
b AS (SELECT l.event_id, l.ts, max_by(r.value, r.ts) AS v0, max(r.ts) AS t0 FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.ts <= l.ts GROUP BY ALL),
a AS (SELECT l.event_id, min_by(r.value, r.ts) AS v1, min(r.ts) AS t1 FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.ts > l.ts GROUP BY ALL)
SELECT event_id, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) * (date_diff('microsecond', t0, ts)::DOUBLE / date_diff('microsecond', t0, t1)::DOUBLE) END, 6) AS interpolated FROM b JOIN a USING (event_id)
"""


def coverage(spark, d):
    return J.covered(_of(spark, d, "click"), _of(spark, d, "view"), "user_id", "ts")


COVERAGE = """
WITH s AS (SELECT user_id, min(ts) AS low, max(ts) AS high FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT e.user_id, bool_and(coalesce(e.ts BETWEEN low AND high, false)) AS covered FROM events e LEFT JOIN s USING (user_id) WHERE event_type = 'click' GROUP BY 1
"""


def rolling_values(spark, d):
    return Wn.rolling_median(_events(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("rolling", 6).alias("rolling"))


ROLLING = """
WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1),
p AS (SELECT user_id, list_concat(list_concat(list_transform(range(7), lambda i: v[1]), v), list_transform(range(7), lambda i: v[-1])) AS v FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, round(list_sort(v[i:i + 14])[8], 6) AS rolling FROM n JOIN p USING (user_id)
"""


def value_paths(spark, d):
    return Wn.path_length(_events(spark, d), "user_id", ["ts", "event_id"], ["value"]).select("user_id", F.round("length", 6).alias("length"))


PATHS = """
SELECT user_id, round(coalesce(sum(s), 0), 6) AS length FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS s FROM events) GROUP BY 1
"""


def event_chunks(spark, d):
    return Wn.chunks(_events(spark, d), "user_id", ["ts", "event_id"], 8, 1).select("event_id", "chunk", "position")


CHUNKS = """
WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT *, unnest(range(0, greatest(0, (n - 2) // 8) + 1)) AS chunk FROM n)
SELECT event_id, chunk, position FROM c WHERE position BETWEEN chunk * 8 AND chunk * 8 + 8
"""


def arrival_order(spark, d):
    return Wn.out_of_order(_events(spark, d), "user_id", ["ts", "event_id"], "event_id").select("event_id", "expected", "in_order")


ARRIVAL = """
SELECT event_id, coalesce(lag(event_id) OVER w + 1, min(event_id) OVER (PARTITION BY user_id)) AS expected,
  event_id = coalesce(lag(event_id) OVER w + 1, min(event_id) OVER (PARTITION BY user_id)) AS in_order
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


def spaced_events(spark, d):
    return Wn.evenly_spaced(_events(spark, d), "user_id", ["ts", "event_id"], 5).select("event_id", "user_id")


SPACED = """
WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id FROM n WHERE n <= 5 OR p IN (SELECT unnest(list_transform(range(5), lambda i: round_even(i * (n - 1) / 4, 0)::BIGINT)))
"""


def stride_events(spark, d):
    return Wn.every_kth(_events(spark, d), "user_id", ["ts", "event_id"], 20).select("event_id", "user_id")


STRIDE = """
WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id FROM n WHERE p % greatest(1, ceil(n / 20)::BIGINT) = 0
"""


def jerk_by_user(spark, d):
    return Wn.third_differences(_events(spark, d), "user_id", ["ts", "event_id"], ["value"]).select("user_id", F.round("jerk", 6).alias("jerk"))


JERK = """
SELECT user_id, round(avg(j), 6) AS jerk FROM (SELECT user_id, abs(value - 3 * lag(value, 1) OVER w + 3 * lag(value, 2) OVER w - lag(value, 3) OVER w) AS j
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1
"""


def smooth_values(spark, d):
    return Wn.smoothed(_events(spark, d), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("smooth", 6).alias("smooth"))


SMOOTH = """
WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, round(CASE WHEN i = 1 OR i = len(v) THEN value ELSE list_sum(list_transform(range(i - 2, i + 3), lambda j: v[greatest(1, least(len(v), j))])) / 5 END, 6) AS smooth
FROM n JOIN s USING (user_id)
"""


def stream_catalogue(spark, d):
    names = _events(spark, d).select("event_type").distinct().unionByName(spark.createDataFrame([("none",)], "event_type string"))
    return A.catalogue(names, _events(spark, d), "event_type", "ts").select("event_type", "n", "first", "last", F.round("span_s", 6).alias("span_s"))


CATALOGUE = """
SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 6) AS span_s FROM events GROUP BY 1
UNION ALL SELECT 'none', 0, NULL, NULL, 0.0
"""


def usage_tally(spark, d):
    calls = _events(spark, d).select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    calls = calls.withColumn("cost", F.when(F.col("user_id") % 3 == 0, F.lit(None)).when(F.col("user_id") % 3 == 1, F.coalesce("cost", F.lit(0.0))).otherwise(F.col("cost")))
    return A.tally(calls, "user_id", "cost", ["tokens"])


TALLY = """
WITH c AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL WHEN event_type <> 'error' THEN value WHEN user_id % 3 = 1 THEN 0.0 END AS cost, (props->>'$.k')::BIGINT AS tokens FROM events)
SELECT user_id, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost,
  CASE WHEN count(cost) = count(*) THEN 'full' WHEN count(cost) > 0 THEN 'partial' ELSE 'unreported' END AS basis FROM c GROUP BY 1
"""


def latency(spark, d):
    out = A.latency_summary(_events(spark, d).select("event_type", "value", (micros("ts") / 1e12).alias("t")), "event_type", "t", "value")
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round("slope", 4).alias("slope"), "n")


LATENCY = """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(regr_slope(value, epoch_us(ts) / 1e12), 4) AS slope, count(*) AS n FROM events GROUP BY 1
"""


def event_cursor(spark, d):
    rows = _events(spark, d).filter("event_id > 100")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.coalesce(F.max("event_id"), F.lit(-1)).alias("next"))


CURSOR = "SELECT user_id, count(*) AS n, coalesce(max(event_id), -1) AS next FROM events WHERE event_id > 100 GROUP BY 1"


def latest_state(spark, d):
    return T.latest(_events(spark, d).select("user_id", "event_type", "ts", "event_id"), ["user_id"], "ts", "event_id")


LATEST = "SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def field_edits(spark, d):
    log = _events(spark, d).select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("label"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("note"))
    return T.edited(log, ["user_id"], ["label", "note"], "ts", "event_id")


EDITS = """
SELECT user_id, max_by(value, (ts, event_id)) FILTER (event_type = 'click') AS label, max_by(event_id, (ts, event_id)) FILTER (event_type = 'error') AS note FROM events GROUP BY 1
"""


def history_page(spark, d):
    return T.page(_events(spark, d).select("event_id", "user_id", "ts"), [F.desc("ts"), F.desc("event_id")], 40, 20)


PAGE = "SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40"


def access_digests(spark, d):
    e = _events(spark, d)
    return e.select("event_id", X.digest(F.col("user_id").cast("string"), 12).alias("access_id"), X.digest(F.concat(F.lit("salt:"), F.col("event_type")), 16).alias("device"), F.get_json_object("props", "$.k").cast("long").alias("k"))


DIGESTS = "SELECT event_id, left(sha256(user_id::VARCHAR), 12) AS access_id, left(sha256('salt:' || event_type), 16) AS device, (props->>'$.k')::BIGINT AS k FROM events"


def track_summaries(spark, d):
    s = _events(spark, d).select("user_id", "event_id", F.col("value").alias("x"), (F.col("value") / 2).alias("y"), F.lit(0.0).alias("z"), (F.col("event_type") == "click").alias("visible"))
    out = A.track_summary(s, "user_id", "event_id", ("x", "y", "z"), "visible")
    return out.select("user_id", *[F.round(c, 9).alias(c) for c in ("x", "y", "z", "displacement")], "moving", "samples")


TRACKS = """
WITH s AS (SELECT user_id, event_id, value AS x, value / 2 AS y, event_type = 'click' AS visible FROM events),
o AS (SELECT *, sqrt(pow(x - first(x) OVER w, 2) + pow(y - first(y) OVER w, 2)) AS off FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(coalesce(avg(x) FILTER (visible), avg(x)), 9) AS x, round(coalesce(avg(y) FILTER (visible), avg(y)), 9) AS y, 0.0::DOUBLE AS z,
  round(max(off), 9) AS displacement, max(off) > 0.05 AS moving, count(*) AS samples FROM o GROUP BY 1
"""


def quality_levels(spark, d):
    rows = _events(spark, d).select("user_id", (micros("ts") / 1e6).alias("ts"), F.col("value").alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"))
    out = Wn.trajectory_quality(rows, "user_id")
    return out.select("user_id", "n_poses", F.round("trend", 5).alias("trend"), F.round("cv", 5).alias("cv"), F.round("jump_rate", 6).alias("jump_rate"), "level")


QUALITY = """
WITH s AS (SELECT user_id, ts, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)) AS step FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM s WHERE step IS NOT NULL),
v AS (SELECT user_id, list(step ORDER BY ts) AS v FROM f GROUP BY 1),
p AS (SELECT user_id, list_concat(list_concat(list_transform(range(7), lambda i: v[1]), v), list_transform(range(7), lambda i: v[-1])) AS v FROM v),
r AS (SELECT f.*, list_sort(p.v[pos:pos + 14])[8] AS roll FROM f JOIN p USING (user_id)),
a AS (SELECT user_id, any_value(n) AS n, median(step) FILTER (pos <= greatest(5, n // 5)) AS head, median(step) FILTER (pos > n - greatest(5, n // 5)) AS tail,
  avg(step) AS mean, stddev_pop(step) AS std, avg((step > 8 * greatest(roll, 1e-12))::INT) AS jump_rate FROM r GROUP BY 1),
b AS (SELECT user_id, n, jump_rate, CASE WHEN head > 1e-12 THEN tail / head ELSE 'infinity'::DOUBLE END AS trend, CASE WHEN mean > 1e-12 THEN std / mean ELSE 'infinity'::DOUBLE END AS cv FROM a),
c AS (SELECT e.user_id, e.n_poses, b.* EXCLUDE (user_id) FROM (SELECT user_id, count(*) AS n_poses FROM events GROUP BY 1) e LEFT JOIN b USING (user_id))
SELECT user_id, n_poses, round(trend, 5) AS trend, round(cv, 5) AS cv, round(jump_rate, 6) AS jump_rate,
  CASE WHEN coalesce(n, 0) < 10 OR n_poses < 30 OR trend < 0.4 OR trend > 2.5 OR cv > 2.5 OR jump_rate > 0.08 THEN 'out_of_class'
       WHEN cv > 1.2 OR jump_rate > 0.02 THEN 'needs_review' ELSE 'high_confidence' END AS level FROM c
"""

QUERIES = {f.__name__: f for f in (visits_by_user, visit_rows, replay_delays, thinned, nearest_purchase, nearest_purchase_late, interpolated_value, coverage, rolling_values, value_paths, event_chunks, arrival_order, spaced_events, stride_events, jerk_by_user, smooth_values, stream_catalogue, usage_tally, latency, event_cursor, latest_state, field_edits, history_page, access_digests, track_summaries, quality_levels)}

ORACLES = {
    "visits_by_user": VISITS, "visit_rows": VISIT_ROWS, "replay_delays": REPLAY, "thinned": THINNED, "nearest_purchase": _nearest_sql("ASC", 36000),
    "nearest_purchase_late": _nearest_sql("DESC", 18000), "interpolated_value": INTERPOLATED, "coverage": COVERAGE, "rolling_values": ROLLING, "value_paths": PATHS,
    "event_chunks": CHUNKS, "arrival_order": ARRIVAL, "spaced_events": SPACED, "stride_events": STRIDE, "jerk_by_user": JERK, "smooth_values": SMOOTH,
    "stream_catalogue": CATALOGUE, "usage_tally": TALLY, "latency": LATENCY, "event_cursor": CURSOR, "latest_state": LATEST, "field_edits": EDITS,
    "history_page": PAGE, "access_digests": DIGESTS, "track_summaries": TRACKS, "quality_levels": QUALITY,
}
