"""Queries over column functions: rotations, cameras, measures, scales, masks, boxes and texts, on parts, suppliers, events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import arrays as A
from cartolith.functions import geometry as G
from cartolith.functions import placing as P
from cartolith.operators import scene as S
from cartolith.operators import folds
from cartolith.plans.tables import rounded, table

#: Vectors of a part: a and b, neither of length 0.
_A, _B = ("p_size - 25.5", "p_retailprice / 1000", "p_partkey % 7 - 3.0"), ("p_partkey % 11 - 5.5", "1.0", "p_size / 10")


def _vectors(spark, d):
    p = table(spark, d, "part")
    vec = lambda parts: F.array(*[F.expr(e).cast("double") for e in parts])
    return p.select("p_partkey", "p_size", "p_retailprice", vec(_A).alias("a"), vec(_B).alias("b"))


VECTORS = f"v AS (SELECT p_partkey, p_size, p_retailprice, {', '.join(f'({e})::DOUBLE AS a{i}, ({f})::DOUBLE AS b{i}' for i, (e, f) in enumerate(zip(_A, _B, strict=True)))} FROM part)"


def _r(c, name, digits=6):
    # adding 0.0 turns -0.0 into 0.0
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def _cube(x):
    """x ** 3, rounded once: Spark's pow and the C library's differ in the last bit now and then."""
    def product(a, b):
        # Dekker: the product and its rounding error
        parts = [(v * 134217729.0 - (v * 134217729.0 - v), v) for v in (a, b)]
        (ah, bh), (al, bl) = [h for h, _ in parts], [v - h for h, v in parts]
        return a * b, ((ah * bh - a * b) + ah * bl + al * bh) + al * bl

    square, off = product(x, x)
    cube, more = product(square, x)
    return cube + (more + off * x)


def rotated_vectors(spark, d):
    """b under the rotation of a quaternion made of a, its determinant, and the quaternion that comes back from it."""
    v = _vectors(spark, d)
    v = v.withColumn("m", F.array(*G.matrix_of(v.a[0], v.a[1], v.a[2], F.lit(2.5))))
    m = [F.col("m")[i] for i in range(9)]
    v = v.withColumn("back", G.quaternion_of(m))
    back = F.col("back")
    sign = F.when(back["w"] < 0, -1.0).otherwise(1.0)
    rows = [sum((m[3 * i + k] * v.b[k] for k in (1, 2)), m[3 * i] * v.b[0]) for i in range(3)]
    return v.select("p_partkey", *[_r(c, f"r{i}") for i, c in enumerate(rows)], _r(G.determinant(m), "det"), *[_r(back[c] * sign, f"q{c}") for c in "xyzw"])


ROTATED = f"""
WITH {VECTORS}, q AS (SELECT *, sqrt(a0 * a0 + a1 * a1 + a2 * a2 + 6.25) AS n FROM v),
t AS (SELECT *, a0 / n AS x, a1 / n AS y, a2 / n AS z, 2.5 / n AS w FROM q),
c AS (SELECT *, 2 * (y * b2 - z * b1) AS t0, 2 * (z * b0 - x * b2) AS t1, 2 * (x * b1 - y * b0) AS t2 FROM t)
SELECT p_partkey, round(b0 + w * t0 + y * t2 - z * t1, 6) + 0.0 AS r0, round(b1 + w * t1 + z * t0 - x * t2, 6) + 0.0 AS r1, round(b2 + w * t2 + x * t1 - y * t0, 6) + 0.0 AS r2,
  1.0::DOUBLE AS det, round(x, 6) + 0.0 AS qx, round(y, 6) + 0.0 AS qy, round(z, 6) + 0.0 AS qz, round(w, 6) + 0.0 AS qw FROM c
"""


def shortest_turns(spark, d):
    """a's direction after the shortest turn onto b, and onto its own opposite."""
    v = _vectors(spark, d)
    u = P.unit(v.a)
    turned = lambda m: [sum((m[3 * i + k] * u[k] for k in (1, 2)), m[3 * i] * u[0]) for i in range(3)]
    v = v.withColumns({"m": P.shortest_arc(v.a, v.b), "n": P.shortest_arc(v.a, P.scaled(v.a, F.lit(-2.0))), "u": u})
    u = v.u
    to, back = turned(v.m), turned(v.n)
    return v.select("p_partkey", *[_r(c, f"to{i}") for i, c in enumerate(to)], *[_r(c, f"back{i}") for i, c in enumerate(back)])


_NORM = "sqrt({0}0 * {0}0 + {0}1 * {0}1 + {0}2 * {0}2)"
TURNS = f"""
WITH {VECTORS} SELECT p_partkey, {", ".join(f"round(b{i} / {_NORM.format('b')}, 6) + 0.0 AS to{i}, round(-a{i} / {_NORM.format('a')}, 6) + 0.0 AS back{i}" for i in range(3))} FROM v
"""


def cameras(spark, d):
    """Where a camera at a that looks at b faces, by its quaternion and by its rotation's columns; both as OpenCV's forward."""
    v = _vectors(spark, d)
    up = P.constant(0.1, 0.2, 1.0)
    v = v.withColumns({"q": P.look_at(v.a, v.b, up), "own": P.camera_rotation(F.zip_with(v.b, v.a, lambda x, y: x - y), up)})
    v = v.withColumn("gl", F.array(*G.matrix_of(*[F.col(f"q.{c}") for c in "xyzw"])))
    v = v.withColumn("cv", P.opencv_pose(F.col("gl")))
    cv, own = v.cv, v.own
    level = own[1] * 0.1 + own[4] * 0.2 + own[7] * 1.0
    return v.select("p_partkey", *[_r(cv[3 * i + 2], f"look{i}") for i in range(3)], *[_r(own[3 * i + 2], f"ahead{i}") for i in range(3)], (level < 0).alias("down_is_down"))


CAMERAS = f"""
WITH {VECTORS}, f AS (SELECT p_partkey, b0 - a0 AS f0, b1 - a1 AS f1, b2 - a2 AS f2 FROM v)
SELECT p_partkey, {", ".join(f"round(f{i} / {_NORM.format('f')}, 6) + 0.0 AS look{i}, round(f{i} / {_NORM.format('f')}, 6) + 0.0 AS ahead{i}" for i in range(3))}, true AS down_is_down FROM f
"""


def projections(spark, d):
    """Pixels of a point before a camera, the point that comes back from them, and intrinsics from a field of view and after a resize."""
    v = _vectors(spark, d)
    u, w, z = G.projected((v.a[0], v.a[1], v.a[2] + 2.0), 600.0, 500.0, 320.0, 240.0)
    v = v.withColumns({"u": u, "w": w, "z": z, "k": P.intrinsics(F.lit(640), F.lit(480), 20.0 + v.p_size)})
    u, w, z, k = v.u, v.w, v.z, v.k
    back = G.unprojected(u, w, z, 600.0, 500.0, 320.0, 240.0)
    small = P.rescaled_intrinsics(k, P.constant(640, 480, 0), P.constant(320, 120, 0))
    box = G.clipped_box(F.array(u, w, u + 30.0, w + 20.0), F.lit(640.0), F.lit(480.0))
    return v.select("p_partkey", _r(u, "u"), _r(w, "w"), *[_r(c, f"back{i}") for i, c in enumerate(back)], _r(k[0], "fx"), _r(small[0], "small_fx"), _r(small[1], "small_fy"), _r((box[2] - box[0]) * (box[3] - box[1]), "area", 4))


PROJECTED = f"""
WITH {VECTORS}, p AS (SELECT *, CASE WHEN a2 + 2 > 1e-9 THEN a2 + 2 END AS z FROM v), q AS (SELECT *, 600 * a0 / z + 320 AS u, 500 * a1 / z + 240 AS w, 240 / tan(radians(20 + p_size) / 2) AS f FROM p),
c AS (SELECT *, greatest(u, 0) AS x0, greatest(w, 0) AS y0, least(u + 30, 640) AS x1, least(w + 20, 480) AS y1 FROM q)
SELECT p_partkey, round(u, 6) + 0.0 AS u, round(w, 6) + 0.0 AS w, CASE WHEN z IS NOT NULL THEN round(a0, 6) + 0.0 END AS back0, CASE WHEN z IS NOT NULL THEN round(a1, 6) + 0.0 END AS back1, round(z, 6) + 0.0 AS back2,
  round(f, 6) AS fx, round(f * 0.5, 6) AS small_fx, round(f * 0.25, 6) AS small_fy, CASE WHEN z IS NOT NULL AND x1 > x0 AND y1 > y0 THEN round((x1 - x0) * (y1 - y0), 4) + 0.0 END AS area FROM c
"""


def measured_pairs(spark, d):
    """Distances with their units and errors, the angle at the origin, and the length in words."""
    v = _vectors(spark, d)
    scale = F.when(v.p_partkey % 3 == 0, 0.5).when(v.p_partkey % 3 == 1, float("nan"))
    other = F.when(v.p_partkey % 5 == 0, v.a).when(v.p_partkey % 7 == 0, F.slice(v.b, 1, 2)).when(v.p_partkey % 11 == 0, F.array(F.lit(float("inf")), v.b[1], v.b[2])).otherwise(v.b)
    v = v.withColumn("m", P.measured(v.a, other, scale))
    m = v.m
    zero = (F.lit(0.0),) * 3
    return v.select("p_partkey", _r(m["distance"], "distance"), m["units"].alias("units"), m["error"].alias("error"), _r(G.angle(P.xyz(v.a), zero, P.xyz(v.b)), "angle"), P.length_text(m["distance"], F.when(v.p_partkey % 3 == 0, 2.0)).alias("said"))


MEASURED = f"""
WITH {VECTORS}, k AS (SELECT *, p_partkey % 3 = 0 AS known, CASE WHEN p_partkey % 5 = 0 THEN 'the points are the same' WHEN p_partkey % 7 = 0 THEN 'not three numbers' WHEN p_partkey % 11 = 0 THEN 'not finite' END AS error FROM v),
m AS (SELECT *, CASE WHEN error IS NULL THEN sqrt(pow(a0 - b0, 2) + pow(a1 - b1, 2) + pow(a2 - b2, 2)) * CASE WHEN known THEN 0.5 ELSE 1 END END AS distance FROM k)
SELECT p_partkey, round(distance, 6) AS distance, CASE WHEN known THEN 'm' ELSE 'scene units' END AS units, error, round(degrees(acos(greatest(-1, least(1, (a0 * b0 + a1 * b1 + a2 * b2) / ({_NORM.format('a')} * {_NORM.format('b')}))))), 6) AS angle,
  CASE WHEN distance IS NULL THEN NULL WHEN known THEN printf('%.2f m', distance * 2) ELSE printf('%.2f units (relative, uncalibrated)', distance) END AS said FROM m
"""


def scale_ladders(spark, d):
    """Which scale is taken, and why, where suppliers' balance, nation and key stand for what is known."""
    s = table(spark, d, "supplier")
    given = F.when(s.s_suppkey % 4 == 0, s.s_acctbal / 1000)
    ref = F.when(s.s_suppkey % 3 == 0, s.s_nationkey.cast("double"))
    m = P.metric_scale(given, ref, F.lit(2.0), F.when(s.s_suppkey % 2 == 0, s.s_name))
    e = P.export_scale(given, ref, F.when(s.s_suppkey % 5 == 0, F.lit(1.5)))
    u = P.report_units(given, F.when(s.s_suppkey % 2 == 0, s.s_name), ref, s.s_nationkey / 10)
    state = G.metric_state(F.when(s.s_suppkey % 2 == 0, "anchor"), given, s.s_name)
    return s.select(
        "s_suppkey", _r(m["scale"], "scale"), m["source"].alias("source"), m["metric"].alias("metric"), _r(e["scale"], "export"), e["source"].alias("export_source"), e["refused"].alias("refused"), u["basis"].alias("basis"), _r(u["report_per_unit"], "per_unit"),
        state["metric_state"].alias("state"), _r(G.anchor_scale(F.lit(3.0), ref), "anchor"), _r(G.geometric_mean(F.array(given, ref)), "mean"), _r(G.covariance_factor(F.least(F.abs(given) / 10, F.lit(1.0))), "factor"),
    )


LADDERS = """
WITH s AS (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal / 1000 END AS g, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey::DOUBLE END AS r FROM supplier),
k AS (SELECT *, coalesce(g > 0, false) AS kg, coalesce(r > 1e-9, false) AS kr, coalesce(r > 0, false) AS pr FROM s)
SELECT s_suppkey, round(CASE WHEN kg THEN g WHEN kr THEN 2 / r ELSE 1 END, 6) AS scale, CASE WHEN kg THEN 'user:factor' WHEN kr THEN 'user:ref_object' || CASE WHEN s_suppkey % 2 = 0 THEN ':' || s_name ELSE '' END ELSE 'none' END AS source, kg OR kr AS metric,
  round(CASE WHEN kg THEN g WHEN pr THEN r WHEN s_suppkey % 5 = 0 THEN 1.5 END, 6) AS export, CASE WHEN kg THEN 'user' WHEN pr THEN 'anchor' WHEN s_suppkey % 5 = 0 THEN 'pointer' END AS export_source, NOT (kg OR pr OR s_suppkey % 5 = 0) AS refused,
  CASE WHEN kg THEN 'anchor:' || CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'derived_latest' END WHEN pr THEN 'capture_height_fraction' ELSE 'extent_fraction' END AS basis, round(CASE WHEN kg THEN g WHEN pr THEN 1 / r ELSE 1 / greatest(s_nationkey / 10, 1e-9) END, 6) AS per_unit,
  CASE WHEN s_suppkey % 2 = 0 AND kg THEN 'metric' ELSE 'up_to_scale' END AS state, CASE WHEN kr THEN round(3 / r, 6) END AS anchor,
  round(CASE WHEN g IS NULL AND r IS NULL THEN 1 WHEN r IS NULL THEN greatest(g, 1e-6) WHEN g IS NULL THEN greatest(r, 1e-6) ELSE sqrt(greatest(g, 1e-6) * greatest(r, 1e-6)) END, 6) AS mean,
  round(least(greatest(pow(100, 1 - CASE WHEN g IS NULL THEN 1 ELSE least(abs(g) / 10, 1) END), 1), 100), 6) AS factor FROM k
"""


def correlations(spark, d):
    e = table(spark, d, "embeddings")
    double = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", _r(P.correlation(F.slice(double, 1, 32), F.slice(double, 33, 32)), "corr"))


CORRELATIONS = "WITH u AS (SELECT vec_id, unnest(embedding[1:32])::DOUBLE AS x, unnest(embedding[33:64])::DOUBLE AS y FROM embeddings) SELECT vec_id, round(corr(x, y), 6) + 0.0 AS corr FROM u GROUP BY 1"


def unit_homographies(spark, d):
    """Triangular homographies scaled to determinant 1: the product of the diagonal tells what becomes of them."""
    p = table(spark, d, "part")
    last = F.when(p.p_partkey % 6 == 0, 0.0).when(p.p_partkey % 5 == 0, -1.0).otherwise(p.p_size / 10)
    m = F.array(*[F.expr(e).cast("double") for e in ("2", "p_size", "1", "0", "0", "p_size", "3", "1", "0", "0", "0.5", "p_partkey % 4", "0", "0", "0")], last)
    p = p.withColumn("m", m)
    p = p.withColumn("out", P.unit_determinant(p.m))
    m, out = p.m, p.out
    return p.select("p_partkey", out["error"].alias("error"), _r(P.determinant4(m), "det", 4), _r(P.determinant4(out["matrix"]), "unit"), _r(out["matrix"][15] / out["matrix"][0], "ratio"))


HOMOGRAPHIES = """
WITH t AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 6 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size / 10 END AS l FROM part)
SELECT p_partkey, CASE WHEN l = 0 THEN 'singular' WHEN l < 0 THEN 'negative determinant' END AS error, round(p_size * l, 4) + 0.0 AS det, CASE WHEN l > 0 THEN 1.0::DOUBLE END AS unit, CASE WHEN l > 0 THEN round(l / 2, 6) END AS ratio FROM t
"""


def asset_fits(spark, d):
    """Assets of three sizes put into boxes of three others, with the tier that the fit earns."""
    v = _vectors(spark, d)
    # tenths are divisions of whole numbers, which round once, as SQL's decimals do
    size = F.array(v.p_size / 10, (v.p_partkey % 9 + 1.0), v.p_retailprice / 500)
    fit = P.asset_fit(P.constant(0, 0, 0), size, P.constant(1, 2, 3), F.array(F.lit(2.0), v.p_size / 5, F.lit(1.0)), P.constant(*P.IDENTITY), P.constant(0, 0, 1))
    v = v.withColumns({"size": size, "fit": fit})
    size, fit = v["size"], v["fit"]
    longest = F.sort_array(size, asc=False)
    ratio = _cube(fit["scale"]) * longest[0] * longest[1] * longest[2] / (v.p_size * 4 / 10)
    # the asset's bottom meets the box's: which of its sizes stands along z shows in the translation
    middle = [sum((fit["rotation"][3 * i + k] * size[k] * fit["scale"] / 2 for k in (1, 2)), fit["rotation"][3 * i] * size[0] * fit["scale"] / 2) + fit["translation"][i] for i in range(3)]
    return v.select("p_partkey", rounded(fit["scale"]).alias("scale"), rounded(ratio).alias("ratio"), rounded(middle[0]).alias("x"), rounded(middle[1]).alias("y"), P.fit_tier(F.lit(0.1) + (v.p_partkey % 4) / 10, ratio).alias("tier"))


FITS = """
WITH s AS (SELECT p_partkey, p_size, list_reverse_sort([p_size * 0.1, p_partkey % 9 + 1.0, p_retailprice / 500]) AS a, list_reverse_sort([2.0, p_size * 0.2, 1.0]) AS t FROM part),
f AS (SELECT *, least(t[1] / a[1], t[2] / a[2], t[3] / a[3]) AS scale FROM s), r AS (SELECT *, pow(scale, 3) * a[1] * a[2] * a[3] / (2.0 * p_size * 0.2) AS ratio FROM f)
SELECT p_partkey, round(scale, 6) AS scale, round(ratio, 6) AS ratio, 1.0::DOUBLE AS x, 2.0::DOUBLE AS y,
  CASE (0.1 + (p_partkey % 4) / 10 <= 0.2)::INT + (ratio BETWEEN 0.2 AND 3)::INT WHEN 2 THEN 'good' WHEN 1 THEN 'usable' ELSE 'low' END AS tier FROM r
"""


def splat_values(spark, d):
    """Colours as harmonics and back, logits, importance, spacing, and a scaled splat's log size."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("p"), F.col("l_tax").alias("t"), F.col("l_quantity").alias("q"))
    return x.select(
        "l_orderkey", "l_linenumber", _r(P.sh_of_rgb(x.p), "sh"), _r(P.rgb_of_sh(P.sh_of_rgb(x.p)), "rgb"), _r(P.logit(x.p), "logit", 5), _r(G.splat_importance(x.t, (x.p, x.t, x.p)), "importance"),
        _r(P.spacing(x.q, F.col("l_linenumber") * 8), "spacing"),
    )


SPLATS = """
SELECT l_orderkey, l_linenumber, round((l_discount - 0.5) / 0.28209479177387814, 6) + 0.0 AS sh, round(l_discount, 6) AS rgb, round(ln(greatest(l_discount, 1e-6) / (1 - greatest(l_discount, 1e-6))), 5) AS logit,
  round(1 / (1 + exp(-l_tax)) * exp(2 * (2 * l_discount + l_tax) / 3), 6) AS importance, round(l_quantity / cbrt(l_linenumber * 8), 6) AS spacing FROM lineitem
"""


def headings(spark, d):
    """Every user's values as headings in order, none more than 0.3 from the one before."""
    e = table(spark, d, "events").filter("value IS NOT NULL").select("user_id", "ts", "event_id", (F.col("value") / 10).alias("raw"))
    out = folds.limited_headings(e, "user_id", ["ts", "event_id"], "raw", 0.3)
    return out.groupBy("user_id").agg(F.count("*").cast("int").alias("n"), _r(F.max_by("heading", F.struct("ts", "event_id")), "last"), _r(F.sum("heading"), "total", 4))


HEADINGS = """
WITH RECURSIVE e AS (SELECT user_id, value / 10 AS raw, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
h(user_id, i, n, h) AS (SELECT user_id, i, n, raw FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, e.n, h.h + least(greatest((SELECT CASE WHEN w = -pi() THEN pi() ELSE w END FROM (SELECT ((e.raw - h.h + pi()) - floor((e.raw - h.h + pi()) / (2 * pi())) * 2 * pi()) - pi() AS w)), -0.3), 0.3) FROM h JOIN e ON e.user_id = h.user_id AND e.i = h.i + 1)
SELECT user_id, max(n)::INT AS n, round(max(h) FILTER (i = n), 6) + 0.0 AS last, round(sum(h), 4) + 0.0 AS total FROM h GROUP BY 1
"""


def masks(spark, d):
    """Bits of a key as a mask of 4 x 4: its runs, its area, and whether it comes back; boxes of four numbers or none."""
    p = table(spark, d, "part")
    bits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.floor(p.p_partkey * 37 / F.pow(F.lit(2.0), i)) % 2 == 1)
    p = p.withColumn("bits", bits)
    p = p.withColumn("runs", A.rle_encode(p.bits))
    bits, runs = p.bits, p.runs
    back = A.rle_decode(F.array(F.lit(4), F.lit(4)), runs)
    box = A.box_or_null(F.when(p.p_partkey % 3 == 0, P.constant(1, 2, 3)).when(p.p_partkey % 3 == 1, P.constant(1, 2, 3, float("nan"))).otherwise(P.constant(1, 2, 3, 4)))
    grid = A.transposed(F.array(F.array(p.p_partkey, p.p_size), F.array(F.lit(7), F.lit(8))), 2)
    doc = A.merged(F.create_map(F.lit("a"), p.p_name, F.lit("b"), p.p_type), F.when(p.p_partkey % 2 == 0, F.create_map(F.lit("b"), p.p_brand)))
    return p.select(
        "p_partkey", A.rle_area(runs).alias("area"), (back == bits).alias("same"), A.rle_decode(F.array(F.lit(4), F.lit(5)), runs).isNull().alias("refused"), box.isNotNull().alias("boxed"), grid[1][0].cast("long").alias("turned"),
        doc["b"].alias("b"), doc["a"].alias("a"), _r(A.percentile_of(F.array(p.p_size.cast("double"), F.lit(10.0), F.lit(40.0)), 0.25), "quarter"),
    )


MASKS = """
SELECT p_partkey, bit_count((p_partkey * 37) & 65535)::BIGINT AS area, true AS same, true AS refused, p_partkey % 3 = 2 AS boxed, p_size::BIGINT AS turned, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS b, p_name AS a,
  round((SELECT quantile_cont(x, 0.25) FROM unnest([p_size::DOUBLE, 10.0, 40.0]) t(x)), 6) AS quarter FROM part
"""


def described_parts(spark, d):
    """Facts, tiers, keywords and merged lists of parts, and prices from nested results."""
    p = table(spark, d, "part")
    facts = P.placement_facts(p.p_size / 10, p.p_size / 4, F.when(p.p_partkey % 2 == 0, p.p_size / 20), F.when(p.p_partkey % 3 == 0, p.p_size / 30), 1.0)
    words = S.keyword_queries(p.p_name, ["red", "small"], {"ring": ["box", "chain"]})
    merged = S.merged_queries([F.split("p_name", " "), F.array(F.lit(" Box "), F.lower("p_type"), F.lit("red")), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))], 4, 5)
    result = F.when(p.p_partkey % 3 == 0, F.to_json(F.struct(p.p_retailprice.alias("extracted_price")))).when(p.p_partkey % 3 == 1, F.to_json(F.struct(F.array(F.struct(p.p_size.alias("price"))).alias("offers")))).otherwise("{broken")
    return p.select("p_partkey", F.array_join(facts, "; ").alias("facts"), P.quality_tier(F.concat(F.lit(" "), F.element_at(F.array(F.lit("GOOD"), F.lit("Usable"), F.lit("NO-GO")), (p.p_partkey % 3 + 1).cast("int")))).alias("tier"), F.array_join(words, " ").alias("words"), F.array_join(merged, ",").alias("merged"), S.prices(result).alias("price"))


DESCRIBED = """
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size / 10 <= 2 THEN 'on the floor' ELSE printf('off the floor — bottom %.2f above it', p_size / 10) END, CASE WHEN p_partkey % 2 = 0 AND p_size / 20 <= 2 THEN 'against a wall' END,
    CASE WHEN p_partkey % 3 = 0 AND p_size / 30 <= 2 THEN 'reaches the ceiling' END, printf('%.2f tall', p_size / 4)], lambda x: x IS NOT NULL), '; ') AS facts,
  CASE p_partkey % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'usable' ELSE 'low' END AS tier,
  array_to_string(w, ' ') AS words, array_to_string(CASE WHEN len(m) < 4 THEN m2 ELSE m END[1:5], ',') AS merged, CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN p_size::DOUBLE END AS price
FROM (SELECT *, CASE WHEN len(m1) < 4 THEN list_concat(m1, list_filter(['a', 'b', 'c', 'd'], lambda x: NOT list_contains(m1, x))) ELSE m1 END AS m2, m1 AS m FROM (
  SELECT *, list_concat(n, list_filter(['box', lower(p_type), 'red'], lambda x: NOT list_contains(n, x))) AS m1,
    list_concat(list_filter(n, lambda x: x NOT IN ('red', 'small') AND length(x) >= 3), CASE WHEN contains(p_name, 'ring') THEN list_filter(['box', 'chain'], lambda x: NOT list_contains(list_filter(n, lambda y: y NOT IN ('red', 'small')), x)) ELSE [] END) AS w
  FROM (SELECT *, string_split(lower(p_name), ' ') AS n FROM part)))
"""


def text_digests(spark, d):
    """Natural keys for sorting names, the text's hash, and whether a heading and a voxel come out as they should."""
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", _r(G.wrapped(s.s_acctbal), "heading"), G.voxel(s.s_acctbal, -1000.0, 250.0).alias("cell"), _r(G.plane_height((s.s_acctbal, F.col("s_nationkey"), F.lit(1.0)), [1.0, 2.0, 3.0], [0.6, 0.8, 0.0]), "height"), _r(G.corners(P.constant(1, 2, 3), F.array(s.s_acctbal, F.lit(2.0), F.lit(4.0)))[5][0], "corner"), *[_r(c, f"t{i}") for i, c in enumerate(G.transformed((s.s_acctbal, F.col("s_nationkey"), F.lit(1.0)), [1, 0, 0, 5, 0, 2, 0, 6, 0, 0, 3, 7, 0, 0, 0, 2], True))])


DIGESTS = """
SELECT s_suppkey, round(s_acctbal - 2 * pi() * ceil((s_acctbal - pi()) / (2 * pi())), 6) + 0.0 AS heading, least(greatest(floor((s_acctbal + 1000) / 250), 0), 2097151)::BIGINT AS cell, round((s_acctbal - 1) * 0.6 + (s_nationkey - 2) * 0.8, 6) + 0.0 AS height,
  round(1 + s_acctbal / 2, 6) AS corner, round((s_acctbal + 5) / 2, 6) AS t0, round((2 * s_nationkey + 6) / 2, 6) AS t1, 5.0::DOUBLE AS t2 FROM supplier
"""

QUERIES = {f.__name__: f for f in (rotated_vectors, shortest_turns, cameras, projections, measured_pairs, scale_ladders, correlations, unit_homographies, asset_fits, splat_values, headings, masks, described_parts, text_digests)}
ORACLES = {
    "rotated_vectors": ROTATED, "shortest_turns": TURNS, "cameras": CAMERAS, "projections": PROJECTED, "measured_pairs": MEASURED, "scale_ladders": LADDERS, "correlations": CORRELATIONS, "unit_homographies": HOMOGRAPHIES, "asset_fits": FITS,
    "splat_values": SPLATS, "headings": HEADINGS, "masks": MASKS, "described_parts": DESCRIBED, "text_digests": DIGESTS,
}
