"""What the third round's review found: each on small tables against SQL or a loop."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import near_dedup
from cartolith.operators import joins, pairs
from cartolith.operators import similarity as V
from cartolith.operators import views as views_of
from cartolith.plans import navigation, placing, scenes, vectors


def against_sql(spark, folder, query, sql, **tables):
    """The rows of a query and of its SQL over tables, written to a folder; both sorted."""
    c = duckdb.connect()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = query(spark, str(folder))
    rel = c.sql(sql)
    assert sorted(rel.columns) == sorted(got.columns)
    return sorted(map(tuple, got.collect()), key=repr), sorted(rel.select(*got.columns).fetchall(), key=repr)


def test_asset_fits_round_as_sql(spark, tmp_path):
    """Parts whose ratio is a tie of the sixth digit, or stands on a tier's bound, for one order of operations."""
    parts = [(k, s, p) for s in range(1, 51) for k, p in zip(range(9 * s, 9 * s + 9), (985.4, 950.0, 901.0, 1000.0, 1250.5, 998.9, 1500.0, 910.3, 1024.7), strict=True)] + [(8854, 1, 985.4), (16500, 13, 950.0)] + [(k, s, p) for s in (6, 12, 13, 18, 26, 30, 39) for k in range(9) for p in np.arange(900, 2000, 5.3).round(1).tolist()]
    part = spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double")
    got, want = against_sql(spark, tmp_path, placing.asset_fits, placing.FITS, part=part)
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["loop_closures", "scored_frames", "matching_frames"])
def test_searches_make_no_row_of_each_pair(spark, tmp_path, monkeypatch, name):
    """In small blocks, with exact copies, whose ties go to the smaller id, against SQL."""
    for limit, value in (("QUERIES", 7), ("FRAMES", 60), ("ROWS", 3), ("PAIRS", 50)):
        monkeypatch.setattr(pairs, limit, value)
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (90, 64)).astype(np.float32)
    rows = [(i, base[i % 90 if i % 7 else 3].tolist(), None if i % 11 == 0 else i % 4) for i in range(300)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    plan = scenes if name == "matching_frames" else vectors
    got, want = against_sql(spark, tmp_path, plan.QUERIES[name], plan.ORACLES[name], embeddings=e)
    assert got == want and (len(want) > 10 or name == "loop_closures")
    assert "NestedLoop" not in plan_of(plan.QUERIES[name](spark, str(tmp_path)))


def test_best_pairs_of_odd_vectors(spark):
    """Gaps, other lengths and numbers past all bounds, against a loop."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [1e200, 1e200]), (4, [-1e200, 1.0]), (5, None), (6, [3.0]), (7, []), (8, [inf, -1.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = V.scored_top(df, df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), [], -1.0, 3).collect()
    want = []
    for q, a in rows:
        scores = []
        for i, b in rows:
            if a is not None and b is not None:
                with np.errstate(all="ignore"):
                    s = float(sum((np.float64(x) * np.float64(y) for x, y in zip(a, b) if x is not None and y is not None), np.float64(0.0)))
                if s > -1.0 or np.isnan(s):
                    scores.append((not np.isnan(s), -s if not np.isnan(s) else 0.0, i))
        want += [(q, i, r + 1) for r, (_, _, i) in enumerate(sorted(scores)[:3])]
    assert sorted((r.query_id, r.id, r.rank) for r in got) == sorted(want)


def test_boxes_of_many_keys(spark, tmp_path):
    """Against SQL, in a plan without a Python group for each key: a line item's ties of the fourth digit, too."""
    rng = np.random.default_rng(4)
    rows = [(i, 0, i % 40, i % 7, float(q), float(p), float(d) / 100, float(d) / 100) for i, (q, p, d) in enumerate(zip(rng.integers(1, 50, 4000), rng.integers(900_00, 10_400_000, 4000) / 100, rng.integers(0, 11, 4000), strict=True))]
    rows += [(9000 + i, 0, 99, 1, q, p, 0.05, 0.05) for i, (q, p) in enumerate([(1.0, 900.0), (50.0, 900.0), (1.0, 104838.15), (50.0, 104838.15)])]
    x = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").repartition(5)
    got, want = against_sql(spark, tmp_path, navigation.yaw_boxes, navigation.BOXES, lineitem=x)
    assert got == want and len(want) == 41
    assert "FlatMapGroups" not in plan_of(navigation.yaw_boxes(spark, str(tmp_path)))


def test_equal_views_are_looked_through_once(spark, tmp_path):
    """Suppliers' cameras stand in 60 places: clusters meet these, whatever the suppliers; against SQL."""
    part = spark.range(300).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "concat('t', id % 4) AS p_type", "1 AS p_size", "1.0D AS p_retailprice")
    supplier = spark.range(200).selectExpr("id AS s_suppkey")
    got, want = against_sql(spark, tmp_path, scenes.seen_clusters, scenes.SEEN, part=part, supplier=supplier)
    assert got == want and len(want) == 4
    views = spark.range(200).selectExpr("id AS view", "array(id % 4 + 0.0D, id % 3) AS c2w", *[f"1.0D AS {c}" for c in ("fx", "fy", "cx", "cy", "width", "height")])
    few, members = views_of.poses(views)
    assert few.count() == 12 and members.count() == 200


def test_copies_of_a_place_look_for_neighbours_together(spark):
    """40 copies of each of 30 places, against a loop."""
    rng = np.random.default_rng(2)
    spots = rng.normal(0, 3, (30, 3))
    rows = [(i, *spots[i % 30].tolist()) for i in range(1200)] + [(5000, 50.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    out = joins.nearest_neighbours(df, "id", ("x", "y", "z"), 3, 1.0)
    got = {}
    for r in out.collect():
        got.setdefault(r.id, {})[r.rank] = r.neighbour
    at = np.array([r[1:] for r in rows])
    for i, (own, *spot) in enumerate(rows):
        off = np.sqrt(((at - spot) ** 2).sum(axis=1))
        want = [rows[j][0] for j in np.lexsort((np.array([r[0] for r in rows]), off)) if j != i][:3]
        assert [got[own][r] for r in (1, 2, 3)] == want
    assert sum(map(len, got.values())) == 3 * len(rows)


def test_no_near_pair_of_a_bucket_is_left_out():
    """near_dedup offers all near pairs of other components, whatever the bucket."""
    assert near_dedup.NEAREST > 10**12


def closure(nodes, pairs):
    """The smallest node that each node is joined with."""
    root, before = {n: n for n in nodes}, None
    while root != before:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_half_similar_texts_make_rows_not_pairs(spark, monkeypatch):
    """240 texts with 2 of 150 words changed, most of similarity 0.76 to each other: no table has more than a row for each text and segment, and components are those of all verified pairs."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for _ in range(240):
        words = list(base)
        for i in rng.sample(range(150), 2):
            words[i] = f"v{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    marked = near_dedup.written(near_dedup.sketches(docs, 5), "marked")
    made, plain = {}, near_dedup.written

    def counted(df, name):
        out = plain(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    linked = {r.node: r.root for r in near_dedup.similar_texts(docs, marked, 0.8, 5, 9, 7).collect()}
    assert max(made.values()) <= 9 * 240, made
    monkeypatch.setattr(near_dedup, "written", plain)
    rows = marked.withColumn("root", F.col("text_id"))
    index = near_dedup.segment_keys(rows, 9, 7)
    pairs = near_dedup.candidates(index, near_dedup.near_bits(64), near_dedup.crowded_keys(index, 10**6), near_dedup.near_bits(704))
    sets = near_dedup.shingle_sets(docs, rows.select("text_id"), 5)
    links = [(r.a, r.b) for r in near_dedup.verified(pairs, sets, 0.8).collect()]
    nodes = [r.text_id for r in rows.collect()]
    want = closure(nodes, links)
    assert pairs.count() > 5 * 9 * 240 and len(links) > 20
    assert {n: linked.get(n, n) for n in nodes} == want


@pytest.mark.parametrize("crowd,blocks", [(64, 1), (4, 1), (4, 3)])
def test_rows_that_have_a_partner(spark, monkeypatch, crowd, blocks):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rng = random.Random(6)
    rows = [(rng.randrange(4), rng.randrange(2**12), 100 + i, rng.choice([1, 1, 1, 2, 3, 100 + i])) for i in range(100)] + [(9, 5, 1000 + i, 7) for i in range(50)]
    crowded = spark.createDataFrame([(k, blocks) for k in (0, 1, 9)] if blocks > 1 else [], "key long, blocks int")
    df = spark.createDataFrame(rows, "key long, check long, text_id long, root long")
    got = [(r.key, r.text_id) for r in near_dedup.partnered(df, 2, crowded).collect()]
    want = {(x[0], x[2]) for x in rows for y in rows if x[0] == y[0] and x[3] != y[3] and (x[1] ^ y[1]).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want) and 20 < len(want) < 90


@pytest.mark.parametrize("members,size", [(1024, 1 << 24), (7, 1 << 24), (1024, 1500)])
def test_links_of_buckets_close_as_all_pairs_do(spark, monkeypatch, members, size):
    """Whole buckets and pairs of blocks, with roots that are joined already, an empty set, and fingerprints that forbid some links."""
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    monkeypatch.setattr(near_dedup, "SHINGLE_BYTES", size)
    rng = random.Random(9)
    sets = {-1: set()}
    for family in range(6):
        for i in range(15):
            sets[family * 100 + i] = {s + 1000 * family for s in range(40) if rng.random() < 0.92}
    fp = {t: (rng.choice([0, 0, 0, 2**20 - 1]), 0) for t in sets}
    root = {t: t if t % 4 else t - t % 100 for t in sets}
    met = [(rng.randrange(3), t) for t in sets] + [(5, t) for t in sets]
    met = sorted(set(met))
    texts = spark.createDataFrame([(t, *fp[t], root[t]) for t in sets], "text_id long, f0 long, f1 long, root long")
    binary = spark.createDataFrame([(t, np.sort(np.array(list(v), np.uint64)).tobytes()) for t, v in sets.items()], "text_id long, shingles binary")
    got = [(r.a, r.b) for r in near_dedup.bucket_links(spark.createDataFrame(met, "key long, text_id long"), texts, binary, 18, 10, 0.8).collect()]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = {(a, b) for k, a in met for j, b in met if j == k and a < b and root[a] != root[b] and fp[a] == fp[b] and alike(a, b)}
    assert set(got) <= want and len(want) > 100
    known = list(root.items())
    assert closure(sets, [*known, *got]) == closure(sets, [*known, *want])
    if members == 1024 and size > 1500:
        assert len(got) <= sum(len({root[t] for k, t in met if k == key}) - 1 for key in {k for k, _ in met})
