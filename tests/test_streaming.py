"""Stream jobs against their batch twins or loops, under batches of any order and after a restart."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cartolith.operators import windows as Wn
from cartolith.sources.versions import VersionedTable
from cartolith.streaming import stateful


def put(spark, tmp_path, i, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))


def stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        put(spark, tmp_path, i, rows, schema)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def drained(df, name, tmp_path):
    """Restarts after what is there each time it is called: the same files and checkpoint."""
    q = df.writeStream.format("parquet").queryName(name).option("path", str(tmp_path / f"out-{name}")).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / f"out-{name}"))


SCHEMA = "event_id long, user_id long, ts timestamp, event_type string"


def rows():
    rng, t0 = random.Random(4), datetime(2024, 1, 1)
    times = sorted(rng.uniform(0, 4000) for _ in range(120))
    return [(i, i % 3, t0 + timedelta(milliseconds=round(s * 1000)), "x") for i, s in enumerate(times)]


def shuffled(rows, seed=1):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return rows


def test_thinning_equals_batch_and_restarts(spark, tmp_path):
    r = rows()
    df = stateful.thin(stream(spark, tmp_path, [shuffled(r[:40]), shuffled(r[40:90])], SCHEMA), "user_id", "ts", 60.0, keep=["event_id"])
    drained(df, "thinned", tmp_path)
    put(spark, tmp_path, 2, shuffled(r[90:]), SCHEMA)
    out = drained(df, "thinned", tmp_path)
    want = sorted(x.event_id for x in Wn.thin(spark.createDataFrame(r, SCHEMA), "user_id", "ts", 60.0).collect())
    assert sorted(x.event_id for x in out.collect()) == want


def test_visits_equal_batch(spark, tmp_path):
    r = rows()
    out = drained(stateful.visits(stream(spark, tmp_path, [shuffled(r[:50]), shuffled(r[50:])], SCHEMA), "user_id", "ts", 120.0), "visits", tmp_path)
    want = Wn.visits(spark.createDataFrame(r, SCHEMA), gap_s=120.0).select("user_id", F.unix_micros("ts").alias("at"), "visit")
    assert {(x.user_id, x["at"], x.visit) for x in out.collect()} == {tuple(x) for x in want.collect()} and out.filter("late").count() == 0


def test_windows_carry_over_a_restart(spark, tmp_path):
    r = [(i, 1, datetime(2024, 1, 1), "x") for i in range(20)]
    df = stateful.windows(stream(spark, tmp_path, [shuffled(r[:7]), shuffled(r[7:12])], SCHEMA), "user_id", "event_id", 8, 1)
    drained(df, "windows", tmp_path)
    put(spark, tmp_path, 2, shuffled(r[12:]), SCHEMA)
    out = drained(df, "windows", tmp_path)
    assert sorted((x.window, x.members, x.partial) for x in out.collect()) == [(0, list(range(9)), False), (1, list(range(8, 17)), False)]


def test_a_trigger_of_many_rows_is_put_in_order(spark, tmp_path):
    """25,000 rows of one key in falling order in one trigger: several Arrow batches."""
    falling = spark.range(25_000).select((F.lit(24_999) - F.col("id")).alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_000) + 24_999 - F.col("id")).alias("ts"), F.lit("x").alias("event_type"))
    falling.coalesce(1).write.parquet(str(tmp_path / "in" / "b=0"))
    src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    out = drained(stateful.windows(src, "user_id", "event_id", 5000, 0), "many", tmp_path).orderBy("window").collect()
    assert [(x.window, x.members[0], x.members[-1]) for x in out] == [(i, 5000 * i, 5000 * i + 4999) for i in range(5)]
    assert drained(stateful.chunk_order(src, "user_id", "event_id", ["ts"]), "order", tmp_path).filter("NOT in_order").count() == 0
    assert sorted(x["at"] for x in drained(stateful.thin(src, "user_id", "ts", 100.0), "thin", tmp_path).collect()) == [(1_700_000_000 + 100 * i) * 10**6 for i in range(250)]


def test_unfinished_windows_are_flushed_at_stops(spark, tmp_path):
    schema = SCHEMA + ", stop boolean"
    r = [(i, u, datetime(2024, 1, 1), "x", i == 6) for u in (1, 2) for i in range(10)] + [(20, 3, datetime(2024, 1, 1), "x", True), (30, 4, datetime(2024, 1, 1), "x", None), (31, 4, datetime(2024, 1, 1), "x", True)]
    out = drained(stateful.windows(stream(spark, tmp_path, [shuffled(r)], schema), "user_id", "event_id", 4, 1, stop="stop"), "stops", tmp_path)
    want = [(u, w, m, p) for u in (1, 2) for w, m, p in ((0, [0, 1, 2, 3, 4], False), (1, [4, 5, 6], True))] + [(4, 0, [30, 31], True)]
    assert sorted((x.user_id, x.window, x.members, x.partial) for x in out.collect()) == want  # three rows after the stop wait; a single one is forgotten


def test_key_frames(spark, tmp_path):
    rng = random.Random(3)
    r = [(i, i % 4, rng.choice([None, float("nan"), *(float(rng.gauss(0, 10)) for _ in range(8))]), rng.choice([3, 20, 50, None])) for i in range(300)]
    out = drained(stateful.key_frames(stream(spark, tmp_path, [shuffled(r[:90]), shuffled(r[90:100]), shuffled(r[100:])], "i long, k long, v double, n int"), "k", "i", "v", "n", 8.0), "frames", tmp_path)
    want, last = [], {}
    for i, k, v, n in r:
        missing = v is None or v != v
        if n is not None and n < 10 or not missing and (last.get(k) is None or abs(v - last[k]) > 8.0):
            want.append((i, k))
            last[k] = None if missing else v
    assert sorted((x.i, x.k) for x in out.collect()) == want and 50 < len(want) < 290


def test_chunk_order(spark, tmp_path):
    t = [datetime(2024, 1, 1, 0, 0, s) for s in range(10)]
    r = [(0, 1, t[0], "x"), (1, 1, t[1], "x"), (3, 1, t[2], "x"), (4, 1, t[3], "x"), (2, 1, t[4], "x"), (3, 1, t[5], "x")]
    out = drained(stateful.chunk_order(stream(spark, tmp_path, [r[1::-1], shuffled(r[2:])], SCHEMA), "user_id", "event_id", ["ts"]), "chunks", tmp_path)
    assert sorted((x.event_id, x.expected, x.in_order) for x in out.collect()) == [(0, 0, True), (1, 1, True), (2, 5, False), (3, 2, False), (3, 3, True), (4, 4, True)]


def test_resends_and_windows(spark, tmp_path):
    r = rows()
    out = drained(stateful.once(stream(spark, tmp_path, [r, r], SCHEMA), ["event_id"], "ts"), "once", tmp_path)
    assert out.count() == len(r)


def test_first_sightings_over_a_restart(spark, tmp_path):
    rng = random.Random(9)
    batches = [[(rng.choice(["s", "t"]), rng.randrange(4), rng.choice(["desk", None])) for _ in range(25)] for _ in range(3)]
    df = stateful.unseen(stream(spark, tmp_path, batches[:2], "session string, frame long, query string"), ["session"], ["frame", "query"])
    drained(df, "unseen", tmp_path)
    put(spark, tmp_path, 2, batches[2], "session string, frame long, query string")
    out = drained(df, "unseen", tmp_path).collect()
    assert len(out) == len(set(map(tuple, out))) and {tuple(x) for x in out} == {x for b in batches for x in b}


def running(df, name, tmp_path):
    return df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(processingTime="500 milliseconds").start()


def waited(spark, name, n, seconds=90):
    """The rows of a memory sink once there are n of them."""
    until = time.time() + seconds
    while time.time() < until and spark.table(name).count() < n:
        time.sleep(0.5)
    return spark.table(name).collect()


def test_idle_keys_are_flushed_and_reported(spark, tmp_path):
    src = stream(spark, tmp_path, [[(i, i % 2, datetime(2024, 1, 1, 0, 0, i), "x") for i in range(6)]], SCHEMA)
    queries = [running(stateful.windows(src, "user_id", "event_id", 8, 1, idle_s=1.0), "flushed", tmp_path), running(stateful.idle(src, "user_id", "ts", 1.0), "idle", tmp_path)]
    try:
        assert sorted((x.user_id, x.window, x.members, x.partial) for x in waited(spark, "flushed", 2)) == [(0, 0, [0, 2, 4], True), (1, 0, [1, 3, 5], True)]
        assert sorted((x.user_id, x.n) for x in waited(spark, "idle", 2)) == [(0, 3), (1, 3)]
        put(spark, tmp_path, 1, [(10 + i, 0, datetime(2024, 1, 2), "x") for i in range(2)], SCHEMA)
        assert {(x.window, tuple(x.members)) for x in waited(spark, "flushed", 3)} >= {(1, (10, 11))}
    finally:
        for q in queries:
            q.stop()


def test_seen_items_are_forgotten_after_a_while(spark, tmp_path):
    schema = "session string, frame long"
    df = stateful.unseen(stream(spark, tmp_path, [[("s", 1), ("s", 2)]], schema), ["session"], ["frame"], ttl_s=3.0)
    q = running(df, "forgotten", tmp_path)
    try:
        assert len(waited(spark, "forgotten", 2)) == 2
        time.sleep(5)
        put(spark, tmp_path, 1, [("s", 1), ("s", 1)], schema)
        assert sorted(x.frame for x in waited(spark, "forgotten", 3)) == [1, 1, 2]
    finally:
        q.stop()


def test_merges_with_and_without_recomputation(spark, tmp_path):
    """A group that closes a loop is made anew from the source; all others are merged. Repeated triggers change nothing."""
    schema = "submap long, query string, at long, score double, loop boolean"
    batches = [[(1, "desk", 1, 0.5, False), (1, "lamp", 1, 0.2, False), (2, "desk", 1, 0.9, False)], [(1, "desk", 2, 0.6, False), (2, "cup", 2, 0.3, True)], [(3, "desk", 3, 0.1, None)]]
    table = VersionedTable(spark, str(tmp_path / "table"), ["submap", "query"], ["at"], buckets=4, by=["submap"])
    whole = spark.createDataFrame([(2, "desk", 2, 1.9), (2, "mug", 2, 1.3)], "submap long, query string, at long, score double")

    def anew(groups):
        return whole.join(groups, "submap", "left_semi")

    writer = lambda: stateful.merged_into(stream_of, table, "merge", full="loop", recompute=anew).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    stream_of = stream(spark, tmp_path, batches[:2], schema)
    writer().start().awaitTermination(300)
    put(spark, tmp_path, 2, batches[2], schema)
    writer().start().awaitTermination(300)
    want = {(1, "desk", 2, 0.6), (1, "lamp", 1, 0.2), (2, "desk", 2, 1.9), (2, "mug", 2, 1.3), (3, "desk", 3, 0.1)}
    assert {tuple(x) for x in table.read().collect()} == want and table.versions() == [1, 2, 3]
    assert table.upsert(spark.createDataFrame([(9, "ghost", 9, 0.0)], "submap long, query string, at long, score double"), ("merge", 2)) == 3


@pytest.mark.parametrize("least", [60.0])
def test_thinning_does_not_depend_on_batches(spark, tmp_path, least):
    r = rows()
    cuts = sorted(random.Random(8).sample(range(1, len(r)), 5))
    batches = [shuffled(r[a:b]) for a, b in zip([0, *cuts], [*cuts, len(r)], strict=True)]
    out = drained(stateful.thin(stream(spark, tmp_path, batches, SCHEMA), "user_id", "ts", least, keep=["event_id"]), "cuts", tmp_path)
    assert sorted(x.event_id for x in out.collect()) == sorted(x.event_id for x in Wn.thin(spark.createDataFrame(r, SCHEMA), "user_id", "ts", least).collect())
