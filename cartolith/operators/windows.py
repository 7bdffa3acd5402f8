"""Ordered analytics: sessions, thinning, rolling statistics, steps, replay, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.functions.time import clamped_delay, micros


def visits(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", gap_s: float = 1800.0) -> DataFrame:
    """events with visit, numbered from 1 for each key; a gap of gap_s or more begins a new one."""
    w = W.partitionBy(key).orderBy(ts, order)
    gap = micros(ts) - micros(F.lag(ts).over(w))
    return events.withColumn("visit", F.sum(F.when(gap < int(gap_s * 1e6), 0).otherwise(1)).over(w).cast("long"))


def visit_summary(events: DataFrame, key: str = "user_id", gap_s: float = 1800.0, return_s: float = 86400.0) -> DataFrame:
    """Of each key: requests, visits, kinds, first and last time, and when it first came back return_s or later."""
    found = visits(events, key, gap_s=gap_s)
    starts = found.groupBy(key, "visit").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.collect_set("event_type").alias("kinds"))
    first = F.min("start").over(W.partitionBy(key))
    back = F.when((F.col("visit") > 1) & (micros("start") - micros("first") >= int(return_s * 1e6)), F.col("start"))
    return starts.withColumn("first", first).groupBy(key).agg(
        F.sum("n").alias("requests"), F.count("*").alias("visits"), F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).cast("long").alias("kinds"),
        F.min("start").alias("first_seen"), F.max("end").alias("last_seen"), F.min(back).alias("returned_at"),
    )


def thin(rows: DataFrame, key: str, ts: str, least_gap_s: float, slack_s: float = 1e-4) -> DataFrame:
    """Greedy thinning: of each key, in order of ts, the rows at least least_gap_s - slack_s after the last one kept.

    A row after a gap of that size is kept whatever came before, so each key is cut there into runs that
    are thinned apart; a key with many rows is spread over tasks. A task walks its runs in one pass with one number of state.
    Rows with a null key or ts are dropped."""
    least = int(round((least_gap_s - slack_s) * 1e6))
    w = W.partitionBy(key).orderBy(ts)
    timed = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__at", micros(ts))
    gap = F.col("__at") - F.lag("__at").over(w)
    run = F.sum(F.when(gap < least, 0).otherwise(1)).over(w)
    dealt = timed.withColumn("__run", run).repartition(key, "__run").sortWithinPartitions(key, "__run", "__at")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0
        for b in batches:
            chosen = []
            for k, r, at in zip(b[key], b["__run"], b["__at"], strict=True):
                if (k, r) != now or at - last >= least:
                    now, last = (k, r), at
                    chosen.append(True)
                else:
                    chosen.append(False)
            yield b[chosen].drop(columns=["__run", "__at"])

    return dealt.mapInPandas(keep, rows.schema)


def replay(events: DataFrame, key: str, ts: str = "ts", order: str = "event_id", low: float = 0.12, high: float = 2.5, speed: float = 1.0) -> DataFrame:
    """events with seq from 0 and delay_s, the clamped time since the row before (low for the first), over speed."""
    w = W.partitionBy(key).orderBy(ts, order)
    gap = (micros(ts) - micros(F.lag(ts).over(w))) / 1e6
    return events.withColumns({"seq": (F.row_number().over(w) - 1).cast("long"), "delay_s": clamped_delay(gap, low, high) / speed})


def steps(rows: DataFrame, key: str, order: list[str], position: list[str]) -> DataFrame:
    """rows with step, the distance from the row before; null for the first."""
    w = W.partitionBy(key).orderBy(*order)
    parts = [F.pow(F.col(c) - F.lag(c).over(w), F.lit(2)) for c in position]
    return rows.withColumn("step", F.sqrt(sum(parts[1:], parts[0])))


def path_length(rows: DataFrame, key: str, order: list[str], position: list[str]) -> DataFrame:
    return steps(rows, key, order, position).groupBy(key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def rolling_median(rows: DataFrame, key: str, order: list[str], value: str, width: int = 15) -> DataFrame:
    """rows with rolling, the centred median over width rows, the ends padded with the first and the last value."""
    w = W.partitionBy(key).orderBy(*order)
    half, whole = width // 2, W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = F.collect_list(value).over(w.rowsBetween(-half, half))
    at, n = F.row_number().over(w), F.count(value).over(W.partitionBy(key))
    before, after = F.greatest(F.lit(0), half - at + 1), F.greatest(F.lit(0), half - (n.cast("int") - at))
    padded = F.sort_array(F.concat(F.array_repeat(F.first(value).over(whole), before), near, F.array_repeat(F.last(value).over(whole), after)))
    return rows.withColumn("rolling", padded[half])


def trajectory_quality(rows: DataFrame, key: str, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row a trajectory (ts, tx, ty, tz): its figures, level and reasons, in the order of the checks.

    Fewer than 10 finite steps, or fewer poses than min_poses, is out_of_class by itself. Any failed check
    gives out_of_class, else any to be reviewed needs_review."""
    # Limits of the checks.
    t = {"min_poses": 30, "trend_low": 0.4, "trend_high": 2.5, "cv_review": 1.2, "cv_fail": 2.5, "jump_review": 0.02, "jump_fail": 0.08} | (thresholds or {})
    stepped = steps(rows, key, ["ts"], ["tx", "ty", "tz"])
    poses = rows.groupBy(key).agg(F.count("*").alias("n_poses"), (F.max("ts") - F.min("ts")).alias("span_s"))
    finite = stepped.filter("step IS NOT NULL AND NOT isnan(step) AND step < double('infinity')")
    w = W.partitionBy(key).orderBy("ts")
    n = F.count("*").over(W.partitionBy(key))
    ranked = rolling_median(finite, key, ["ts"], "step").withColumns({"n": n, "at": F.row_number().over(w)})
    fifth = F.greatest(F.lit(5), F.floor(F.col("n") / 5))
    ranked = ranked.withColumns({"head": F.when(F.col("at") <= fifth, F.col("step")), "tail": F.when(F.col("at") > F.col("n") - fifth, F.col("step")), "jump": (F.col("step") > 8 * F.greatest("rolling", F.lit(1e-12))).cast("int")})
    found = ranked.groupBy(key).agg(F.count("*").alias("n"), F.median("head").alias("head"), F.median("tail").alias("tail"), F.avg("step").alias("mean"), F.stddev_pop("step").alias("std"), F.avg("jump").alias("jump_rate"))
    inf = F.lit(float("inf"))
    found = found.select(key, "n", F.when(F.col("head") > 1e-12, F.col("tail") / F.col("head")).otherwise(inf).alias("trend"), F.when(F.col("mean") > 1e-12, F.col("std") / F.col("mean")).otherwise(inf).alias("cv"), "jump_rate")
    out = poses.join(found, key, "left")
    short = (F.coalesce("n", F.lit(0)) < 10) | (F.col("n_poses") < t["min_poses"])
    drift = (F.col("trend") < t["trend_low"]) | (F.col("trend") > t["trend_high"])
    fails = F.array(F.when(drift, F.lit("step trend")), F.when(F.col("cv") > t["cv_fail"], F.lit("step variation")), F.when(F.col("jump_rate") > t["jump_fail"], F.lit("jump rate")))
    reviews = F.array(F.when((F.col("cv") > t["cv_review"]) & (F.col("cv") <= t["cv_fail"]), F.lit("step variation")), F.when((F.col("jump_rate") > t["jump_review"]) & (F.col("jump_rate") <= t["jump_fail"]), F.lit("jump rate")))
    fails, reviews = F.array_compact(fails), F.array_compact(reviews)
    level = F.when(short | (F.size(fails) > 0), F.lit("out_of_class")).when(F.size(reviews) > 0, F.lit("needs_review")).otherwise(F.lit("high_confidence"))
    return out.select(key, "n_poses", "span_s", "trend", "cv", "jump_rate", level.alias("level"), F.when(short, F.array(F.lit("too few poses"))).otherwise(F.concat(fails, reviews)).alias("reasons"))


def chunks(rows: DataFrame, key: str, order: list[str], size: int, overlap: int) -> DataFrame:
    """Each row once for each chunk of size + overlap rows that it is in; a chunk begins every size rows.

    The last chunk may be short, but holds at least one row that no other has."""
    w = W.partitionBy(key).orderBy(*order)
    at, n = (F.row_number().over(w) - 1).cast("long"), F.count("*").over(W.partitionBy(key))
    placed = rows.withColumns({"__at": at, "__n": n})
    last = F.greatest(F.lit(0), F.floor((F.col("__n") - overlap - 1) / size))
    low = F.greatest(F.lit(0), F.ceil((F.col("__at") - size - overlap + 1) / size))
    inside = F.explode(F.sequence(low.cast("long"), F.least(F.floor(F.col("__at") / size), last).cast("long"))).alias("chunk")
    return placed.select(*rows.columns, inside, F.col("__at").alias("position"))


def out_of_order(rows: DataFrame, key: str, arrival: list[str], number: str) -> DataFrame:
    """rows with expected (one more than the number of the row before, the lowest for the first) and in_order."""
    w = W.partitionBy(key).orderBy(*arrival)
    expected = F.coalesce(F.lag(number).over(w) + 1, F.min(number).over(W.partitionBy(key)))
    return rows.withColumn("expected", expected).withColumn("in_order", F.col(number) == F.col("expected"))


def evenly_spaced(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """k rows of each key at even steps, both ends included (half-even rounding); all rows where there are fewer."""
    w = W.partitionBy(key).orderBy(*order)
    placed = rows.withColumns({"__at": (F.row_number().over(w) - 1).cast("long"), "__n": F.count("*").over(W.partitionBy(key))})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(max(1, k - 1))).cast("long"))
    return placed.filter((F.col("__n") <= k) | F.array_contains(wanted, F.col("__at"))).drop("__at", "__n")


def every_kth(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Rows 0, s, 2s, ... of each key, s the smallest stride that leaves at most `most`."""
    w = W.partitionBy(key).orderBy(*order)
    placed = rows.withColumns({"__at": (F.row_number().over(w) - 1).cast("long"), "__n": F.count("*").over(W.partitionBy(key))})
    return placed.filter(F.col("__at") % F.greatest(F.lit(1), F.ceil(F.col("__n") / most)) == 0).drop("__at", "__n")


def third_differences(rows: DataFrame, key: str, order: list[str], position: list[str]) -> DataFrame:
    """Mean norm of the third difference of each key (its jerk, in units a step cubed); null below 4 rows."""
    w = W.partitionBy(key).orderBy(*order)
    parts = [F.pow(F.col(c) - 3 * F.lag(c, 1).over(w) + 3 * F.lag(c, 2).over(w) - F.lag(c, 3).over(w), F.lit(2)) for c in position]
    return rows.select(key, F.sqrt(sum(parts[1:], parts[0])).alias("jerk")).groupBy(key).agg(F.avg("jerk").alias("jerk"))


def smoothed(rows: DataFrame, key: str, order: list[str], value: str, width: int = 5) -> DataFrame:
    """rows with smooth: the moving average over width rows, ends padded with their own value, and pinned."""
    w = W.partitionBy(key).orderBy(*order)
    half, whole = width // 2, w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near, at, n = w.rowsBetween(-half, half), F.row_number().over(w), F.count("*").over(W.partitionBy(key))
    before, after = F.greatest(F.lit(0), half - at + 1), F.greatest(F.lit(0), half - (n - at))
    total = F.sum(value).over(near) + before * F.first(value).over(whole) + after * F.last(value).over(whole)
    return rows.withColumn("smooth", F.when((at == 1) | (at == n), F.col(value)).otherwise(total / (2 * half + 1)))
