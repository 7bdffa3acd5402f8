"""Filters, top-k, sampling and set operations over inventories, detections and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.functions import text as X
from cartolith.operators.shared import with_each


def of_queries(detections: DataFrame, queries: list[str], query: str = "query") -> DataFrame:
    """Rows whose folded query is among those named; none if no query is named."""
    wanted = sorted({q.strip().lower() for q in queries if q and q.strip()})
    return detections.filter(X.folded_query(F.col(query)).isin(wanted) if wanted else F.lit(False))


def of_project(scenes: DataFrame, client: str = "", project: str = "") -> DataFrame:
    return scenes.filter((F.coalesce("client", F.lit("")) == client) & (F.coalesce("project", F.lit("")) == project))


def numbered(objects: DataFrame, order: list[str], scan: str, dismissed: Column, include_dismissed: bool = False) -> DataFrame:
    """objects with uid, their place in the whole list of their scan; dismissed ones are hidden after numbering."""
    uid = F.concat(F.lit("det:"), (F.row_number().over(W.partitionBy(scan).orderBy(*order)) - 1).cast("string"))
    out = objects.withColumn("uid", uid)
    return out if include_dismissed else out.filter(~F.coalesce(dismissed, F.lit(False)))


def above_percentile(rows: DataFrame, key: str, value: str, p: float, margin: float = 1e-6) -> DataFrame:
    """Rows whose value is above the key's linear percentile plus a margin."""
    limit = rows.groupBy(key).agg((F.percentile(value, F.lit(p)) + margin).alias("__limit"))
    return rows.join(limit, key).filter(F.col(value) > F.col("__limit")).drop("__limit")


def best_by(rows: DataFrame, key: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("__rank") <= k).drop("__rank")


def latest(rows: DataFrame, key: list[str], at: str, order: str) -> DataFrame:
    """The last row of each key, by partial aggregation rather than by sorting."""
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(at, order)).alias("__row")).select(*key, *[F.col(f"__row.{c}").alias(c) for c in names])


def edited(log: DataFrame, key: list[str], fields: list[str], at: str, order: str) -> DataFrame:
    """Of each key, the last non-null value of each field."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(at, order))).alias(f) for f in fields]
    return log.groupBy(*key).agg(*last)


def exact_then_partial(rows: DataFrame, name: str, wanted: str, order: list[Column], k: int) -> DataFrame:
    """Rows whose folded name equals wanted, then those that contain it, at most k, with tier 0 or 1."""
    text = X.folded_query(F.col(name))
    tier = F.when(text == wanted, 0).when(text.contains(wanted), 1)
    return rows.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", *order).limit(k)


def listed(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows, with how many there are and whether some are missing."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(k).join(F.broadcast(total)).withColumn("truncated", F.col("total") > k)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the smallest by a hash of key and seed; the same for any partitioning."""
    return rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).orderBy("__h", key).limit(n).drop("__h")


def newly_seen(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    return now.join(before.select(*keys).distinct(), keys, "left_anti")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Values only in new (added) or only in old (removed)."""
    tag = lambda df, name: df.distinct().withColumn("change", F.lit(name))
    return tag(new.subtract(old), "added").unionByName(tag(old.subtract(new), "removed"))


def active_union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def unknown_references(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """References that nothing known has; a closed world needs this to be empty."""
    return refs.join(known.select(key).distinct(), key, "left_anti")


def retained(rows: DataFrame, key: str, newest: list[Column], most: int) -> DataFrame:
    """The newest `most` rows of each key; 0 keeps all."""
    return best_by(rows, [key], *newest, k=most) if most > 0 else rows


def reserved_slots(rows: DataFrame, key: str, structural: Column, order: list[Column], budget: int) -> DataFrame:
    """At most budget rows of distinct key: structural ones hold up to half the slots, and what they leave goes to the rest."""
    one = best_by(rows.withColumn("__structural", F.coalesce(structural, F.lit(False))), [key], F.desc("__structural"), *order)
    rank = F.row_number().over(W.partitionBy("__structural").orderBy(*order))
    tier = F.when(F.col("__structural") & (F.col("__rank") <= budget // 2), 0).when(~F.col("__structural"), 1).otherwise(2)
    return one.withColumn("__rank", rank).withColumn("__tier", tier).orderBy("__tier", "__rank").limit(budget).drop("__structural", "__rank", "__tier")


def resolved_reference(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """Each ref with the uid it stands for: det:<i>, a bare number, or the best labelled object that isn't dismissed.

    A label that equals the ref beats one that contains it, then confidence, then the earlier object; null if nothing fits."""
    r = refs.select("ref", X.folded_query(F.col("ref")).alias("__r"))
    direct = F.when(F.col("__r").rlike(r"^det:\d+$"), F.col("__r")).when(F.col("__r").rlike(r"^\d+$"), F.concat(F.lit("det:"), F.col("__r")))
    r = r.withColumn("__direct", direct)
    o = objects.select("uid", "position", "confidence", "dismissed", X.folded_query(X.display_label(F.col("human_label"), F.col("query"))).alias("__label"))
    by_id = r.join(o.select("uid"), F.col("__direct") == F.col("uid")).select("ref", "uid")
    fits = (F.col("__label") == F.col("__r")) | F.col("__label").contains(F.col("__r")) | F.col("__r").contains(F.col("__label"))
    by_label = with_each(o.filter("NOT dismissed"), r.filter("__direct IS NULL")).filter(fits)
    score = F.col("confidence") + F.when(F.col("__label") == F.col("__r"), 10.0).otherwise(0.0)
    by_label = by_label.groupBy("ref").agg(F.max_by("uid", F.struct(score, -F.col("position"))).alias("uid"))
    return refs.select("ref").join(by_id.unionByName(by_label), "ref", "left")


def stitched(points: DataFrame, scan: str, submap: str, frame: str, closes_loop: str, overlap: int = 1) -> DataFrame:
    """points of a scan's submaps without what they hold twice: submaps that only close a loop, and the first overlap frames of all others but the first, which the submap before ends with.

    A null closes_loop counts as false. Frames are ordered by their number in their submap."""
    regular = points.filter(~F.coalesce(F.col(closes_loop), F.lit(False)))
    frames = regular.select(scan, submap, frame).distinct()
    first = frames.groupBy(scan).agg(F.min(submap).alias("__first"))
    place = F.row_number().over(W.partitionBy(scan, submap).orderBy(frame))
    held = frames.withColumn("__place", place).join(first, scan).filter((F.col(submap) > F.col("__first")) & (F.col("__place") <= overlap))
    return regular.join(held.select(scan, submap, frame), [scan, submap, frame], "left_anti")
