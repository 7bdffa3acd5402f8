"""Lookups and rules over a scene's tables: objects, relations, detections, evidence, layers, jobs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.functions import text as X
from cartolith.operators.folds import folded
from cartolith.operators.shared import with_each
from cartolith.operators.tables import best_by


def evidence_frames(preferred: DataFrame, objects: DataFrame, timeline: DataFrame, budget: int) -> DataFrame:
    """submap, frame, rank (from 0): a budget of frames to look at, each once.

    First frame 0 of the preferred submaps (submap, place), then objects' evidence (confidence, place, submap,
    frame) from the most confident object on, then frames spread over the timeline (place, submap, frame).
    Negative numbers stand for none. What a tier can give is cut to the budget before the tiers meet."""
    tiers = [
        preferred.select(F.lit(0).alias("tier"), F.lit(0.0).alias("first"), F.col("place").cast("long").alias("place"), "submap", F.lit(0).cast("long").alias("frame")),
        objects.select(F.lit(1).alias("tier"), (-F.col("confidence")).alias("first"), F.col("place").cast("long").alias("place"), "submap", F.col("frame").cast("long").alias("frame")),
        timeline.select(F.lit(2).alias("tier"), F.lit(0.0).alias("first"), F.col("place").cast("long").alias("place"), "submap", F.col("frame").cast("long").alias("frame")),
    ]
    order = ["tier", "first", "place"]
    one = [best_by(t.filter("submap >= 0 AND frame >= 0"), ["submap", "frame"], *order).orderBy(*order).limit(budget) for t in tiers]
    best = best_by(one[0].unionByName(one[1]).unionByName(one[2]), ["submap", "frame"], *order).orderBy(*order, "submap", "frame").limit(budget)
    return best.withColumn("rank", (F.row_number().over(W.orderBy(*order, "submap", "frame")) - 1).cast("int")).select("submap", "frame", "rank")  # budget rows


def cited_frames(cited: DataFrame, candidates: DataFrame, fallback: int) -> DataFrame:
    """The candidates (submap, frame, place) that an answer cites (submap, frame, place), in its order; the first few candidates if it cites none."""
    met = best_by(cited.join(candidates.select("submap", "frame").distinct(), ["submap", "frame"]), ["submap", "frame"], F.asc("place")).select("submap", "frame", "place")
    rest = candidates.orderBy("place").limit(fallback).select("submap", "frame", "place")
    none = met.limit(1).agg(F.count("*").alias("n"))
    return met.unionByName(rest.join(F.broadcast(none), F.col("n") == 0).select("submap", "frame", "place"))


def relation_terms(relations: DataFrame) -> DataFrame:
    """name, terms: of each object that relations (a, b, relation) name, the stemmed terms of its partners and of the qualifiers."""
    a, b = (F.lower(F.trim(c)) for c in ("a", "b"))
    both = relations.select(F.explode(F.array(F.struct(a.alias("name"), b.alias("partner")), F.struct(b.alias("name"), a.alias("partner")))).alias("p"), "relation").filter("p.name <> ''")
    qualifier = F.when(F.coalesce(F.trim("relation"), F.lit("")) != "", F.array(X.stem(F.trim("relation")))).otherwise(F.array().cast("array<string>"))
    terms = both.select(F.col("p.name").alias("name"), F.explode(F.concat(F.coalesce(X.terms(F.col("p.partner")), F.array().cast("array<string>")), qualifier)).alias("term"))
    return terms.groupBy("name").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def prose_terms(sentences: DataFrame, names: DataFrame) -> DataFrame:
    """name, terms: the stemmed terms of every sentence that mentions a name (lower-cased)."""
    said = sentences.select(F.lower("sentence").alias("low"), X.terms(F.col("sentence")).alias("found"))
    met = with_each(said, names.select(F.lower(F.trim("name")).alias("name")).filter("name <> ''").distinct()).filter(F.col("low").contains(F.col("name")))
    return met.select("name", F.explode("found").alias("term")).groupBy("name").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def located(objects: DataFrame, name: str) -> DataFrame:
    """name, query, center, confidence of the best detection that a name stands for: equal first, then one that contains it."""
    asked = X.folded_query(F.lit(name))
    own = X.folded_query(F.col("query"))
    fits = objects.filter((own == asked) | own.contains(asked)).withColumn("exact", own == asked)
    return fits.orderBy(F.desc("exact"), F.desc("confidence"), "position").limit(1).select(F.lit(name).alias("name"), "query", "center", "confidence")


def snapshot(objects: DataFrame, submaps: DataFrame, key: str = "query") -> DataFrame:
    """One row: objects, distinct queries, the highest confidence, submaps and frames of a scene."""
    o = objects.agg(F.count("*").alias("objects"), F.count_distinct(key).alias("queries"), F.max("confidence").alias("top_confidence"))
    s = submaps.agg(F.count_distinct("submap").alias("submaps"), F.count("*").alias("frames"))
    return o.join(F.broadcast(s))


def refusal(code: str, detail: Column, next_steps: list[str] = ()) -> Column:
    """struct(ok, error, detail, next_steps): how a tool says that it won't."""
    return F.struct(F.lit(False).alias("ok"), F.lit(code).alias("error"), detail.alias("detail"), F.array(*[F.lit(x) for x in next_steps]).cast("array<string>").alias("next_steps"))


def known_or_refused(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """calls (call, tool, args json) with the tool that its name or alias stands for, and a refusal where it is unknown or lacks a required argument.

    tools: name, aliases array, required array."""
    names = tools.select("name", "required", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    met = calls.join(best_by(names, ["alias"], F.asc("name")), F.lower(F.trim(F.col("tool"))) == F.col("alias"), "left")
    missing = F.array_except("required", F.coalesce(F.json_object_keys("args"), F.array().cast("array<string>")))
    error = F.when(F.col("name").isNull(), "unknown_tool").when(F.try_parse_json("args").isNull(), "invalid_args").when(F.size(missing) > 0, "missing_args")
    return met.select(*calls.columns, "name", error.alias("error"), F.when(error == "missing_args", missing).alias("missing"))


def once_each(calls: DataFrame, key: str, order: str) -> DataFrame:
    """calls with replay: whether an earlier call had the same idempotency key (a null key never repeats)."""
    first = F.row_number().over(W.partitionBy(key).orderBy(order)) == 1
    return calls.withColumn("replay", F.col(key).isNotNull() & ~first)


def under_ceiling(calls: DataFrame, session: str, order: str, estimate: str, ceiling: float) -> DataFrame:
    """calls with allowed: whether a session's estimates up to and with this call stay within the ceiling; a refused call counts against none after it, and one without an estimate is refused."""

    def step(spent: float | None, cost: float | None) -> tuple[float, tuple]:
        spent = spent or 0.0
        fits = cost is not None and spent + cost <= ceiling
        return spent + cost if fits else spent, (fits,)

    cost = calls.withColumn("__cost", F.col(estimate).cast("double"))
    return folded(cost, session, [order], ["__cost"], step, "allowed boolean").drop("__cost")


def curated(layer: DataFrame, exclude: list[str] = (), include: list[str] | None = None, box_only: bool = True, caveats: dict[str, str] | None = None) -> DataFrame:
    """An object layer (id, tier, caveats array) without excluded ids, or only with included ones, perhaps without box-only ones, and with caveats added."""
    out = layer.filter(~F.col("id").isin(list(exclude))) if exclude else layer
    if include is not None:
        out = out.filter(F.col("id").isin(list(include))) if include else out.limit(0)
    if not box_only:
        out = out.filter(F.col("tier") != "low")
    added = F.lit(None).cast("string")
    for k, v in (caveats or {}).items():
        added = F.when(F.col("id") == k, v).otherwise(added)
    old = F.coalesce("caveats", F.array().cast("array<string>"))
    return out.withColumn("caveats", F.when(added.isNotNull(), F.concat(old, F.array(added))).otherwise(old))


def stale_assets(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The keys that a re-attached layer no longer names."""
    return old.select(key).subtract(new.select(key))


def orphan_files(files: DataFrame, named: DataFrame, key: str = "path") -> DataFrame:
    """Files that no export slot names."""
    return files.join(named.select(key).distinct(), key, "left_anti")


def export_slots(records: DataFrame) -> DataFrame:
    """The latest record (format, bytes, files, points, source_points, at) of each format, with decimated: fewer points than the source."""
    return best_by(records, ["format"], F.desc("at")).withColumn("decimated", F.coalesce(F.col("points") < F.col("source_points"), F.lit(False)))


def replaced_inventory(current: DataFrame, detected: DataFrame) -> DataFrame:
    """detected objects in place of a scene's, unless the scene (scene, provenance) holds any that was captured: then nothing, for that scene."""
    captured = current.filter(F.col("provenance") == "captured").select("scene").distinct()
    return detected.join(captured, "scene", "left_anti")


def active_jobs(states: DataFrame, prefix: str) -> DataFrame:
    """scene, job, state: the latest state (scene, job, kind, state, at) of jobs whose kind begins with prefix, where it is queued or running."""
    latest = best_by(states.filter(F.col("kind").startswith(prefix)), ["scene", "job"], F.desc("at"))
    return latest.filter(F.col("state").isin("queued", "running")).select("scene", "job", "state")


def resolved_group(requests: DataFrame, groups: DataFrame, pointers: DataFrame) -> DataFrame:
    """requests (scene, wanted) with the derived group to read: the one asked for, else the scene's pointer, else original; degraded where that one is missing."""
    have = groups.select(F.col("scene").alias("__scene"), F.col("key").alias("__key")).distinct()
    r = requests.join(pointers.select("scene", "pointer"), "scene", "left")
    pick = F.coalesce(F.nullif("wanted", F.lit("")), F.nullif("pointer", F.lit("")))
    r = r.withColumn("__pick", pick).join(have, (F.col("__pick") == F.col("__key")) & (F.col("scene") == F.col("__scene")), "left")
    missing = F.col("__pick").isNotNull() & F.col("__key").isNull()
    return r.select("scene", "wanted", F.coalesce("__key", F.lit("original")).alias("group"), missing.alias("degraded"))


def trusted_scale(rows: DataFrame) -> DataFrame:
    """rows (level, allowed, reference, warning, scale) with reasons, all that speak against a scale, and trusted: none does."""
    reasons = F.filter(
        F.array(
            F.when(~F.col("level").eqNullSafe("high"), "confidence is not high"), F.when(~F.coalesce("allowed", F.lit(False)), "not allowed"), F.when(F.col("reference").isNull(), "no reference"),
            F.when(F.col("warning").isNotNull(), "warned"), F.when(~(G.finite(F.col("scale")) & (F.col("scale") > 0)), "scale is not finite and positive"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.withColumn("reasons", reasons).withColumn("trusted", F.size("reasons") == 0)


def merged_queries(lists: list[Column], least: int = 5, most: int = 8) -> Column:
    """The first list's entries, then, while there are fewer than least, the next one's: each once, folded, most at most."""
    folded = [F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), X.folded_query), lambda v: v != "") for x in lists]
    out = F.array_distinct(folded[0])
    for more in folded[1:]:
        out = F.when(F.size(out) < least, F.array_distinct(F.concat(out, more))).otherwise(out)
    return F.slice(out, 1, most)


def keyword_queries(text: Column, stop: list[str], hints: dict[str, list[str]]) -> Column:
    """Words of three or more letters that aren't stop-words, in order, then what domains that the text names hint at."""
    low = F.lower(text)
    words = F.filter(F.split(low, "[^a-z]+"), lambda w: (F.length(w) >= 3) & ~w.isin(stop))
    out = words
    for domain, things in hints.items():
        out = F.concat(out, F.when(low.contains(domain), F.array(*[F.lit(x) for x in things])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(out)


def focus(objects: DataFrame, name: Column, asks: DataFrame) -> DataFrame:
    """asks (name) with the stored center of the inventory object of that name; null if there is none: a center is never made up."""
    o = best_by(objects.withColumn("__name", X.folded_query(name)), ["__name"], F.desc("confidence"), "position").select("__name", "center")
    return asks.join(o, X.folded_query(F.col("name")) == F.col("__name"), "left").drop("__name")


def prices(result: Column) -> Column:
    """The price of a nested search result (JSON): its extracted price, else the first offer's."""
    return F.coalesce(*[F.try_variant_get(F.try_parse_json(result), p, "double") for p in ("$.extracted_price", "$.offers[0].price", "$.price.value")])


def parsed_layer(manifest: Column, schema: str) -> Column:
    """A layer's manifest (JSON); null on any error, a list of objects being required."""
    parsed = F.from_json(manifest, schema, {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(manifest).isNotNull() & parsed["objects"].isNotNull(), parsed)


def ranked_by_tiebreak(objects: DataFrame, key: str, most: int = 50) -> DataFrame:
    """objects (score) with tie_score null wherever a scene has more than `most`: a tie-break of similarity is skipped there."""
    n = F.count("*").over(W.partitionBy(key))
    return objects.withColumn("tie_score", F.when(n <= most, F.col("score")))


def cropped_best(crops: DataFrame, key: list[str]) -> DataFrame:
    """Of each key's crops the one with the highest product of both scores (clip, seg); ties to the earlier place."""
    return best_by(crops.withColumn("score", F.col("clip") * F.col("seg")), key, F.desc("score"), "place")
