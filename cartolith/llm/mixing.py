"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is what brings its share of tokens to its target weight. Each document's
count is a Poisson draw with that mean, taken by inverting the distribution at a number hashed from the
seed and the document, so a rerun or a lost executor gives the same counts. Documents are exploded by
their counts and shuffled globally by a hash of seed, document and copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import as_row, of_row, unit_hash, width, written

#: Entries of all sources' distributions up to which these are broadcast (8 bytes each); with more, they are joined by salted shuffle.
BROADCAST_ENTRIES = 1_000_000
SALTS = 32
#: The largest mean of one draw, well above which exp(-rate) underflows; larger rates are drawn as sums of equal parts.
DRAW = 500.0


def cumulative(mean: float) -> np.ndarray:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable, as far as a hashed number in [0, 1) can pass it."""
    k = np.arange(int(mean + 9 * mean**0.5 + 30))
    if mean <= 0:
        return np.empty(0)
    terms = np.exp(-mean + k * np.log(mean) - np.append(0.0, np.cumsum(np.log(k[1:]))))
    sums = np.cumsum(terms)
    return sums[sums <= 1 - 2.0**-52]


def with_distributions(rates: DataFrame) -> DataFrame:
    """rates (source, rate) with draws, how many equal parts a rate is drawn in, and cum, cumulative() of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate = b.column("rate").to_numpy()
            draws = np.maximum(1, np.ceil(rate / DRAW)).astype(np.int32)
            cum = pa.array([cumulative(r / n) for r, n in zip(rate, draws, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(draws), cum], [*b.schema.names, "draws", "cum"])

    rows = rates.select("source", "rate")
    return rows.mapInArrow(run, "source string, rate double, draws int, cum array<double>")


def poisson_count(u: Column, cum: Column) -> Column:
    """The smallest k with u < P(X <= k)."""
    return F.size(F.filter(cum, lambda c: c <= u))


def counts(draws: Column, cum: Column, *parts: Column | str) -> Column:
    """A Poisson count from the hash of parts; of several draws the sum, each from a hash of its own."""
    total = F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda acc, i: acc + poisson_count(unit_hash(*parts, i.cast("string")), cum))
    return F.when(draws == 1, poisson_count(unit_hash(*parts), cum)).otherwise(total)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, smoothing: float = 0.7, budget: float = 1.0) -> DataFrame:
    """(source, tokens, weight, rate) of each source; a null source is a source of its own.

    Target weights are those given (a source that isn't named gets 0, and its documents go) or, without
    any, proportional to tokens ** smoothing, which lifts small sources. budget is the target total as a
    multiple of the tokens there are. Tokens are approximated by bytes of text / 4, at least 1 a document."""
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    tokens = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum((size / 4).cast("long") + 1).alias("tokens"))
    if weights is None:
        weight = F.pow(F.col("tokens").cast("double"), F.lit(smoothing))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    tokens = written(tokens.withColumn("weight", weight), "source-tokens")
    total = tokens.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w")).first()
    share = F.col("weight") / F.lit(float(total["w"] or 1.0))
    return tokens.select("source", "tokens", share.alias("weight"), (share * F.lit(float(budget) * float(total["t"] or 0)) / F.col("tokens")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = 7, smoothing: float = 0.7, budget: float = 1.0) -> DataFrame:
    """docs replicated to the target weights and shuffled, with added columns copy (from 0), n_copies, rate.

    A count depends on seed, doc_id and the text alone, so equal rows (same doc_id and text) get equal
    counts; a null doc_id or text hashes as an empty string. Every rate is drawn, however large: the column
    rate tells where a small source is repeated often. Columns of docs named copy, n_copies or rate are
    replaced, all others stay, whatever their names. An empty table gives an empty result."""
    names = [c for c in docs.columns if c.lower() not in ("copy", "n_copies", "rate")]
    spark = docs.sparkSession
    rate = written(with_distributions(rates(docs, weights, smoothing, budget)).withColumnRenamed("source", "of"), "rates")
    entries = rate.agg(F.sum(F.size("cum") + 16)).first()[0] or 0
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(as_row(docs, names), F.col("source").cast("string").alias("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.md5(text.cast("binary")).alias("md5"))
    same = F.col("source").eqNullSafe(F.col("of"))
    if entries <= BROADCAST_ENTRIES:
        keyed = keyed.join(F.broadcast(rate), same)
    else:
        salted = rate.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "md5"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("of_salt")))
    counted = keyed.withColumn("n_copies", counts(F.col("draws"), F.col("cum"), F.lit(str(seed)), "id", "md5")).filter("n_copies > 0")
    copies = counted.select("row", "id", "md5", "n_copies", "rate", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    # the text goes through one shuffle: a hashed key deals copies to random partitions, in each of which they are put in hashed order
    copies = copies.select("row", "copy", "n_copies", "rate", F.xxhash64(F.lit(seed), "id", "md5", "copy").alias("place"))
    shuffled = copies.repartition(width(spark), "place").sortWithinPartitions("place")
    return shuffled.select(*of_row(names), "copy", "n_copies", "rate")
