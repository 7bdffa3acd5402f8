"""Arrays: run-length masks, vectors, documents as maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rle_area(counts: Column) -> Column:
    """Set pixels of a run-length mask whose first run is unset."""
    return F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)


def rle_decode(size: Column, counts: Column) -> Column:
    """The mask as an array of booleans by rows; null unless the runs add up to the size."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    runs = F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i % 2 == 1, n.cast("int"))))
    return F.when(total == size[0].cast("long") * size[1], runs)


def rle_encode(mask: Column) -> Column:
    """Run lengths of an array of booleans, the first of unset pixels (perhaps 0)."""
    n = F.size(mask)
    turns = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.coalesce(mask[i], F.lit(False)) != F.when(i > 0, F.coalesce(mask[i - 1], F.lit(False))).otherwise(False)))
    return F.transform(turns, lambda at, k: at - F.when(k > 0, turns[k - 1]).otherwise(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), length(a) * length(b)), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def transposed(m: Column, n: int = 3) -> Column:
    """Rows of an n x n array of arrays as columns."""
    def column(k: int) -> Column:
        return F.transform(m, lambda row: row[k])  # a second parameter of the lambda would be the row's number

    return F.array(*[column(k) for k in range(n)])


def box_or_null(c: Column) -> Column:
    """Four numbers, or null."""
    return F.when((F.size(c) == 4) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)), c)


def merged(old: Column, new: Column) -> Column:
    """Map entries of new over those of old."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def percentile_of(a: Column, p: float) -> Column:
    """The linear percentile of an array; null if it is empty."""
    s = F.sort_array(a)
    at = (F.size(s) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    return F.when(F.size(s) > 0, s[low] + (at - low) * (s[F.least(low + 1, F.size(s) - 1)] - s[low]))
