"""Upserts against a loop, repeated and lost attempts, other writers, removal and eviction."""

import random

import pytest
from pyspark.sql import functions as F

from cartolith.sources.versions import ConflictError, VersionedTable

ROWS = "k long, m string, at long, a string, b double"


def batch(rng, n):
    return [(rng.randrange(12), rng.choice(["x", "y", None]), rng.randrange(50), rng.choice([None, "p", "q", "r"]), rng.choice([None, 1.0, 2.0, float(rng.randrange(9))])) for _ in range(n)]


def folded(batches, filled=False, fixed=()):
    """By key, the rows in order; of equal order only those of one batch are ambiguous, and are left out of the data."""
    out = {}
    rows = sorted(((r[2], i, r) for i, b in enumerate(batches) for r in b), key=lambda x: x[:2])
    for _, _, r in rows:
        old = out.get(r[:2])
        new = list(r)
        for c in (2, 3, 4):
            if old is not None and (filled and new[c] is None):
                new[c] = old[c]
        if old is not None and 3 in fixed:
            new[3] = old[3] if old[3] is not None else new[3]
        out[r[:2]] = tuple(new)
    return out


def distinct_order(rows):
    return list({(r[0], r[1], r[2]): r for r in rows}.values())


@pytest.mark.parametrize("filled,fixed", [(False, ()), (True, ()), (True, ("a",))])
def test_upserts_against_a_loop(spark, tmp_path, filled, fixed):
    rng = random.Random(1)
    batches = [distinct_order(batch(rng, n)) for n in (40, 5, 0, 60)]
    t = VersionedTable(spark, str(tmp_path / "t"), ["k", "m"], ["at"], buckets=4, filled=filled, fixed=fixed)
    versions = [t.upsert(spark.createDataFrame(b, ROWS), ("w", i)) for i, b in enumerate(batches)]
    assert versions == [1, 2, 3, 4] and t.versions() == versions
    for i in range(4):
        got = [tuple(r) for r in t.read(versions[i]).collect()]
        assert sorted(got, key=repr) == sorted(folded(batches[: i + 1], filled, (3,) if fixed else ()).values(), key=repr)
    before = sorted(map(tuple, t.read().collect()), key=repr)
    assert t.upsert(spark.createDataFrame(batches[1], ROWS), ("w", 1)) == 4 and t.upsert(spark.createDataFrame(batches[3], ROWS), ("w", 3)) == 4  # repeats
    assert t.upsert(spark.createDataFrame(batches[3], ROWS), ("other", 3)) == 5 and sorted(map(tuple, t.read().collect()), key=repr) == before  # the same rows change nothing


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], ["at"], buckets=8)
    t.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("at")))
    old = t.manifest()["parts"]
    t.upsert(spark.createDataFrame([(5, 2)], "k long, at int"))
    new = t.manifest()["parts"]
    assert len(old) == 8 and sum(old[b] != new[b] for b in old) == 1 and t.read().count() == 100


def test_what_a_lost_attempt_left_is_never_read(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], ["at"], buckets=2)
    row = lambda k, at: spark.createDataFrame([(k, at)], "k long, at int")
    t.upsert(row(1, 1), ("w", 0))

    def dies(self, manifest):
        raise RuntimeError("lost")

    commit = VersionedTable._commit
    monkeypatch.setattr(VersionedTable, "_commit", dies)
    with pytest.raises(RuntimeError, match="lost"):
        t.upsert(row(2, 1), ("w", 1))
    monkeypatch.setattr(VersionedTable, "_commit", commit)
    assert {r.k for r in t.read().collect()} == {1} and t.upsert(row(2, 1), ("w", 1)) == 2 and {r.k for r in t.read().collect()} == {1, 2}
    assert t.vacuum(keep=1, older_than_s=0) >= 1 and {r.k for r in t.read().collect()} == {1, 2} and t.versions() == [2]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer's commit in between is merged, not lost; one that always comes first ends in an error."""
    t, other = (VersionedTable(spark, str(tmp_path / "t"), ["k"], ["at"], buckets=2) for _ in range(2))
    row = lambda k, at: spark.createDataFrame([(k, at)], "k long, at int")
    commit, turns = VersionedTable._commit, [1, 0]

    def second(self, manifest):
        if turns and turns.pop():
            monkeypatch.setattr(VersionedTable, "_commit", commit)
            other.upsert(row(7, 1))
            monkeypatch.setattr(VersionedTable, "_commit", second)
        return commit(self, manifest)

    turns.reverse()
    monkeypatch.setattr(VersionedTable, "_commit", second)
    assert t.upsert(row(1, 1)) == 2 and {r.k for r in t.read().collect()} == {1, 7}
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, manifest: False)
    with pytest.raises(ConflictError):
        t.upsert(row(2, 1))
    assert t.versions() == [1, 2]


def test_removal_and_eviction(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["scan", "k"], ["at"], buckets=4, by=["scan"])
    t.upsert(spark.createDataFrame([(s, k, 10 * s + k) for s in range(5) for k in range(4)], "scan long, k long, at long"))
    t.upsert(spark.createDataFrame([(2, 9, 1)], "scan long, k long, at long"), remove=spark.createDataFrame([(2,), (77,)], "scan long"))
    assert sorted((r.scan, r.k) for r in t.read().collect()) == sorted([(s, k) for s in (0, 1, 3, 4) for k in range(4)] + [(2, 9)])
    t.upsert(t.read().limit(0), remove=spark.createDataFrame([(3,)], "k long"))  # not the columns that buckets are dealt by
    assert {r.k for r in t.read().collect()} == {0, 1, 2, 9}
    t.evict(3)
    assert sorted((r.scan, r.k) for r in t.read().collect()) == [(4, 0), (4, 1), (4, 2)] and t.evict(0) == t.evict(3) == t.versions()[-1]
    none = VersionedTable(spark, str(tmp_path / "none"), ["k"], ["at"])
    with pytest.raises(ValueError, match="no version"):
        none.read()
