"""Every registered query of the library's own operators against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from cartolith.plans import events, ledger, navigation, objects, placing, points, scenes, streams, vectors

DIR = "/root/testdata/sf0.001"
PLANS = (events, points, navigation, streams, objects, vectors, ledger, placing, scenes)
NAMES = [(p, n) for p in PLANS for n in p.QUERIES]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("plan,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, duck, plan, name):
    df = plan.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in plan.ORACLES:
        rel = duck.sql(plan.ORACLES[name])
        assert sorted(rel.columns) == cols
        want = sorted((tuple(_value(v) for v in r) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
        assert got == want
    else:
        assert df.columns
