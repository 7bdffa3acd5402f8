"""Queries without SQL read whole tables: against loops over the smallest ones."""

import os
from collections import Counter

import pytest

from cartolith.operators import ledger as L
from cartolith.plans import ledger, points

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_clusters_take_all_line_items(spark):
    items = spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount").collect()
    voxels = Counter(tuple(int(v // points.SIDE) for v in (float(r[0]), float(r[1]) / 1000, float(r[2]) * 100)) for r in items)
    want, left = Counter(), set(voxels)
    while left:
        todo = [left.pop()]
        found = list(todo)
        while todo:
            i, j, k = todo.pop()
            near = {(i + a, j + b, k + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)} & left
            left -= near
            todo += near
            found += near
        want[len(found), sum(voxels[v] for v in found)] += 1
    assert Counter((r.voxels, r.points) for r in points.clusters(spark, DIR).collect()) == want


def test_ledger_folds_all_orders(spark):
    orders = spark.read.parquet(f"{DIR}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    got = ledger.ledger_balances(spark, DIR).collect()
    assert sorted(r.user_id for r in got) == sorted({str(r.o_custkey) for r in orders})
    rows, books, balance = Counter(), L.Books(), Counter()
    for c in sorted(ledger._commands(spark, DIR).collect(), key=lambda c: c.seq):  # all users in one book
        for user, status, kind, delta, *_ in books.apply(c):
            rows[c.op, status, kind] += 1
            balance[user] += delta if kind else 0
    assert {c[1] for c in rows} >= {"ok", "replay", "insufficient_credits", "no_hold", "hold_not_open"} and {c[2] for c in rows} >= {"grant", "spend", "hold", "settle"}
    assert {r.user_id: r.balance for r in got} == dict(balance)
    results = ledger.ledger_results(spark, DIR).collect()
    assert Counter({(r.op, r.status, r.kind): r.n for r in results}) - rows == rows - Counter({(r.op, r.status, r.kind): r.n for r in results}) == Counter() and sum(r.n for r in results) >= len(orders)
