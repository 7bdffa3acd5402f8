"""Queries over orders and customers as a credit ledger: folds, balances, audits, overdue holds, prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import geometry as G
from cartolith.operators import ledger as L
from cartolith.plans.tables import table


OPS = ["grant", "spend", "hold", "topup", "settle", "hold", "grant", "spend", "void", "expire", "hold", "settle", "spend", "ensure"]


def _commands(spark, d):
    """Every order as a command of its customer: each 14th is a grant, and so on; some customers share references, some are unlimited."""
    o = table(spark, d, "orders")
    op = F.element_at(F.array(*[F.lit(x) for x in OPS]), (F.col("o_orderkey") % len(OPS) + 1).cast("int"))
    own = F.when(F.col("o_custkey") % 25 == 0, F.concat(F.lit("shared-"), (F.col("o_custkey") % 150).cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    none = F.lit(None).cast("string")
    ops = o.select(
        (F.col("o_orderkey") + 10).alias("seq"), F.col("o_custkey").cast("string").alias("user_id"), op.alias("op"), (F.floor(F.col("o_totalprice") / 1000) - 20).cast("long").alias("amount"),
        F.lit("order").alias("ref_type"), F.concat(own, F.lit("/"), (F.col("o_orderkey") % 2).cast("string")).alias("ref_id"), F.concat(F.lit("k:"), F.floor(F.col("o_orderkey") / 3).cast("string")).alias("idem"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(5000).cast("long")).alias("ttl_s"), F.col("o_orderkey").cast("double").alias("now"),
    )
    seeds = o.select("o_custkey").distinct().select(
        F.lit(0).cast("long").alias("seq"), F.col("o_custkey").cast("string").alias("user_id"), F.when(F.col("o_custkey") % 40 == 0, "ensure_unlimited").otherwise("ensure").alias("op"), F.lit(300).cast("long").alias("amount"),
        none.alias("ref_type"), none.alias("ref_id"), none.alias("idem"), F.lit(None).cast("long").alias("ttl_s"), F.lit(0.0).alias("now"),
    )
    return seeds.unionByName(ops)


def ledger_results(spark, d):
    return L.fold(_commands(spark, d)).groupBy("op", "status", "kind").agg(F.count("*").alias("n"), F.sum("delta").alias("delta"))


def ledger_balances(spark, d):
    return L.balances(L.fold(_commands(spark, d)))


def account_audit(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.floor("c_acctbal").cast("long").alias("balance"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("delta"))
    return L.imbalanced(c, o, "c_custkey", "balance", "delta")


AUDIT = """
WITH l AS (SELECT o_custkey, sum(floor(o_totalprice / 100)::BIGINT)::BIGINT AS s FROM orders GROUP BY 1)
SELECT c_custkey, floor(c_acctbal)::BIGINT AS balance, coalesce(s, 0) AS ledger_sum FROM customer LEFT JOIN l ON c_custkey = o_custkey WHERE floor(c_acctbal)::BIGINT <> coalesce(s, 0)
"""


def spendable(spark, d):
    c = table(spark, d, "customer")
    now, exp = F.lit("1998-01-01").cast("timestamp"), F.when(F.col("c_custkey") % 2 == 0, F.expr("timestamp'1997-01-01 00:00:00'"))
    return c.select("c_custkey", L.available(F.floor("c_acctbal").cast("long"), F.lit(50).cast("long"), exp, (F.col("c_nationkey") * 2).cast("long"), now).alias("available"))


SPENDABLE = "SELECT c_custkey, floor(c_acctbal)::BIGINT + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 50 END - c_nationkey * 2 AS available FROM customer"


def overdue_holds(spark, d):
    o = table(spark, d, "orders")
    h = o.select(F.col("o_orderkey").alias("hold_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("settled").alias("status"), F.col("o_orderdate").cast("timestamp").alias("expires_at"))
    return L.expired_holds(h, F.expr("timestamp'1997-06-01 00:00:00'"), 3600).select("hold_id")


OVERDUE = "SELECT o_orderkey AS hold_id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 3600 SECOND < TIMESTAMP '1997-06-01' ORDER BY o_orderdate, o_orderkey LIMIT 200"


def reaped_holds(spark, d):
    o = table(spark, d, "orders")
    h = o.select(F.col("o_orderkey").alias("hold_id"), F.floor(F.col("o_orderkey") * 1.25).cast("long").alias("ref_id"))
    j = o.select(F.col("o_orderkey").alias("ref_id"), F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "failed").otherwise("done").alias("job_status"))
    return L.reaper_actions(h, j).groupBy("action").agg(F.count("*").alias("n"))


REAPED = """
SELECT CASE j.o_orderstatus WHEN 'O' THEN 'skip' WHEN 'P' THEN 'void' ELSE 'settle' END AS action, count(*) AS n FROM orders h LEFT JOIN orders j ON j.o_orderkey = floor(h.o_orderkey * 1.25)::BIGINT GROUP BY 1
"""


def compute_prices(spark, d):
    prices = table(spark, d, "nation").select(F.col("n_nationkey").alias("kind"), (F.col("n_regionkey") * 0.25).alias("price")).filter("kind < 20")
    use = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("kind"), F.floor("s_acctbal").alias("seconds"))
    return L.priced(use, prices, "kind", "seconds", "price").select("s_suppkey", "cost", "basis", G.minutes_billed(F.col("seconds")).alias("credits"))


PRICES = """
SELECT s_suppkey, CASE WHEN n_nationkey IS NOT NULL THEN round(floor(s_acctbal) * n_regionkey * 0.25, 6)::DOUBLE END AS cost, CASE WHEN n_nationkey IS NULL THEN 'unlisted' ELSE 'listed' END AS basis, (ceil(floor(s_acctbal) / 60) * 25)::BIGINT AS credits
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20
"""

QUERIES = {f.__name__: f for f in (ledger_results, ledger_balances, account_audit, spendable, overdue_holds, reaped_holds, compute_prices)}
ORACLES = {"account_audit": AUDIT, "spendable": SPENDABLE, "overdue_holds": OVERDUE, "reaped_holds": REAPED, "compute_prices": PRICES}
