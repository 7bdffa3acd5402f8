"""Reading the driver's tables, and the roles they play: line items as points, parts as labelled objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c, digits=6):
    """Rounded as SQL does it: the product with a power of ten is, so that ties are told by the double and not by its shortest text."""
    power = F.lit(10.0**digits)
    return F.round(c * power) / power + F.lit(0.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z: quantity, price in thousands, and discount in percent of every line item, with a unique id."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("frame"), F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_tax").alias("conf"),
    )


POINTS_SQL = "points AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS frame, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_tax AS conf FROM lineitem)"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as objects: uid order, query, confidence, position."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("position"), F.col("p_name").alias("query"), F.col("p_brand").alias("human_label"), (F.col("p_size") / 50).alias("confidence"),
        ((F.col("p_partkey") % 97) / 10).alias("x"), ((F.col("p_partkey") % 31) / 10).alias("y"), ((F.col("p_partkey") % 7) / 10).alias("z"), F.col("p_type").alias("scan"),
    )


OBJECTS_SQL = "objects AS (SELECT p_partkey AS position, p_name AS query, p_brand AS human_label, p_size / 50 AS confidence, (p_partkey % 97) / 10 AS x, (p_partkey % 31) / 10 AS y, (p_partkey % 7) / 10 AS z, p_type AS scan FROM part)"
