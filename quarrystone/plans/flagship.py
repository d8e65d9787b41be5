"""The star roll-up that `entry` returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.sources.tables import load


def nation_year_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers and revenue by nation and order year.

    Lines are summed by order before the join, so the large table shuffles once, as one row per order.
    """
    line = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).alias("revenue"), F.count(F.lit(1)).alias("lines")
    )
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"))
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "order_year").agg(
        F.sum("lines").alias("n_lines"),
        F.count(F.lit(1)).alias("n_orders"),
        F.countDistinct("c_custkey").alias("n_customers"),
        F.round(F.sum("revenue").cast("double"), 2).alias("revenue"),
    )


SQL = """
SELECT n_name, year(o_orderdate) AS order_year, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders,
       count(DISTINCT c_custkey) AS n_customers,
       round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, year(o_orderdate)
"""
