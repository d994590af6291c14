"""Registered queries and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.aggregates import exact_sum, hundredths

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """SELECT n_name AS nation, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_orders,
       sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS revenue
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
)
def flagship_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .groupBy(F.col("n_name").alias("nation"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n_orders"), exact_sum(hundredths("o_totalprice")).alias("revenue"))
    )
