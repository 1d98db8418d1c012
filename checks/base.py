"""Registry of queries and shared derivations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded and dates as text, so that two engines can be compared value by value."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append((F.round(name, digits) + F.lit(0.0)).alias(name))
        elif kind.startswith("decimal"):
            out.append(F.round(F.col(name).cast("double"), digits).alias(name))
        elif kind == "int":
            out.append(F.col(name).cast("bigint").alias(name))
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            out.append(F.col(name).cast("string").alias(name))
        elif kind == "array<string>":
            out.append(F.array_join(name, ";").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def money(column: str):
    return F.col(column).cast("decimal(18,4)")


def daily_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """Daily order value per priority: one series per priority."""
    orders = table(spark, sf, "orders")
    return orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.sum(money("o_totalprice")).cast("double").alias("revenue"))


DAILY = """daily AS (
  SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue
  FROM orders GROUP BY 1, 2)"""
