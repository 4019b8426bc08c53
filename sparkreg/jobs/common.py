"""Datasets that the queries derive from the tables, and how queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.operators.dataset import create_dataset


class Registry:
    """Queries and, where SQL can express them, their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to six places, without a negative zero: what an oracle can compare."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def gap6(c: Column) -> Column:
    """A number that is not negative, rounded to six places as SQL does: its millionfold to the nearest integer, halves up. Spark's
    round makes a decimal of each number, which takes longer than all else about a pair."""
    v = c * 1e6
    return F.when(v - F.rint(v) == 0.5, F.rint(v) + 1).otherwise(F.rint(v)) / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset of all events: feature hours since 2024, target value, key event type; row_id dense from 0."""
    e = table(spark, sf_dir, "events")
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 3.6e9D")
    return create_dataset(e, F.col("event_id"), hours, F.col("value"), 0.1 * (1 + F.col("event_id") % 5), F.col("event_type").alias("key"), F.col("user_id"))


#: The same in SQL, as a common table expression.
EV = "ev AS (SELECT event_id AS row_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS feature, value AS target, 0.1 * (1 + event_id % 5) AS target_variance, event_type AS key, user_id FROM events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items for regression: x quantity, y price in thousands, variance from the discount, several group keys."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (0.5 + F.col("l_discount")).alias("variance"), F.col("l_returnflag").alias("flag"),
        F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"),
    )


LI = "li AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, 0.5 + l_discount AS variance, l_returnflag AS flag, l_suppkey AS supp, l_orderkey AS okey, l_linenumber AS line, l_tax AS tax, l_discount AS discount FROM lineitem)"


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed table: revenue in thousands of each order's line items."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(r6(F.sum(F.col("l_extendedprice") / 1000)).alias("value"))


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed table: price in thousands of orders whose key is not a multiple of three."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"), r6(F.col("o_totalprice") / 1000).alias("value"))


KEYED = "a AS (SELECT l_orderkey AS key, round(sum(l_extendedprice / 1000), 6) AS value FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS key, round(o_totalprice / 1000, 6) AS value FROM orders WHERE o_orderkey % 3 <> 0)"
