"""Operators on keyed tables: columns key and value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Merge = Callable[[Column, Column], Column]


def _sides(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    left = a.select("key", F.col("value").alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select("key", F.col("value").alias("__b"), F.lit(True).alias("__in_b"))
    return left.join(right, "key", how)


def intersect(a: DataFrame, b: DataFrame, merge: Merge = lambda x, y: F.struct(x.alias("a"), y.alias("b"))) -> DataFrame:
    """Keys of both, values merged (default: the pair)."""
    return _sides(a, b, "inner").select("key", merge(F.col("__a"), F.col("__b")).alias("value"))


def union(a: DataFrame, b: DataFrame, merge: Merge = lambda x, y: x) -> DataFrame:
    """Keys of either; where both have one, values are merged (default: left stays)."""
    both = F.col("__in_a") & F.col("__in_b")
    value = F.when(both, merge(F.col("__a"), F.col("__b"))).when(F.col("__in_a"), F.col("__a")).otherwise(F.col("__b"))
    return _sides(a, b, "full_outer").select("key", value.alias("value"))


def join_over(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either; the right value overwrites."""
    return union(a, b, lambda x, y: y)


def join_strict(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either; an error if a key is on both sides."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("key on both sides"))).otherwise(F.first("value"))
    return a.select("key", "value").unionByName(b.select("key", "value")).groupBy("key").agg(once.alias("value"))


def at_or(a: DataFrame, asked: DataFrame, default) -> DataFrame:
    """The value of every asked key, or default."""
    found = a.select("key", "value", F.lit(True).alias("__hit"))
    return asked.select("key").join(found, "key", "left").select("key", F.when(F.col("__hit"), F.col("value")).otherwise(F.lit(default)).alias("value"))


def subset(a: DataFrame, keys: DataFrame) -> DataFrame:
    """The entries of the listed keys; keys that are missing are ignored."""
    return a.join(keys.select("key"), "key", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The left entries whose key is not on the right."""
    return a.join(b.select("key"), "key", "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return difference(a, b).unionByName(difference(b, a))


def intersect_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("key").join(b.select("key"), "key", "left_semi")
