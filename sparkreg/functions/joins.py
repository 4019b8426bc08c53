"""Joins that hold when one key has a large share of the rows, or when the rows are wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.storage import is_small

_BITS = 26  # of a bitmap of keys: 2,048 parts of 4 KB, 8 MB at most, whatever the number of keys
_PART = 32_768  # bits of a part, as Spark's bitmap functions have them


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, hot_rows: int = 20_000) -> DataFrame:
    """left inner joined with right on key, where right has one row a key and ``size``, the rows of left with that key.

    A small right side is broadcast. Else keys of more than hot_rows rows, of which there is at most one for every
    hot_rows rows, are joined by a broadcast of their own, and only the others are shuffled. right should be materialised.
    """
    if is_small(right):
        return left.join(F.broadcast(right), key)
    hot, rest = right.where(F.col(size) > hot_rows), right.where(F.col(size) <= hot_rows)
    if not is_small(hot):
        return left.join(right, key)
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(others.join(rest, key))


def _marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with ``maybe``: false only where the key is not among keys; by a bitmap of hashes of a fixed size."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << _BITS))
    maps = keys.select(F.expr(f"pmod(xxhash64(`{key}`), {1 << _BITS})").alias("slot"))
    maps = maps.groupBy(F.expr(f"slot div {_PART}").alias("part")).agg(F.bitmap_construct_agg(F.col("slot") % _PART).alias("bits"))
    rows = rows.withColumn("slot", slot).withColumn("at", F.expr(f"slot div {_PART}")).join(F.broadcast(maps), F.col("at") == F.col("part"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(bits, int((slot % {_PART}) div 8) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(b, int(slot % 8)) & 1")
    return rows.withColumn("b", byte).withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("slot", "at", "part", "bits", "b")


def _packed(docs: DataFrame, key: Column) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"))


def without_keys(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of docs whose key is not in keys (a materialised table with the column k).

    A small table of keys is broadcast. Beyond that, a bitmap lets the rows that cannot be meant pass without a shuffle.
    """
    rows = _packed(docs, key)
    if is_small(keys):
        return rows.join(F.broadcast(keys), "k", "left_anti").select("row.*")
    rows = _marked(rows, keys, "k")
    doubtful = rows.where("maybe").join(keys, "k", "left_anti")
    return rows.where("not maybe").select("row.*").union(doubtful.select("row.*"))


def with_keys(docs: DataFrame, key: Column, table: DataFrame) -> DataFrame:
    """(row, k, the columns of table) for the rows of docs (as structs) whose key is in table, which has a column k."""
    rows = _packed(docs, key)
    if is_small(table):
        return rows.join(F.broadcast(table), "k")
    return _marked(rows, table.select("k"), "k").where("maybe").drop("maybe").join(table, "k")
