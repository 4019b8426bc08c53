"""Split, apply, combine: group keys stay columns, groups stay rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.order import global_row_number, spread
from sparkreg.functions.storage import bounded_broadcast, materialise


def with_key(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return df.withColumn(name, key)


def leave_one_out(df: DataFrame, row_id: str = "row_id", name: str = "key") -> DataFrame:
    """Every row a group of its own."""
    return df.withColumn(name, F.col(row_id))


def kfold(df: DataFrame, k: int = 2, row_id: str = "row_id", name: str = "key", dense: bool = False) -> DataFrame:
    """Key = position mod k. dense: row_id already is the position 0 .. n-1."""
    if dense:
        return df.withColumn(name, F.col(row_id) % k)
    places = global_row_number(df.select(row_id), row_id, name="__pos")
    return df.join(places, row_id).withColumn(name, F.col("__pos") % k).drop("__pos")


def indexers(df: DataFrame, key: str = "key", row_id: str = "row_id", max_rows: int = 10_000_000) -> DataFrame:
    """(key, indices): ascending row_ids of each group, in one row a group; a group of more than max_rows rows is an error before
    any is gathered. The long form, for groups of any size, is df itself."""
    largest = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by(key, "n").alias("k"), F.max("n").alias("n")).first()
    if (largest.n or 0) > max_rows:
        raise ValueError(f"group {largest.k} has {largest.n} rows; at most {max_rows} are put into one")
    return df.groupBy(key).agg(F.sort_array(F.collect_list(row_id)).alias("indices"))


def extreme_group(df: DataFrame, key: str = "key", last: bool = False) -> DataFrame:
    """The rows of the group with the least (or greatest) key."""
    edge = df.agg((F.max if last else F.min)(key).alias("__edge"))
    return df.join(F.broadcast(edge), F.col(key) == F.col("__edge")).drop("__edge")


def filter_groups(df: DataFrame, keep: Column, key: str = "key") -> DataFrame:
    """The rows of the groups for which the aggregate keep holds."""
    kept = materialise(df.groupBy(key).agg(keep.alias("__keep")).where("__keep").select(F.col(key).alias("__key")), "kept-groups")
    return df.join(bounded_broadcast(kept), F.col(key).eqNullSafe(F.col("__key")), "left_semi")


def with_group_value(df: DataFrame, value: Column, name: str, key: str = "key") -> DataFrame:
    """df with an aggregate of its group: aggregated first and joined back, so a hot group is no single task."""
    sums = materialise(df.groupBy(F.col(key).alias("__key")).agg(value.alias(name)), "group-values")
    return df.join(bounded_broadcast(sums), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def apply_groups(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str | list[str] = "key", row_id: str = "row_id", max_rows: int = 50_000) -> DataFrame:
    """f over the rows of each group in order of row_id; a larger group than max_rows is an error that names the key."""
    keys = [key] if isinstance(key, str) else list(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_rows:
            raise ValueError(f"group {pdf[keys].iloc[0].tolist()} has {len(pdf)} rows; at most {max_rows} are modelled together")
        return f(pdf.sort_values(row_id))

    return spread(df, *keys).groupBy(*keys).applyInPandas(run, schema)


def combine(df: DataFrame, key: str = "key", row_id: str = "row_id", name: str = "position") -> DataFrame:
    """All rows in key order, then their own order: positions 0 .. n-1."""
    return global_row_number(df, key, row_id, name=name)


def extreme_value(df: DataFrame, value: str, key: str = "key", largest: bool = False) -> DataFrame:
    """(key, value) of the least or largest value; the lowest key wins a tie."""
    if not largest:
        return df.agg(F.min(F.struct(F.col(value).alias("value"), F.col(key).alias("key"))).alias("s")).select("s.key", "s.value")
    top = df.agg(F.max(value).alias("__top"))
    return df.join(F.broadcast(top), F.col(value) == F.col("__top")).agg(F.min(key).alias("key"), F.max(value).alias("value"))


def all_any(df: DataFrame, value: Column) -> DataFrame:
    """all and any of a boolean; of no rows: true and false."""
    return df.agg(F.coalesce(F.bool_and(value), F.lit(True)).alias("all_true"), F.coalesce(F.bool_or(value), F.lit(False)).alias("any_true"))


def all_same(df: DataFrame, value: Column) -> DataFrame:
    """Whether a column is constant; of no rows: true."""
    return df.agg(F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias("all_same"))


def uniform_ks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Largest distance of the empirical distribution of value from the uniform one on [0, 1], at least 0."""
    rows = global_row_number(df.select(*(by or []), value), *(by or []), value, name="__p")
    if by:  # positions within a group are those within the table less the group's first: no group meets in one task
        groups = materialise(rows.groupBy(*by).agg(F.min("__p").alias("__first"), F.count(F.lit(1)).alias("__n")), "group-starts")
        groups = groups.select(*(F.col(c).alias(f"__{c}") for c in by), "__first", "__n")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
        rows = rows.join(bounded_broadcast(groups), same).withColumn("__i", F.col("__p") - F.col("__first"))
    else:
        rows = rows.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__n")))).withColumnRenamed("__p", "__i")
    gap = F.greatest((F.col("__i") + 1) / F.col("__n") - F.col(value), F.col(value) - F.col("__i") / F.col("__n"), F.lit(0.0))
    return rows.groupBy(*(by or [])).agg(F.max(gap).alias("ks"))


def in_original_order(parts: DataFrame, expected: DataFrame, row_id: str = "row_id") -> DataFrame:
    """parts, with an error unless their row_ids are those of expected, each once."""
    facts = parts.agg(F.count(row_id).alias("n"), F.count_distinct(row_id).alias("d"), F.min(row_id).alias("lo"), F.max(row_id).alias("hi"))
    want = expected.agg(F.count(row_id).alias("wn"), F.min(row_id).alias("wlo"), F.max(row_id).alias("whi"))
    whole = F.broadcast(facts.crossJoin(want).select(F.expr("n = wn and d = n and lo <=> wlo and hi <=> whi").alias("__whole")))
    held = F.when(F.col("__whole"), F.col(row_id)).otherwise(F.raise_error(F.lit("row_ids are not those of the dataset")).cast("long"))
    return parts.crossJoin(whole).withColumn(row_id, held).drop("__whole")
