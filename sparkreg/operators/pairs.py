"""Tables of pairs of rows: distances and covariances in long form.

All pairs of a whole table are quadratic, so the pairs here are of rows that share a group; across a table, one side is a
stated set of bounded size, or the pairs are found by equality.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.joins import join_hot
from sparkreg.functions.storage import bounded_broadcast, materialise

Pair = Callable[[Column, Column], Column]
_BLOCK = 1_000  # rows of one feature that meet another row as an array
_TASK_PAIRS, _MAX_TASKS = 20_000_000, 20_000


def within_groups(df: DataFrame, value: Pair, group: str = "group", index: str = "i", feature: str = "x", name: str = "cov") -> DataFrame:
    """(group, i, j, value): the symmetric matrix of each group. Each unordered pair is evaluated once and mirrored."""
    other = df.select(F.col(group).alias("__g"), F.col(index).alias("j"), F.col(feature).alias("__y"))
    half = df.join(other, (F.col(group) == F.col("__g")) & (F.col(index) <= F.col("j"))).select(F.col(group).alias("group"), F.col(index).alias("i"), "j", value(F.col(feature), F.col("__y")).alias(name))
    ends = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.withColumn("__e", F.explode(ends)).select("group", "__e.i", "__e.j", name)


def against(df: DataFrame, queries: DataFrame, value: Pair, index: str = "i", feature: str = "x", name: str = "cov", max_queries: int = 100_000) -> DataFrame:
    """(i, j, value) of every row against a stated set of queries (j, y), which every task gets."""
    return df.join(bounded_broadcast(queries.select("j", F.col("y").alias("__y")), max_queries)).select(F.col(index).alias("i"), "j", value(F.col(feature), F.col("__y")).alias(name))


def noise(df: DataFrame, sigma: float, index: str = "i", feature: str = "x", max_equal: int | None = None) -> DataFrame:
    """(i, j, cov) of independent noise: all pairs of rows of equal features, null features aside. Indices are unique.

    Pairs grow with the square of the rows that share a feature (``noise_blocks`` has the same matrix in linear size), so a feature
    is cut into blocks of about _BLOCK rows and its pairs are dealt out by pairs of blocks to tasks of about _TASK_PAIRS pairs,
    whatever feature they have. A row meets a block as one array, so what is shuffled are the pairs over _BLOCK, and what a
    task holds of a row's partners is one block. More than max_equal rows of a feature, where it is given, are an error.
    """
    rows = df.where(F.col(feature).isNotNull()).select(F.col(index).alias("i"), F.col(feature).alias("__x"))
    sizes = rows.groupBy("__x").agg(F.count(F.lit(1)).alias("__n")).withColumn("__g", F.monotonically_increasing_id())
    sizes = materialise(sizes, "noise-sizes")
    found = sizes.agg(F.max_by("__x", "__n").alias("x"), F.max("__n").alias("n"), F.sum(F.col("__n").cast("double") ** 2).alias("pairs")).first()
    if max_equal is not None and (found.n or 0) > max_equal:
        raise ValueError(f"{found.n} rows share the feature {found.x}; at most {max_equal} are paired")
    blocks = F.ceil(F.col("__n") / _BLOCK)
    placed = join_hot(rows, sizes, "__x", "__n").select("__g", "i", F.pmod(F.xxhash64("i"), blocks).alias("__b"), F.sequence(F.lit(0).cast("long"), blocks - 1).alias("__all"))
    placed = materialise(placed, "noise-rows")
    left = placed.select("__g", F.col("__b").alias("__a"), F.explode("__all").alias("__b"), "i")
    arrays = placed.groupBy("__g", "__b", "__all").agg(F.transform(F.collect_list(F.struct("i")), lambda s: s["i"]).alias("__j"))  # structs keep nulls
    right = arrays.select("__g", F.explode("__all").alias("__a"), "__b", "__j")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil((found.pairs or 0) / _TASK_PAIRS))
    ends, at = ["__g", "__a", "__b"], min(tasks, _MAX_TASKS)
    met = left.repartition(at, *ends).join(right.repartition(at, *ends).hint("merge"), ends)  # no broadcast: rows stay dealt out
    return met.select("i", F.explode("__j").alias("j"), F.lit(float(sigma**2)).alias("cov"))


def noise_blocks(df: DataFrame, sigma: float, index: str = "i", feature: str = "x") -> DataFrame:
    """(i, block, cov): the matrix of independent noise is cov between rows of one block and 0 elsewhere; a block is named by its
    least index. One row a row, however many share a feature; a null feature equals none."""
    blocks = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).alias("__x")).agg(F.min(index).alias("block"), F.count(F.lit(1)).alias("__n"))
    named = join_hot(df.where(F.col(feature).isNotNull()).withColumnRenamed(feature, "__x"), materialise(blocks, "noise-blocks"), "__x", "__n")
    alone = df.where(F.col(feature).isNull()).select(F.col(index).alias("i"), F.col(index).alias("block"))
    return named.select(F.col(index).alias("i"), "block").union(alone).withColumn("cov", F.lit(float(sigma**2)))


def of_combinations(combos: DataFrame, value: Pair) -> DataFrame:
    """(c, d, cov) between linear combinations, long rows (group, c, x, coef) within a group: sums of coef coef' k(x, x')."""
    other = combos.select(F.col("group").alias("__g"), F.col("c").alias("d"), F.col("x").alias("__y"), F.col("coef").alias("__f"))
    rows = combos.join(other, F.col("group") == F.col("__g"))
    return rows.groupBy("group", "c", "d").agg(F.sum(F.col("coef") * F.col("__f") * value(F.col("x"), F.col("__y"))).alias("cov"))
