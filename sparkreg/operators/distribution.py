"""Uncertain columns: marginal distributions (row_id, mean, variance) and joint ones in long form (group, i, j, cov).

A joint distribution has its means as rows (group, i, mean). Matrices are long: (i, j, v) or (i, k, v).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_marginals(a: DataFrame, b: DataFrame, sign: int = 1, row_id: str = "row_id") -> DataFrame:
    """Sum (or difference) of independent marginals: variances always add."""
    other = b.select(row_id, F.col("mean").alias("__m"), F.col("variance").alias("__v"))
    return a.join(other, row_id).select(row_id, (F.col("mean") + sign * F.col("__m")).alias("mean"), (F.col("variance") + F.col("__v")).alias("variance"))


def scale_marginal(a: DataFrame, s: float, row_id: str = "row_id") -> DataFrame:
    return a.select(row_id, (s * F.col("mean")).alias("mean"), (s * s * F.col("variance")).alias("variance"))


def approximately_equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-3, row_id: str = "row_id") -> DataFrame:
    """Whether |a - b| <= tolerance min(|a|, |b|) for means and for variances (Euclidean norms)."""
    other = b.select(F.col(row_id).alias("__r"), F.col("mean").alias("__m"), F.col("variance").alias("__v"))
    both = a.join(other, F.col(row_id) == F.col("__r"), "full_outer")
    missing = F.max((F.col("__r").isNull() | F.col(row_id).isNull()).cast("int"))
    sums = {f"{k}{n}": F.sum(e) for k, x, y in (("m", F.col("mean"), F.col("__m")), ("v", F.col("variance"), F.col("__v"))) for n, e in (("d", (x - y) * (x - y)), ("a", x * x), ("b", y * y))}
    row = both.agg(missing.alias("missing"), *(e.alias(n) for n, e in sums.items()))
    near = F.coalesce(F.col("missing") == 0, F.lit(True))
    for k in "mv":
        near = near & (F.coalesce(F.sqrt(f"{k}d"), F.lit(0.0)) <= tolerance * F.coalesce(F.sqrt(F.least(f"{k}a", f"{k}b")), F.lit(0.0)))
    return row.select(near.alias("equal"))


def combine_joints(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Covariance of the sum of independent joint distributions; sign is of no account."""
    other = b.select("group", "i", "j", F.col("cov").alias("__c"))
    return a.join(other, ["group", "i", "j"], "full_outer").select("group", "i", "j", (F.coalesce("cov", F.lit(0.0)) + F.coalesce("__c", F.lit(0.0))).alias("cov"))


def joint_marginal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("group", "i", F.col("cov").alias("variance"))


def joint_subset(a: DataFrame, positions: DataFrame) -> DataFrame:
    """Covariance of positions (pos, i) in their order: a symmetric subset."""
    p, q = positions.select(F.col("pos").alias("__p"), "i"), positions.select(F.col("pos").alias("__q"), F.col("i").alias("j"))
    return a.join(p, "i").join(q, "j").select("group", F.col("__p").alias("i"), F.col("__q").alias("j"), "cov")


def transform_marginal(matrix: DataFrame, a: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Mean A m and variance diag(A V A') of a diagonal distribution, for a long matrix (i, k, v): one partial aggregate."""
    rows = matrix.join(a.withColumnRenamed(row_id, "k"), "k")
    return rows.groupBy("i").agg(F.sum(F.col("v") * F.col("mean")).alias("mean"), F.sum(F.col("v") * F.col("v") * F.col("variance")).alias("variance"))


def transform_joint(matrix: DataFrame, cov: DataFrame) -> DataFrame:
    """A V A' for long A (i, k, v) and V (k, l, cov): two sparse products, aggregated between."""
    left = matrix.join(cov, "k").groupBy("i", "l").agg(F.sum(F.col("v") * F.col("cov")).alias("w"))
    right = matrix.select(F.col("i").alias("j"), F.col("k").alias("l"), F.col("v").alias("u"))
    return left.join(right, "l").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("u")).alias("cov"))
