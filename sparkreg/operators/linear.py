"""Least squares: closed forms from power sums, and a distributed tall-skinny QR for any design.

Factors of QR are unique up to signs, so what is compared and stored is R'R and the coefficients.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.storage import bounded_broadcast, materialise

SUMS = ("n", "sx", "sy", "sxx", "sxy")


def power_sums(x: Column, y: Column) -> list[Column]:
    """Aggregates n, sx, sy, sxx, sxy. Pass centred columns where values are large against their spread."""
    return [F.count(x).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy")]


def line(prefix: str = "") -> tuple[Column, Column]:
    """(offset, slope) from power sums."""
    n, sx, sy, sxx, sxy = (F.col(prefix + c) for c in SUMS)
    slope = (sxy - sx * sy / n) / (sxx - sx * sx / n)
    return sy / n - slope * sx / n, slope


def fit_line(df: DataFrame, x: str, y: str, by: list[str] | None = None, variance: str | None = None) -> DataFrame:
    """offset and slope of y on x, of the table or of each group; an error unless target variances are all equal."""
    centre = F.broadcast(df.agg(F.avg(x).alias("__cx"), F.avg(y).alias("__cy")))
    rows = df.crossJoin(centre)  # one row
    same = [] if variance is None else [(F.min(variance) == F.max(variance)).alias("__same")]
    sums = rows.groupBy(*(by or [])).agg(*power_sums(F.col(x) - F.col("__cx"), F.col(y) - F.col("__cy")), F.first("__cx").alias("__cx"), F.first("__cy").alias("__cy"), *same)
    offset, slope = line()
    if variance is not None:
        slope = F.when(F.col("__same"), slope).otherwise(F.raise_error(F.lit("target variances differ")).cast("double"))
    fits = sums.withColumn("__o", offset).withColumn("slope", slope)
    return fits.select(*(by or []), (F.col("__o") + F.col("__cy") - F.col("slope") * F.col("__cx")).alias("offset"), "slope")


def predict_line(rows: DataFrame, fits: DataFrame, x: str, by: list[str] | None = None, name: str = "prediction") -> DataFrame:
    """rows with offset + slope x; fits are one row, or one a group."""
    joined = rows.join(bounded_broadcast(materialise(fits, "fits")), by) if by else rows.crossJoin(F.broadcast(fits))
    return joined.withColumn(name, F.col("offset") + F.col("slope") * F.col(x)).drop("offset", "slope")


def triangle(stack: np.ndarray) -> np.ndarray:
    """R of a QR of stack, with rows added up to a square."""
    r = np.linalg.qr(stack, mode="r") if len(stack) else np.zeros((0, stack.shape[1]))
    return np.vstack([r, np.zeros((max(0, stack.shape[1] - len(r)), stack.shape[1]))])[: stack.shape[1]]


def reduce_triangles(blocks: DataFrame, width: int, fan_in: int = 16) -> np.ndarray:
    """One triangle from a column r of packed width x width triangles: combined in tasks, fan_in to one, until few are left."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, width))
        for batch in batches:
            parts = [np.frombuffer(b, float).reshape(width, width) for b in batch.column("r").to_pylist()]
            total = triangle(np.vstack([total, *parts]))
        if len(total):
            yield pa.RecordBatch.from_pydict({"r": [total.tobytes()]}, schema=pa.schema([("r", pa.binary())]))

    level = materialise(blocks.select("r").mapInArrow(merge, "r binary"), "triangles")
    while (n := level.count()) > fan_in:
        level = materialise(level.repartition(-(-n // fan_in)).mapInArrow(merge, "r binary"), "triangles")
    parts = [np.frombuffer(bytes(r.r), float).reshape(width, width) for r in level.collect()]  # at most fan_in triangles
    return triangle(np.vstack([np.zeros((0, width)), *parts]))


def fit_least_squares(df: DataFrame, design: Callable[[pd.DataFrame], np.ndarray], width: int, target: str, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, R) minimising |y - A x| for the design rows of each batch: TSQR, only triangles leave tasks."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((0, width + 1))
        for pdf in batches:
            if len(pdf):
                total = triangle(np.vstack([total, np.column_stack([design(pdf), pdf[target].to_numpy(float)])]))
        if len(total):
            yield pd.DataFrame({"r": [total.tobytes()]})

    r = reduce_triangles(df.select(target, *columns).mapInPandas(reduce, "r binary"), width + 1)
    a, b = r[:width, :width], r[:width, width]
    return np.linalg.lstsq(a, b, rcond=None)[0], a


def predict_dot(features: Column, coefficients: list[float]) -> Column:
    """Dot product of an array column with fixed coefficients."""
    return F.aggregate(F.zip_with(features, F.array(*map(F.lit, map(float, coefficients))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
