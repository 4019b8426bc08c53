"""Models that follow a stream: running regressions, sparse processes, filters.

Late rows: sums and sparse factors do not depend on order, so they take late rows as they come; a filter needs event time:
``event_time.event_time_filter`` waits for the watermark, ``stream_kalman_filter`` here answers at once and gives what arrives
behind its last step back marked as late. What a stream knows is written with each batch, so a restart goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkreg.functions.kernels import Kernel
from sparkreg.functions.order import spread
from sparkreg.functions.storage import bounded_broadcast, materialise
from sparkreg.functions.versions import Versions
from sparkreg.operators.gp import Mean, arrays, inverse_lower, per_group, zero
from sparkreg.operators.linear import SUMS, line, power_sums
from sparkreg.operators.sparse_gp import SparseFit, fit_sparse_gp
from sparkreg.streaming.scan import scan_filter
from sparkreg.streaming.totals import KeyedTotals


def running_regression(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """offset and slope of each key so far, of a stream (update or complete mode) or a table. Keep x near zero."""
    return _solved(rows.groupBy(*by).agg(*power_sums(F.col(x), F.col(y))), by)


def _solved(sums: DataFrame, by: list[str]) -> DataFrame:
    offset, slope = line()
    return sums.select(*by, "n", offset.alias("offset"), slope.alias("slope"))


class RegressionStream(KeyedTotals):
    """A regression for each key that each micro-batch updates; use ``update`` with foreachBatch. A batch writes the keys that
    it changed only (``KeyedTotals``)."""

    def __init__(self, folder: str, x: str, y: str, by: list[str], compact_every: int = 16) -> None:
        super().__init__(folder, by, list(SUMS), lambda df: df.groupBy(*by).agg(*power_sums(F.col(x), F.col(y))), compact_every)

    def fits(self, spark: SparkSession) -> DataFrame | None:
        """offset and slope of every key so far."""
        sums = self.table(spark)
        return None if sums is None else _solved(sums, self.by)


class SparseStream:
    """A sparse fit that each micro-batch updates; use ``update`` with foreachBatch. A PITC group must come whole.

    The fit is written below ``folder`` with the id of its last batch, one row a batch: a new object with the same folder goes
    on where the last one ended, and a batch that is run again after a failure is not counted twice. The last ``keep`` fits stay.
    """

    def __init__(self, kernel: Kernel, u: np.ndarray, folder: str, group: str | None = None, mean: Mean = zero, keep: int = 2) -> None:
        self.kernel, self.u, self.group, self.mean, self.keep = kernel, u, group, mean, keep
        self.versions = Versions(folder, "batch")

    def _last(self, spark: SparkSession) -> tuple[SparseFit | None, int]:
        """The fit of the last batch whose write has ended."""
        found = self.versions.numbers(spark)
        if not found:
            return None, -1
        row = spark.read.parquet(self.versions.path(found[-1])).first()
        return SparseFit.from_row(row), row["last"]

    def fit(self, spark: SparkSession) -> SparseFit | None:
        return self._last(spark)[0]

    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, last = self._last(spark)
        if batch_id > last:
            fit = fit_sparse_gp(batch, self.kernel, self.u, self.group, self.mean, start=before)
            self.versions.write(fit.table(spark, batch_id), batch_id)
            self.versions.drop(spark, self.versions.numbers(spark)[: -self.keep])


def filter_steps(t: np.ndarray, y: np.ndarray, noise: float, k: Callable[[float], float], x: float = 0.0, p: float | None = None, last: float | None = None, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of a one-state filter after each step of a series (NaN y: an outage, predicted only).

    Over a step d, F = k(d) / k(0) and Q = k(0) - k(d)^2 / k(0). The variance is carried as P + Q, or F P F + Q if exact.
    """
    k0 = k(0.0)
    p = k0 if p is None else p
    means, variances = np.empty(len(t)), np.empty(len(t))
    for i, now in enumerate(t):
        if last is not None:
            f = k(now - last) / k0
            q = k0 - k(now - last) ** 2 / k0
            x, p = f * x, (f * f * p if exact else p) + q
        if not np.isnan(y[i]):
            gain = p / (p + noise)
            x, p = x + gain * (y[i] - x), (1 - gain) * p
        means[i], variances[i], last = x, p, now
    return means, variances


def filter_rows(code: np.ndarray, t: np.ndarray, y: np.ndarray, noise: float, k: Callable[[float], float], x: np.ndarray, p: np.ndarray, last: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``filter_steps`` of many series at once: rows of series ``code``, each series in order. x, p and last (NaN: none yet) have an
    entry a series and are left as they are after its last row."""
    k0, xs, ps, lasts, means, variances = k(0.0), x.tolist(), p.tolist(), last.tolist(), [], []
    for c, now, value in zip(code.tolist(), t.tolist(), y.tolist(), strict=True):
        a, b, before = xs[c], ps[c], lasts[c]
        if before == before:
            known = k(now - before)
            f, q = known / k0, k0 - known**2 / k0
            a, b = f * a, (f * f * b if exact else b) + q
        if value == value:
            gain = b / (b + noise)
            a, b = a + gain * (value - a), (1 - gain) * b
        xs[c], ps[c], lasts[c] = a, b, now
        means.append(a)
        variances.append(b)
    x[:], p[:], last[:] = xs, ps, lasts
    return np.array(means), np.array(variances)


def kalman_filter(rows: DataFrame, k: Callable[[float], float], noise: float, key: str = "key", exact: bool = False, chunk_rows: int = 50_000, long_rows: int = 1_000_000) -> DataFrame:
    """(key, row_id, mean, variance) of every series, in the order of feature. Series of at most long_rows rows are filtered in a
    task each, some five seconds for a million; longer ones by a scan over chunks (``scan.scan_filter``)."""
    rows = rows.select(key, "row_id", "feature", "target")
    long = materialise(rows.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_rows).select("__k"), "long-series")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["feature", "row_id"])
        m, v = filter_steps(pdf["feature"].to_numpy(float), pdf["target"].to_numpy(float), noise, k, exact=exact)
        return pd.DataFrame({key: pdf[key], "row_id": pdf["row_id"], "mean": m, "variance": v})

    schema = f"{key} {dict(rows.dtypes)[key]}, row_id long, mean double, variance double"
    if not long.limit(1).count():
        return spread(rows, key).groupBy(key).applyInPandas(run, schema)
    side, same = bounded_broadcast(long), F.col(key).eqNullSafe(F.col("__k"))
    short = spread(rows.join(side, same, "left_anti"), key).groupBy(key).applyInPandas(run, schema)
    return short.unionByName(scan_filter(rows.join(side, same, "left_semi"), k, noise, key, exact, chunk_rows))


def stream_kalman_filter(rows: DataFrame, k: Callable[[float], float], noise: float, key: str = "key", exact: bool = False) -> DataFrame:
    """The same over a stream: the state of a key is (mean, variance, last time, late rows so far).

    Rows behind the last time come back with ``late`` true and no estimate; n_late counts those of the key so far.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, p, last, n_late = state.get if state.exists else (0.0, k(0.0), None, 0)
        pdf = pd.concat(list(batches)).sort_values(["feature", "row_id"])
        late = pdf[pdf["feature"] < last] if last is not None else pdf[:0]
        pdf, n_late = pdf.drop(late.index) if len(late) else pdf, n_late + len(late)
        m, v = filter_steps(pdf["feature"].to_numpy(float), pdf["target"].to_numpy(float), noise, k, x, p, last, exact)
        if len(pdf):
            x, p, last = float(m[-1]), float(v[-1]), float(pdf["feature"].iloc[-1])
        state.update((x, p, last, n_late))
        if len(pdf):
            yield pd.DataFrame({key: group[0], "row_id": pdf["row_id"], "mean": m, "variance": v, "late": False, "n_late": n_late})
        if len(late):
            yield pd.DataFrame({key: group[0], "row_id": late["row_id"], "mean": np.nan, "variance": np.nan, "late": True, "n_late": n_late})

    schema = f"{key} {dict(rows.dtypes)[key]}, row_id long, mean double, variance double, late boolean, n_late long"
    return rows.select(key, "row_id", "feature", "target").groupBy(key).applyInPandasWithState(run, schema, "x double, p double, last double, late long", "append", GroupStateTimeout.NoTimeout)


def grow(kernel: Kernel, x: np.ndarray, y: np.ndarray, variance: np.ndarray, mean: Mean = zero) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance at each row given the rows up to it.

    The leading blocks of the inverse factor of all rows are those of the rows up to each, so one factorisation does, and what a
    row sees is a column of the upper triangle of its product with the covariances. Rows that are not finite, or nearly leave no
    variance of their own, are taken step by step.
    """
    residual, k = y - mean(x), kernel.measured(x, x) + np.diag(variance)
    if np.isfinite(k).all() and np.isfinite(residual).all():
        try:
            low = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            return grow_by_row(kernel, x, y, variance, mean)
        if (np.diag(low) ** 2 > 1e-9 * np.diag(k)).all():
            root = inverse_lower(low)
            half = np.triu(root @ kernel.matrix(x, x))
            return mean(x) + (root @ residual) @ half, kernel.diagonal(x) - (half**2).sum(0)
    return grow_by_row(kernel, x, y, variance, mean)


def grow_by_row(kernel: Kernel, x: np.ndarray, y: np.ndarray, variance: np.ndarray, mean: Mean = zero) -> tuple[np.ndarray, np.ndarray]:
    """The same; the inverse factor grows by a row in place: two products with it a step."""
    n, residual = len(x), y - mean(x)
    root, w, means, variances = np.zeros((n, n)), np.zeros(n), np.empty(n), np.empty(n)
    prior = kernel.diagonal(x)
    for i in range(n):
        now, upto = slice(i, i + 1), slice(0, i + 1)
        old = root[:i, :i]
        b = old @ kernel.measured(x[:i], x[now])[:, 0]
        own = kernel.measured(x[now], x[now])[0, 0] + variance[i]
        corner = 1 / np.sqrt(max(own - b @ b, 1e-12 * own))
        root[i, :i], root[i, i] = -corner * (b @ old), corner
        w[i] = corner * (residual[i] - b @ w[:i])
        half = root[upto, upto] @ kernel.matrix(x[upto], x[now])[:, 0]
        means[i], variances[i] = half @ w[upto], prior[i] - half @ half
    return means + mean(x), variances


def iterative_gp(rows: DataFrame, kernel: Kernel, key: str = "key", mean: Mean = zero, max_rows: int = 2000) -> DataFrame:
    """(key, row_id, mean, variance): the estimate at each row from the rows up to it (``grow``)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, v = grow(kernel, *arrays(pdf), mean)
        return pd.DataFrame({key: pdf[key], "row_id": pdf["row_id"], "mean": m, "variance": v})

    return per_group(rows.select(key, "row_id", "feature", "target", "target_variance"), run, f"{key} {dict(rows.dtypes)[key]}, row_id long, mean double, variance double", key, max_rows)
