"""Sparse Gaussian processes (FITC / PITC) by map and reduce.

Given m inducing points u, groups of rows are independent. Each group contributes the triangle of [L^-1 K_fu | L^-1 (y - mean)]
with L the Cholesky factor of its own block K_ff + D - Q_ff; triangles add up by QR, so only (m+1) x (m+1) matrices are
shuffled, in any order. A fit is the reduced triangle that starts from the root of K_uu; an update starts from the fit's.

A fit is an object of the driver (one process over a table), or a row of a table of fits (a process a key). A task folds all
its rows into one triangle a key before anything is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkreg.functions.kernels import Kernel
from sparkreg.functions.order import spread
from sparkreg.functions.storage import is_small, materialise
from sparkreg.functions.typed import features
from sparkreg.operators.gp import HELD_ROWS, MAX_ROWS, Mean, by_key, cholesky, inverse_lower, joint_rows, meet, whole_groups, with_fits, zero
from sparkreg.operators.linear import reduce_triangles, triangle


@dataclass
class SparseFit:
    """u: inducing points; low: Cholesky of K_uu; r: reduced triangle [R | R v] with m + 1 columns; sums for the likelihood."""

    u: np.ndarray
    low: np.ndarray
    r: np.ndarray
    log_det_a: float = 0.0
    squares: float = 0.0
    rows: int = 0

    @classmethod
    def prior(cls, kernel: Kernel, u: np.ndarray, nugget: float = 1e-8) -> SparseFit:
        """The fit to no rows."""
        u = np.asarray(u, float)
        low, m = cholesky(kernel.matrix(u, u) + nugget * np.eye(len(u))), len(u)
        r = np.zeros((m + 1, m + 1))
        r[:m, :m] = low.T
        return cls(u, low, r)

    def plus(self, r: np.ndarray, log_det: float, squares: float, n: int) -> SparseFit:
        """With the triangle of more rows. What the points leave unexplained (the last row) is not carried on."""
        return SparseFit(self.u, self.low, triangle(np.vstack([self.r[:-1], r])), self.log_det_a + log_det, self.squares + squares, int(self.rows + n))

    def minus(self, r: np.ndarray, log_det: float, squares: float, n: int) -> SparseFit:
        """Without the rows of that triangle: R'R - T'T = R' (I - S'S) R with S = T R^-1, whose middle has a root."""
        root, z = self.root, self.r[:-1, -1]
        s = np.linalg.solve(root.T, r[:, :-1].T).T
        middle = np.eye(len(root)) - s.T @ s
        values, vectors = np.linalg.eigh((middle + middle.T) / 2)
        scale = np.sqrt(np.maximum(values, 1e-15))
        out = np.zeros_like(self.r)
        out[:-1, :-1] = (vectors * scale).T @ root
        out[:-1, -1] = (vectors.T @ (z - s.T @ r[:, -1])) / scale
        out[:-1] = np.linalg.qr(out[:-1], mode="r")
        return SparseFit(self.u, self.low, out, self.log_det_a - log_det, self.squares - squares, int(self.rows - n))

    def packed(self) -> dict:
        u = np.asarray(self.u, float)
        return {"m": len(u), "d": 0 if u.ndim == 1 else u.shape[1], "u": u.tobytes(), "low": self.low.tobytes(), "r": np.ascontiguousarray(self.r).tobytes(), "log_det_a": float(self.log_det_a), "squares": float(self.squares), "n": int(self.rows)}

    @property
    def root(self) -> np.ndarray:
        return self.r[:-1, :-1]

    @cached_property
    def prior_root(self) -> np.ndarray:
        return inverse_lower(self.low)

    @cached_property
    def post_root(self) -> np.ndarray:
        """The inverse of the transposed root."""
        return np.linalg.inv(self.root.T)

    @cached_property
    def v(self) -> np.ndarray:
        return np.linalg.lstsq(self.root, self.r[:-1, -1], rcond=None)[0]

    def mean(self, kernel: Kernel, x: np.ndarray, mean: Mean = zero) -> np.ndarray:
        return kernel.matrix(x, self.u) @ self.v + mean(x)

    def joint(self, kernel: Kernel, x: np.ndarray, mean: Mean = zero, measured: bool = False) -> tuple[np.ndarray, np.ndarray]:
        cross = kernel.matrix(x, self.u)
        q, s = self.prior_root @ cross.T, self.post_root @ cross.T
        return cross @ self.v + mean(x), kernel.between(x, x, measured, measured) - q.T @ q + s.T @ s

    def marginal(self, kernel: Kernel, x: np.ndarray, mean: Mean = zero, measured: bool = False) -> tuple[np.ndarray, np.ndarray]:
        cross = kernel.matrix(x, self.u)
        q, s = self.prior_root @ cross.T, self.post_root @ cross.T
        return cross @ self.v + mean(x), kernel.diagonal(x, measured) - (q**2).sum(0) + (s**2).sum(0)

    def log_likelihood(self) -> float:
        """log|K| = log|A| + 2 log|R| - log|K_uu|; the quadratic form is b'b less what the triangle explains."""
        log_det = self.log_det_a + 2 * np.log(np.abs(np.diag(self.root))).sum() - 2 * np.log(np.diag(self.low)).sum()
        explained = float((self.r[:-1, -1] ** 2).sum())
        return float(-0.5 * (self.squares - explained) - 0.5 * log_det - 0.5 * self.rows * np.log(2 * np.pi))

    def table(self, spark: SparkSession, batch: int = -1) -> DataFrame:
        """The fit as one row, to be written; batch: the last micro-batch that it holds."""
        return spark.createDataFrame([(batch, *self.packed().values())], "last long, m int, d int, u binary, low binary, r binary, log_det_a double, squares double, n long")

    @classmethod
    def from_row(cls, row) -> SparseFit:
        u = np.frombuffer(row["u"])
        values = (np.frombuffer(row[c]).reshape(-1, row["m"] + extra) for c, extra in (("low", 0), ("r", 1)))
        return cls(u.reshape(row["m"], row["d"]) if row["d"] else u, *values, row["log_det_a"], row["squares"], row["n"])

    def rebase(self, kernel: Kernel, u: np.ndarray, nugget: float = 1e-8) -> SparseFit:
        """The fit on new inducing points: its joint prediction there, taken as a fit (lossy)."""
        mean, cov = self.joint(kernel, u)
        low = cholesky(kernel.matrix(u, u) + nugget * np.eye(len(u)))
        root = inverse_lower(low)
        inverse = root.T @ root
        information = inverse @ mean
        # R'R with (R'R)^-1 = K^-1 cov K^-1, so that variances at u come out as cov
        precision = np.linalg.inv(inverse @ (cov + nugget * np.eye(len(u))) @ inverse)
        root = np.linalg.cholesky((precision + precision.T) / 2).T
        r = np.zeros((len(u) + 1, len(u) + 1))
        r[:-1, :-1], r[:-1, -1] = root, root @ information
        return SparseFit(u, low, r, self.log_det_a, self.squares, self.rows)


BLOCKS = "r binary, log_det double, squares double, n long"
_FLUSH_BYTES = 64 << 20  # of triangles that a task holds


def _block(kernel: Kernel, u: np.ndarray, prior_root: np.ndarray, pdf: pd.DataFrame, mean: Mean, nugget: float, group: str | None = None, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float, float]:
    """(rows [L^-1 K_fu | L^-1 (y - mean)], log determinant, sum of squares); the rows of a group depend on each other (None:
    each is alone)."""
    x = features(pdf["feature"])
    codes = None if group is None else pd.factorize(pdf[group], use_na_sentinel=False)[0]
    if codes is not None and np.any(np.diff(codes) < 0):  # groups one after the other
        order = np.argsort(codes, kind="stable")
        x, pdf, codes = x[order], pdf.iloc[order], codes[order]
    cross = kernel.matrix(x, u)
    half = prior_root @ cross.T
    noise = pdf["target_variance"].to_numpy(float) + nugget
    out = np.column_stack([cross, pdf["target"].to_numpy(float) - mean(x)])
    if codes is None:
        root = np.sqrt(kernel.diagonal(x, measured=True) + noise - (half**2).sum(0))
        out, log_det = out / root[:, None], 2 * np.log(root).sum()
        return out, float(log_det), float(out[:, -1] @ out[:, -1])
    log_det, squares, parts, ends = 0.0, 0.0, [out[:0]], np.append(np.flatnonzero(np.diff(codes)) + 1, len(codes))
    for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        own, part = x[lo:hi], half[:, lo:hi]
        found = _large_group(kernel, own, part, out[lo:hi], noise[lo:hi]) if hi - lo > _DENSE_ROWS else None
        if found is None:
            if hi - lo > max_rows:
                raise ValueError(f"group {pdf[group].iloc[lo]} has {hi - lo} rows; at most {max_rows} depend on each other")
            k = kernel.measured(own, own) - part.T @ part
            k.flat[:: hi - lo + 1] += noise[lo:hi]
            a = cholesky(k)
            rows = inverse_lower(a) @ out[lo:hi]
            found = rows, 2 * np.log(np.diag(a)).sum(), rows[:, -1] @ rows[:, -1]
        parts.append(found[0])
        log_det, squares = log_det + found[1], squares + found[2]
    return np.vstack(parts), float(log_det), float(squares)


_DENSE_ROWS = 1_000  # of a group that is factored as a whole in any case
_MAX_RANK = 1_500


def _large_group(kernel: Kernel, x: np.ndarray, half: np.ndarray, b: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """(triangle, log determinant, sum of squares) of a group of many rows, without its covariance, in memory that is linear in
    the rows. Rows of equal features become one, their weighted mean; what the points leave unexplained of the process is G G' by
    a pivoted Cholesky factorisation, to 1e-12 of the noise, and triangle'triangle = b' (G G' + D)^-1 b by one QR.

    None where the covariance has no such form: features of several kinds, noise that is not a row's own, no low rank.
    """
    if not isinstance(x, np.ndarray):
        return None
    _, first, at = np.unique(x, axis=0, return_index=True, return_inverse=True)
    at, x, half = at.reshape(-1), x[first], half[:, first]
    weight = np.bincount(at, 1 / noise)
    y = np.bincount(at, b[:, -1] / noise) / weight
    log_det, squares = np.log(noise).sum() + np.log(weight).sum(), (((b[:, -1] - y[at]) ** 2) / noise).sum()
    prior = kernel.diagonal(x)
    d = prior - (half**2).sum(0)
    own = kernel.diagonal(x, measured=True) - prior + 1 / weight
    if own.min() <= 0 or not all(_own_noise(kernel, x[lo : lo + 64], np.arange(len(x[lo : lo + 64])), x[lo : lo + 64]) for lo in range(0, len(x), 32)):
        return None
    tolerance, g, most = max(1e-12 * own.min(), 64 * np.finfo(float).eps * prior.max()), np.empty((len(x), 16)), max(min(_MAX_RANK, len(x) // 4), min(_DENSE_ROWS, len(x)))
    k, pivots = 0, []
    while d.max() > tolerance:
        if k == most:
            return None
        if k == g.shape[1]:
            g = np.hstack([g, np.empty_like(g)])
        p = int(d.argmax())
        g[:, k] = (kernel.matrix(x, x[[p]])[:, 0] - half.T @ half[:, p] - g[:, :k] @ g[p, :k]) / np.sqrt(d[p])
        d -= g[:, k] ** 2
        d[p], k = 0.0, k + 1
        pivots.append(p)
    if not _own_noise(kernel, x, np.array(pivots, int), x[pivots]):
        return None
    spread_, g = np.sqrt(own + np.maximum(d, 0)), g[:, :k]
    stack = np.zeros((len(x) + k, k + b.shape[1]))
    stack[: len(x)] = np.column_stack([g, b[first, :-1], y]) / spread_[:, None]
    stack[len(x) :, :k] = np.eye(k)
    r = np.linalg.qr(stack, mode="r")
    log_det += 2 * np.log(spread_).sum() + 2 * np.log(np.abs(np.diag(r)[:k])).sum()
    rows = np.vstack([r[k:, k:], np.zeros(b.shape[1])])
    rows[-1, -1] = np.sqrt(squares)  # of rows of equal features around their mean
    return rows, log_det, rows[:, -1] @ rows[:, -1]


def _own_noise(kernel: Kernel, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> bool:
    """Whether measurements of x and y, which are the features x[at], share no more than the process does but with themselves."""
    extra = kernel.measured(x, y) - kernel.matrix(x, y)
    extra[at, np.arange(len(at))] = 0
    return not extra.any()


class _Total:
    """The blocks of one key so far: rows wait until there are a few times as many as columns."""

    def __init__(self) -> None:
        self.waiting: list[np.ndarray] = []
        self.held = self.n = 0
        self.log_det = self.squares = 0.0

    def add(self, block: tuple[np.ndarray, float, float], n: int) -> None:
        self.waiting.append(block[0])
        self.held += len(block[0])
        self.log_det, self.squares, self.n = self.log_det + block[1], self.squares + block[2], self.n + n
        if self.held > 4 * block[0].shape[1]:
            self.reduce()

    def reduce(self) -> np.ndarray:
        self.waiting = [triangle(np.vstack(self.waiting))]
        self.held = len(self.waiting[0])
        return self.waiting[0]


Points = Callable[[object], tuple[np.ndarray, np.ndarray] | None]  # a key's inducing points and the inverse root of their prior


def _folder(kernel: Kernel, mean: Mean, nugget: float, keys: list[str], group: str | None, max_rows: int) -> Callable[[Points, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Folds the rows of a task into one triangle for each of its keys (none: one in all)."""

    def run(points: Points, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({**{k: list(totals) for k in keys}, "r": [t.reduce().tobytes() for t in totals.values()], "log_det": [t.log_det for t in totals.values()], "squares": [t.squares for t in totals.values()], "n": [t.n for t in totals.values()]})
            totals.clear()
            return out

        for pdf in whole_groups(batches, [*keys, group], max(max_rows, HELD_ROWS)) if group else batches:
            for name, own in pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]:
                k = _plain(name[0]) if keys else None
                if len(own) and (at := points(k)) is not None:
                    totals.setdefault(k, _Total()).add(_block(kernel, *at, own, mean, nugget, group, max_rows), len(own))
            if sum(t.held * t.waiting[0].shape[1] * 8 for t in totals.values()) > _FLUSH_BYTES:
                yield flush()
        if totals:
            yield flush()

    return run


def _plain(value):
    return None if value is None or value != value else value


def _needed(df: DataFrame, *names: str | None) -> DataFrame:
    return df.select(*dict.fromkeys(n for n in names if n), "feature", "target", "target_variance")


def fit_sparse_gp(
    df: DataFrame, kernel: Kernel, u: np.ndarray, group: str | None = None, mean: Mean = zero, *, nugget: float = 1e-12, inducing_nugget: float = 1e-8, start: SparseFit | None = None, max_rows: int = MAX_ROWS,
) -> SparseFit:
    """Fit rows (feature, target, target_variance); group None: every row by itself (FITC), which needs no shuffle.

    A task gives back one triangle, whatever its rows; groups are sorted together and folded as they stream by.
    start: a fit to update with these rows, on its own inducing points.
    """
    start = start or SparseFit.prior(kernel, u, inducing_nugget)
    at, m = (start.u, start.prior_root), len(start.u)
    run = _folder(kernel, mean, nugget, [], group, max_rows)
    rows = _needed(df, group)
    if group:
        rows = spread(rows, group).sortWithinPartitions(group)
    blocks = materialise(rows.mapInPandas(lambda batches: run(lambda _: at, batches), BLOCKS), "sparse-blocks")
    return start.plus(*_reduced(blocks, m + 1))


def _reduced(blocks: DataFrame, width: int, few: int = 16) -> tuple[np.ndarray, float, float, int]:
    """(triangle, log determinant, sum of squares, rows) of all of a materialised table of blocks."""
    found = blocks.select("r", "log_det", "squares", "n").limit(few + 1).collect()
    if len(found) <= few:
        parts = [np.frombuffer(bytes(b.r)).reshape(width, width) for b in found]
        return triangle(np.vstack([np.zeros((0, width)), *parts])), sum(b.log_det for b in found), sum(b.squares for b in found), sum(b.n for b in found)
    sums = blocks.agg(F.sum("log_det").alias("d"), F.sum("squares").alias("s"), F.sum("n").alias("n")).first()
    return reduce_triangles(blocks, width), sums.d, sums.s, sums.n


# ---- one fit a key


def fits_schema(key: str, kind: str) -> str:
    return f"{key} {kind}, m int, d int, u binary, low binary, r binary, log_det_a double, squares double, n long"


def prior_fits(points: DataFrame, kernel: Kernel, key: str = "key", inducing_nugget: float = 1e-8) -> DataFrame:
    """Fits without rows, from inducing points (key, u): u an array of numbers, or of arrays of numbers."""

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [SparseFit.prior(kernel, _points_of(u), inducing_nugget).packed() for u in pdf["u"]]
            if made:
                yield pd.DataFrame(made).assign(**{key: pdf[key].to_numpy()})[[key, *made[0]]]

    return points.select(key, "u").mapInPandas(start, fits_schema(key, dict(points.dtypes)[key]))


def _points_of(u) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in u]) if len(u) and not np.isscalar(u[0]) else np.asarray(u, float)


def update_sparse_gps(fits: DataFrame, df: DataFrame, kernel: Kernel, key: str = "key", group: str | None = None, mean: Mean = zero, *, nugget: float = 1e-12, max_rows: int = MAX_ROWS, part_rows: int = 100_000) -> DataFrame:
    """Fits of every key with the rows of df added; keys without rows keep theirs, rows of keys without a fit are left out.

    Fits that are small together go to the rows: a task folds its rows into one triangle a key (FITC: many keys without a hot
    one are dealt out first, else rows stay where they are; groups are sorted by key and group). Else fits and rows meet by key, large keys in parts. A key's triangles are merged 16 to 1.
    """
    kind, fits = dict(df.dtypes)[key], materialise(fits, "sparse-fits")
    blocks = materialise(_key_blocks(fits, df, kernel, key, group, mean, nugget, max_rows, part_rows), "sparse-blocks")
    blocks = merged_by_key(blocks, key)

    def add(old: dict | None, new: pd.DataFrame) -> pd.DataFrame | None:
        if old is None or not len(new):
            return None if old is None else pd.DataFrame([old])
        fit, row = SparseFit.from_row(old), new.iloc[0]
        width = len(fit.u) + 1
        return pd.DataFrame([{key: old[key], **fit.plus(np.frombuffer(row["r"]).reshape(width, width), row["log_det"], row["squares"], row["n"]).packed()}])

    return by_key(fits, blocks, add, fits_schema(key, kind), [key])


def _key_blocks(fits: DataFrame, df: DataFrame, kernel: Kernel, key: str, group: str | None, mean: Mean, nugget: float, max_rows: int, part_rows: int) -> DataFrame:
    run, kind = _folder(kernel, mean, nugget, [key], group, max_rows), dict(df.dtypes)[key]
    schema = f"{key} {kind}, {BLOCKS}"
    if is_small(fits):
        rows = _needed(df, key, group)
        if group:
            rows = spread(rows, key, group).sortWithinPartitions(key, group)
        else:
            sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c")).first()
            if sizes.n > 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) and sizes.c <= part_rows:
                rows = spread(rows, key)  # a narrow table may lie in a task or two; few or hot keys would not be dealt out evenly
        sent = df.sparkSession.sparkContext.broadcast(fits.select(key, "m", "d", "u", "low").toArrow())

        def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = _HeldPoints(sent.value, key)
            yield from run(held.get, batches)

        return rows.mapInPandas(folded, schema)
    single = _folder(kernel, mean, nugget, [], group, max_rows)

    def own(fit: SparseFit, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(group) if group else part
        return pd.concat(list(single(lambda _: (fit.u, fit.prior_root), iter([part])))).assign(**{key: part[key].iloc[0]})[[key, "r", "log_det", "squares", "n"]]

    rows = df.select(*dict.fromkeys(n for n in (key, group, "row_id", "feature", "target", "target_variance") if n))
    return with_fits(fits, rows, own, schema, key, part_rows, group, SparseFit.from_row)


class _HeldPoints:
    """Inducing points and inverse prior roots of the keys that a task has met."""

    def __init__(self, table, key: str) -> None:
        self.table, self.at, self.kept = table, {k: i for i, k in enumerate(table.column(key).to_pylist())}, {}

    def get(self, key) -> tuple[np.ndarray, np.ndarray] | None:
        if key not in self.at:
            return None
        if key not in self.kept:
            row = {c: self.table.column(c)[self.at[key]].as_py() for c in ("m", "d", "u", "low")}
            u = np.frombuffer(row["u"])
            self.kept[key] = (u.reshape(row["m"], row["d"]) if row["d"] else u, inverse_lower(np.frombuffer(row["low"]).reshape(row["m"], -1)))
        return self.kept[key]


def merged_by_key(blocks: DataFrame, key: str, fan_in: int = 16) -> DataFrame:
    """One block a key from a materialised table of blocks: fan_in to one, until every key has one."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(round((len(pdf["r"].iloc[0]) // 8) ** 0.5))
        r = triangle(np.vstack([np.frombuffer(b).reshape(width, width) for b in pdf["r"]]))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "r": [r.tobytes()], "log_det": [pdf["log_det"].sum()], "squares": [pdf["squares"].sum()], "n": [pdf["n"].sum()]})

    schema = f"{key} {dict(blocks.dtypes)[key]}, {BLOCKS}"
    while (blocks.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c")).first().c or 0) > 1:
        numbered = blocks.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.monotonically_increasing_id())))  # a block a task and key
        level = numbered.withColumn("__k", F.expr(f"(__k - 1) div {fan_in}"))
        blocks = materialise(spread(level, key, "__k").groupBy(key, "__k").applyInPandas(merge, schema), "sparse-blocks")
    return blocks


def predict_sparse_gps(fits: DataFrame, rows: DataFrame, kernel: Kernel, key: str = "key", mean: Mean = zero, measured: bool = False, part_rows: int = 100_000) -> DataFrame:
    """(key, row_id, mean, variance) of rows by the sparse fit of their key; rows without a fit are left out."""

    def marginal(fit: SparseFit, part: pd.DataFrame) -> pd.DataFrame:
        m, v = fit.marginal(kernel, features(part["feature"]), mean, measured)
        return pd.DataFrame({key: part[key], "row_id": part["row_id"], "mean": m, "variance": v})

    rows = rows.select(key, "row_id", "feature")
    return meet(fits, rows, marginal, f"{key} {dict(rows.dtypes)[key]}, row_id long, mean double, variance double", key, part_rows, SparseFit.from_row)


def rebase_sparse_gps(fits: DataFrame, points: DataFrame, kernel: Kernel, key: str = "key", nugget: float = 1e-8) -> DataFrame:
    """Fits on new inducing points (key, u) of their keys; keys without new points keep their fit."""

    def move(old: dict | None, new: pd.DataFrame) -> pd.DataFrame | None:
        if old is None or not len(new):
            return None if old is None else pd.DataFrame([old])
        return pd.DataFrame([{key: old[key], **SparseFit.from_row(old).rebase(kernel, _points_of(new["u"].iloc[0]), nugget).packed()}])

    return by_key(materialise(fits, "sparse-fits"), points.select(key, "u"), move, fits_schema(key, dict(fits.dtypes)[key]), [key])


# ---- leave-one-group-out


def fold_fits(df: DataFrame, kernel: Kernel, u: np.ndarray, fold: str, group: str | None = None, mean: Mean = zero, *, nugget: float = 1e-12, inducing_nugget: float = 1e-8, max_rows: int = MAX_ROWS) -> tuple[SparseFit, DataFrame]:
    """(fit to all rows, fits without each fold by fold). Rows are read once: a fold is one triangle, by which the factor of all
    rows is downdated. A group lies within one fold; a null fold is a fold."""
    spark, kind = df.sparkSession, dict(df.dtypes)[fold]
    start = SparseFit.prior(kernel, u, inducing_nugget)
    run, at = _folder(kernel, mean, nugget, [fold], group, max_rows), (start.u, start.prior_root)
    rows = _needed(df, fold, group)
    if group:
        rows = spread(rows, fold, group).sortWithinPartitions(fold, group)
    blocks = merged_by_key(materialise(rows.mapInPandas(lambda batches: run(lambda _: at, batches), f"{fold} {kind}, {BLOCKS}"), "fold-blocks"), fold)
    whole = start.plus(*_reduced(blocks, len(start.u) + 1))
    sent = spark.sparkContext.broadcast(whole)

    def leave_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = sent.value
        width = len(full.u) + 1
        for pdf in batches:
            made = [full.minus(np.frombuffer(r["r"]).reshape(width, width), r["log_det"], r["squares"], r["n"]).packed() for r in pdf.to_dict("records")]
            if made:
                yield pd.DataFrame(made).assign(**{fold: pdf[fold].to_numpy()})[[fold, *made[0]]]

    return whole, materialise(blocks.mapInPandas(leave_out, fits_schema(fold, kind)), "fold-fits")


def logo_sparse_gp(df: DataFrame, kernel: Kernel, u: np.ndarray, fold: str, group: str | None = None, mean: Mean = zero, measured: bool = False, **settings) -> DataFrame:
    """(fold, row_id, mean, variance): each fold as all others predict it."""
    return predict_sparse_gps(fold_fits(df, kernel, u, fold, group, mean, **settings)[1], df, kernel, fold, mean, measured)


def logo_sparse_gp_joint(df: DataFrame, kernel: Kernel, u: np.ndarray, fold: str, group: str | None = None, mean: Mean = zero, measured: bool = False, max_rows: int = MAX_ROWS, **settings) -> DataFrame:
    """(fold, i, j, mean, cov): the joint prediction of each fold by all others, i and j being row_ids.

    Without groups the fit to all rows is sent, and a fold is left out in closed form from its own rows, however many folds there
    are (``_left_out``). With groups a fold is one triangle, as in ``fold_fits``.
    """
    kind = dict(df.dtypes)[fold]
    schema = f"{fold} {kind}, i long, j long, mean double, cov double"

    def guard(name, n: int) -> None:
        if n > max_rows:
            raise ValueError(f"fold {name} has {n} rows; at most {max_rows} are predicted together")

    def joint(fit: SparseFit, own: pd.DataFrame) -> pd.DataFrame:
        guard(own[fold].iloc[0], len(own))
        return joint_rows({fold: own[fold].iloc[0]}, own["row_id"].to_numpy(), *fit.joint(kernel, features(own["feature"]), mean, measured))

    if group:
        fits = fold_fits(df, kernel, u, fold, group, mean, max_rows=max_rows, **settings)[1]
        return with_fits(fits, df.select(fold, "row_id", "feature"), joint, schema, fold, 10**9, None, SparseFit.from_row)
    nugget = settings.get("nugget", 1e-12)
    sent = df.sparkSession.sparkContext.broadcast(fit_sparse_gp(df, kernel, u, None, mean, **settings))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = sent.value
        for pdf, at in _equal_blocks(batches, fold, max_rows, "fold", "are predicted together"):
            yield _left_out(full, kernel, pdf, at, fold, mean, measured, nugget)

    rows = spread(df.select(fold, "row_id", "feature", "target", "target_variance"), fold).sortWithinPartitions(fold, "row_id")
    return rows.mapInPandas(run, schema)


def _left_out(full: SparseFit, kernel: Kernel, pdf: pd.DataFrame, at: np.ndarray, fold: str, mean: Mean, measured: bool, nugget: float) -> pd.DataFrame:
    """Joint predictions, in long form, of folds of n rows (at: a row a fold) by the fit without them.

    With A = D^-1 K_fu and b = D^-1 (y - mean) the rows of a fold, S = A R^-1, and C = I - S S': the fit without them has
    R'R - A'A, hence mean + D C^-1 (S z - (I - C) b) and K_ff - Q_ff + D C^-1 (I - C) D. A fold of more rows than there are points
    is a triangle first, whose factor is downdated.
    """
    own = pdf.iloc[at.reshape(-1)]
    (c, n), x = at.shape, features(own["feature"])
    if n > len(full.u):
        parts = []
        for k in range(c):
            part = own.iloc[k * n : k * n + n]
            block = _block(kernel, full.u, full.prior_root, part, mean, nugget)
            without, xs = full.minus(triangle(block[0]), block[1], block[2], n), x[k * n : k * n + n]
            parts.append(joint_rows({fold: part[fold].iloc[0]}, part["row_id"].to_numpy(), *without.joint(kernel, xs, mean, measured)))
        return pd.concat(parts)
    cross, prior = kernel.matrix(x, full.u), mean(x)
    half = full.prior_root @ cross.T
    spread_ = np.sqrt(kernel.diagonal(x, measured=True) + own["target_variance"].to_numpy(float) + nugget - (half**2).sum(0))
    s = (full.post_root @ (cross / spread_[:, None]).T).T.reshape(c, n, -1)
    b, d = ((own["target"].to_numpy(float) - prior) / spread_).reshape(c, n), spread_.reshape(c, n)
    shared = s @ s.transpose(0, 2, 1)
    h = s @ full.r[:-1, -1] - (shared @ b[:, :, None])[:, :, 0]
    solved = np.linalg.solve(np.eye(n) - shared, np.concatenate([h[:, :, None], shared], 2))
    means = prior.reshape(c, n) + d * solved[:, :, 0]
    part = half.T.reshape(c, n, -1)
    covs = _own_blocks(kernel, x, c, n, measured) - part @ part.transpose(0, 2, 1) + d[:, :, None] * solved[:, :, 1:] * d[:, None, :]
    return _joint_blocks(fold, own, n, means, covs)


def predict_sparse_gp(rows: DataFrame, kernel: Kernel, fit: SparseFit, mean: Mean = zero) -> DataFrame:
    """(row_id, mean, variance): map-only, with the fit sent to every task."""

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m, v = fit.marginal(kernel, features(pdf["feature"]), mean)
            yield pd.DataFrame({"row_id": pdf["row_id"], "mean": m, "variance": v})

    return rows.select("row_id", "feature").mapInPandas(predict, "row_id long, mean double, variance double")


def predict_sparse_gp_joint(rows: DataFrame, kernel: Kernel, fit: SparseFit, block: str, mean: Mean = zero, max_rows: int = MAX_ROWS) -> DataFrame:
    """(block, i, j, mean, cov): joint predictions of the rows of each block, i and j being row_ids. The blocks of a batch that have
    as many rows are predicted together: most blocks are small, and a call for each would cost more than its numbers."""
    sent = rows.sparkSession.sparkContext.broadcast(fit)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = sent.value
        for pdf, at in _equal_blocks(batches, block, max_rows, "block", "are predicted together"):
            (c, n), own = at.shape, pdf.iloc[at.reshape(-1)]
            x = features(own["feature"])
            cross = kernel.matrix(x, full.u)
            q, s = ((root @ cross.T).T.reshape(c, n, -1) for root in (full.prior_root, full.post_root))
            covs = _own_blocks(kernel, x, c, n) - q @ q.transpose(0, 2, 1) + s @ s.transpose(0, 2, 1)
            yield _joint_blocks(block, own, n, cross @ full.v + mean(x), covs)

    rows = spread(rows.select(block, "row_id", "feature"), block).sortWithinPartitions(block, "row_id")
    return rows.mapInPandas(predict, f"{block} {dict(rows.dtypes)[block]}, i long, j long, mean double, cov double")


_JOINT_CELLS = 1_000_000  # of covariances that are made at a time


def _equal_blocks(batches: Iterator[pd.DataFrame], name: str, max_rows: int, what: str, why: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, positions of whole blocks of n rows, a row a block) of rows sorted by block, for every n."""
    for pdf in whole_groups(batches, [name], max(max_rows, HELD_ROWS)):
        codes = pd.factorize(pdf[name], use_na_sentinel=False)[0]
        begins = np.append(0, np.flatnonzero(np.diff(codes)) + 1)
        sizes = np.diff(np.append(begins, len(pdf)))
        if sizes.max() > max_rows:
            raise ValueError(f"{what} {pdf[name].iloc[begins[sizes.argmax()]]} has {sizes.max()} rows; at most {max_rows} {why}")
        for n in np.unique(sizes).tolist():
            at = begins[sizes == n][:, None] + np.arange(n)
            step = max(1, _JOINT_CELLS // (n * n))
            for lo in range(0, len(at), step):
                yield pdf, at[lo : lo + step]


def _own_blocks(kernel: Kernel, x, c: int, n: int, measured: bool = False, rows: int = 64) -> np.ndarray:
    """The covariances within each of c blocks of n rows: those of small blocks are cut out of matrices of several blocks."""
    if n == 1:
        return kernel.diagonal(x, measured).reshape(c, 1, 1)
    out, few = np.empty((c, n, n)), max(1, rows // n)
    for lo in range(0, c, few):
        hi = min(lo + few, c)
        part, k = x[lo * n : hi * n], np.arange(hi - lo)
        out[lo:hi] = kernel.between(part, part, measured, measured).reshape(hi - lo, n, hi - lo, n)[k, :, k]
    return out


def _joint_blocks(name: str, own: pd.DataFrame, n: int, means: np.ndarray, covs: np.ndarray) -> pd.DataFrame:
    """Long form of the joint distributions of blocks of n rows."""
    ids = own["row_id"].to_numpy().reshape(-1, n)
    return pd.DataFrame({name: np.repeat(own[name].to_numpy()[::n], n * n), "i": np.broadcast_to(ids[:, :, None], covs.shape).reshape(-1), "j": np.broadcast_to(ids[:, None, :], covs.shape).reshape(-1), "mean": np.repeat(means.reshape(-1), n), "cov": covs.reshape(-1)})
