"""Gaussian processes, one for each key: exact fits of groups whose rows fit a task.

A fit is a row (key, n, d, x, root, information, whitened, ...): training features (d numbers each, 0 for scalars), the inverse
of the Cholesky factor of K + variances (its lower triangle, row by row), the information vector K^-1 (y - mean) and the factor
times the residuals. The factor is inverted once, so that every later solve is a product. Larger groups than max_rows are an
error that names the key; the sparse form is for those.

Features are doubles, arrays of doubles of one length, or arrays of terms (``functions.typed``) where a process has features of
several kinds or linear combinations of them as rows. Rows of a group are measurements unless a boolean column ``measured``
says otherwise (null: true).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.joins import is_small
from sparkreg.functions.kernels import Flags, Kernel
from sparkreg.functions.order import spread
from sparkreg.functions.storage import materialise, row_bytes, size_of
from sparkreg.functions.typed import Terms, features, joined

Mean = Callable[[np.ndarray], np.ndarray]
MAX_ROWS = 5000


def zero(x: np.ndarray) -> np.ndarray:
    return np.zeros(len(x))


def cholesky(k: np.ndarray) -> np.ndarray:
    """Cholesky factor; a diagonal shift only where the matrix is not positive definite to rounding."""
    shift = 0.0
    for _ in range(8):
        try:
            return np.linalg.cholesky(k + shift * np.eye(len(k)))
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 1e-12 * float(np.trace(k)) / len(k))
    raise np.linalg.LinAlgError("covariance is not positive definite")


def inverse_lower(low: np.ndarray, block: int = 128) -> np.ndarray:
    """The inverse of a lower triangle, by halves."""
    n = len(low)
    if n <= block:
        return np.tril(np.linalg.inv(low)) if n else low.copy()
    h = n // 2
    out = np.zeros_like(low)
    out[:h, :h], out[h:, h:] = inverse_lower(low[:h, :h], block), inverse_lower(low[h:, h:], block)
    out[h:, :h] = -out[h:, h:] @ low[h:, :h] @ out[:h, :h]
    return out


def root_of(k: np.ndarray) -> np.ndarray:
    """R with R' R = k^-1, lower triangular."""
    return inverse_lower(cholesky(k))


class Fit:
    """A fitted process: features, inverse Cholesky factor of the training covariance, information vector, the residuals times
    that factor (whitened), and which rows are measurements."""

    def __init__(self, x, root: np.ndarray, v: np.ndarray, w: np.ndarray, measured: Flags = True) -> None:
        self.x, self.root, self.v, self.w, self.measured = x, root, v, w, measured

    @classmethod
    def of(cls, kernel: Kernel, x, y: np.ndarray, variance: np.ndarray, mean: Mean = zero, measured: Flags = True) -> Fit:
        root = root_of(kernel.between(x, x, measured, measured) + np.diag(variance))
        w = root @ (y - mean(x))
        return cls(x, root, root.T @ w, w, measured)

    @property
    def precision(self) -> np.ndarray:
        """K^-1."""
        return self.root.T @ self.root

    def cross(self, kernel: Kernel, xs, measured: bool) -> np.ndarray:
        return kernel.between(xs, self.x, measured, self.measured)

    def mean(self, kernel: Kernel, xs, mean: Mean = zero) -> np.ndarray:
        return self.cross(kernel, xs, False) @ self.v + mean(xs)

    def joint(self, kernel: Kernel, xs, mean: Mean = zero, measured: bool = False) -> tuple[np.ndarray, np.ndarray]:
        cross = self.cross(kernel, xs, measured)
        half = self.root @ cross.T
        return cross @ self.v + mean(xs), kernel.between(xs, xs, measured, measured) - half.T @ half

    def marginal(self, kernel: Kernel, xs, mean: Mean = zero, measured: bool = False, step: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        means, variances = [np.empty(0)], [np.empty(0)]
        for lo in range(0, len(xs), step):  # bounds the cross covariance in memory
            part = xs[lo : lo + step]
            cross = self.cross(kernel, part, measured)
            means.append(cross @ self.v + mean(part))
            variances.append(kernel.diagonal(part, measured) - ((self.root @ cross.T) ** 2).sum(0))
        return np.concatenate(means), np.concatenate(variances)

    def blocks(self, kernel: Kernel, xs, ends: np.ndarray, mean: Mean = zero, measured: bool = False, step: int = 2000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, mean, covariance) of the blocks of xs that end before ends: one product with the factor for several."""
        begins, k = np.append(0, ends[:-1]), 0
        while k < len(ends):
            last = max(k + 1, int(np.searchsorted(ends, begins[k] + step, side="right")))
            base, part = int(begins[k]), xs[int(begins[k]) : int(ends[last - 1])]
            cross = self.cross(kernel, part, measured)
            means, half = cross @ self.v + mean(part), self.root @ cross.T
            for lo, hi in zip(begins[k:last].tolist(), ends[k:last].tolist(), strict=True):
                at, own = slice(lo - base, hi - base), xs[lo:hi]
                yield lo, hi, means[at], kernel.between(own, own, measured, measured) - half[:, at].T @ half[:, at]
            k = last

    def update(self, kernel: Kernel, x, y: np.ndarray, variance: np.ndarray, mean: Mean = zero, measured: Flags = True) -> Fit:
        """Condition on new rows without factoring the old block again: the new rows of the inverse factor."""
        b = self.root @ kernel.between(self.x, x, self.measured, measured)
        corner = root_of(kernel.between(x, x, measured, measured) + np.diag(variance) - b.T @ b)
        root = np.block([[self.root, np.zeros((len(self.x), len(x)))], [-corner @ b.T @ self.root, corner]])
        new = corner @ (y - mean(x) - b.T @ self.w)
        v = np.concatenate([self.v, np.zeros(len(x))]) + root[len(self.x) :].T @ new
        flags = self.measured is True and measured is True
        flags = flags or np.concatenate([np.broadcast_to(m, len(t)) for m, t in ((self.measured, self.x), (measured, x))])
        return Fit(joined(self.x, x), root, v, np.concatenate([self.w, new]), flags)

    def packed(self, key: dict) -> dict:
        x = self.x
        row = {**key, "n": len(x), "root": self.root[np.tril_indices(len(self.root))], "information": self.v, "whitened": self.w}
        row["latent"] = np.flatnonzero(~np.broadcast_to(self.measured, len(x))).astype(np.int32) if self.measured is not True else None
        if isinstance(x, Terms):
            row |= {"d": x.value.shape[1], "x": x.value.reshape(-1), "kinds": x.kind, "widths": x.width.astype(np.int32), "coefs": x.coef, "starts": x.start.astype(np.int32)}
        else:
            x = np.asarray(x, float)
            row |= {"d": 0 if x.ndim == 1 else x.shape[1], "x": x.reshape(-1), "kinds": None, "widths": None, "coefs": None, "starts": None}
        return row

    def pack(self, key: dict) -> pd.DataFrame:
        return pd.DataFrame([self.packed(key)])

    @classmethod
    def unpack(cls, row) -> Fit:
        n, d = int(row["n"]), int(row["d"])
        root = np.zeros((n, n))
        root[np.tril_indices(n)] = np.asarray(row["root"], float)
        x = np.asarray(row["x"], float)
        if row["kinds"] is not None:
            x = Terms(np.asarray(row["kinds"], object), x.reshape(-1, d), np.asarray(row["widths"], np.int64), np.asarray(row["coefs"], float), np.asarray(row["starts"], np.int64))
        elif d:
            x = x.reshape(n, d)
        measured: Flags = True
        if row["latent"] is not None:
            measured = np.ones(n, bool)
            measured[np.asarray(row["latent"], np.int64)] = False
        return cls(x, root, *(np.asarray(row[c], float) for c in ("information", "whitened")), measured)


def fit_schema(key: str, kind: str = "long") -> str:
    return f"{key} {kind}, n long, d int, x array<double>, root array<double>, information array<double>, whitened array<double>, latent array<int>, kinds array<string>, widths array<int>, coefs array<double>, starts array<int>"


def _guard(pdf: pd.DataFrame, key: str, most: int) -> None:
    if len(pdf) > most:
        raise ValueError(f"group {pdf[key].iloc[0]} has {len(pdf)} rows; at most {most} make an exact process")


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows in the order of row_id, which they mostly are in."""
    return pdf if pdf["row_id"].is_monotonic_increasing else pdf.sort_values("row_id")


def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray | Terms, np.ndarray, np.ndarray]:
    """Features, targets and variances in the order of row_id."""
    pdf = in_order(pdf)
    return features(pdf["feature"]), pdf["target"].to_numpy(float), pdf["target_variance"].to_numpy(float)


def flags(pdf: pd.DataFrame) -> Flags:
    """Which rows are measurements, in the order of row_id."""
    if "measured" not in pdf:
        return True
    own = in_order(pdf)["measured"].fillna(True).to_numpy(bool)
    return True if own.all() else own


def training(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "row_id", "feature", "target", "target_variance", *(["measured"] if "measured" in df.columns else []))


def whole_groups(batches: Iterator[pd.DataFrame], names: list[str], max_rows: int) -> Iterator[pd.DataFrame]:
    """The same rows, sorted by names, cut so that no group of equal names is divided: the last of a batch waits for the next."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf])
        codes = [pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in names]
        changes = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) if len(pdf) else np.empty(0, int)
        lo = int(changes[-1]) + 1 if len(changes) else 0
        if lo:
            yield pdf.iloc[:lo]
        rest = pdf.iloc[lo:]
        if len(rest) > max_rows:
            raise ValueError(f"group {rest[names[-1]].iloc[0]} has more than {max_rows} rows, which depend on each other")
    if rest is not None and len(rest):
        yield rest


HELD_ROWS = 2_000_000  # of a group that a task holds, which a guard then counts
_OUT_BYTES = 32 << 20  # of what a task gives out at a time


def _groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """One frame a group, of rows sorted by names."""
    for pdf in whole_groups(batches, names, HELD_ROWS):
        codes = np.array([pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in names])
        ends = np.append(np.flatnonzero((np.diff(codes) != 0).any(axis=0)) + 1, len(pdf)).tolist()
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            yield pdf.iloc[lo:hi]


def _together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in fewer frames."""
    held, size = [], 0
    for frame in frames:
        if len(frame):
            held.append(frame)
            size += 8 * frame.size + sum(v.nbytes if isinstance(v, np.ndarray) else len(v) for c in frame for v in (frame[c] if frame[c].dtype == object else ()) if isinstance(v, np.ndarray | bytes))
        if size > _OUT_BYTES:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def per_group(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "key", max_rows: int = MAX_ROWS) -> DataFrame:
    """f over the rows of each key, sorted by row_id, guarded by max_rows. Groups stream by, sorted, many in a batch: handing each to
    a worker by itself costs more than most groups do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[pd.DataFrame]:
            for pdf in _groups(batches, [key]):
                _guard(pdf, key, max_rows)
                yield f(pdf)

        yield from _together(each())

    return spread(df, key).sortWithinPartitions(key, "row_id").mapInPandas(run, schema)


def fit_gp(df: DataFrame, kernel: Kernel, key: str = "key", mean: Mean = zero, max_rows: int = MAX_ROWS) -> DataFrame:
    """One fit a key from rows (key, row_id, feature, target, target_variance)."""

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in _groups(batches, [key]):
            _guard(pdf, key, max_rows)
            held.append(Fit.of(kernel, *arrays(pdf), mean, flags(pdf)).packed({key: pdf[key].iloc[0]}))
            size += held[-1]["root"].nbytes
            if size > _OUT_BYTES:
                yield pd.DataFrame(held)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held)

    return spread(training(df, key), key).sortWithinPartitions(key, "row_id").mapInPandas(fits, fit_schema(key, dict(df.dtypes)[key]))


def update_gp(fits: DataFrame, df: DataFrame, kernel: Kernel, key: str = "key", mean: Mean = zero) -> DataFrame:
    """Fits conditioned on new rows, of other kinds too; keys without new rows keep their fit, keys without a fit get one."""

    def update(old: dict | None, new: pd.DataFrame) -> pd.DataFrame:
        if not len(new):
            return pd.DataFrame([old])
        if old is None:
            return Fit.of(kernel, *arrays(new), mean, flags(new)).pack({key: new[key].iloc[0]})
        return Fit.unpack(old).update(kernel, *arrays(new), mean, flags(new)).pack({key: new[key].iloc[0]})

    return by_key(materialise(fits, "fits"), training(df, key), update, fit_schema(key, dict(df.dtypes)[key]), [key])


def with_fits(fits: DataFrame, rows: DataFrame, f: Callable[[Fit, pd.DataFrame], pd.DataFrame], schema: str, key: str, part_rows: int, together: str | None = None, unpack: Callable = Fit.unpack, tasks: int = 0) -> DataFrame:
    """f(fit, rows) where fits and rows meet by key. Keys of over part_rows rows are dealt out in parts of about that many,
    each of which gets the fit; rows that agree in the column ``together`` stay in one part. Rows without a fit are left out.
    fits should be materialised. tasks: at least so many."""
    large = materialise(rows.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > part_rows), "large-keys")
    side = F.broadcast(large) if is_small(large) else large
    parts = F.coalesce(F.ceil(F.col("__n") / part_rows), F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64(F.col(together or "row_id")), parts).cast("int")
    rows = rows.join(side, F.col(key) == F.col("__k"), "left").withColumn("__part", part).drop("__k", "__n")
    fits = fits.join(side, F.col(key) == F.col("__k"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__k", "__n")

    def own(fit: dict | None, part: pd.DataFrame) -> pd.DataFrame | None:
        return f(unpack(fit), part) if fit is not None and len(part) else None

    tasks = max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return by_key(fits, rows, own, schema, [key, "__part"], tasks)


_WIDE_BYTES = 128 << 10  # of a row that is handed to a worker by itself


def by_key(left: DataFrame, right: DataFrame, f: Callable[[dict | None, pd.DataFrame], pd.DataFrame | None], schema: str, keys: list[str], tasks: int | None = None) -> DataFrame:
    """f(row of left or None, rows of right in the order of row_id, if they have one) for every value of keys; left has one row
    each and should be materialised.

    Both sides stream by as one table, sorted, many keys in a batch: a cogroup hands over each key by itself, which costs more
    than most keys do. Left rows of over _WIDE_BYTES would make batches too large, so with any of those it is a cogroup.
    """
    mine, own = ([c for c in t.columns if c not in keys] for t in (left, right))
    order = ["row_id"] if "row_id" in own else []
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def joined_(row: dict | None, rows: pd.DataFrame) -> pd.DataFrame:
        out = f(row, in_order(rows) if order else rows)
        return pd.DataFrame({c: [] for c in names}, dtype=object) if out is None else out  # of any type in Arrow

    if (left.agg(F.max(row_bytes(left)).alias("b")).first().b or 0) > _WIDE_BYTES:
        a, b = (spread(t, *keys, tasks=tasks).groupBy(*keys) for t in (left, right))
        return a.cogroup(b).applyInPandas(lambda a, b: joined_(a.iloc[0].to_dict() if len(a) else None, b), schema)

    def blank(name: str, kind: str, alias: str) -> Column:
        """Zero where a null would turn whole numbers into doubles in a worker."""
        return F.lit(0 if kind in ("tinyint", "smallint", "int", "bigint") else None).cast(kind).alias(alias)

    kinds = {"l": dict(left.dtypes), "r": dict(right.dtypes)}
    first = left.select(*keys, F.lit(0).alias("__side"), *[F.col(c).alias(f"__l_{c}") for c in mine], *[blank(c, kinds["r"][c], f"__r_{c}") for c in own])
    second = right.select(*keys, F.lit(1).alias("__side"), *[blank(c, kinds["l"][c], f"__l_{c}") for c in mine], *[F.col(c).alias(f"__r_{c}") for c in own])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[pd.DataFrame]:
            for pdf in _groups(batches, keys):
                n = int((pdf["__side"] == 0).sum())
                row = {**{c: pdf[c].iat[0] for c in keys}, **{c: pdf[f"__l_{c}"].iat[0] for c in mine}} if n else None
                rows = pdf[[*keys, *(f"__r_{c}" for c in own)]].iloc[n:]
                yield joined_(row, rows.set_axis([*keys, *own], axis=1))

        yield from _together(each())

    both = spread(first.union(second), *keys, tasks=tasks)
    return both.sortWithinPartitions(*keys, "__side", *(f"__r_{c}" for c in order)).mapInPandas(run, schema)


_HELD_BYTES = 64 << 20  # of unpacked fits that a worker keeps
_TASK_BYTES = 64 << 20  # of fits that a task reads


class _Held:
    """Fits of a table that was sent, unpacked when they are asked for; those used last are kept."""

    def __init__(self, table: pa.Table, key: str, unpack: Callable) -> None:
        self.table, self.unpack, self.kept, self.bytes = table, unpack, OrderedDict(), 0
        self.at = {k: i for i, k in enumerate(table.column(key).to_pylist())}

    def get(self, key) -> Fit | None:
        key = None if key is None or key != key else key
        if key not in self.at:
            return None
        if key not in self.kept:
            i = self.at[key]
            own = {c: self.table.column(c)[i] for c in self.table.column_names}
            self.kept[key] = self.unpack({c: v.values.to_numpy() if c in ("root", "x") else v.as_py() for c, v in own.items()})
            self.bytes += self.kept[key].root.nbytes
        self.kept.move_to_end(key)
        while self.bytes > _HELD_BYTES and len(self.kept) > 1:
            self.bytes -= self.kept.popitem(last=False)[1].root.nbytes
        return self.kept[key]


def _mapped(fits: DataFrame, rows: DataFrame, f: Callable[[Fit, pd.DataFrame], pd.DataFrame], schema: str, key: str, unpack: Callable = Fit.unpack) -> DataFrame:
    """f(fit, rows of its key in a batch) where the rows are: no row moves. fits are few enough to be sent."""
    sent = rows.sparkSession.sparkContext.broadcast(fits.toArrow())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(sent.value, key, unpack)
        for pdf in batches:
            found = [f(fit, own) for k, own in pdf.groupby(key, sort=False, dropna=False) if (fit := held.get(k)) is not None]
            if found:
                yield pd.concat(found)

    return rows.mapInPandas(run, schema)


def meet(fits: DataFrame, rows: DataFrame, f: Callable[[Fit, pd.DataFrame], pd.DataFrame], schema: str, key: str, part_rows: int, unpack: Callable = Fit.unpack) -> DataFrame:
    """f(fit, rows): fits that are small together go to the rows; else both meet by key. Rows without a fit are left out."""
    fits = materialise(fits, "fits")
    if is_small(fits):
        return _mapped(fits, rows, f, schema, key, unpack)
    return with_fits(fits, rows, f, schema, key, part_rows, None, unpack, -(-size_of(fits)[1] // _TASK_BYTES))


def predict_gp(fits: DataFrame, rows: DataFrame, kernel: Kernel, key: str = "key", mean: Mean = zero, measured: bool = False, part_rows: int = 100_000) -> DataFrame:
    """(key, row_id, mean, variance) of rows by the fit of their key; rows without a fit are left out.

    Fits that are small together (``is_small``) go to the rows, which stay where they are; else fits and rows meet by key.
    """

    def marginal(fit: Fit, part: pd.DataFrame) -> pd.DataFrame:
        m, v = fit.marginal(kernel, features(part["feature"]), mean, measured)
        return pd.DataFrame({key: part[key], "row_id": part["row_id"], "mean": m, "variance": v})

    rows, schema = rows.select(key, "row_id", "feature"), f"{key} {dict(rows.dtypes)[key]}, row_id long, mean double, variance double"
    return meet(fits, rows, marginal, schema, key, part_rows)


def joint_rows(key: dict, ids: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Long form of a joint distribution: (*key, i, j, mean of i, cov)."""
    i, j = np.indices(cov.shape).reshape(2, -1)
    return pd.DataFrame({**key, "i": ids[i], "j": ids[j], "mean": np.asarray(mean)[i], "cov": cov.reshape(-1)})


def predict_gp_joint(fits: DataFrame, rows: DataFrame, kernel: Kernel, block: str, key: str = "key", mean: Mean = zero, measured: bool = False, max_block: int = MAX_ROWS, part_rows: int = 100_000) -> DataFrame:
    """(key, block, i, j, mean, cov): joint predictions of the rows of each block of a key, i and j being row_ids."""
    kind = dict(rows.dtypes)

    def joint(fit: Fit, part: pd.DataFrame) -> pd.DataFrame:
        code = pd.factorize(part[block], use_na_sentinel=False)[0]
        order = np.lexsort((part["row_id"].to_numpy(), code))
        part, code = part.iloc[order], code[order]
        ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code))
        if (sizes := np.diff(ends, prepend=0)).max() > max_block:
            _guard(part.iloc[ends[sizes.argmax()] - sizes.max() : ends[sizes.argmax()]], block, max_block)
        at, i, j, means, covs = [], [], [], [], []
        for lo, hi, m, c in fit.blocks(kernel, features(part["feature"]), ends, mean, measured):
            a, b = np.indices(c.shape).reshape(2, -1)
            at.append(np.full(len(a), lo))
            i.append(lo + a)
            j.append(lo + b)
            means.append(m[a])
            covs.append(c.reshape(-1))
        at, i, j = map(np.concatenate, (at, i, j))
        ids, blocks = part["row_id"].to_numpy(), part[block].to_numpy()
        return pd.DataFrame({key: part[key].iloc[0], block: blocks[at], "i": ids[i], "j": ids[j], "mean": np.concatenate(means), "cov": np.concatenate(covs)})

    schema = f"{key} {kind[key]}, {block} {kind[block]}, i long, j long, mean double, cov double"
    return with_fits(materialise(fits, "fits"), rows.select(key, "row_id", block, "feature"), joint, schema, key, part_rows, block)


def _marginal_schema(df: DataFrame, key: str) -> str:
    return f"{key} {dict(df.dtypes)[key]}, row_id long, mean double, variance double"


def log_likelihood(kernel: Kernel, x: np.ndarray, y: np.ndarray, mean: Mean = zero, variance: np.ndarray | None = None) -> float:
    """log N(y - mean; K). The target variance is left out unless given."""
    root = root_of(kernel.measured(x, x) + (0 if variance is None else np.diag(variance)))
    r = root @ (y - mean(x))
    return float(-0.5 * (r @ r) + np.log(np.diag(root)).sum() - 0.5 * len(y) * np.log(2 * np.pi))


def log_likelihoods(df: DataFrame, kernel: Kernel, key: str = "key", mean: Mean = zero, with_variance: bool = False, max_rows: int = MAX_ROWS, prior: Column | float = 0.0) -> DataFrame:
    """(key, log_likelihood) of the rows of each key, with the log density of the parameters (``tuning.prior_log_pdf``) added."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = arrays(pdf)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "log_likelihood": [log_likelihood(kernel, x, y, mean, v if with_variance else None)]})

    found = per_group(df, run, f"{key} {dict(df.dtypes)[key]}, log_likelihood double", key, max_rows)
    return found.withColumn("log_likelihood", F.col("log_likelihood") + prior)


def leave_one_out(fit: Fit, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closed-form held-out means and variances."""
    inverse = (fit.root**2).sum(0)
    return y - fit.v / inverse, 1 / inverse


def leave_group_out(fit: Fit, y: np.ndarray, groups: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Closed-form held-out (indices, means, covariance) of each group: with A the block of K^-1, y - A^-1 v and A^-1."""
    out, codes = [], pd.factorize(pd.Series(groups), sort=True, use_na_sentinel=False)[0]  # a null group is a group
    for g in range(codes.max(initial=-1) + 1):
        at = np.flatnonzero(codes == g)
        cov = np.linalg.inv(fit.root[:, at].T @ fit.root[:, at])
        out.append((at, y[at] - cov @ fit.v[at], cov))
    return out


def loo_gp(df: DataFrame, kernel: Kernel, key: str = "key", mean: Mean = zero, max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, row_id, mean, variance): each row as its key's other rows predict it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = arrays(pdf)
        m, var = leave_one_out(Fit.of(kernel, x, y, v, mean, flags(pdf)), y)
        return pd.DataFrame({key: pdf[key], "row_id": pdf["row_id"], "mean": m, "variance": var})

    return per_group(df, run, _marginal_schema(df, key), key, max_rows)


def logo_gp(df: DataFrame, kernel: Kernel, fold: str, key: str = "key", mean: Mean = zero, max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, row_id, mean, variance): each fold of a key as the key's other folds predict it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = arrays(pdf)
        ids = pdf["row_id"].to_numpy()
        held = leave_group_out(Fit.of(kernel, x, y, v, mean, flags(pdf)), y, pdf[fold].to_numpy())
        return pd.concat([pd.DataFrame({key: pdf[key].iloc[0], "row_id": ids[at], "mean": m, "variance": np.diag(c)}) for at, m, c in held])

    return per_group(df, run, _marginal_schema(df, key), key, max_rows)


def logo_gp_joint(df: DataFrame, kernel: Kernel, fold: str, key: str = "key", mean: Mean = zero, max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, fold, i, j, mean, cov): the joint prediction of each fold of a key by the key's other folds, as measurements with
    their target variances; i and j are row_ids."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = arrays(pdf)
        ids, folds = pdf["row_id"].to_numpy(), pdf[fold].to_numpy()
        held = leave_group_out(Fit.of(kernel, x, y, v, mean, flags(pdf)), y, folds)
        return pd.concat([joint_rows({key: pdf[key].iloc[0], fold: folds[at[0]]}, ids[at], m, c) for at, m, c in held])

    return per_group(df, run, f"{key} {kinds[key]}, {fold} {kinds[fold]}, i long, j long, mean double, cov double", key, max_rows)


JointMetric = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], float]


def logo_metrics(df: DataFrame, kernel: Kernel, fold: str, metrics: dict[str, JointMetric], key: str = "key", mean: Mean = zero, max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, fold, metrics): each metric(mean, covariance, targets, target variances) of the held-out joint predictions."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = arrays(pdf)
        folds = pdf[fold].to_numpy()
        held = leave_group_out(Fit.of(kernel, x, y, v, mean, flags(pdf)), y, folds)
        return pd.DataFrame([{key: pdf[key].iloc[0], fold: folds[at[0]], **{name: f(m, c - np.diag(v[at]), y[at], v[at]) for name, f in metrics.items()}} for at, m, c in held])

    return per_group(df, run, f"{key} {kinds[key]}, {fold} {kinds[fold]}, " + ", ".join(f"{name} double" for name in metrics), key, max_rows)


def fit_from_prediction(kernel: Kernel, x: np.ndarray, mean: np.ndarray, cov: np.ndarray, prior_mean: Mean = zero) -> tuple[np.ndarray, np.ndarray]:
    """(information, explained) of a fit that reproduces a joint prediction at x: information = K^-1 (mean - prior), and
    the matrix E = K^-1 - K^-1 cov K^-1 that takes the place of an inverse in the variance k - k' E k."""
    root = root_of(kernel.matrix(x, x))
    inverse = root.T @ root
    return inverse @ (mean - prior_mean(x)), inverse - inverse @ cov @ inverse


def predict_from_prediction(fits: DataFrame, anchors: DataFrame, rows: DataFrame, kernel: Kernel, key: str = "key", mean: Mean = zero, fit_kernel: Kernel | None = None, part_rows: int = 100_000) -> DataFrame:
    """(key, row_id, mean, variance) of rows by fits that keep only the joint prediction at anchors (key, row_id, feature).

    fit_kernel: the kernel of fits where it is another; kernel is that of the new fits.
    """
    # anchors and rows meet the fit together, so that what is kept of it never leaves the task
    both = rows.select(key, "row_id", "feature", F.lit(False).alias("__anchor")).union(anchors.select(key, "row_id", "feature", F.lit(True)))

    def predict(fit: Fit, own: pd.DataFrame) -> pd.DataFrame | None:
        anchor = own["__anchor"].to_numpy(bool)
        own, at = own[~anchor], own[anchor]
        if not len(own) or not len(at):
            return None
        x, xs = features(at["feature"]), features(own["feature"])
        information, e = fit_from_prediction(kernel, x, *fit.joint(fit_kernel or kernel, x, mean), mean)
        cross = kernel.matrix(xs, x)
        return pd.DataFrame({key: own[key], "row_id": own["row_id"], "mean": cross @ information + mean(xs), "variance": kernel.diagonal(xs) - ((cross @ e) * cross).sum(1)})

    return with_fits(materialise(fits, "fits"), both, predict, _marginal_schema(rows, key), key, 10**9)


def condition(mean: np.ndarray, cov: np.ndarray, known: np.ndarray, y: np.ndarray, variance: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A joint prior conditioned on noisy values at known indices, at wanted indices."""
    root = root_of(cov[np.ix_(known, known)] + np.diag(variance))
    half = root @ cov[np.ix_(known, wanted)]
    return mean[wanted] + half.T @ (root @ (y - mean[known])), cov[np.ix_(wanted, wanted)] - half.T @ half


def condition_gp(df: DataFrame, kernel: Kernel, known: str, key: str = "key", mean: Mean = zero, max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, row_id, mean, variance) of the rows that are not known, given the targets of those that are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, v = arrays(pdf)
        given = pdf[known].to_numpy(bool)
        a, b = np.flatnonzero(given), np.flatnonzero(~given)
        m, c = condition(mean(x), kernel.matrix(x, x), a, y[a], v[a], b)
        return pd.DataFrame({key: pdf[key].iloc[0], "row_id": pdf["row_id"].to_numpy()[b], "mean": m, "variance": np.diag(c)})

    return per_group(df, run, _marginal_schema(df, key), key, max_rows)


def sample_gp(df: DataFrame, kernel: Kernel, seed: int, key: str = "key", mean: Mean = zero, max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, row_id, value): a draw of the prior over the rows of each key, the same for the same seed and rows."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        x = features(pdf["feature"])
        rng = np.random.default_rng([seed, *str(pdf[key].iloc[0]).encode()])
        return pd.DataFrame({key: pdf[key], "row_id": pdf["row_id"], "value": mean(x) + cholesky(kernel.matrix(x, x)) @ rng.standard_normal(len(x))})

    return per_group(df, draw, f"{key} {dict(df.dtypes)[key]}, row_id long, value double", key, max_rows)
