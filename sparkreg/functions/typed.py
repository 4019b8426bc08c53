"""Features of several kinds in one process: a row is a linear combination of terms, each of a kind.

As a column a feature is an array of (kind, value, coef); in NumPy a ragged table of terms with the first term of each row.
``by_kind`` dispatches on the kinds of two terms; a kernel is evaluated between terms and summed over the segments of both
sides, so the covariance of two combinations is coef' K coef.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<kind: string, value: array<double>, coef: double>>"


class Terms:
    """n rows of terms: kind, value (t, d) of which the first ``width`` numbers count, and coef of each term; row i has the
    terms start[i] .. start[i + 1] - 1."""

    def __init__(self, kind: np.ndarray, value: np.ndarray, width: np.ndarray, coef: np.ndarray, start: np.ndarray) -> None:
        self.kind, self.value, self.width, self.coef, self.start = kind, value, width, coef, start

    @classmethod
    def of(cls, rows: list) -> Terms:
        """Of rows as lists of (kind, value, coef); values of fewer numbers end in zeros; null is no term."""
        rows = [r if r is not None else () for r in rows]
        terms = [t for r in rows for t in r]
        values = [np.atleast_1d(np.asarray(t["value"], float)) for t in terms]
        table = np.zeros((len(terms), max((len(v) for v in values), default=1)))
        for k, v in enumerate(values):
            table[k, : len(v)] = v
        kind = np.array([t["kind"] for t in terms], object)
        coef = np.array([1.0 if t["coef"] is None else t["coef"] for t in terms], float)
        return cls(kind, table, np.array(list(map(len, values)), np.int64), coef, np.cumsum([0, *map(len, rows)]))

    @classmethod
    def plain(cls, kind: str, value: np.ndarray) -> Terms:
        """One term of one kind a row."""
        value = np.asarray(value, float)
        value = value.reshape(len(value), -1)
        return cls(np.full(len(value), kind, object), value, np.full(len(value), value.shape[1]), np.ones(len(value)), np.arange(len(value) + 1))

    def __len__(self) -> int:
        return len(self.start) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.start)

    def __getitem__(self, at) -> Terms:
        rows = np.arange(len(self))[at]
        sizes = self.sizes[rows]
        upto = np.cumsum(sizes)
        terms = np.repeat(self.start[:-1][rows] - upto + sizes, sizes) + np.arange(sizes.sum())
        return Terms(self.kind[terms], self.value[terms], self.width[terms], self.coef[terms], np.append(0, upto))

    def singles(self) -> Terms:
        """Each term as a row of its own, with coefficient one."""
        return Terms(self.kind, self.value, self.width, np.ones(len(self.kind)), np.arange(len(self.kind) + 1))

    def spread(self, flags):
        """A flag for each row as one for each term."""
        return flags if isinstance(flags, (bool, np.bool_)) else np.repeat(flags, self.sizes)

    def fold(self, table: np.ndarray) -> np.ndarray:
        """Rows of a table of terms, times their coefficients, summed by row of this."""
        table = table * (self.coef[:, None] if table.ndim > 1 else self.coef)
        out, some = np.zeros((len(self), *table.shape[1:])), np.flatnonzero(self.sizes)
        if len(some):
            out[some] = np.add.reduceat(table, self.start[:-1][some], axis=0)
        return out


def values(x) -> np.ndarray:
    """The numbers of features or terms: (n,) where there is one each, else (n, d)."""
    if not isinstance(x, Terms):
        return np.asarray(x, float)
    d = int(x.width.max(initial=1))
    return x.value[:, 0] if d == 1 else x.value[:, :d]


def joined(a, b):
    """Features one after the other; of one form."""
    if not isinstance(a, Terms):
        return np.concatenate([a, b])
    d = max(a.value.shape[1], b.value.shape[1])
    value = np.concatenate([np.pad(x.value, ((0, 0), (0, d - x.value.shape[1]))) for x in (a, b)])
    return Terms(np.concatenate([a.kind, b.kind]), value, np.concatenate([a.width, b.width]), np.concatenate([a.coef, b.coef]), np.append(a.start, a.start[-1] + b.start[1:]))


def features(column: pd.Series) -> np.ndarray | Terms:
    """(n,) of a column of numbers, (n, d) of arrays of numbers, Terms of arrays of (kind, value, coef)."""
    first = next((v for v in column if v is not None), None)
    if isinstance(first, (list, tuple, np.ndarray)):
        if any(len(v) and not isinstance(v[0], (int, float, np.number)) for v in column if v is not None):
            return Terms.of(list(column))
        return np.stack([np.asarray(v, float) for v in column])
    return column.to_numpy(float)


def term(kind: str, *value: Column, coef: float | Column = 1.0) -> Column:
    """One term as a struct."""
    return F.struct(F.lit(kind).alias("kind"), F.array(*(v.cast("double") for v in value)).alias("value"), (coef if isinstance(coef, Column) else F.lit(float(coef))).alias("coef"))


def typed(kind: str, *value: Column) -> Column:
    """A feature of one kind as a column."""
    return F.array(term(kind, *value))


def combination(*terms: Column) -> Column:
    """A linear combination of terms as a column."""
    return F.array(*terms)


def mean_by_kind(means: dict[str, Callable[[np.ndarray], np.ndarray]]) -> Callable[[Terms], np.ndarray]:
    """A mean function of typed features: combinations of the means of their terms; kinds without a mean have 0."""

    def mean(x: Terms) -> np.ndarray:
        out = np.zeros(len(x.kind))
        for kind, f in means.items():
            at = np.flatnonzero(x.kind == kind)
            if len(at):
                out[at] = f(values(x.singles()[at]))
        return x.fold(out)

    return mean
