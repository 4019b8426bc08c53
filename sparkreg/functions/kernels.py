"""Covariance and mean functions, each as a Column over a pair of rows and as NumPy over two arrays of features.

A Kernel composes with + and *. ``column(x, y)`` takes two Columns, ``matrix(x, y)`` two arrays of features: scalars have shape
(n,), vectors (n, d), and features of several kinds are ``Terms``. Every node of a tree of kernels is given, beside the
features, which sides are measurements, so what holds between measurements only keeps its place within sums and products.
Noise is equality of features, so as a table it is an equality join.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkreg.functions.columns import distance_angular, distance_euclidean, distance_radial
from sparkreg.functions.typed import Terms, values

Flags = bool | np.ndarray  # which rows are measurements


def _pairwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.ndim == 1:
        return np.abs(x[:, None] - y[None, :])
    squares = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):  # a dimension at a time: no (n, m, d) array
        squares += (x[:, k, None] - y[None, :, k]) ** 2
    return np.sqrt(squares)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.abs(x) if x.ndim == 1 else np.linalg.norm(x, axis=-1)


def _radial(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(_norms(x)[:, None] - _norms(y)[None, :])


def _angular(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    c = (x @ y.T) / (np.linalg.norm(x, axis=-1)[:, None] * np.linalg.norm(y, axis=-1)[None, :])
    return np.where(c > 1 - 1e-16, 0.0, np.where(c < -1 + 1e-16, math.pi, np.arccos(np.clip(c, -1, 1))))


DISTANCES = {"euclidean": (distance_euclidean, _pairwise), "radial": (lambda x, y, arrays=True: distance_radial(x, y), _radial), "angular": (lambda x, y, arrays=True: distance_angular(x, y), _angular)}


def _outer(mx: Flags, my: Flags, shape: tuple[int, int]) -> np.ndarray:
    return np.broadcast_to(np.asarray(mx, bool), shape[:1])[:, None] & np.broadcast_to(np.asarray(my, bool), shape[1:])[None, :]


@dataclass(frozen=True)
class Kernel:
    """form(x, y, x measured, y measured): a Column; value(x, y, mx, my): a matrix; own(x, m): k(x_i, x_i) of every row."""

    form: Callable[[Column, Column, Column, Column], Column]
    value: Callable[[np.ndarray, np.ndarray, Flags, Flags], np.ndarray]
    own: Callable[[np.ndarray, Flags], np.ndarray]

    @classmethod
    def of(cls, column: Callable[[Column, Column], Column], matrix: Callable[[np.ndarray, np.ndarray], np.ndarray], own: Callable[[np.ndarray], np.ndarray] | None = None, step: int = 64) -> Kernel:
        """Of functions of two plain features; without ``own`` the diagonal comes from small blocks of the matrix."""

        def blocks(x: np.ndarray) -> np.ndarray:
            return np.concatenate([np.empty(0), *(np.diag(matrix(x[lo : lo + step], x[lo : lo + step])) for lo in range(0, len(x), step))])

        return cls(lambda x, y, _, __: column(x, y), lambda x, y, _, __: matrix(values(x), values(y)), lambda x, _: (own or blocks)(values(x)))

    def __add__(self, other: Kernel) -> Kernel:
        return Kernel(lambda *a: self.form(*a) + other.form(*a), lambda *a: self.value(*a) + other.value(*a), lambda *a: self.own(*a) + other.own(*a))

    def __mul__(self, other: Kernel) -> Kernel:
        """The right side is not looked at where the left is zero."""

        def form(*a: Column) -> Column:
            left = self.form(*a)
            return F.when(left == 0, 0.0).otherwise(left * other.form(*a))

        def value(*a) -> np.ndarray:
            left = self.value(*a)
            return np.multiply(left, other.value(*a), out=np.zeros_like(left, float), where=left != 0) if left.any() else np.zeros_like(left, float)

        def own(*a) -> np.ndarray:
            left = self.own(*a)
            return np.multiply(left, other.own(*a), out=np.zeros_like(left, float), where=left != 0) if left.any() else np.zeros_like(left, float)

        return Kernel(form, value, own)

    def between(self, x, y, mx: Flags, my: Flags) -> np.ndarray:
        """The matrix between features of which mx and my say which are measurements."""
        if not isinstance(x, Terms):
            return self.value(x, y, mx, my)
        return y.fold(x.fold(self.value(x.singles(), y.singles(), x.spread(mx), y.spread(my))).T).T

    def column(self, x: Column, y: Column) -> Column:
        return self.form(x, y, F.lit(False), F.lit(False))

    def matrix(self, x, y) -> np.ndarray:
        """Between features as such."""
        return self.between(x, y, False, False)

    def measured(self, x, y) -> np.ndarray:
        """Between measurements of features."""
        return self.between(x, y, True, True)

    def diagonal(self, x, measured: Flags = False) -> np.ndarray:
        """k(x_i, x_i) of every feature."""
        if not isinstance(x, Terms):
            return self.own(x, measured)
        out = np.zeros(len(x))
        flags = np.broadcast_to(np.asarray(measured, bool), len(x))
        one = np.flatnonzero(x.sizes == 1)
        if len(one):
            part = x[one]
            out[one] = part.coef**2 * self.own(part.singles(), flags[one])
        for i in np.flatnonzero(x.sizes > 1):
            part, m = x[[i]], bool(flags[i])
            out[i] = self.between(part, part, m, m)[0, 0]
        return out


def _of_distance(name: str, arrays: bool, col_form: Callable[[Column], Column], np_form: Callable[[np.ndarray], np.ndarray]) -> Kernel:
    on_columns, on_arrays = DISTANCES[name]
    at_zero = float(np_form(np.zeros(1))[0])
    return Kernel.of(lambda x, y: col_form(on_columns(x, y, arrays)), lambda x, y: np_form(on_arrays(x, y)), lambda x: np.full(len(x), at_zero))


def _zero_scale(length: float) -> bool:
    return length <= 0


def squared_exponential(length: float, sigma: float, distance: str = "euclidean", arrays: bool = False) -> Kernel:
    """sigma^2 exp(-(d / length)^2): no half in the exponent; length <= 0: 0."""
    if _zero_scale(length):
        return constant(0.0)
    return _of_distance(distance, arrays, lambda d: sigma**2 * F.exp(-(d / length) * (d / length)), lambda d: sigma**2 * np.exp(-((d / length) ** 2)))


def exponential(length: float, sigma: float, distance: str = "euclidean", arrays: bool = False) -> Kernel:
    """sigma^2 exp(-|d / length|); length <= 0: 0."""
    if _zero_scale(length):
        return constant(0.0)
    return _of_distance(distance, arrays, lambda d: sigma**2 * F.exp(-F.abs(d / length)), lambda d: sigma**2 * np.exp(-np.abs(d / length)))


def matern_32(length: float, sigma: float, distance: str = "euclidean", arrays: bool = False) -> Kernel:
    if _zero_scale(length):
        return constant(0.0)
    q = math.sqrt(3) / length
    return _of_distance(distance, arrays, lambda d: sigma**2 * (1 + q * d) * F.exp(-q * d), lambda d: sigma**2 * (1 + q * d) * np.exp(-q * d))


def matern_52(length: float, sigma: float, distance: str = "euclidean", arrays: bool = False) -> Kernel:
    if _zero_scale(length):
        return constant(0.0)
    q = math.sqrt(5) / length
    return _of_distance(distance, arrays, lambda d: sigma**2 * (1 + q * d + q * q * d * d / 3) * F.exp(-q * d), lambda d: sigma**2 * (1 + q * d + (q * d) ** 2 / 3) * np.exp(-q * d))


def constant(sigma: float) -> Kernel:
    return Kernel.of(lambda x, y: F.lit(float(sigma**2)), lambda x, y: np.full((len(x), len(y)), float(sigma**2)), lambda x: np.full(len(x), float(sigma**2)))


def polynomial(sigmas: list[float]) -> Kernel:
    """Sum of sigma_i^2 x^i y^i."""

    def column(x: Column, y: Column) -> Column:
        out = F.lit(0.0)
        for i, s in enumerate(sigmas):
            out = out + s**2 * F.pow(x * y, F.lit(i))
        return out

    return Kernel.of(column, lambda x, y: sum(s**2 * np.outer(x, y) ** i for i, s in enumerate(sigmas)), lambda x: sum(s**2 * x ** (2 * i) for i, s in enumerate(sigmas)) + np.zeros(len(x)))


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.ndim == 1:
        return x[:, None] == y[None, :]
    same = np.ones((len(x), len(y)), bool)
    for k in range(x.shape[1]):
        same &= x[:, k, None] == y[None, :, k]
    return same


def independent_noise(sigma: float) -> Kernel:
    """sigma^2 between equal features, so repeated features share their noise."""
    return Kernel.of(lambda x, y: F.when(x == y, sigma**2).otherwise(0.0), lambda x, y: sigma**2 * _same(x, y), lambda x: np.full(len(x), float(sigma**2)))


def nugget(sigma: float = 1e-8) -> Kernel:
    return independent_noise(sigma)


def measurements_of(kernel: Kernel) -> Kernel:
    """kernel where both sides are measurements, else 0."""

    def value(x, y, mx: Flags, my: Flags) -> np.ndarray:
        if not (np.any(mx) and np.any(my)):
            return np.zeros((len(x), len(y)))
        k = kernel.value(x, y, False, False)
        return k if np.all(mx) and np.all(my) else np.where(_outer(mx, my, k.shape), k, 0.0)

    return Kernel(
        lambda x, y, mx, my: F.when(mx & my, kernel.form(x, y, F.lit(False), F.lit(False))).otherwise(0.0),
        value,
        lambda x, m: np.where(np.broadcast_to(np.asarray(m, bool), len(x)), kernel.own(x, False), 0.0),
    )


def measurement_noise(sigma: float) -> Kernel:
    """Noise that enters only between two measurements."""
    return measurements_of(independent_noise(sigma))


def scaling(column: Callable[[Column], Column], numbers: Callable[[np.ndarray], np.ndarray]) -> Kernel:
    """f(x) f(y)."""
    return Kernel.of(lambda x, y: column(x) * column(y), lambda x, y: np.outer(numbers(x), numbers(y)), lambda x: numbers(x) ** 2)


def by_kind(kernels: dict[tuple[str, str], Kernel]) -> Kernel:
    """A kernel of typed features: that of the two kinds, in either order; 0 where none is given.

    As Columns the features are structs (kind, value): a term, or one with a plain number as value.
    """
    both = {**{(b, a): (k, True) for (a, b), k in kernels.items()}, **{pair: (k, False) for pair, k in kernels.items()}}

    def form(x: Column, y: Column, mx: Column, my: Column) -> Column:
        out = F.lit(0.0)
        for (a, b), (k, swapped) in both.items():
            part = k.form(y["value"], x["value"], my, mx) if swapped else k.form(x["value"], y["value"], mx, my)
            out = F.when((x["kind"] == a) & (y["kind"] == b), part).otherwise(out)
        return out

    def value(x: Terms, y: Terms, mx: Flags, my: Flags) -> np.ndarray:
        out = np.zeros((len(x), len(y)))
        rows, cols = ({k: np.flatnonzero(t.kind == k) for k in set(t.kind)} for t in (x, y))
        for (a, b), (k, swapped) in both.items():
            if a in rows and b in cols:
                i, j = rows[a], cols[b]
                flags = (m if isinstance(m, (bool, np.bool_)) else m[at] for m, at in ((mx, i), (my, j)))
                left, right = flags
                own = k.value(y[j], x[i], right, left).T if swapped else k.value(x[i], y[j], left, right)
                out[np.ix_(i, j)] = own
        return out

    def own(x: Terms, m: Flags) -> np.ndarray:
        out, flags = np.zeros(len(x)), np.broadcast_to(np.asarray(m, bool), len(x))
        for a in set(x.kind):
            if (a, a) in both:
                at = np.flatnonzero(x.kind == a)
                out[at] = both[a, a][0].own(x[at], flags[at])
        return out

    return Kernel(form, value, own)


def of_kind(kind: str, kernel: Kernel) -> Kernel:
    """kernel between two features of one kind, else 0."""
    return by_kind({(kind, kind): kernel})


def measurement_only(value: Column, x_measured: Column, y_measured: Column) -> Column:
    """A covariance where both sides are measurements, else 0."""
    return F.when(x_measured & y_measured, value).otherwise(0.0)


def process_noise(kernel_at_zero: float, kernel_at: Column) -> Column:
    """Standard deviation of the process noise of a step: sqrt(k(0) - k(d)^2 / k(0))."""
    return F.sqrt(kernel_at_zero - kernel_at * kernel_at / kernel_at_zero)


def mean_linear(x: Column, offset: float, slope: float) -> Column:
    return slope * x + offset
