"""A long series filtered in parallel: an associative scan over chunks of rows.

The variance after a step is a fraction (a p + b) / (c p + d) of the variance before it, and such fractions compose as 2 x 2
matrices; once the variance at the start of a chunk is known its gains are, and the mean at its end is affine in the mean at its
start. So chunks give matrices, matrices are combined in order, chunks give affine maps, these are combined, and every chunk is
filtered with its own start. A chunk is one row of packed arrays, written once after one range shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.order import spread
from sparkreg.functions.storage import bounded_broadcast, materialise

_CHUNK = "part int, seq int, n long, t binary, y binary, ids binary"


def steps_of(t: np.ndarray, y: np.ndarray, before: float | None, noise: float, k: Callable[[float], float], exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(factor of the mean, factor of the variance, added variance, whether a value is seen) of every step; the very first step
    of a series has no time before it and changes nothing."""
    k0 = k(0.0)
    gaps = np.diff(t, prepend=t[0] if before is None else before)
    known, inverse = np.unique(gaps, return_inverse=True)
    at = np.array([k(float(d)) for d in known])[inverse]
    f, q = at / k0, k0 - at**2 / k0
    return f, (f * f if exact else np.ones(len(t))), q, ~np.isnan(y)


def variance_map(a: np.ndarray, q: np.ndarray, seen: np.ndarray, noise: float) -> np.ndarray:
    """The 2 x 2 matrix of all steps, the last one on the left, scaled to a largest entry of one."""
    m = np.zeros((len(a), 2, 2))  # predict [[a, q], [0, 1]]; then update [[noise, 0], [1, noise]] where a value is seen
    m[:, 0, 0], m[:, 0, 1] = np.where(seen, noise * a, a), np.where(seen, noise * q, q)
    m[:, 1, 0], m[:, 1, 1] = np.where(seen, a, 0.0), np.where(seen, q + noise, 1.0)
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else None
        m = m[1 : len(m) - len(m) % 2 : 2] @ m[0 : len(m) - len(m) % 2 : 2]
        m = m / np.abs(m).max(axis=(1, 2), keepdims=True)
        m = m if odd is None else np.concatenate([m, odd])
    return m[0]


def run_steps(f: np.ndarray, a: np.ndarray, q: np.ndarray, seen: np.ndarray, y: np.ndarray, noise: float, x: float, p: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(means, variances, factor of x in the last mean)."""
    means, variances, slope = np.empty(len(f)), np.empty(len(f)), 1.0
    for i, (fi, ai, qi, si, yi) in enumerate(zip(f.tolist(), a.tolist(), q.tolist(), seen.tolist(), y.tolist(), strict=True)):
        x, p, slope = fi * x, ai * p + qi, fi * slope
        if si:
            gain = p / (p + noise)
            x, p, slope = x + gain * (yi - x), (1 - gain) * p, (1 - gain) * slope
        means[i], variances[i] = x, p
    return means, variances, slope


def _numbers(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["t"]), np.frombuffer(row["y"])


def scan_filter(rows: DataFrame, k: Callable[[float], float], noise: float, key: str = "key", exact: bool = False, chunk_rows: int = 50_000) -> DataFrame:
    """(key, row_id, mean, variance) of every series in the order of feature, whatever its length."""
    kind = dict(rows.dtypes)[key]
    order = [F.col(key), F.col("feature"), F.col("row_id")]
    placed = rows.select(key, "row_id", "feature", "target").repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, rest = TaskContext.get().partitionId(), 0, None

        def made(own: pd.DataFrame) -> pd.DataFrame:
            columns = {c: [np.ascontiguousarray(own[name].to_numpy(kind)).tobytes()] for c, name, kind in (("t", "feature", float), ("y", "target", float), ("ids", "row_id", np.int64))}
            return pd.DataFrame({key: [own[key].iloc[0]], "part": part, "seq": seq, "n": len(own), **columns})

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            code = pd.factorize(pdf[key], use_na_sentinel=False)[0]
            ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(pdf))
            lo, rest = 0, None
            for end in ends.tolist():
                last = end == len(pdf)
                while end - lo >= (chunk_rows if last else 1):
                    hi = min(lo + chunk_rows, end)
                    yield made(pdf.iloc[lo:hi])
                    lo, seq = hi, seq + 1
            rest = pdf.iloc[lo:] if lo < len(pdf) else None
        if rest is not None:
            yield made(rest)

    chunks = materialise(placed.mapInPandas(pack, f"{key} {kind}, {_CHUNK}"), "chunks")

    # the step into a chunk spans the end of the one before: that end comes from a table of ends, one row a chunk
    def ends_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = [np.frombuffer(b) for b in pdf["t"]]
            yield pd.DataFrame({key: pdf[key], "part": pdf["part"], "seq": pdf["seq"], "first": [v[0] for v in t], "final": [v[-1] for v in t]})

    ends = chunks.select(key, "part", "seq", "t").mapInPandas(ends_of, f"{key} {kind}, part int, seq int, first double, final double")

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "seq"])
        return pdf.assign(before=pdf["final"].shift())[["part", "seq", "before"]]

    starts = materialise(spread(ends, key).groupBy(key).applyInPandas(before, "part int, seq int, before double"), "chunk-starts")

    def joined(table: DataFrame) -> DataFrame:
        return chunks.join(bounded_broadcast(table), ["part", "seq"])

    def known(row) -> float | None:
        return None if row["before"] is None or row["before"] != row["before"] else float(row["before"])

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.to_dict("records"):
                t, y = _numbers(row)
                _, a, q, seen = steps_of(t, y, known(row), noise, k, exact)
                found.append(variance_map(a, q, seen, noise).reshape(-1))
            yield pd.DataFrame({key: pdf[key], "part": pdf["part"], "seq": pdf["seq"], "before": pdf["before"], "m": found})

    def variances(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, p, out = pdf.sort_values(["part", "seq"]), float(k(0.0)), []
        for m in pdf["m"]:
            out.append(p)
            p = (m[0] * p + m[1]) / (m[2] * p + m[3])
        return pdf.assign(p=out)[["part", "seq", "before", "p"]]

    maps = joined(starts).select(key, "part", "seq", "t", "y", "before").mapInPandas(matrices, f"{key} {kind}, part int, seq int, before double, m array<double>")
    starts = materialise(spread(maps, key).groupBy(key).applyInPandas(variances, "part int, seq int, before double, p double"), "chunk-variances")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.to_dict("records"):
                t, y = _numbers(row)
                means, _, slope = run_steps(*steps_of(t, y, known(row), noise, k, exact), y, noise, 0.0, row["p"])
                found.append((slope, means[-1]))
            yield pd.DataFrame({key: pdf[key], "part": pdf["part"], "seq": pdf["seq"], "before": pdf["before"], "p": pdf["p"], "slope": [s for s, _ in found], "offset": [o for _, o in found]})

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, out = pdf.sort_values(["part", "seq"]), 0.0, []
        for slope, offset in zip(pdf["slope"], pdf["offset"], strict=True):
            out.append(x)
            x = slope * x + offset
        return pdf.assign(x=out)[["part", "seq", "before", "p", "x"]]

    maps = joined(starts).select(key, "part", "seq", "t", "y", "before", "p").mapInPandas(lines, f"{key} {kind}, part int, seq int, before double, p double, slope double, offset double")
    starts = materialise(spread(maps, key).groupBy(key).applyInPandas(means, "part int, seq int, before double, p double, x double"), "chunk-means")

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                t, y = _numbers(row)
                m, v, _ = run_steps(*steps_of(t, y, known(row), noise, k, exact), y, noise, row["x"], row["p"])
                own = row[key] if row[key] is not None and row[key] == row[key] else None
                yield pd.DataFrame({key: pd.Series([own] * len(t), dtype=object if own is None else None), "row_id": np.frombuffer(row["ids"], np.int64), "mean": m, "variance": v})

    return joined(starts).mapInPandas(filtered, f"{key} {kind}, row_id long, mean double, variance double")
