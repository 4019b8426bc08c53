"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are binned; cyclic boosting visits the features in turn and adds a shallow tree (four leaves)
of the current residual to that feature's lookup table, then does the same over the strongest pairs of features on coarser
bins. A score is the sum of table entries, looked up for whole batches at once, through the logistic function.

Training takes about ``max_rows`` labelled rows at most (those in a share of the range of a hash of the id, so reruns agree); features are computed
for, and scores given to, all rows. The features see the text alone.

Defined cases: null text counts as empty; texts of any length are measured whole; a feature equal to a bin's edge lies in the
upper bin; ids of any type are kept, and rows that repeat an id are scored each; other columns are ignored; of several labels of an id the largest holds; null labels are not used; a null
id is held out (as the empty text's checksum is 0); without labels, or with one class alone, every score is the smoothed
share of label 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreg.functions.storage import materialise
from sparkreg.llm.rules import measured_docs
from sparkreg.llm.textstats import COUNTS

FEATURES = ("log_words", "word_length", "symbols", "marks", "upper", "digits", "distinct", "top_word", "repeats", "dup_lines", "line_words", "spaces")


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The FEATURES of rows of textstats, one column each."""
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_marks"] / chars, c["n_upper"] / chars, c["n_digits"] / chars,
        c["n_distinct"] / words, c["n_top"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_words"] / lines, (c["n_chars"] - c["word_chars"]) / np.maximum(c["n_chars"], 1),
    ])


@dataclass
class Model:
    """base + sum of main[f][bin of f] + sum of pair tables[bin of f, bin of g]."""

    base: float
    edges: list[np.ndarray]
    main: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.main, strict=True)):
            z += table[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.tables, strict=True):
            z += table[np.searchsorted(self.coarse[f], x[:, f], side="right"), np.searchsorted(self.coarse[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best split of a row of bins; place 0: none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Leaf values of a shallow tree over bins."""
    at = _cut(g, h, ridge)[1] if depth else 0
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], ridge, depth - 1), _tree(g[at:], h[at:], ridge, depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values over a grid of two features: the better first axis is split, each side along the other axis."""
    rows, columns = _cut(g.sum(1), h.sum(1), ridge), _cut(g.sum(0), h.sum(0), ridge)
    if columns[0] > rows[0]:
        return _tree2(g.T, h.T, ridge).T if rows[0] < columns[0] and columns[1] else np.zeros_like(g)
    at = rows[1] or max(1, len(g) // 2)
    sides = [np.broadcast_to(_tree(g[s].sum(0), h[s].sum(0), ridge, 1), g[s].shape) for s in (slice(0, at), slice(at, None)) if len(g[s])]
    return np.concatenate(sides)


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 250, rate: float = 0.08, bins: int = 64, pair_bins: int = 12, n_pairs: int = 6, ridge: float = 2.0) -> Model:
    """Cyclic boosting of the logistic loss: all features, then the n_pairs strongest pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [_edges(x[:, f], bins) if len(x) else np.empty(0) for f in range(x.shape[1])]
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    place = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, at in enumerate(place):
            g, h = slopes()
            step = rate * _tree(np.bincount(at, g, len(edges[f]) + 1), np.bincount(at, h, len(edges[f]) + 1), ridge)
            model.main[f] += step
            z += step[at]
    model.coarse = [_edges(x[:, f], pair_bins) for f in range(x.shape[1])]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    size = [len(e) + 1 for e in model.coarse]
    g, h = slopes()

    def grid(f: int, k: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[f] * size[k] + rough[k], v, size[f] * size[k]).reshape(size[f], size[k])

    gains = {(f, k): float((_tree2(grid(f, k, g), grid(f, k, h), ridge) * grid(f, k, g)).sum()) for f in range(len(size)) for k in range(f + 1, len(size))}
    model.pairs = sorted(gains, key=gains.get, reverse=True)[:n_pairs]
    model.tables = [np.zeros((size[f], size[k])) for f, k in model.pairs]
    for _ in range(rounds // 4):
        for (f, k), table in zip(model.pairs, model.tables, strict=True):
            g, h = slopes()
            step = rate * _tree2(grid(f, k, g), grid(f, k, h), ridge)
            table += step
            z += step[rough[f], rough[k]]
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 5, threshold: float = 0.3, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    rest = F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds, F.lit(0))
    slim = materialise(measured_docs(docs, [F.col(id_col).alias("doc_id"), (rest == 0).alias("held_out")], text_col), "gam-features")
    known = labels.where("quality is not null").groupBy(F.col(id_col).cast("string").alias("__id")).agg(F.max("quality").alias("__y"))
    train = materialise(slim.where("not held_out").join(known, F.col("doc_id").cast("string") == F.col("__id")).select("doc_id", "__y", *COUNTS), "gam-labelled")
    # a cut of the hash range keeps about max_rows rows before any leave their task; 1.1 leaves room for chance
    share = min(1.0, max_rows / max(1, train.count()))
    train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(int(1.1 * max_rows)).toPandas()
    train = train.sort_values(["doc_id", *COUNTS])
    model = fit(features({c: train[c].to_numpy(float) for c in COUNTS}), train["__y"].to_numpy(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features({c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in COUNTS}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
