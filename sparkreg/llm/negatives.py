"""Hard negatives: threshold joins of anchors with all rows, in the manner of L2AP, with thresholds that fall until windows fill.

Scores are inner products of integer vectors (components times ``scale``, rounded down). A search has a threshold for each anchor:

* Index. Dimensions stand in ascending order of their mean square. The first dimensions of a row, as long as the norm of that
  prefix times the largest norm of an anchor's prefix is below the threshold, are left out of the inverted lists: they alone
  cannot reach it.
* Accumulation. Lists are read from the last dimension to the first, a few together; a pair whose partial score plus the
  product of the norms that remain stays below the threshold is dropped. While most pairs live the sums are a dense block,
  later a list of pairs.
* Check. Pairs that are left get their exact integer score.

First every anchor looks for its best rows of the same label; each of those makes a window of scores in which the best rows of
another label are wanted. A threshold starts where a normal tail with the moments of a bounded sample expects a few more rows
than are wanted; anchors and windows that did not fill search again with a lower one, at last with none (the window's end).
The sample decides how much work is done, never what is found.

Anchors are the query set: they are sent in blocks of bounded bytes; a task holds a few thousand rows at a time and gives back
no more rows a window than are wanted.

Defined cases: rows with a null label or vector, or a null, NaN or infinite component take no part, nor do vectors whose
integer norm reaches 2^28 (per cents of their scores would not fit); shorter vectors count as ending in zeros; rows with the anchor's own id
are not its partners; repeated rows are rows of their own; an anchor that is repeated counts once; equal scores are ordered by
id, nulls last; a negative positive score has an empty window; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.functions.storage import bounded_broadcast, materialise

SAMPLE = 2_000  # rows whose scores set the first thresholds
BLOCK_BYTES = 32 << 20  # of anchors that are sent together
TILE_ROWS, TILE_ANCHORS, LIST_STEP = 4096, 512, 8
DENSE = 0.15  # share of living pairs above which sums stay a block
WIDER = 8  # times as many rows are expected a round
ROUNDS = 3  # before the one without a threshold
LIMIT = float(1 << 28)
_MOST = (1 << 63) - 1
_NORMAL = NormalDist()


def _prefix_norms(x: np.ndarray) -> np.ndarray:
    """(n, d + 1): norms of the first 0 .. d components."""
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1))


def _dots(a: np.ndarray, y: np.ndarray, i: np.ndarray, k: np.ndarray, exact: bool, step: int = 20_000) -> np.ndarray:
    """Integer scores of the pairs (i, k); exact: doubles hold every sum."""
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), step):
        p, q = a[i[lo : lo + step]], y[k[lo : lo + step]]
        out[lo : lo + step] = np.einsum("pj,pj->p", p, q) if exact else (p.astype(np.int64) * q.astype(np.int64)).sum(1)
    return out


def threshold_join(a: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score is at least the anchor's threshold; a and y hold integers as doubles."""
    none = np.empty(0, np.int64)
    if not len(a) or not len(y):
        return none, none, none
    na, ny, d = _prefix_norms(a), _prefix_norms(y), a.shape[1]
    exact = float(na[:, -1].max()) * float(ny[:, -1].max()) < 2.0**52
    least = float(t.min())
    slack = 1e-9 * (1 + float(na[:, -1].max()) * float(ny[:, -1].max())) if not exact else 1e-3
    start = (ny[:, 1:] * na[:, 1:].max(0) < least - slack).sum(1) if least > 0 else np.zeros(len(y), np.int64)
    rows = np.argsort(start, kind="stable")
    rows = rows[: int(np.searchsorted(start[rows], d))]  # others have no list at all
    start, own, ny = start[rows], y[rows], ny[rows]
    lists = np.where(np.arange(d) >= start[:, None], own, 0.0)
    sums = np.zeros((len(a), len(rows)))
    left_i, left_k = [none], [none]
    pairs = None
    for hi in range(d, 0, -LIST_STEP):
        lo = max(0, hi - LIST_STEP)
        here, after = (int(np.searchsorted(start, x)) for x in (hi, lo))  # rows in these lists, and in those to come
        if pairs is None:
            sums[:, :here] += a[:, lo:hi] @ lists[:here, lo:hi].T
            ended = np.arange(after, here)
            i, k = np.nonzero(sums[:, after:here] + na[:, start[ended]] * ny[ended, start[ended]] >= t[:, None] - slack)
            left_i.append(i)
            left_k.append(k + after)
            if lo == 0:
                i, k = np.nonzero(sums[:, :after] >= t[:, None] - slack)
                left_i.append(i)
                left_k.append(k)
            elif 2 * lo <= d and least > -math.inf:
                alive = sums[:, :after] + np.outer(na[:, lo], ny[:after, lo]) >= t[:, None] - slack
                if alive.mean() < DENSE if alive.size else True:
                    i, k = np.nonzero(alive)
                    pairs = (i, k, sums[i, k])
        else:
            i, k, s = pairs
            s = s + np.einsum("pj,pj->p", a[i, lo:hi], lists[k, lo:hi])
            at = np.maximum(start[k], lo)
            alive = s + na[i, at] * ny[k, at] >= t[i] - slack
            i, k, s = i[alive], k[alive], s[alive]
            ended = start[k] >= lo
            left_i.append(i[ended])
            left_k.append(k[ended])
            pairs = (i[~ended], k[~ended], s[~ended])
            if lo == 0:
                left_i.append(pairs[0])
                left_k.append(pairs[1])
    i, k = np.concatenate(left_i), np.concatenate(left_k)
    score = _dots(a, own, i, k, exact)
    keep = score >= t[i] - slack * (not exact)
    return i[keep], rows[k[keep]], score[keep]


def _first(group: np.ndarray, score: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Indices of the best ``most`` of each group, by score and then row."""
    order = np.lexsort((row, -score, group))
    g = group[order]
    begins = np.flatnonzero(np.diff(g, prepend=-1)) if len(g) else np.empty(0, np.int64)
    place = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
    return order[place < most]


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    """(n, d) of a column of lists, with zeros behind shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), d))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _codes(labels: list, known: dict) -> np.ndarray:
    return np.fromiter((known.get(x, -1) for x in labels), np.int64, len(labels))


class _Block:
    """Anchors of one block, ready for joins."""

    def __init__(self, table: pa.Table, d: int, order: np.ndarray) -> None:
        self.a = table.column("a").to_numpy()
        self.ids = table.column("id").to_pylist()
        self.x = _vectors(table.column("q"), d)[:, order]
        self.known: dict = {}
        self.label = np.fromiter((self.known.setdefault(x, len(self.known)) for x in table.column("label").to_pylist()), np.int64, len(table))
        self.t = table.column("t").to_numpy()
        self.windows = [np.stack(list(map(np.asarray, table.column(c).to_pylist()))) for c in ("w_t", "w_hi")] if "w_t" in table.column_names and len(table) else None


def _hits(block: _Block, ids: list, y: np.ndarray, label: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) at or above the anchors' thresholds, among rows of the same label or of others."""
    found = []
    groups = [(np.flatnonzero(block.label == g), np.flatnonzero(label == g)) for g in np.unique(label[label >= 0])] if same else [(np.arange(len(block.x)), np.arange(len(y)))]
    for anchors, rows in groups:
        anchors = anchors[np.argsort(-block.t[anchors], kind="stable")]  # tiles of like thresholds
        for lo in range(0, len(rows), TILE_ROWS):
            own = rows[lo : lo + TILE_ROWS]
            for at in range(0, len(anchors), TILE_ANCHORS):
                tile = anchors[at : at + TILE_ANCHORS]
                i, k, s = threshold_join(block.x[tile], y[own], block.t[tile])
                found.append((tile[i], own[k], s))
    i, k, s = (np.concatenate([f[c] for f in found] or [np.empty(0, np.int64)]) for c in range(3))
    keep = np.fromiter((block.ids[p] != ids[q] for p, q in zip(i.tolist(), k.tolist(), strict=True)), bool, len(i)) if same else label[k] != block.label[i]
    return i[keep], k[keep], s[keep]


def _search(rows: DataFrame, anchors: DataFrame, d: int, order: np.ndarray, most: int, same: bool) -> DataFrame:
    """(a, w, score, id): for each anchor (w = 0) or window the best rows above its threshold, ``most`` at most."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["id"]
    blocks = max(1, -(-anchors.count() * (8 * d + 200) // BLOCK_BYTES))
    parts = []
    for b in range(blocks):  # the query set goes to the tasks a block at a time
        own = anchors if blocks == 1 else anchors.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast(own.toArrow())

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = _Block(sent.value, d, order)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                by_id = sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] if ids[r] is not None else 0))
                batch, ids = batch.take(pa.array(by_id, pa.int64())), [ids[r] for r in by_id]
                y, label = _vectors(batch.column(2), d)[:, order], _codes(batch.column(1).to_pylist(), block.known)
                i, k, s = _hits(block, ids, y, label, same)
                if block.windows is None:
                    picks = [(0, _first(i, s, k, most))]
                else:
                    w_t, w_hi = block.windows
                    picks = []
                    for w in range(w_t.shape[1]):
                        inside = np.flatnonzero((s >= w_t[i, w]) & (s <= w_hi[i, w]))
                        picks.append((w, inside[_first(i[inside], s[inside], k[inside], most)]))
                at = np.concatenate([p for _, p in picks])
                w = np.repeat([w for w, _ in picks], [len(p) for _, p in picks]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(block.a[i[at]], pa.int64()), pa.array(w), pa.array(s[at], pa.int64()), batch.column(0).take(pa.array(k[at]))], names=["a", "w", "score", "id"])

        parts.append(materialise(rows.mapInArrow(scan, f"a long, w int, score long, id {kind}"), "negative-hits"))
        sent.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    place = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return materialise(out.withColumn("place", place).where(F.col("place") <= most), "negative-best")


def _tail(p: float) -> float:
    """The normal quantile above which a share p lies."""
    return -math.inf if p >= 1 else -_NORMAL.inv_cdf(p)


def first_thresholds(mu: float, sd: float, rows: int, wanted: int) -> list[float]:
    """A threshold for each round: more and more rows are expected above it; at last none."""
    if sd <= 0 or rows < 1:
        return [-math.inf] * (ROUNDS + 1)
    return [mu + sd * _tail(4 * max(1, wanted) * WIDER**r / rows) for r in range(ROUNDS)] + [-math.inf]


def window_thresholds(mu: float, sd: float, rows: int, wanted: int, lo: int, hi: int) -> list[float]:
    """The same below the upper end of a window; at last its lower end."""
    if sd <= 0 or rows < 1:
        return [float(lo)] * (ROUNDS + 1)
    above = 0.5 * math.erfc((hi - mu) / sd / math.sqrt(2))
    return [max(float(lo), math.floor(mu + sd * _tail(above + 2.5 * wanted * WIDER**r / rows)) if above + 2.5 * wanted * WIDER**r / rows < 1 else float(lo)) for r in range(ROUNDS)] + [float(lo)]


def integer_rows(vectors: DataFrame, scale: float, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, q, and the anchor mark) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LIMIT))
    taken = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
    q = F.transform(v, lambda x: F.floor(x * float(scale)))
    norm = F.aggregate(F.col("q"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return taken.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), q.alias("q"), "__anchor").where(norm < LIMIT**2)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor its best ``positives`` rows of the same label, and for each of those the best ``negatives`` rows of another
    label whose score is low to high per cent of the positive's.
    """
    spark = vectors.sparkSession
    marked = integer_rows(vectors.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False))), scale, id_col, label_col, vector_col)
    marked = marked.select("id", "label", F.col("q").cast("array<int>").alias("q"), "__anchor")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(marked.repartition(tasks), "vectors")
    labels = materialise(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"), F.max(F.size("q")).alias("d")), "labels")
    held = labels.agg(F.sum("n_label").alias("n"), F.max("d").alias("d")).first()
    n, d = held.n or 0, max(1, held.d or 0)
    sample = _vectors(rows.where(F.rand(7) < 2 * SAMPLE / max(1, n)).limit(SAMPLE).select("q").toArrow().column(0), d) if n else np.zeros((0, d))
    order = np.argsort((sample**2).sum(0), kind="stable")
    seen = spark.sparkContext.broadcast(sample)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, s = _vectors(batch.column(2), d), seen.value
            mu, sd = np.zeros(len(x)), np.zeros(len(x))
            for lo in range(0, len(x) if len(s) else 0, 1000):
                scores = x[lo : lo + 1000] @ s.T
                mu[lo : lo + 1000], sd[lo : lo + 1000] = scores.mean(1), scores.std(1)
            ts = [first_thresholds(m, v, c, positives) for m, v, c in zip(mu, sd, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mu), pa.array(sd), pa.array(ts, pa.list_(pa.float64()))], names=["id", "label", "q", "n_label", "mu", "sd", "ts"])

    kinds = dict(rows.dtypes)
    asked = rows.where("__anchor").select("id", "label", "q").distinct().join(bounded_broadcast(labels.select("label", "n_label")), "label").select("id", "label", "q", "n_label")
    asked = asked.mapInArrow(moments, f"id {kinds['id']}, label {kinds['label']}, q array<int>, n_label long, mu double, sd double, ts array<double>")
    anchors = materialise(asked.withColumn("a", F.monotonically_increasing_id()), "anchors")
    targets = rows.select("id", "label", "q")

    found, waiting = None, anchors
    for r in range(ROUNDS + 1):
        best = _search(targets, waiting.select("a", "id", "label", "q", F.col("ts")[r].alias("t")), d, order, positives, True)
        full = best.groupBy("a").agg(F.count(F.lit(1)).alias("got"))
        judged = materialise(waiting.join(full, "a", "left").withColumn("full", (F.coalesce("got", F.lit(0)) >= F.least(F.lit(positives), F.col("n_label") - 1)) | F.lit(r == ROUNDS)), "anchors-left")
        part = best.join(judged.where("full").select("a"), "a", "left_semi")
        found = part if found is None else found.union(part)
        waiting = judged.where("not full").drop("got", "full")
        if not waiting.limit(1).count():
            break

    low_end, high_end = F.expr(f"({low} * score + 99) div 100"), F.expr(f"({high} * score) div 100")
    positive = found.select("a", F.col("place").alias("w"), F.col("id").alias("positive_id"), "score").join(anchors, "a")
    positive = positive.where("score >= 0").withColumn("lo", low_end).withColumn("hi", high_end)

    @F.pandas_udf("array<double>")
    def levels(mu: pd.Series, sd: pd.Series, count: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([window_thresholds(*x[:3], negatives, *x[3:]) for x in zip(mu, sd, count, lo, hi, strict=True)])

    windows = materialise(positive.select("a", "w", "positive_id", "score", "lo", "hi", "id", "label", levels("mu", "sd", F.lit(n) - F.col("n_label"), "lo", "hi").alias("ts")), "windows")
    chosen, waiting = None, windows
    for r in range(ROUNDS + 1):
        at = F.sort_array(F.collect_list(F.struct("w", F.ceil(F.col("ts")[r]).alias("t"), "hi")))  # at most ``positives``
        each = waiting.groupBy("a").agg(at.alias("ws")).join(anchors.select("a", "id", "label", "q"), "a")
        slots = F.sequence(F.lit(1), F.lit(positives))  # windows that are full or absent take no score

        def of(slot: Column, field: str) -> Column:
            return F.coalesce(F.get(F.filter("ws", lambda x: x["w"] == slot), F.lit(0))[field], F.lit(_MOST if field == "t" else -_MOST))

        each = each.withColumn("w_t", F.transform(slots, lambda k: of(k, "t"))).withColumn("w_hi", F.transform(slots, lambda k: of(k, "hi")))
        each = materialise(each.select("a", "id", "label", "q", F.array_min("w_t").cast("double").alias("t"), "w_t", "w_hi"), "open-windows")
        best = _search(targets, each, d, order, negatives, False).withColumn("w", F.col("w") + 1)
        full = best.groupBy("a", "w").agg(F.count(F.lit(1)).alias("got"))
        ended = (F.coalesce("got", F.lit(0)) >= negatives) | (F.col("ts")[r] <= F.col("lo"))
        judged = materialise(waiting.join(full, ["a", "w"], "left").withColumn("full", ended), "windows-left")
        part = best.join(judged.where("full").select("a", "w"), ["a", "w"], "left_semi")
        chosen = part if chosen is None else chosen.union(part)
        waiting = judged.where("not full").drop("got", "full")
        if not waiting.limit(1).count():
            break
    named = chosen.select("a", "w", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(windows.select("a", "w", F.col("id").alias("anchor_id"), "positive_id", F.col("score").alias("positive_score")), ["a", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
