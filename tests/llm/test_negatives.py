"""Hard negatives against all pairs, and threshold joins against products."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkreg.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int, a int"


def table(n=400, d=12, labels=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[: n // 3] = x[0]  # a third of the rows is one vector
    x[10:20] = x[0] + 0.05 * rng.standard_normal((10, d))
    out = [[k, v.tolist(), int(rng.integers(labels))] for k, v in enumerate(x)]
    out[50][1] = None
    out[51][2] = None
    out[52][1] = [*out[52][1][:-1], float("nan")]
    out[53][1] = [*out[53][1][:-1], float("inf")]
    out[54][1] = [*out[54][1][:-1], None]
    out[55][1] = []
    out[56][1] = out[56][1][:5]
    out[57][1] = [1e9] * d
    out[60][2] = 77  # a label of its own
    out += [out[30], out[30], [None, out[31][1], 2], [40, out[32][1], 1]]  # repeated rows, no id, an id with another vector
    return [(*r, "own id", 5, 6) for r in out]


def plain(rows, anchor, positives=5, most=10, low=30, high=90):
    """Of all pairs: (anchor, positive, rank, negative, scores)."""
    d = max((len(r[1]) for r in rows if r[1]), default=1)
    taken = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) or abs(x) > 1e6 for x in v):
            continue
        q = np.zeros(d, object)
        q[: len(v)] = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        taken.append((i, label, q))
    out, key = [], lambda x: (-x[1], x[0] is None, x[0] or 0)
    for i, label, q in {(i, lab, tuple(q)): (i, lab, q) for i, lab, q in taken if i is not None and anchor(i)}.values():
        scored = [(j, int(q @ p), lab) for j, lab, p in taken if j != i]
        for pid, ps, _ in sorted([s for s in scored if s[2] == label], key=key)[:positives]:
            inside = sorted([s for s in scored if s[2] != label and low * ps <= 100 * s[1] <= high * ps], key=key)[:most]
            out += [(i, pid, rank, nid, ps, ns) for rank, (nid, ns, _) in enumerate(inside, 1)]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)) for r in df.collect())


@pytest.mark.parametrize("seed", [3, 4])
def test_agrees_with_all_pairs(spark, seed):
    data = table(seed=seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)) == plain(data, lambda i: i % 10 == 0)


def test_blocks_of_anchors_and_thresholds_that_fall(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(negatives, "first_thresholds", lambda mu, sd, rows, wanted: [1e5, 3e4, 1e4, -np.inf])
    monkeypatch.setattr(negatives, "window_thresholds", lambda mu, sd, rows, wanted, lo, hi: [float(hi), max(lo, 0.95 * hi), max(lo, 0.8 * hi), float(lo)])
    data = table(250, 7, 4, 8)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert got(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, positives=3, negatives=4, low=20, high=80)) == plain(data, lambda i: i % 10 == 0, 3, 4, 20, 80)


def test_empty_tables_and_no_anchor(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame(table(70), SCHEMA), F.lit(False)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(0, None, 1, "", 0, 0), (10, None, 1, "", 0, 0)], SCHEMA), F.lit(True)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 60), st.integers(1, 50), st.floats(-2, 2), st.booleans())
def test_threshold_join_loses_nothing(seed, m, n, d, level, huge):
    rng = np.random.default_rng(seed)
    scale = 2e6 if huge else 100
    a, y = np.floor(rng.standard_normal((m, d)) * scale), np.floor(rng.standard_normal((n, d)) * scale * rng.choice([0.0, 0.3, 1.0], (n, d)))
    t = level * scale**2 * np.sqrt(d) * rng.random(m)
    t[0] = -np.inf if seed % 3 == 0 else t[0]
    i, k, s = negatives.threshold_join(a, y, t)
    scores = a.astype(np.int64) @ y.astype(np.int64).T
    assert (scores[i, k] == s).all()
    found = set(zip(i.tolist(), k.tolist(), strict=True))
    assert len(found) == len(i) and found >= set(zip(*np.nonzero(scores >= t[:, None] + 1e-6 * scale**2 * huge), strict=True))
    if not huge:
        assert found == set(zip(*np.nonzero(scores >= t[:, None]), strict=True))


def test_lists_leave_out_what_norms_cover():
    """High thresholds leave few sums: rows whose norm cannot reach them have no list."""
    a, y = np.full((1, 16), 10.0), np.concatenate([np.full((5, 16), 10.0), np.full((5, 16), 1.0)])
    i, k, s = negatives.threshold_join(a, y, np.array([1000.0]))
    assert sorted(k.tolist()) == [0, 1, 2, 3, 4] and set(s.tolist()) == {1600}
