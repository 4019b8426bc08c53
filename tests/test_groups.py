"""Many small groups: calls are for batches of groups, not for each; results are those of a group by itself."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkreg.functions import kernels as KF
from sparkreg.functions.order import spread
from sparkreg.operators import gp as GP
from sparkreg.operators import graph as GR
from sparkreg.operators import sparse_gp as SG
from sparkreg.streaming import updates as U

K = KF.exponential(3.0, 2.0) + KF.measurement_noise(0.5)


def counting(spark):
    """A mean of zero and the number of its calls."""
    calls = spark.sparkContext.accumulator(0)

    def mean(x):
        calls.add(1)
        return np.zeros(len(x))

    return mean, calls


def some(n, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"row_id": np.arange(n), "feature": rng.uniform(0, 50, n), "target": rng.normal(size=n), "target_variance": rng.uniform(0.1, 1, n)})


def test_sparse_blocks_are_predicted_together(spark):
    rows = some(600)
    rows["block"] = np.sort(np.random.default_rng(1).integers(0, 400, 600))
    x, y, v = (rows[c].to_numpy() for c in ("feature", "target", "target_variance"))
    fit = SG.SparseFit.prior(K, np.linspace(0, 50, 9))
    part = SG._block(K, fit.u, fit.prior_root, rows, GP.zero, 1e-12)
    fit = fit.plus(SG.triangle(part[0]), part[1], part[2], len(rows))
    mean, calls = counting(spark)
    got = SG.predict_sparse_gp_joint(spark.createDataFrame(rows).repartition(3), K, fit, "block", mean).toPandas().sort_values(["block", "i", "j"])
    assert calls.value < 60  # a call a block were about 300
    m, c = fit.joint(K, x)
    assert len(got) == int((rows.groupby("block").size() ** 2).sum())
    np.testing.assert_allclose(got["mean"], m[got.i], atol=1e-9)
    np.testing.assert_allclose(got["cov"], c[got.i, got.j], atol=1e-9)
    with pytest.raises(Exception, match="has 12 rows; at most 5"):
        SG.predict_sparse_gp_joint(spark.createDataFrame(rows[:12].assign(block=1)), K, fit, "block", max_rows=5).collect()


def test_growth_takes_one_factorisation():
    rows, calls = some(80, 3), []
    counted = KF.Kernel(K.form, lambda *a: calls.append(1) or K.value(*a), K.own)
    x, y, v = GP.arrays(rows)
    got = U.grow(counted, x, y, v)
    assert len(calls) < 10  # a row a call were 240
    for a, b in zip(got, U.grow_by_row(K, x, y, v), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_growth_of_odd_rows():
    x, y, v = np.array([1.0, 1.0, 2.0, 5.0]), np.array([1.0, 2.0, np.nan, 0.5]), np.array([0.0, 0.0, 0.1, 0.1])
    plain = KF.exponential(3.0, 2.0)
    for a, b in zip(U.grow(plain, x, y, v), U.grow_by_row(plain, x, y, v), strict=True):  # a row twice without noise; no target
        np.testing.assert_array_equal(a, b)
    assert np.isfinite(U.grow(plain, x, y, v)[0][:2]).all()


def test_spread_is_kept_after_a_window(spark):
    rows = spark.range(1000).withColumn("key", F.col("id") % 40).groupBy("key").agg(F.max("id").alias("row_id"))
    assert spread(rows, "key").rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_forests_of_parts_leave_few_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.integers(0, 60, 6000), "b": rng.integers(60, 120, 6000), "cost": rng.integers(0, 50, 6000).astype(float), "id": np.arange(6000)})
    df = spark.createDataFrame(pdf).withColumn("w", F.col("cost"))
    left = GR._parts(df, 2).toPandas()
    assert len(left) < 1500  # all edges went into every round
    want = GR.kept_edges(pdf.assign(w=pdf["cost"]))
    assert len(want) == 119 and set(want["id"]) <= set(left["id"])
    assert {r.id for r in GR.spanning_forest(df.drop("w")).collect()} == set(want["id"])
    monkeypatch.setattr(GR, "_HELD_EDGES", 100)  # more is left than a task may hold: rounds of joins
    assert {r.id for r in GR.spanning_forest(df.drop("w")).collect()} == set(want["id"])


def test_forest_of_edges_without_cost(spark):
    rows = [(1, 2, None, 1), (1, 2, 3.0, 2), (2, 3, float("nan"), 3), (2, 3, 1.0, 4), (3, 4, 2.0, None), (3, 4, 2.0, 5)]
    df = spark.createDataFrame(rows, "a int, b int, cost double, id int")
    assert sorted((r.a, r.b, r.cost, r.id or 0) for r in GR.spanning_forest(df).where("cost is not null").collect()) == [(2, 3, 1.0, 4), (3, 4, 2.0, 0)]
    assert [(r.a, r.b, r.id) for r in GR.spanning_forest(df).where("cost is null").collect()] == [(1, 2, 1)]


def test_sides_meet_in_batches(spark):
    left = spark.createDataFrame([(1, 5, [1.0]), (2, 6, [2.0]), (None, 7, [3.0]), (4, 8, [4.0])], "key long, n long, x array<double>")
    right = spark.createDataFrame([(1, 2**60 + 2, 2.0), (1, 2**60 + 1, 1.0), (None, 2**60 + 3, 3.0), (9, 2**60 + 4, 4.0)], "key long, row_id long, feature double")

    def f(row, own):
        return pd.DataFrame({"n": [-1 if row is None else row["n"]], "x": [0.0 if row is None else row["x"][0]], "ids": [own["row_id"].to_numpy()]})

    schema = "n long, x double, ids array<long>"
    for width in (GP._WIDE_BYTES, 0):  # as one table, and as a cogroup
        before, GP._WIDE_BYTES = GP._WIDE_BYTES, width
        try:
            df = GP.by_key(left, right, f, schema, ["key"])
            got = sorted((r.n, r.x, list(r.ids)) for r in df.collect())
        finally:
            GP._WIDE_BYTES = before
        assert got == [(-1, 0.0, [2**60 + 4]), (5, 1.0, [2**60 + 1, 2**60 + 2]), (6, 2.0, []), (7, 3.0, [2**60 + 3]), (8, 4.0, [])]
        assert ("CoGroup" in df._jdf.queryExecution().toString()) == (width == 0)
