"""Kernel trees with measured and latent sides, features of several kinds, constraints, and rows whose fold is null."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkreg.functions import kernels as KF
from sparkreg.functions import storage
from sparkreg.functions import typed as TY
from sparkreg.operators import crossval as CV
from sparkreg.operators import gp as GP
from sparkreg.operators import pairs as P

ROWS = "key long, row_id long, feature double, target double, target_variance double, fold int"
RNG = np.random.default_rng(4)


def rows_of(n=30, keys=2, null_folds=True):
    out = []
    for k in range(keys):
        for i in range(n):
            x = 0.3 * i
            out.append((k, i, x, float(np.sin(x) + 0.1 * RNG.standard_normal()), 0.01 + 0.001 * (i % 3), None if null_folds and i % 3 == 0 else i % 3))
    return out


# ---- trees


def plain_exponential(x, y, length=5.0, sigma=2.0):
    return sigma**2 * np.exp(-np.abs(x[:, None] - y[None, :]) / length)


@pytest.mark.parametrize("shape", ["sum", "product", "product on the right", "nested"])
def test_noise_keeps_its_place_in_sums_and_products(shape):
    x, y = np.array([0.0, 1.0, 1.0, 4.0]), np.array([1.0, 2.0, 0.0])
    a, noise, c = KF.exponential(5, 2), KF.measurement_noise(1), KF.constant(3)
    k = {"sum": a + noise, "product": (a + noise) * c, "product on the right": c * (a + noise), "nested": (a + noise) * c + KF.measurements_of(KF.polynomial([1.0, 0.5]))}[shape]
    same = x[:, None] == y[None, :]
    smooth = plain_exponential(x, y)
    want = {"sum": (smooth, smooth + same), "product": (9 * smooth, 9 * (smooth + same)), "product on the right": (9 * smooth, 9 * (smooth + same)), "nested": (9 * smooth, 9 * (smooth + same) + 1 + 0.25 * np.outer(x, y))}[shape]
    np.testing.assert_allclose(k.matrix(x, y), want[0])
    np.testing.assert_allclose(k.measured(x, y), want[1])
    mx, my = np.array([True, False, True, True]), np.array([True, True, False])
    np.testing.assert_allclose(k.between(x, y, mx, my), np.where(np.outer(mx, my), want[1], want[0]))
    for flag in (False, True, mx):
        np.testing.assert_allclose(k.diagonal(x, flag), np.diag(k.between(x, x, flag, flag)))


def test_both_forms_of_a_tree_agree(spark):
    k = (KF.exponential(5, 2) + KF.measurement_noise(1)) * KF.constant(3) + KF.measurements_of(KF.squared_exponential(2, 1))
    data = [(1, i, (0.5 * (i // 2), i % 3 > 0)) for i in range(8)]
    df = spark.createDataFrame(data, "group long, i long, f struct<x: double, m: boolean>")
    got = P.within_groups(df, lambda a, b: k.form(a["x"], b["x"], a["m"], b["m"]), feature="f").toPandas()
    x, m = np.array([r[2][0] for r in data]), np.array([r[2][1] for r in data])
    want = k.between(x, x, m, m)
    np.testing.assert_allclose(got["cov"], want[got.i, got.j])


def test_product_does_not_look_right_of_a_zero():
    bad = KF.Kernel.of(None, lambda x, y: np.full((len(x), len(y)), np.inf))
    assert (KF.constant(0) * bad).matrix(np.zeros(2), np.zeros(3)).tolist() == [[0.0] * 3] * 2


@pytest.mark.parametrize("kernel", [KF.squared_exponential(2, 3), KF.exponential(2, 3), KF.matern_32(2, 3), KF.matern_52(2, 3), KF.constant(2), KF.polynomial([1, 2, 0.5]), KF.independent_noise(2), KF.scaling(None, lambda x: 1 + x), KF.squared_exponential(2, 3, "radial")])
def test_diagonals(kernel):
    x = np.array([0.0, 1.0, 1.0, -2.0, 7.0])
    np.testing.assert_allclose(kernel.diagonal(x), np.diag(kernel.matrix(x, x)))


def test_vector_distances_a_dimension_at_a_time():
    x, y = RNG.standard_normal((7, 3)), RNG.standard_normal((5, 3))
    np.testing.assert_allclose(KF._pairwise(x, y), np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)))


# ---- typed features

TYPED = KF.of_kind("time", KF.exponential(5, 2) + KF.measurement_noise(0.1)) + KF.by_kind({("bias", "bias"): KF.independent_noise(1.5), ("time", "place"): KF.constant(0.5), ("place", "place"): KF.squared_exponential(2, 1)})


def test_combinations_agree_with_sums_over_terms():
    rows = [[("time", 1.0, 1.0)], [("time", 2.0, 2.0), ("bias", 3.0, -1.0)], [], [("place", [1.0, 2.0], 0.5), ("bias", 3.0, 1.0), ("time", 1.0, 1.0)], [("other", 1.0, 1.0)]]
    as_rows = [[{"kind": k, "value": v, "coef": c} for k, v, c in r] for r in rows]
    x = TY.Terms.of(as_rows)

    def one(a, b):
        kinds = {a[0], b[0]}
        va, vb = (np.atleast_1d(np.asarray(t[1], float)) for t in (a, b))
        if kinds == {"time"}:
            return 4 * np.exp(-abs(va[0] - vb[0]) / 5)
        if kinds == {"bias"}:
            return 2.25 * (va[0] == vb[0])
        if kinds == {"time", "place"}:
            return 0.25
        return np.exp(-((va - vb) ** 2).sum() / 4) if kinds == {"place"} else 0.0

    want = np.array([[sum(a[2] * b[2] * one(a, b) for a in p for b in q) for q in rows] for p in rows])
    np.testing.assert_allclose(TYPED.matrix(x, x), want, atol=1e-12)
    np.testing.assert_allclose(TYPED.diagonal(x), np.diag(want), atol=1e-12)
    at = [3, 0, 2]
    np.testing.assert_allclose(TYPED.matrix(x[at], x[1:4]), want[np.ix_(at, [1, 2, 3])], atol=1e-12)
    both = TY.joined(x[:2], x[3:])
    np.testing.assert_allclose(TYPED.matrix(both, x), want[[0, 1, 3, 4]], atol=1e-12)


BIASED = KF.of_kind("all", KF.constant(100)) + KF.of_kind("interval", KF.independent_noise(5))
BIAS_SCHEMA = f"key long, row_id long, feature {TY.TYPE}, target double, target_variance double"


def biased_rows(key=1, n=10):
    """Rows that see a constant and the bias of their interval: neither can be told from the other by these rows alone."""
    out = []
    for i in range(n):
        out.append((key, i, [("all", [0.0], 1.0), ("interval", [float(int(0.3 * i))], 1.0)], 3.14159, 0.1))
    return out, sorted({int(0.3 * i) for i in range(n)})


def joint_of(spark, data, wanted, update=None):
    fits = GP.fit_gp(spark.createDataFrame(data, BIAS_SCHEMA), BIASED)
    if update:
        fits = GP.update_gp(fits, spark.createDataFrame(update, BIAS_SCHEMA), BIASED)
    rows = spark.createDataFrame([(1, i, [("interval", [float(v)], 1.0)], 0) for i, v in enumerate(wanted)], f"key long, row_id long, feature {TY.TYPE}, block int")
    joint = GP.predict_gp_joint(fits, rows, BIASED, "block").toPandas()
    n = len(wanted)
    cov = np.zeros((n, n))
    cov[joint.i, joint.j] = joint["cov"]
    return joint[joint.j == 0].sort_values("i")["mean"].to_numpy(), cov


@pytest.mark.parametrize("as_update", [False, True])
def test_sum_constraint(spark, as_update):
    data, intervals = biased_rows()
    rule = [(1, 100, [("interval", [float(v)], 1.0) for v in intervals], 0.0, 1e-5)]
    mean, cov = joint_of(spark, data, intervals, rule) if as_update else joint_of(spark, data + rule, intervals)
    ones = np.ones(len(intervals))
    assert abs(ones @ mean) < 1e-6 and abs(ones @ cov @ ones) < 1.1e-5


@pytest.mark.parametrize("as_update", [False, True])
def test_difference_constraint(spark, as_update):
    data, intervals = biased_rows()
    rule = [(1, 100, [("interval", [float(intervals[0])], 1.0), ("interval", [float(intervals[1])], -1.0)], 0.0, 1e-5)]
    mean, cov = joint_of(spark, data, intervals[:2], rule) if as_update else joint_of(spark, data + rule, intervals[:2])
    ends = np.array([1.0, -1.0])
    assert abs(ends @ mean) < 1e-6 and abs(ends @ cov @ ends) < 1.1e-5


def test_update_with_another_kind_equals_a_refit(spark):
    data, intervals = biased_rows()
    more = [(1, 200 + k, [("interval", [float(v)], 1.0)], 0.3 * k, 0.05) for k, v in enumerate(intervals)] + [(2, 0, [("all", [0.0], 1.0)], 5.0, 0.1)]
    a, b = joint_of(spark, data + more, intervals), joint_of(spark, data, intervals, more)
    np.testing.assert_allclose(a[0], b[0], atol=1e-8)
    np.testing.assert_allclose(a[1], b[1], atol=1e-8)


def test_mixed_measured_and_latent_rows(spark):
    """Rows that are not measurements carry no measurement noise, in fits, updates and files of fits."""
    k = (KF.exponential(5, 2) + KF.measurement_noise(0.7)) * KF.constant(1)
    data = [(1, i, 0.4 * i, float(np.cos(i)), 0.01, i % 3 != 0) for i in range(20)]
    df = spark.createDataFrame(data, "key long, row_id long, feature double, target double, target_variance double, measured boolean")
    places = spark.createDataFrame([(1, i, 0.4 * i + 0.1) for i in range(20)], "key long, row_id long, feature double")
    fits = storage.materialise(GP.update_gp(GP.fit_gp(df.where("row_id < 12"), k), df.where("row_id >= 12"), k), "fits")
    got = GP.predict_gp(fits, places, k).toPandas().sort_values("row_id")
    x, y, m, xs = (np.array(v) for v in zip(*((r[2], r[3], r[5], r[2] + 0.1) for r in data), strict=True))
    kk = plain_exponential(x, x) + 0.49 * np.diag(m) + 0.01 * np.eye(20)
    cross = plain_exponential(xs, x)
    np.testing.assert_allclose(got["mean"], cross @ np.linalg.solve(kk, y), atol=1e-9)
    np.testing.assert_allclose(got["variance"], 4 - np.einsum("ij,ji->i", cross, np.linalg.solve(kk, cross.T)), atol=1e-9)


def test_means_by_kind():
    x = TY.Terms.of([[{"kind": "time", "value": 2.0, "coef": 3.0}, {"kind": "bias", "value": 1.0, "coef": 1.0}], []])
    assert TY.mean_by_kind({"time": lambda v: 10 * v})(x).tolist() == [60.0, 0.0]


# ---- predictions where the rows are

KERNEL = KF.exponential(3, 1) + KF.measurement_noise(0.2)


@pytest.mark.parametrize("small", [True, False])
def test_predictions_with_and_without_a_shuffle(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(GP, "is_small", lambda *a, **k: False)
    data = rows_of() + [(None, i, float(i), 1.0, 0.1, 0) for i in range(5)]
    df = spark.createDataFrame(data, ROWS)
    places = spark.createDataFrame([(k, i, 0.3 * i + 0.07) for k in (0, 1, 9) for i in range(12)], "key long, row_id long, feature double").repartition(3)
    found = GP.predict_gp(GP.fit_gp(df, KERNEL), places, KERNEL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("FlatMapCoGroupsInPandas" in plan) is not small and ("MapInPandas" in plan) is small
    got = found.toPandas()
    assert sorted(set(got.key)) == [0, 1]
    for k in (0, 1):
        x, y, v = (np.array([r[c] for r in data if r[0] == k]) for c in (2, 3, 4))
        own = got[got.key == k].sort_values("row_id")
        m, var = GP.Fit.of(KERNEL, x, y, v).marginal(KERNEL, 0.3 * own.row_id.to_numpy() + 0.07)
        np.testing.assert_allclose(own["mean"], m)
        np.testing.assert_allclose(own["variance"], var)


def test_blocks_of_a_joint_prediction():
    x, y = np.sort(RNG.random(30)) * 9, RNG.standard_normal(30)
    fit = GP.Fit.of(KERNEL, x, y, np.full(30, 0.1))
    xs, ends = np.linspace(0, 9, 23), np.array([1, 4, 11, 12, 23])
    for step in (1, 5, 1000):
        for lo, hi, m, c in fit.blocks(KERNEL, xs, ends, step=step):
            wm, wc = fit.joint(KERNEL, xs[lo:hi])
            np.testing.assert_allclose(m, wm)
            np.testing.assert_allclose(c, wc)


def test_size_of_nested_columns(spark):
    df = spark.range(10).select(F.struct(F.repeat(F.lit("x"), 1000).alias("s")).alias("a"), F.array(F.repeat(F.lit("y"), 1000)).alias("b"), F.create_map(F.lit("k"), F.repeat(F.lit("z"), 1000)).alias("c"))
    assert storage.is_small(df, max_bytes=40_000) and not storage.is_small(df, max_bytes=29_000)


# ---- null folds


def test_processes_keep_rows_whose_fold_is_null(spark):
    data = rows_of()
    df = spark.createDataFrame(data, ROWS)
    got = GP.logo_gp(df, KERNEL, "fold").toPandas()
    assert len(got) == len(data)
    for k in (0, 1):
        own = [r for r in data if r[0] == k]
        x, y, v = (np.array([r[c] for r in own]) for c in (2, 3, 4))
        held = np.array([r[5] is None for r in own])
        m, _ = GP.Fit.of(KERNEL, x[~held], y[~held], v[~held]).marginal(KERNEL, x[held])
        np.testing.assert_allclose(got[(got.key == k)].sort_values("row_id")["mean"].to_numpy()[held], m, atol=1e-8)
    scores = GP.logo_metrics(df, KERNEL, "fold", {"nll": CV.nll_joint}).collect()
    assert sorted((r.key, r.fold is None) for r in scores if r.fold is None) == [(0, True), (1, True)] and len(scores) == 6


@pytest.mark.parametrize("kind", ["int", "string"])
def test_any_model_and_additive_models_keep_rows_whose_fold_is_null(spark, kind):
    data = rows_of(keys=1)
    df = spark.createDataFrame(data, ROWS).withColumn("fold", F.col("fold").cast(kind))
    schema = f"fold {kind}, row_id long, mean double"

    def predict(model, pdf):
        return pd.DataFrame({"fold": pdf["fold"], "row_id": pdf["row_id"], "mean": model})

    a = CV.cv_predict(df, lambda pdf: float(pdf["target"].mean()), predict, schema, "fold").collect()
    b = CV.cv_predict_additive(df, lambda pdf: np.array([len(pdf), pdf["target"].sum()]), lambda s: s[1] / s[0], predict, schema, "fold").collect()
    want = {r[1]: np.mean([q[3] for q in data if q[5] != r[5]]) for r in data}
    for found in (a, b):
        assert len(found) == len(data)
        np.testing.assert_allclose([r["mean"] for r in sorted(found, key=lambda r: r.row_id)], [want[k] for k in sorted(want)])
        assert sum(r.fold is None for r in found) == 10


def test_models_of_folds_are_bounded_by_bytes(spark):
    df = spark.createDataFrame(rows_of(keys=1), ROWS)
    with pytest.raises(ValueError, match="bytes"):
        CV.cv_predict(df, lambda pdf: np.zeros(1000), lambda m, pdf: pdf, "row_id long", "fold", max_model_bytes=5000)


def test_joint_predictions_of_folds_by_any_model(spark):
    df = spark.createDataFrame(rows_of(keys=1), ROWS)

    def predict(model, pdf):
        return GP.joint_rows({"fold": pdf["fold"].iloc[0]}, pdf["row_id"].to_numpy(), np.full(len(pdf), model), np.eye(len(pdf)))

    got = CV.cv_predict(df, lambda pdf: float(len(pdf)), predict, "fold int, i long, j long, mean double, cov double", "fold", together=True).toPandas()
    assert len(got) == 300 and set(got["mean"]) == {20.0} and got.fold.isna().sum() == 100
    with pytest.raises(ValueError, match="predicted together"):
        CV.cv_predict(df, lambda pdf: 0.0, predict, "fold int, i long, j long, mean double, cov double", "fold", together=True, max_test=9)


def test_noise_in_blocks_and_bounds(spark):
    from sparkreg.operators import grouping as G

    df = spark.createDataFrame([(i, None if i == 9 else i % 3) for i in range(10)], "i long, x int")
    blocks = {r.i: r.block for r in P.noise_blocks(df, 2.0).collect()}
    assert blocks == {**{i: i % 3 for i in range(9)}, 9: 9}
    pairs = {(r.i, r.j) for r in P.noise(df, 2.0).collect()}
    assert pairs == {(i, j) for i in range(9) for j in range(9) if blocks[i] == blocks[j]}
    with pytest.raises(ValueError, match="share"):
        P.noise(df, 2.0, max_equal=2)
    with pytest.raises(ValueError, match="put into one"):
        G.indexers(df, "x", "i", max_rows=2)


def test_noise_is_dealt_out_by_pairs_of_blocks_and_whole(spark, monkeypatch):
    """One file of few features was one task, and 20,000 rows of a feature were a limit."""
    assert P.noise(spark.range(0, 20_001, 1, 1).select(F.col("id").alias("i"), F.lit(1.5).alias("x")), 1.0).where("i = 7").count() == 20_001
    monkeypatch.setattr(P, "_BLOCK", 100)
    df = spark.range(0, 1000, 1, 1).select(F.when(F.col("id") > 0, F.col("id")).alias("i"), F.when(F.col("id") < 900, F.lit(0.0)).when(F.col("id") < 990, F.lit(float("nan"))).alias("x"))
    got = P.noise(df, 2.0).select("*", F.spark_partition_id().alias("task")).toPandas()
    ids = [None, *range(1, 900)], list(range(900, 990))
    want = {(a, b) for own in ids for a in own for b in own}
    pairs = [(None if np.isnan(i) else int(i), None if np.isnan(j) else int(j)) for i, j in zip(got.i, got.j, strict=True)]
    assert len(pairs) == len(want) and set(pairs) == want and set(got["cov"]) == {4.0}
    assert got.groupby("task").size().max() < len(got) / 2
    assert P.noise(df.where("i < 0"), 2.0).count() == 0


def test_additive_sums_where_tasks_have_no_rows(spark):
    df = spark.range(0, 40, 1, 8).where("id < 12").select((F.col("id") % 3).cast("int").alias("fold"), F.col("id").alias("row_id"), F.col("id").cast("double").alias("y"))

    def predict(model, pdf):
        return pd.DataFrame({"fold": pdf["fold"], "row_id": pdf["row_id"], "mean": model})

    got = CV.cv_predict_additive(df, lambda pdf: np.array([len(pdf), pdf["y"].sum()]), lambda s: s[1] / s[0], predict, "fold int, row_id long, mean double", "fold").collect()
    assert {r.row_id: r.mean for r in got} == {i: np.mean([j for j in range(12) if j % 3 != i % 3]) for i in range(12)}


def test_the_size_of_a_table_is_summed_where_its_rows_are(spark):
    """A limit before the sum would send every row, with all its arrays, to one task."""
    df = spark.range(0, 4000, 1, 8).select("id", F.array_repeat(F.rand(1), 500).alias("a"))
    before, tracker = storage.size_of(df), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("size", "size")
    assert storage.size_of(df) == before and before[0] == 4000 and before[1] >= 4000 * 500 * 8
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = [s for j in tracker.getJobIdsForGroup("size") for s in tracker.getJobInfo(j).stageIds]
    written = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if tracker.getStageInfo(s) and tracker.getStageInfo(s).numCompletedTasks)
    assert written < 10_000


@pytest.mark.parametrize("n", [9, 10, 400])
def test_medians_without_a_fold(spark, n):
    """Even and odd numbers, repeated values, nulls, NaN and a null fold; more rows than a task would train on."""
    values = [None, float("nan"), *np.random.default_rng(n).integers(0, 30, n).astype(float).tolist()]
    data = [(i, [None, "a", "b"][i % 3], v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "row_id long, key string, y double").repartition(4)

    def predict(model, pdf):
        return pd.DataFrame({"fold": pdf["fold"], "row_id": pdf["row_id"], "mean": model})

    got = CV.predict_folds(df, CV.fold_medians(df, "y"), predict, "fold string, row_id long, mean double").collect()
    assert {r.row_id: r.mean for r in got} == {i: pd.Series([v for _, g, v in data if g != f], dtype=float).median() for i, f, _ in data}


def test_any_model_query_has_no_bound_on_its_training_rows(spark, small, monkeypatch):
    from sparkreg.jobs import registry

    monkeypatch.setattr(CV.cv_predict, "__defaults__", ("key", CV.MAX_FOLDS, 5, CV.MAX_MODEL_BYTES, False, CV.MAX_TEST))
    assert registry.queries()["cv_predict_any_model"](spark, small).count() == spark.read.parquet(f"{small}/events.parquet").count()


def test_joint_predictions_of_folds_by_pairs_of_blocks(spark):
    """A fold of more rows than a block has, a null fold, and a fold of one row."""
    data = [(i, None if i < 7 else 1 if i < 30 else 2, float(i * i % 11)) for i in range(31)]
    df = spark.createDataFrame(data, "row_id long, fold int, y double").repartition(3)

    def predict(model, a, b):
        i, j = np.repeat(a["row_id"].to_numpy(), len(b)), np.tile(b["row_id"].to_numpy(), len(a))
        return pd.DataFrame({"fold": a["fold"].iloc[0], "i": i, "j": j, "mean": model, "cov": 1.0 * (i == j)})

    got = CV.cv_predict_pairs(df, lambda pdf: float(pdf["y"].mean()), predict, "fold int, i long, j long, mean double, cov double", "fold", block_rows=4).collect()
    means = {f: np.mean([y for _, g, y in data if g != f]) for f in (None, 1, 2)}
    want = {(f, i, j): (means[f], float(i == j)) for i, f, _ in data for j, g, _ in data if f == g}
    assert len(got) == len(want)
    assert all(abs(want[r.fold, r.i, r.j][0] - r.mean) < 1e-12 and want[r.fold, r.i, r.j][1] == r.cov for r in got)
