"""Processes, scores and consensus against dense NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkreg.functions import columns as C
from sparkreg.functions import kernels as KF
from sparkreg.operators import crossval as CV
from sparkreg.operators import gp as GP
from sparkreg.operators import linear as L
from sparkreg.operators import ransac as RS
from sparkreg.operators import sparse_gp as SG
from sparkreg.operators import tuning as T
from sparkreg.sources import tables as S
from sparkreg.streaming import updates as U

K = KF.squared_exponential(3.0, 2.0) + KF.measurement_noise(0.3)


def _toy(n=40, seed=0):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.uniform(0, 10, n))
    return x, 5 * np.sin(x) + rng.normal(0, 0.1, n), rng.uniform(0.01, 0.1, n)


def _frame(spark, x, y, v, key=0):
    return spark.createDataFrame(pd.DataFrame({"key": key, "row_id": np.arange(len(x)), "feature": x, "target": y, "target_variance": v}))


def test_closed_form_leave_one_out_equals_refits():
    x, y, v = _toy()
    fit = GP.Fit.of(K, x, y, v)
    means, variances = GP.leave_one_out(fit, y)
    for i in range(len(x)):
        keep = np.arange(len(x)) != i
        m, var = GP.Fit.of(K, x[keep], y[keep], v[keep]).marginal(K, x[i : i + 1], measured=True)
        assert means[i] == pytest.approx(m[0], abs=1e-6)
        assert variances[i] == pytest.approx(var[0] + v[i], abs=1e-6)


def test_closed_form_leave_group_out_equals_refits():
    x, y, v = _toy()
    groups = np.arange(len(x)) % 4
    for at, m, cov in GP.leave_group_out(GP.Fit.of(K, x, y, v), y, groups):
        keep = np.setdiff1d(np.arange(len(x)), at)
        wm, wc = GP.Fit.of(K, x[keep], y[keep], v[keep]).joint(K, x[at], measured=True)
        np.testing.assert_allclose(m, wm, atol=1e-6)
        np.testing.assert_allclose(cov, wc + np.diag(v[at]), atol=1e-6)


def test_update_equals_refit(spark):
    x, y, v = _toy()
    df = _frame(spark, x, y, v)
    fits = GP.update_gp(GP.fit_gp(df.where("row_id < 25"), K), df.where("row_id >= 25"), K)
    got = GP.predict_gp(fits, df, K).orderBy("row_id").toPandas()
    m, var = GP.Fit.of(K, x, y, v).marginal(K, x)
    np.testing.assert_allclose(got["mean"], m, atol=1e-6)
    np.testing.assert_allclose(got["variance"], var, atol=1e-6)
    joined = GP.predict_gp(fits, df, K, part_rows=7).orderBy("row_id").toPandas()  # the way for a hot key
    np.testing.assert_allclose(joined["mean"], m, atol=1e-6)


def test_vector_features(spark):
    x, y, v = _toy()
    wide = np.column_stack([x, np.cos(x)])
    k = KF.exponential(3.0, 2.0, arrays=True)
    df = spark.createDataFrame(pd.DataFrame({"key": "k", "row_id": np.arange(len(x)), "feature": wide.tolist(), "target": y, "target_variance": v}))
    got = GP.predict_gp(GP.fit_gp(df, k), df, k).orderBy("row_id").toPandas()
    m, var = GP.Fit.of(k, wide, y, v).marginal(k, wide)
    np.testing.assert_allclose(got["mean"], m, atol=1e-8)
    np.testing.assert_allclose(got["variance"], var, atol=1e-8)
    fit = SG.fit_sparse_gp(df, k, wide[::4])
    got = SG.predict_sparse_gp(df, k, fit).orderBy("row_id").toPandas()
    np.testing.assert_allclose(got["mean"], fit.mean(k, wide), atol=1e-8)


def _dense(k, x, y, v, xs, mean):
    """Mean and covariance by plain solves."""
    kk = k.measured(x, x) + np.diag(v)
    cross = k.matrix(xs, x)
    return mean(xs) + cross @ np.linalg.solve(kk, y - mean(x)), k.matrix(xs, xs) - cross @ np.linalg.solve(kk, cross.T)


def two(x):
    return np.full(len(x), 2.0)


def test_table_forms_equal_dense_numpy(spark):
    sets = {key: _toy(30 + key, key) for key in (1, 2, 3)}
    df = _frame(spark, *sets[1], key=1).union(_frame(spark, *sets[2], key=2)).union(_frame(spark, *sets[3], key=3)).withColumn("fold", F.col("row_id") % 4).repartition(5)
    fits = GP.fit_gp(df, K, mean=two)
    joint = GP.predict_gp_joint(fits, df, K, "fold", mean=two, part_rows=9).toPandas()
    loo, logo = (t.orderBy("key", "row_id").toPandas() for t in (GP.loo_gp(df, K, mean=two), GP.logo_gp(df, K, "fold", mean=two)))
    like = GP.log_likelihoods(df, K, mean=two, with_variance=True).toPandas().set_index("key").log_likelihood
    known = GP.condition_gp(df.withColumn("known", F.col("row_id") % 3 > 0), K, "known", mean=two).orderBy("key", "row_id").toPandas()
    again = GP.predict_from_prediction(fits, df.where("row_id % 5 = 0"), df.where("row_id % 5 = 0"), K, mean=two).orderBy("key", "row_id").toPandas()
    draws = [GP.sample_gp(d, K, 5, mean=two).orderBy("key", "row_id").toPandas() for d in (df, df.repartition(2))]
    np.testing.assert_array_equal(draws[0]["value"], draws[1]["value"])
    metric = GP.logo_metrics(df, K, "fold", {"nll": CV.nll_joint, "size": lambda m, c, y, v: float(len(y))}, mean=two).toPandas()
    for key, (x, y, v) in sets.items():
        ids = np.arange(len(x))
        for fold in range(4):
            at = np.flatnonzero(ids % 4 == fold)
            m, c = _dense(K, x, y, v, x[at], two)
            part = joint[(joint.key == key) & (joint.fold == fold)]
            table = part.pivot(index="i", columns="j", values="cov")
            assert table.index.tolist() == at.tolist()
            np.testing.assert_allclose(table, c, atol=1e-7)
            np.testing.assert_allclose(part.groupby("i")["mean"].first(), m, atol=1e-7)
            rest = np.setdiff1d(ids, at)
            m, c = _dense(K, x[rest], y[rest], v[rest], x[at], two)
            own = logo[(logo.key == key) & logo.row_id.isin(at)]
            np.testing.assert_allclose(own["mean"], m, atol=1e-6)
            noise = np.diag(K.measured(x[at], x[at]) - K.matrix(x[at], x[at]))
            np.testing.assert_allclose(own["variance"], np.diag(c) + noise + v[at], atol=1e-6)
            found = metric[(metric.key == key) & (metric.fold == fold)].iloc[0]
            assert found["size"] == len(at) and found.nll == pytest.approx(CV.nll_joint(m, c + np.diag(noise), y[at], v[at]), abs=1e-5)
        i = 7
        rest = np.setdiff1d(ids, [i])
        m, _ = _dense(K, x[rest], y[rest], v[rest], x[[i]], two)
        assert loo[(loo.key == key) & (loo.row_id == i)]["mean"].iloc[0] == pytest.approx(m[0], abs=1e-6)
        kk = K.measured(x, x) + np.diag(v)
        assert like[key] == pytest.approx(-0.5 * ((y - 2) @ np.linalg.solve(kk, y - 2) + np.linalg.slogdet(kk)[1] + len(x) * np.log(2 * np.pi)), abs=1e-6)
        a, b = np.flatnonzero(ids % 3 > 0), np.flatnonzero(ids % 3 == 0)
        cov = K.matrix(x, x)
        want = 2 + cov[np.ix_(b, a)] @ np.linalg.solve(cov[np.ix_(a, a)] + np.diag(v[a]), y[a] - 2)
        np.testing.assert_allclose(known[known.key == key]["mean"], want, atol=1e-5)
        m, c = _dense(K, x, y, v, x[::5], two)
        np.testing.assert_allclose(again[again.key == key]["mean"], m, atol=1e-4)
        np.testing.assert_allclose(again[again.key == key]["variance"], np.diag(c), atol=1e-4)
    rng = np.random.default_rng([5, *b"1"])
    x = sets[1][0]
    np.testing.assert_allclose(draws[0][draws[0].key == 1]["value"], 2 + GP.cholesky(K.matrix(x, x)) @ rng.standard_normal(len(x)), atol=1e-9)


def test_iterative_process_equals_refits(spark):
    x, y, v = _toy(15)
    got = U.iterative_gp(_frame(spark, x, y, v), K, mean=two).orderBy("row_id").toPandas()
    for i in range(15):
        m, c = _dense(K, x[: i + 1], y[: i + 1], v[: i + 1], x[[i]], two)
        assert got["mean"][i] == pytest.approx(m[0], abs=1e-6) and got["variance"][i] == pytest.approx(c[0, 0], abs=1e-6)


def test_fits_are_saved_and_loaded(spark, tmp_path):
    x, y, v = _toy()
    df = _frame(spark, x, y, v)
    fits = GP.fit_gp(df, K)
    S.save_fit(fits, f"file://{tmp_path}/dense")
    same = [GP.predict_gp(f, df, K).orderBy("row_id").toPandas() for f in (fits, S.load_fit(spark, f"file://{tmp_path}/dense"))]
    pd.testing.assert_frame_equal(*same)
    sparse = SG.fit_sparse_gp(df, K, np.linspace(0, 10, 9))
    S.save_sparse_fit(spark, sparse, f"file://{tmp_path}/sparse")
    back = S.load_sparse_fit(spark, f"file://{tmp_path}/sparse")
    np.testing.assert_array_equal(back.marginal(K, x)[1], sparse.marginal(K, x)[1])
    assert back.log_likelihood() == sparse.log_likelihood()


def test_sparse_stream_goes_on_after_a_restart(spark, tmp_path):
    x, y, v = _toy(60)
    df, u = _frame(spark, x, y, v), np.linspace(0, 10, 9)
    parts = [df.where(F.col("row_id") % 3 == k) for k in range(3)]
    first = U.SparseStream(K, u, f"file://{tmp_path}/state")
    assert first.fit(spark) is None
    first.update(parts[0], 0)
    first.update(parts[1], 1)
    later = U.SparseStream(K, u, f"file://{tmp_path}/state")  # knows nothing but the folder
    later.update(parts[1], 1)  # run again after a failure
    later.update(parts[2], 2)
    want = SG.fit_sparse_gp(df, K, u)
    np.testing.assert_allclose(later.fit(spark).mean(K, x), want.mean(K, x), atol=1e-6)
    assert later.fit(spark).rows == 60


def test_late_rows_of_a_filter_are_marked(spark, tmp_path):
    rows = [(1, k, float(k), float(k % 5)) for k in range(8)] + [(2, 20, 0.5, 1.0)]
    late = [(1, 8, 3.5, 1.0), (1, 9, 9.0, 2.0)]
    schema = "key long, row_id long, feature double, target double"
    for k, part in enumerate((rows, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        out = U.stream_kalman_filter(stream, lambda d: 4 * np.exp(-abs(d) / 2), 0.5)
        out.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/progress").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("append").parquet(f"file://{tmp_path}/out")).start().awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").toPandas().set_index("row_id")
    assert got.late.sum() == 1 and got.late[8] and got.n_late[9] == 1 and np.isnan(got["mean"][8])
    kept = [r for r in rows + late if r[0] == 1 and r[1] != 8]
    m, _ = U.filter_steps(np.array([r[2] for r in kept]), np.array([r[3] for r in kept]), 0.5, lambda d: 4 * np.exp(-abs(d) / 2))
    np.testing.assert_allclose(got["mean"][[r[1] for r in kept]], m)


def test_large_group_is_named(spark):
    with pytest.raises(Exception, match="group 7 has 40 rows"):
        GP.fit_gp(_frame(spark, *_toy(), key=7), K, max_rows=10).collect()


def test_sparse_update_equals_refit_and_partitions_do_not_matter(spark):
    x, y, v = _toy(120)
    u = np.linspace(0, 10, 14)
    df = _frame(spark, x, y, v).withColumn("g", F.floor("feature"))
    for group in (None, "g"):
        whole = SG.fit_sparse_gp(df.repartition(1), K, u, group)
        split = SG.fit_sparse_gp(df.repartition(7), K, u, group)
        parts = SG.fit_sparse_gp(df.where("g < 5"), K, u, group)
        parts = SG.fit_sparse_gp(df.where("g >= 5"), K, u, group, start=parts)
        for other in (split, parts):
            np.testing.assert_allclose(other.mean(K, x), whole.mean(K, x), atol=1e-5)
            np.testing.assert_allclose(other.marginal(K, x)[1], whole.marginal(K, x)[1], atol=1e-5)
            assert other.log_likelihood() == pytest.approx(whole.log_likelihood(), abs=1e-3)


def test_sparse_with_all_points_is_dense(spark):
    x, y, v = _toy(25)
    fit = SG.fit_sparse_gp(_frame(spark, x, y, v), K, x, inducing_nugget=1e-9)
    dense = GP.Fit.of(K, x, y, v)
    np.testing.assert_allclose(fit.mean(K, x), dense.mean(K, x), atol=1e-2)
    kk = K.measured(x, x) + np.diag(v)
    want = -0.5 * (y @ np.linalg.solve(kk, y) + np.linalg.slogdet(kk)[1] + len(x) * np.log(2 * np.pi))
    assert fit.log_likelihood() == pytest.approx(want, abs=0.05)


def test_rebase_on_more_points_keeps_the_mean(spark):
    x, y, v = _toy(60)
    fit = SG.fit_sparse_gp(_frame(spark, x, y, v), K, np.linspace(0, 10, 12))
    np.testing.assert_allclose(fit.rebase(K, np.linspace(0, 10, 16)).mean(K, x), fit.mean(K, x), atol=0.05)


def test_fit_from_prediction_reproduces_it():
    x, y, v = _toy()
    m, cov = GP.Fit.of(K, x, y, v).joint(K, x[::8])
    info, e = GP.fit_from_prediction(K, x[::8], m, cov)
    kk = K.matrix(x[::8], x[::8])
    np.testing.assert_allclose(kk @ info, m, atol=1e-6)
    np.testing.assert_allclose(kk - kk @ e @ kk, cov, atol=1e-6)


def test_least_squares_matches_lstsq(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(500, 3)), np.array([1.0, -2.0, 3.0])
    pdf = pd.DataFrame(a, columns=list("pqr")).assign(y=a @ b + rng.normal(0, 0.01, 500))
    for parts in (1, 5, 40):
        got, r = L.fit_least_squares(spark.createDataFrame(pdf).repartition(parts), lambda t: t[list("pqr")].to_numpy(), 3, "y", list("pqr"))
        np.testing.assert_allclose(got, np.linalg.lstsq(a, pdf["y"], rcond=None)[0], atol=1e-9)
        np.testing.assert_allclose(r.T @ r, a.T @ a, atol=1e-8)


def test_ransac_finds_the_line_without_outliers(spark):
    x = np.arange(10.0)
    y = 5 + x
    y[[3, 5]] = -400
    df = spark.createDataFrame(pd.DataFrame({"key": np.arange(10), "x": x, "y": y}))
    s = RS.Settings(threshold=1.0, sample=3, consensus=5, iterations=20)
    code, judged, line = RS.fit(df, s)
    row = line.first()
    assert code == "success" and row.offset == pytest.approx(5) and row.slope == pytest.approx(1)
    assert RS.fit(df, RS.Settings(1.0, 3, 2, 20))[0] == "invalid_arguments"
    assert RS.fit(df, RS.Settings(1e-9, 3, 9, 2))[0] == "no_consensus"


def _outliers(spark):
    x = np.arange(12.0)
    y = 5 + x
    y[[3, 5]] = -400
    return spark.createDataFrame(pd.DataFrame({"key": np.arange(12), "row_id": np.arange(12), "x": x, "y": y}))


def test_ransac_with_a_model(spark):
    fit, metric = lambda t: np.polyfit(t["x"], t["y"], 1), lambda w, t: float(np.abs(t["y"] - np.polyval(w, t["x"])).max())
    df, s = _outliers(spark), RS.Settings(threshold=1.0, sample=3, consensus=6, iterations=12)
    code, judged, rows = RS.fit_model(df, s, RS.Model(fit, metric))
    assert code == "success" and sorted(r.key for r in rows.collect()) == [0, 1, 2, 4, 6, 7, 8, 9, 10, 11]
    line_roles = sorted(RS.inliers(df, RS.candidates(df.select("key"), s), s).select("iteration", "key", "role").collect())
    assert sorted(judged.select("iteration", "key", "role").collect()) == line_roles  # the closed form of lines agrees
    valid = lambda t: bool((t["y"] > 0).all())
    assert RS.fit_model(df, s, RS.Model(fit, metric, valid))[0] == "exceeded_max_failed_candidates"  # none may fail
    patient = RS.Settings(threshold=1.0, sample=3, consensus=6, iterations=4, max_failed=40)
    code, judged, _ = RS.fit_model(df, patient, RS.Model(fit, metric, valid, lambda: -F.sum("n")))
    assert code == "success" and judged.select("iteration").distinct().count() == 4
    assert judged.where("role = 'candidate' and key in (3, 5)").count() == 0
    assert RS.fit_model(df, RS.Settings(1e-9, 3, 11, 2), RS.Model(fit, metric))[0] == "no_consensus"
    assert RS.fit_model(df, RS.Settings(1.0, 12, 13, 2), RS.Model(fit, metric))[0] == "invalid_arguments"


def test_counted_draws(spark):
    def run(flags, iterations, max_failed):
        table = spark.createDataFrame(list(enumerate(flags)), "iteration int, valid boolean")
        return RS.counted(table, RS.Settings(1.0, 1, 2, iterations, max_failed=max_failed))

    assert run([True, False, True, True], 3, 2) == ([0, 2, 3], 1)
    assert run([True, False, False, True], 3, 2) == ([0], 2)
    assert run([False, True], 1, 0) == ([], 1) and run([True, False], 1, 0) == ([0], 0)


def test_consensus_of_processes_leaves_out_a_bad_group(spark):
    x, y, v = _toy(40)
    y = y.copy()
    y[8:12] += 40
    df = _frame(spark, x, y, v).withColumn("g", F.expr("row_id div 4"))
    k = KF.squared_exponential(3.0, 5.0) + KF.independent_noise(0.3)
    r = RS.consensus_gp(df, k, "g", RS.Settings(0.999, 4, 6, 12, max_failed=60)).first()
    assert (r.code, r.groups, r.rows) == ("success", 9, 36)
    assert RS.consensus_gp(df, k, "g", RS.Settings(0.999, 10, 6, 12)).first().code == "invalid_arguments"


def test_cross_validation_of_any_model(spark):
    df = _outliers(spark).withColumn("fold", (F.col("key") % 3).cast("int")).drop("key")
    predict = lambda m, t: pd.DataFrame({"row_id": t["row_id"], "mean": m})
    got = {r.row_id: r.mean for r in CV.cv_predict(df, lambda t: float(t["y"].max()), predict, "row_id long, mean double", "fold").collect()}
    table = df.toPandas()
    assert got == {int(r.row_id): table[table.fold != r.fold].y.max() for r in table.itertuples()}
    with pytest.raises(ValueError, match="train a fold"):
        CV.cv_predict(df, len, predict, "row_id long, mean double", "fold", max_train=5)
    moments = CV.cv_predict_additive(df, lambda t: np.array([len(t), t["y"].sum()]), lambda s: s[1] / s[0], predict, "row_id long, mean double", "fold")
    for r in moments.collect():
        assert r.mean == pytest.approx(table[table.fold != table.fold[r.row_id]].y.mean())
    with pytest.raises(ValueError, match="folds"):
        CV.cv_predict_additive(df, lambda t: np.array([1.0]), float, predict, "row_id long, mean double", "fold", max_folds=2)


def test_quantiles_without_a_gathered_group(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=101), "b": rng.normal(size=7), "c": np.array([3.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs], "name string, v double").repartition(6)
    for r in T.quantiles(df, [0.05, 0.5, 0.93]).collect():
        assert r.q == pytest.approx(np.quantile(values[r.name], [0.05, 0.5, 0.93]).tolist())


def test_tuning_by_a_process_metric(spark):
    sets = {key: _toy(20 + key, key) for key in (1, 2)}
    df = _frame(spark, *sets[1], key=1).union(_frame(spark, *sets[2], key=2))
    kernel = lambda p: KF.squared_exponential(p["length"], 4.0) + KF.measurement_noise(0.2)
    objective = T.gp_objective(df, kernel, mean=two)
    asked = [0.5, 2.0, 9.0]
    got = T.evaluate(spark, [{"length": a} for a in asked], objective)
    for a, value in zip(asked, got, strict=True):
        want, k = 0.0, kernel({"length": a})
        for x, y, v in sets.values():
            for i in range(len(x)):
                rest = np.arange(len(x)) != i
                m, c = _dense(k, x[rest], y[rest], v[rest], x[[i]], two)
                var = c[0, 0] + 0.04 + v[i]
                want += 0.5 * (np.log(2 * np.pi * var) + (y[i] - m[0]) ** 2 / var)
        assert value == pytest.approx(want, rel=1e-5)
    params, best = T.greedy_tune(spark, {"length": T.Parameter(9.0, 0.1, 20.0)}, objective, sweeps=1)
    assert best <= got[2] and best == pytest.approx(T.evaluate(spark, [{"length": params["length"].value}], objective)[0])
    both = T.over_datasets([T.gp_objective(df.where(f"key = {k}"), kernel, mean=two) for k in (1, 2)])
    assert T.evaluate(spark, [{"length": a} for a in asked], both) == pytest.approx([g / 2 for g in got])


def test_greedy_tuning_finds_a_minimum(spark):
    bowl = lambda sets: sets.select("set_id", (F.pow(F.col("a") - 3, F.lit(2)) + F.pow(F.col("b") + 1, F.lit(2))).alias("value"))
    params, best = T.greedy_tune(spark, {"a": T.Parameter(0.0, -10.0, 10.0), "b": T.Parameter(5.0, -10.0, 10.0), "c": T.Parameter(7.0, 0.0, 9.0, True)}, bowl, sweeps=10, n=12)
    assert best < 0.1 and params["a"].value == pytest.approx(3, abs=0.3) and params["b"].value == pytest.approx(-1, abs=0.3)


def test_ensemble_moves_sample_the_density():
    rng = np.random.default_rng(1)
    log_density = lambda w: -0.5 * ((w[:, 0] - 1) ** 2 + (w[:, 1] / 3) ** 2)
    state = rng.normal(size=(40, 2))
    log_p, seen = log_density(state), []
    for step in range(1500):
        state, log_p, accepted = T.ensemble_step(state, log_p, log_density, rng)
        assert np.allclose(log_p, log_density(state)) and accepted.shape == (40,)
        if step > 200:
            seen.append(state)
    draws = np.concatenate(seen)
    np.testing.assert_allclose(draws.mean(0), [1, 0], atol=0.15)
    np.testing.assert_allclose(draws.std(0), [1, 3], rtol=0.07)


def test_scores():
    assert C.chi_squared_cdf_values([3.841459, 5.991465, 11.070498], [1, 2, 5]) == pytest.approx([0.95] * 3, abs=1e-6)
    assert np.isnan(C.chi_squared_cdf_values(-1.0, 2)) and C.chi_squared_cdf_values(np.inf, 2) == 1 and C.chi_squared_cdf_values(1.0, 0) == 1
    a = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert CV.wasserstein_2(np.zeros(2), a, np.zeros(2), a) == pytest.approx(0, abs=1e-9)
    assert CV.wasserstein_2(np.ones(2), a, np.zeros(2), a) == pytest.approx(2)
    assert CV.nll_joint(np.zeros(2), np.eye(2), np.ones(2), np.zeros(2)) == pytest.approx(1 + np.log(2 * np.pi))
    assert CV.differential_entropy(np.eye(3) * 2, textbook=True) == pytest.approx(0.5 * (3 * (1 + np.log(2 * np.pi)) + 3 * np.log(2)))
    near, far = (CV.energy_score(np.zeros(2), np.eye(2), np.full(2, t), np.zeros(2)) for t in (0.0, 4.0))
    assert near < far


def test_column_functions(spark):
    import math

    xs = [-7.0, -3.0, -0.5, 0.0, 1e-9, 0.5, 1.0, 3.0, 5.9, float("nan")]
    got = [r.e for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.erf(F.col("x")).alias("e")).collect()]
    assert got[:-1] == pytest.approx([math.erf(x) for x in xs[:-1]], abs=1e-14) and math.isnan(got[-1])
    row = spark.range(1).select(C.crps_normal(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("a"), C.expected_abs_normal(F.lit(-2.0), F.lit(0.0)).alias("b"), C.chebyshev_t(F.lit(0.3), 9).alias("t"), C.chebyshev_u(F.lit(0.3), 9).alias("u")).first()
    th = math.acos(0.3)
    assert (row.a, row.b) == (1.0, 2.0) and row.t == pytest.approx(math.cos(9 * th)) and row.u == pytest.approx(math.sin(10 * th) / math.sin(th))


def test_exact_filter_equals_a_process(spark):
    """An exact filter is a process with an exponential kernel: the last estimate agrees."""
    t = np.array([0.0, 1.0, 1.5, 4.0, 9.0])
    y = np.array([1.0, 2.0, 0.5, -1.0, 3.0])
    m, p = U.filter_steps(t, y, 0.5, lambda d: 4 * np.exp(-abs(d) / 2), exact=True)
    fit = GP.Fit.of(KF.exponential(2.0, 2.0), t, y, np.full(5, 0.5))
    gm, gv = fit.marginal(KF.exponential(2.0, 2.0), t[-1:])
    assert m[-1] == pytest.approx(gm[0]) and p[-1] == pytest.approx(gv[0])
