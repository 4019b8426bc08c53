"""Queries on models, cross-validation and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkreg.functions import columns as C
from sparkreg.functions import kernels as KF
from sparkreg.functions import typed as TY
from sparkreg.jobs.columns import _AB, _CRPS, _DEV, _JOINT, _kernel_table, _marginals, _scored, chi_sql, day_of_user, erf_sql, inducing_uniform
from sparkreg.jobs.common import EV, LI, Registry, events, lines, r6, table
from sparkreg.operators import crossval as CV
from sparkreg.operators import gp as GP
from sparkreg.operators import grouping as G
from sparkreg.operators import linear as L
from sparkreg.operators import sparse_gp as SG
from sparkreg.operators import tuning as T

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add

# ---- least squares


@add("fit_linear_regression", f"WITH {LI} SELECT supp, round(regr_intercept(y, x), 6) AS \"offset\", round(regr_slope(y, x), 6) AS slope FROM li GROUP BY 1")
def _(spark, d):
    return L.fit_line(lines(spark, d), "x", "y", ["supp"]).select("supp", r6("offset").alias("offset"), r6("slope").alias("slope"))


def _design(pdf: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), pdf["x"], pdf["discount"], pdf["tax"], pdf["x"] * pdf["discount"]])


def _plane(spark, d):
    return L.fit_least_squares(lines(spark, d), _design, 5, "y", ["x", "discount", "tax"])


@add("fit_least_squares")
def _(spark, d):
    coefs, _ = _plane(spark, d)
    return spark.createDataFrame([(k, float(c)) for k, c in enumerate(coefs)], "k int, coef double").select("k", r6("coef").alias("coef"))


@add("predict_linear_regression", f"WITH {LI}, f AS (SELECT supp, regr_intercept(y, x) AS o, regr_slope(y, x) AS s FROM li GROUP BY 1) SELECT okey, line, supp, x, round(o + s * x, 6) AS prediction FROM li JOIN f USING (supp)")
def _(spark, d):
    df = lines(spark, d)
    return L.predict_line(df, L.fit_line(df, "x", "y", ["supp"]), "x", ["supp"]).select("okey", "line", "supp", "x", r6("prediction").alias("prediction"))


@add("predict_least_squares")
def _(spark, d):
    coefs, _ = _plane(spark, d)
    row = F.array(F.lit(1.0), F.col("x"), F.col("discount"), F.col("tax"), F.col("x") * F.col("discount"))
    return lines(spark, d).select("okey", "line", r6(L.predict_dot(row, coefs)).alias("prediction"))


@add("null_model", f"WITH {EV} SELECT row_id, 0.0 AS mean, 10000.0 AS variance FROM ev")
def _(spark, d):
    return events(spark, d).select("row_id", F.lit(0.0).alias("mean"), F.lit(1e4).alias("variance"))


# ---- one process a user

KERNEL = KF.exponential(5.0, 20.0) + KF.measurement_noise(5.0)


def fifty(x: np.ndarray) -> np.ndarray:
    return np.full(len(x), 50.0)


def _users(spark, d):
    """All events of every user as (key, row_id, feature, target, target_variance); row_ids from 1 within a user."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("row_id")).cast("long")
    rows = events(spark, d).select(F.col("user_id").alias("key"), "row_id", "feature", "target", "target_variance")
    return rows.withColumn("row_id", n)


def _grid(spark, d):
    """Places to predict: the middle between each two events of a user, with the day they are in."""
    after = F.lead("feature").over(Window.partitionBy("key").orderBy("row_id"))
    rows = _users(spark, d).withColumn("feature", (F.col("feature") + after) / 2).where("feature is not null")
    return rows.select("key", "row_id", "feature", F.floor(F.col("feature") / 24).alias("day"))


def _shown(df):
    return df.select("key", "row_id", r6("mean").alias("mean"), r6("variance").alias("variance"))


@add("fit_gp")
def _(spark, d):
    fits = GP.fit_gp(_users(spark, d), KERNEL, mean=fifty)
    return fits.select("key", "n", F.posexplode("information").alias("i", "v")).select("key", "n", "i", r6("v").alias("v"))


@add("predict_gp_mean")
def _(spark, d):
    return _shown(GP.predict_gp(GP.fit_gp(_users(spark, d), KERNEL, mean=fifty), _grid(spark, d), KERNEL, mean=fifty)).drop("variance")


@add("predict_gp_marginal")
def _(spark, d):
    return _shown(GP.predict_gp(GP.fit_gp(_users(spark, d), KERNEL, mean=fifty), _grid(spark, d), KERNEL, mean=fifty))


@add("predict_with_measurement_noise")
def _(spark, d):
    return _shown(GP.predict_gp(GP.fit_gp(_users(spark, d), KERNEL, mean=fifty), _grid(spark, d), KERNEL, mean=fifty, measured=True))


@add("predict_gp_joint")
def _(spark, d):
    found = GP.predict_gp_joint(GP.fit_gp(_users(spark, d), KERNEL, mean=fifty), _grid(spark, d), KERNEL, "day", mean=fifty)
    return found.select("key", "day", "i", "j", r6("mean").alias("mean"), r6("cov").alias("cov"))


@add("gp_prior", f"WITH {EV}, {_JOINT} SELECT g AS \"group\", i, j, 0.0 AS mean, round(cov, 6) AS cov FROM k")
def _(spark, d):
    return _kernel_table(spark, d).select("group", "i", "j", F.lit(0.0).alias("mean"), r6("cov").alias("cov"))


#: Priors of the parameters of KERNEL: kind, value and the bounds.
PRIORS = [("log_scale_uniform", 5.0, 0.1, 100.0), ("uniform", 20.0, 0.0, 100.0), ("uniform", 5.0, 0.0, 50.0)]


@add("gp_log_likelihood")
def _(spark, d):
    return GP.log_likelihoods(_users(spark, d), KERNEL, mean=fifty, prior=T.log_prior(PRIORS)).select("key", r6("log_likelihood").alias("log_likelihood"))


@add("gp_nll")
def _(spark, d):
    return QUERIES["gp_log_likelihood"](spark, d).select("key", (-F.col("log_likelihood")).alias("nll"))


@add("gp_update")
def _(spark, d):
    u = _users(spark, d)
    fits = GP.update_gp(GP.fit_gp(u.where("row_id <= 40"), KERNEL, mean=fifty), u.where("row_id > 40"), KERNEL, mean=fifty)
    return _shown(GP.predict_gp(fits, _grid(spark, d), KERNEL, mean=fifty))


# An event is a sum of two terms: the user's process at its hour and the bias of its day.
TYPED = KF.of_kind("time", KF.exponential(5.0, 20.0) + KF.measurement_noise(5.0)) + KF.of_kind("day", KF.independent_noise(3.0))
TYPED_MEAN = TY.mean_by_kind({"time": fifty})


def _typed(spark, d):
    """(events of every user, a row a user that says that the biases of its days sum to zero, the days of every user)."""
    rows = _users(spark, d).withColumn("day", F.floor(F.col("feature") / 24))
    events_ = rows.withColumn("feature", TY.combination(TY.term("time", F.col("feature")), TY.term("day", F.col("day")))).drop("day")
    days = rows.select("key", "day").distinct()
    terms = F.transform(F.sort_array(F.collect_list("day")), lambda v: TY.term("day", v))  # one a day
    rule = days.groupBy("key").agg(terms.alias("feature")).select("key", F.lit(0).cast("long").alias("row_id"), "feature", F.lit(0.0).alias("target"), F.lit(1e-5).alias("target_variance"))
    return events_, rule, days.select("key", F.col("day").alias("row_id"), TY.typed("day", F.col("day")).alias("feature"))


@add("fit_on_two_datasets")
def _(spark, d):
    """The biases of a user's days, from its events and the constraint that they sum to zero."""
    rows, rule, days = _typed(spark, d)
    fits = GP.fit_gp(rows.unionByName(rule), TYPED, mean=TYPED_MEAN)
    return _shown(GP.predict_gp(fits, days, TYPED, mean=TYPED_MEAN))


@add("gp_update_other_kind")
def _(spark, d):
    """The same, with the constraint as an update of fits to the events."""
    rows, rule, days = _typed(spark, d)
    fits = GP.update_gp(GP.fit_gp(rows, TYPED, mean=TYPED_MEAN), rule, TYPED, mean=TYPED_MEAN)
    return _shown(GP.predict_gp(fits, days, TYPED, mean=TYPED_MEAN))


PLAIN = KF.exponential(5.0, 20.0)


@add("gp_fit_from_prediction")
def _(spark, d):
    """Fits kept as their joint predictions half an hour after each event, predicting there."""
    u = _users(spark, d)
    anchors = u.select("key", "row_id", (F.col("feature") + 0.5).alias("feature"))
    return _shown(GP.predict_from_prediction(GP.fit_gp(u, KERNEL, mean=fifty), anchors, anchors, PLAIN, mean=fifty))


@add("conditional_gaussian")
def _(spark, d):
    return _shown(GP.condition_gp(_users(spark, d).withColumn("known", F.col("row_id") % 2 == 1), PLAIN, "known", mean=fifty))


# ---- sparse processes over all events

SPARSE = KF.squared_exponential(40.0, 20.0) + KF.measurement_noise(5.0)


def _points(spark, d, n: int = 24) -> np.ndarray:
    return np.array([r.y for r in inducing_uniform(events(spark, d), n).orderBy("j").collect()])  # n points


def _grouped(spark, d):
    return events(spark, d).drop("key").withColumn("key", F.floor(F.col("feature")).cast("long"))


def _sparse_shown(df):
    return df.select("row_id", F.round("mean", 4).alias("mean"), F.round("variance", 4).alias("variance"))


@add("fit_sparse_gp")
def _(spark, d):
    fit = SG.fit_sparse_gp(_grouped(spark, d), SPARSE, _points(spark, d), mean=fifty)
    return spark.createDataFrame([(k, float(u), float(round(x, 4))) for k, (u, x) in enumerate(zip(fit.u, fit.mean(SPARSE, fit.u, fifty), strict=True))], "k int, u double, mean double")


@add("fit_sparse_gp_groups")
def _(spark, d):
    fit = SG.fit_sparse_gp(_grouped(spark, d), SPARSE, _points(spark, d), group="key", mean=fifty)
    return spark.createDataFrame([(k, float(u), float(round(x, 4))) for k, (u, x) in enumerate(zip(fit.u, fit.mean(SPARSE, fit.u, fifty), strict=True))], "k int, u double, mean double")


@add("predict_sparse_gp_mean")
def _(spark, d):
    fit = SG.fit_sparse_gp(events(spark, d), SPARSE, _points(spark, d), mean=fifty)
    return _sparse_shown(SG.predict_sparse_gp(events(spark, d), SPARSE, fit, fifty)).drop("variance")


@add("predict_sparse_gp_marginal")
def _(spark, d):
    fit = SG.fit_sparse_gp(events(spark, d), SPARSE, _points(spark, d), mean=fifty)
    return _sparse_shown(SG.predict_sparse_gp(events(spark, d), SPARSE, fit, fifty))


@add("predict_sparse_gp_joint")
def _(spark, d):
    fit = SG.fit_sparse_gp(events(spark, d), SPARSE, _points(spark, d), mean=fifty)

    rows = events(spark, d).select(day_of_user().alias("day"), "row_id", "feature")
    found = SG.predict_sparse_gp_joint(rows, SPARSE, fit, "day", fifty)
    return found.select("day", "i", "j", F.round("mean", 4).alias("mean"), F.round("cov", 4).alias("cov"))


@add("sparse_gp_update")
def _(spark, d):
    e = events(spark, d)
    fit = SG.fit_sparse_gp(e.where("row_id % 2 = 0"), SPARSE, _points(spark, d), mean=fifty)
    fit = SG.fit_sparse_gp(e.where("row_id % 2 = 1"), SPARSE, fit.u, mean=fifty, start=fit)
    return _sparse_shown(SG.predict_sparse_gp(e, SPARSE, fit, fifty))


@add("sparse_gp_log_likelihood")
def _(spark, d):
    fit = SG.fit_sparse_gp(_grouped(spark, d), SPARSE, _points(spark, d), group="key", mean=fifty)
    return spark.createDataFrame([(fit.rows, round(fit.log_likelihood(), 2))], "n long, log_likelihood double")


@add("rebase_inducing_points")
def _(spark, d):
    fit = SG.fit_sparse_gp(events(spark, d), SPARSE, _points(spark, d), mean=fifty).rebase(SPARSE, _points(spark, d, 30))
    return SG.predict_sparse_gp(events(spark, d), SPARSE, fit, fifty).select("row_id", F.round("mean", 2).alias("mean"))


# ---- a sparse process a user


def _user_points(spark, d, n: int = 12):
    """Inducing points of every user: n places from its first event to its last."""
    ends = _users(spark, d).groupBy("key").agg(F.min("feature").alias("a"), F.max("feature").alias("b"))
    return ends.select("key", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.col("a") + j * (F.col("b") - F.col("a")) / (n - 1)).alias("u"))


def _user_fits(spark, d, group: str | None = None):
    rows = _users(spark, d).withColumn("day", F.floor(F.col("feature") / 24))
    return SG.update_sparse_gps(SG.prior_fits(_user_points(spark, d), SPARSE), rows, SPARSE, group=group, mean=fifty)


def _keyed_shown(df):
    return df.select("key", "row_id", F.round("mean", 3).alias("mean"), F.round("variance", 3).alias("variance"))


@add("fit_sparse_gp_by_key")
def _(spark, d):
    fits = _user_fits(spark, d, "day")
    return fits.select("key", "m", "n", F.round("log_det_a", 3).alias("log_det"), F.round("squares", 2).alias("squares"))


@add("predict_sparse_gp_by_key")
def _(spark, d):
    return _keyed_shown(SG.predict_sparse_gps(_user_fits(spark, d), _grid(spark, d), SPARSE, mean=fifty))


@add("sparse_gp_update_by_key")
def _(spark, d):
    """Fits to the first forty events of every user, then the others."""
    rows = _users(spark, d)
    fits = SG.update_sparse_gps(SG.prior_fits(_user_points(spark, d), SPARSE), rows.where("row_id <= 40"), SPARSE, mean=fifty)
    fits = SG.update_sparse_gps(fits, rows.where("row_id > 40"), SPARSE, mean=fifty)
    return _keyed_shown(SG.predict_sparse_gps(fits, _grid(spark, d), SPARSE, mean=fifty))


@add("rebase_inducing_points_by_key")
def _(spark, d):
    fits = SG.rebase_sparse_gps(_user_fits(spark, d), _user_points(spark, d, 23), SPARSE)
    return SG.predict_sparse_gps(fits, _grid(spark, d), SPARSE, mean=fifty).select("key", "row_id", F.round("mean", 1).alias("mean"))


@add("sparse_gp_logo")
def _(spark, d):
    """Every event as the events of all other types predict it."""
    found = SG.logo_sparse_gp(events(spark, d), SPARSE, _points(spark, d), "key", mean=fifty)
    return found.select("key", "row_id", F.round("mean", 3).alias("mean"), F.round("variance", 3).alias("variance"))


@add("sparse_gp_logo_joint")
def _(spark, d):
    """The joint prediction of every day of a user's events by all other days of all users."""
    rows = events(spark, d).select(day_of_user().alias("day"), "row_id", "feature", "target", "target_variance")
    found = SG.logo_sparse_gp_joint(rows, SPARSE, _points(spark, d), "day", mean=fifty)
    return found.select("day", "i", "j", F.round("mean", 3).alias("mean"), F.round("cov", 3).alias("cov"))


# ---- folds


@add("create_folds", f"WITH {EV}, k AS (SELECT DISTINCT key AS fold FROM ev) SELECT fold, row_id, CASE WHEN key = fold THEN 'test' ELSE 'train' END AS role FROM ev, k")
def _(spark, d):
    return CV.create_folds(events(spark, d)).select("fold", "row_id", "role")


@add("group_indexer_from_folds", f"WITH {EV} SELECT key AS fold, row_id FROM ev")
def _(spark, d):
    return CV.create_folds(events(spark, d)).where("role = 'test'").select("fold", "row_id")


@add("unique_indices", f"WITH {EV} SELECT DISTINCT row_id FROM ev")
def _(spark, d):
    return CV.create_folds(events(spark, d)).where("role = 'test'").select("row_id").distinct()


_CV = "t AS (SELECT flag AS fold FROM li GROUP BY 1), f AS (SELECT fold, regr_intercept(y, x) AS o, regr_slope(y, x) AS s FROM li JOIN t ON flag <> fold GROUP BY 1), cv AS (SELECT okey, line, supp, flag AS fold, x, y, o + s * x AS prediction FROM li JOIN f ON flag = fold)"


def _cv(spark, d):
    return CV.cv_predict_line(lines(spark, d), "x", "y", "flag")


@add("cv_predict", f"WITH {LI}, {_CV} SELECT okey, line, supp, x, round(prediction, 6) AS prediction FROM cv")
def _(spark, d):
    return _cv(spark, d).select("okey", "line", "supp", "x", r6("prediction").alias("prediction"))


@add("cv_scores", f"WITH {LI}, {_CV} SELECT fold, count(*) AS n, round(sqrt(avg((y - prediction) ** 2)), 6) AS rmse FROM cv GROUP BY 1")
def _(spark, d):
    e = F.col("y") - F.col("prediction")
    return _cv(spark, d).groupBy(F.col("flag").alias("fold")).agg(F.count(F.lit(1)).alias("n"), r6(CV.rmse(e)).alias("rmse"))


@add("cv_predict_any_model", f"WITH {EV}, k AS (SELECT DISTINCT key AS fold FROM ev), m AS (SELECT fold, median(target) AS mean FROM ev JOIN k ON key <> fold GROUP BY 1) SELECT key AS fold, row_id, round(mean, 6) AS mean FROM ev JOIN m ON key = fold")
def _(spark, d):
    def predict(model, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf["fold"], "row_id": pdf["row_id"], "mean": model})

    rows = events(spark, d).select("key", "row_id", "target")
    found = CV.predict_folds(rows, CV.fold_medians(rows, "target"), predict, "fold string, row_id long, mean double")
    return found.select("fold", "row_id", r6("mean").alias("mean"))


_SUPPLIERS = "su AS (SELECT s_suppkey AS row_id, s_nationkey AS fold, s_acctbal / 1000 AS y FROM supplier), h AS (SELECT o.fold, count(*) AS n, avg(s.y) AS m, var_samp(s.y) AS v FROM (SELECT DISTINCT fold FROM su) o JOIN su s ON s.fold <> o.fold GROUP BY 1)"


@add("cv_predict_joint", f"WITH {_SUPPLIERS} SELECT a.fold, a.row_id AS i, b.row_id AS j, round(m, 6) AS mean, round(v / n + CASE WHEN a.row_id = b.row_id THEN v ELSE 0 END, 6) AS cov FROM su a JOIN su b ON a.fold = b.fold JOIN h ON h.fold = a.fold")
def _(spark, d):
    """Suppliers of a nation by those of all others: a common mean, whose error they share, and a spread of their own."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_nationkey").alias("key"), (F.col("s_acctbal") / 1000).alias("y"))

    def predict(model, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        n, m, v = model
        i, j = np.repeat(a["row_id"].to_numpy(), len(b)), np.tile(b["row_id"].to_numpy(), len(a))
        return pd.DataFrame({"fold": a["fold"].iloc[0], "i": i, "j": j, "mean": m, "cov": v / n + v * (i == j)})

    found = CV.cv_predict_pairs(rows, lambda pdf: (len(pdf), float(pdf["y"].mean()), float(pdf["y"].var())), predict, "fold int, i long, j long, mean double, cov double")
    return found.select("fold", "i", "j", r6("mean").alias("mean"), r6("cov").alias("cov"))


@add("cv_predict_additive", f"WITH {EV}, k AS (SELECT DISTINCT key AS fold FROM ev), f AS (SELECT fold, regr_intercept(target, feature) AS o, regr_slope(target, feature) AS s FROM ev JOIN k ON key <> fold GROUP BY 1) SELECT key AS fold, row_id, round(o + s * feature, 6) AS mean FROM ev JOIN f ON key = fold")
def _(spark, d):
    """A line by its gram matrix, as any other model of additive sums."""

    def sums(pdf: pd.DataFrame) -> np.ndarray:
        a = np.column_stack([np.ones(len(pdf)), pdf["feature"] / 1000, pdf["target"]])
        return a.T @ a

    def predict(w, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": pdf["fold"], "row_id": pdf["row_id"], "mean": w[0] + w[1] * pdf["feature"] / 1000})

    rows = events(spark, d).select("key", "row_id", "feature", "target")
    found = CV.cv_predict_additive(rows, sums, lambda g: np.linalg.solve(g[:2, :2], g[:2, 2]), predict, "fold string, row_id long, mean double")
    return found.select("fold", "row_id", r6("mean").alias("mean"))


@add("loo_predict", f"WITH {EV}, s AS (SELECT avg(feature) AS mx, avg(target) AS my, count(*) AS n, var_pop(feature) * count(*) AS sxx, regr_slope(target, feature) AS b FROM ev) SELECT row_id, round(target - ((target - my) - b * (feature - mx)) / (1 - 1.0 / n - (feature - mx) ** 2 / sxx), 6) AS prediction FROM ev, s")
def _(spark, d):
    return CV.loo_predict_line(events(spark, d), "feature", "target").select("row_id", r6("prediction").alias("prediction"))


@add("gp_loo")
def _(spark, d):
    return _shown(GP.loo_gp(_users(spark, d), KERNEL, mean=fifty))


def _folds(spark, d):
    return _users(spark, d).withColumn("fold", (F.col("row_id") % 5).cast("int"))


@add("gp_logo")
def _(spark, d):
    return _shown(GP.logo_gp(_folds(spark, d), KERNEL, "fold", mean=fifty))


@add("gp_logo_joint")
def _(spark, d):
    found = GP.logo_gp_joint(_folds(spark, d), KERNEL, "fold", mean=fifty)
    return found.select("key", "fold", "i", "j", r6("mean").alias("mean"), r6("cov").alias("cov"))


# ---- scores


@add("rmse", f"WITH {LI}, {_CV} SELECT supp, round(sqrt(avg((y - prediction) ** 2)), 6) AS rmse FROM cv GROUP BY 1")
def _(spark, d):
    return _cv(spark, d).groupBy("supp").agg(r6(CV.rmse(F.col("y") - F.col("prediction"))).alias("rmse"))


@add("error_std", f"WITH {LI}, {_CV} SELECT okey, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(y - prediction) END, 6) AS sd FROM cv GROUP BY 1")
def _(spark, d):
    return _cv(spark, d).groupBy("okey").agg(r6(CV.error_std(F.col("y") - F.col("prediction"))).alias("sd"))


@add("nll_marginal", f"WITH {EV}, {_DEV} SELECT key, round(sum(0.5 * (ln(2 * pi()) + ln(v + 1.5) + z * z / (v + 1.5))), 6) AS nll FROM p GROUP BY 1")
def _(spark, d):
    return _scored(spark, d).groupBy("key").agg(r6(F.sum(C.negative_log_likelihood(F.col("z"), F.col("v") + 1.5))).alias("nll"))


def _joint_metric(name: str, f) -> None:
    """A metric of the held-out joint prediction of each fold of each user."""

    @add(name)
    def _(spark, d):
        return GP.logo_metrics(_folds(spark, d), KERNEL, "fold", {"value": f}, mean=fifty).select("key", "fold", F.round("value", 4).alias("value"))


_joint_metric("nll_joint", CV.nll_joint)
_joint_metric("chi_squared_cdf_joint", lambda m, c, y, v: float(C.chi_squared_cdf_values(CV.mahalanobis(m, c, y, v), len(y))))
_joint_metric("wasserstein_2_joint", lambda m, c, y, v: CV.wasserstein_2(m, c + np.diag(v), y, np.diag(v)))
_joint_metric("energy_score", lambda m, c, y, v: CV.energy_score(m, c, y, v))
_joint_metric("differential_entropy_joint", lambda m, c, y, v: CV.differential_entropy(c + np.diag(v)))


@add("logo_likelihood_gp")
def _(spark, d):
    """Per user: the negative log likelihood of every held-out fold, summed, less the log density of the parameters."""
    folds = GP.logo_metrics(_folds(spark, d), KERNEL, "fold", {"value": CV.nll_joint}, mean=fifty)
    return folds.groupBy("key").agg(F.round(F.sum("value") - T.log_prior(PRIORS), 4).alias("value"))


@add("sample_mvn")
def _(spark, d):
    return GP.sample_gp(_users(spark, d), PLAIN, 7, mean=fifty).select("key", "row_id", r6("value").alias("value"))


@add("chi_squared_diagonal", f"WITH {EV}, {_DEV}, q AS (SELECT row_id // 4 AS g, sum(z * z / v) AS x, count(*) AS n FROM p GROUP BY 1) SELECT g, round({chi_sql('x', 'n')}, 6) AS cdf FROM q")
def _(spark, d):
    q = _scored(spark, d).groupBy(F.expr("row_id div 4").alias("g")).agg(F.sum(F.col("z") * F.col("z") / F.col("v")).alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
    return q.select("g", r6(C.chi_squared_cdf("x", "n")).alias("cdf"))


@add("reliability_histogram", f"WITH {EV}, {_DEV}, q AS (SELECT 0.5 * (1 + {erf_sql('z / 1.4 / sqrt(2.0)')}) AS u FROM p), n AS (SELECT count(*) AS n FROM q) SELECT least(49, CAST(floor(u * 50) AS BIGINT)) AS bin, count(*) AS c, round(50.0 * count(*) / any_value(n), 6) AS density FROM q, n GROUP BY 1")
def _(spark, d):
    u = _scored(spark, d).select(F.least(F.lit(49), F.floor(50 * C.normal_cdf(F.col("z") / 1.4))).cast("long").alias("bin"))
    n = F.broadcast(u.agg(F.count(F.lit(1)).alias("n")))
    return u.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).crossJoin(n).select("bin", "c", r6(50.0 * F.col("c") / F.col("n")).alias("density"))


@add("reliability_ks", f"WITH {EV}, {_DEV}, q AS (SELECT key, 0.5 * (1 + {erf_sql('z / 1.4 / sqrt(2.0)')}) AS u FROM p), r AS (SELECT key, u, row_number() OVER (PARTITION BY key ORDER BY u) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM q) SELECT key, round(max(greatest((i + 1) / n - u, u - i / n, 0.0)), 6) AS ks FROM r GROUP BY 1")
def _(spark, d):
    u = _scored(spark, d).select("key", C.normal_cdf(F.col("z") / 1.4).alias("u"))
    return G.uniform_ks(u, "u", ["key"]).select("key", r6("ks").alias("ks"))


@add("wasserstein_2", f"WITH {EV}, {_AB} SELECT row_id // 10 AS g, round(sum((a.mean - b.mean) ** 2 + (sqrt(a.variance) - sqrt(b.variance)) ** 2) / 1000, 6) AS w2 FROM a JOIN b USING (row_id) GROUP BY 1")
def _(spark, d):
    a, b = _marginals(spark, d)
    both = a.join(b.select("row_id", F.col("mean").alias("m"), F.col("variance").alias("v")), "row_id")
    dm, ds = F.col("mean") - F.col("m"), F.sqrt("variance") - F.sqrt("v")
    return both.groupBy(F.expr("row_id div 10").alias("g")).agg(r6(F.sum(dm * dm + ds * ds) / 1000).alias("w2"))


@add("crps_mean", f"WITH {EV}, {_DEV} SELECT key, round(avg({_CRPS}), 6) AS crps FROM p GROUP BY 1")
def _(spark, d):
    return _scored(spark, d).groupBy("key").agg(r6(F.avg(C.crps_normal(F.col("z"), F.lit(0.0), F.sqrt("v")))).alias("crps"))


def _pairs_of_ten(spark, d):
    rows = events(spark, d).select(F.expr("row_id div 10").alias("g"), "row_id", "target", "target_variance")
    other = rows.select("g", F.col("row_id").alias("o"), F.col("target").alias("t"), F.col("target_variance").alias("v"))
    both = rows.join(other, "g").where("row_id < o")
    return both.select("g", (F.col("target") - F.col("t")).alias("dy"), F.lit(0.0).alias("dm"), (F.col("target_variance") + F.col("v") + 800).alias("dv"))


_VAR = "vp AS (SELECT a.row_id // 10 AS g, a.target - b.target AS dy, a.target_variance + b.target_variance + 800 AS dv FROM ev a JOIN ev b ON a.row_id // 10 = b.row_id // 10 AND a.row_id < b.row_id)"


@add("variogram_score", f"WITH {EV}, {_VAR} SELECT g, round(sum((abs(dy) - sqrt(2 * dv / pi())) ** 2) / 1000, 6) AS score FROM vp GROUP BY 1")
def _(spark, d):
    return CV.variogram_score(_pairs_of_ten(spark, d), ["g"]).select("g", r6(F.col("score") / 1000).alias("score"))


# The standard deviation of the noise is 20, uniform on [0, 100] before the data.
NOISE_PRIOR = [("uniform", 20.0, 0.0, 100.0)]
_NLL = "0.5 * (ln(2 * pi()) + ln(400) + e * e / 400)"


@add("loo_likelihood", f"WITH {LI}, s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM li), o AS (SELECT x, y, n - 1 AS n, sx - x AS sx, sy - y AS sy, sxx - x * x AS sxx, sxy - x * y AS sxy FROM li, s), f AS (SELECT x, y, sx / n AS mx, sy / n AS my, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS b FROM o), r AS (SELECT y - my - b * (x - mx) AS e FROM f) SELECT round((sum({_NLL}) + ln(100)) / 1000, 6) AS nll FROM r")
def _(spark, d):
    """Every row as the line through all others predicts it: summed, less the log density of the noise."""
    rows = CV.loo_predict_line(lines(spark, d), "x", "y")
    nll = F.sum(C.negative_log_likelihood(F.col("y") - F.col("prediction"), F.lit(400.0)))
    return rows.agg(r6((nll - T.log_prior(NOISE_PRIOR)) / 1000).alias("nll"))


@add("logo_likelihood", f"WITH {LI}, {_CV}, r AS (SELECT y - prediction AS e FROM cv) SELECT round((sum({_NLL}) + ln(100)) / 1000, 6) AS nll FROM r")
def _(spark, d):
    """The same for held-out return flags."""
    nll = F.sum(C.negative_log_likelihood(F.col("y") - F.col("prediction"), F.lit(400.0)))
    return _cv(spark, d).agg(r6((nll - T.log_prior(NOISE_PRIOR)) / 1000).alias("nll"))


@add("loo_rmse", f"WITH {EV}, s AS (SELECT avg(feature) AS mx, avg(target) AS my, count(*) AS n, var_pop(feature) * count(*) AS sxx, regr_slope(target, feature) AS b FROM ev) SELECT round(avg(abs(((target - my) - b * (feature - mx)) / (1 - 1.0 / n - (feature - mx) ** 2 / sxx))), 6) AS rmse FROM ev, s")
def _(spark, d):
    return CV.loo_predict_line(events(spark, d), "feature", "target").agg(r6(F.avg(F.abs(F.col("target") - F.col("prediction")))).alias("rmse"))


@add("differential_entropy", f"WITH {EV} SELECT row_id // 10 AS g, round(0.5 * count(*) * (1 + ln(2 * pi()) + sum(ln(target_variance))), 6) AS entropy FROM ev GROUP BY 1")
def _(spark, d):
    k, log_det = F.count(F.lit(1)), F.sum(F.log("target_variance"))
    return events(spark, d).groupBy(F.expr("row_id div 10").alias("g")).agg(r6(0.5 * k * (1 + C.LOG_2PI + log_det)).alias("entropy"))


