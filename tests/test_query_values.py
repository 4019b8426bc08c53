"""Registered queries that SQL cannot express, against dense NumPy on the same rows."""

import math
from functools import cache

import duckdb
import numpy as np
import pytest

from sparkreg.functions import kernels as KF
from sparkreg.functions.columns import chi_squared_cdf_values
from sparkreg.jobs import registry
from sparkreg.jobs.common import EV, LI
from sparkreg.operators import crossval as CV

QUERIES = registry.queries()
SMALL = "/root/testdata/sf0.001"
K, NOISE, MEAN = KF.exponential(5.0, 20.0), 25.0, 50.0
S = KF.squared_exponential(40.0, 20.0)
PRIOR = -math.log(5.0) - math.log(math.log(100.0) - math.log(0.1)) - math.log(100.0) - math.log(50.0)


@cache
def table(sql):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con.sql(sql).df()


@cache
def users():
    """key: (row_ids, features, targets, variances)."""
    e = table(f"WITH {EV} SELECT * FROM ev ORDER BY row_id")
    return {int(k): (np.arange(1, len(p) + 1), *(p[c].to_numpy(float) for c in ("feature", "target", "target_variance"))) for k, p in e.groupby("user_id")}


@cache
def gram(key):
    _, x, _, v = users()[key]
    return K.matrix(x, x) + NOISE * (x[:, None] == x[None, :]) + np.diag(v)


def predicted(key, xs, keep=None, measured=False):
    """Mean and covariance at xs from the rows of a key that are kept."""
    _, x, y, _ = users()[key]
    keep = np.ones(len(x), bool) if keep is None else keep
    kk, cross = gram(key)[np.ix_(keep, keep)], K.matrix(xs, x[keep])
    own = K.matrix(xs, xs)
    if measured:
        cross, own = cross + NOISE * (xs[:, None] == x[keep][None, :]), own + NOISE * (xs[:, None] == xs[None, :])
    return MEAN + cross @ np.linalg.solve(kk, y[keep] - MEAN), own - cross @ np.linalg.solve(kk, cross.T)


def places(key):
    """(row_ids, places, days) between each two rows."""
    ids, x, _, _ = users()[key]
    mid = (x[:-1] + x[1:]) / 2
    return ids[:-1], mid, np.floor(mid / 24).astype(int)


def rows(spark, name):
    return QUERIES[name](spark, SMALL).toPandas()


def by_key(spark, name, value):
    """Held against value(key) -> {row_id: numbers}."""
    got = rows(spark, name)
    columns = [c for c in got.columns if c not in ("key", "row_id")]
    want = {(k, i): v for k in users() for i, v in value(k).items()}
    mine = {(int(r.key), int(r.row_id)): [getattr(r, c) for c in columns] for r in got.itertuples()}
    assert mine.keys() == want.keys()
    np.testing.assert_allclose([mine[k] for k in sorted(want)], [np.atleast_1d(want[k]) for k in sorted(want)], atol=2e-5)


def marginals(key, measured=False):
    ids, xs, _ = places(key)
    m, c = predicted(key, xs, measured=measured) if len(xs) else (np.empty(0), np.empty((0, 0)))
    return dict(zip(ids.tolist(), np.column_stack([m, np.diag(c)]), strict=True))


# ---- processes


@pytest.mark.parametrize("name", ["predict_gp_marginal", "predict_with_measurement_noise", "load_fit", "gp_update"])
def test_marginals(spark, name):
    by_key(spark, name, lambda k: marginals(k, name == "predict_with_measurement_noise"))


def test_means(spark):
    by_key(spark, "predict_gp_mean", lambda k: {i: v[:1] for i, v in marginals(k).items()})


def test_joint(spark):
    got = rows(spark, "predict_gp_joint")
    seen = 0
    for k in users():
        ids, xs, days = places(k)
        for day in set(days.tolist()):
            at = np.flatnonzero(days == day)
            m, c = predicted(k, xs[at])
            own = got[(got.key == k) & (got.day == day)].sort_values(["i", "j"])
            assert own["i"].to_numpy().tolist() == np.repeat(ids[at], len(at)).tolist()
            np.testing.assert_allclose(own["cov"], c.reshape(-1), atol=2e-5)
            np.testing.assert_allclose(own["mean"], np.repeat(m, len(at)), atol=2e-5)
            seen += len(own)
    assert seen == len(got)


def test_information_and_files_of_fits(spark):
    got = rows(spark, "fit_gp")
    for k in users():
        v = np.linalg.solve(gram(k), users()[k][2] - MEAN)
        np.testing.assert_allclose(got[got.key == k].sort_values("i")["v"], v, atol=2e-6)
    saved = rows(spark, "save_fit")
    for r in saved.itertuples():
        n = len(users()[int(r.key)][1])
        assert (r.n, r.features, r.factor, r.information) == (n, n, n * (n + 1) // 2, n)


def test_likelihoods(spark):
    ll, nll = (rows(spark, n).set_index("key") for n in ("gp_log_likelihood", "gp_nll"))
    for k, (_, x, y, v) in users().items():
        kk = gram(k) - np.diag(v)  # the variances of targets are left out
        want = PRIOR - 0.5 * ((y - MEAN) @ np.linalg.solve(kk, y - MEAN) + np.linalg.slogdet(kk)[1] + len(x) * math.log(2 * math.pi))
        assert ll.log_likelihood[k] == pytest.approx(want, abs=1e-4) and nll.nll[k] == pytest.approx(-want, abs=1e-4)


def held_out(key, keep):
    _, x, _, _ = users()[key]
    return predicted(key, x[~keep], keep, measured=True)


def test_leave_one_out(spark):
    def value(k):
        ids, x, _, v = users()[k]
        out = {}
        for i in range(len(x)):
            keep = np.arange(len(x)) != i
            m, c = held_out(k, keep)
            out[int(ids[i])] = (m[0], c[0, 0] + v[i])
        return out

    by_key(spark, "gp_loo", value)


def folds(key):
    """(fold, rows of it, mean and covariance of measurements without target variances)."""
    ids = users()[key][0]
    for f in sorted(set((ids % 5).tolist())):
        at = np.flatnonzero(ids % 5 == f)
        yield f, at, *held_out(key, ids % 5 != f)


def test_leave_group_out(spark):
    by_key(spark, "gp_logo", lambda k: {int(users()[k][0][i]): (m[j], c[j, j] + users()[k][3][i]) for _, at, m, c in folds(k) for j, i in enumerate(at)})


def test_leave_group_out_joints(spark):
    got, seen = rows(spark, "gp_logo_joint"), 0
    for k in users():
        ids, _, _, v = users()[k]
        for f, at, m, c in folds(k):
            own = got[(got.key == k) & (got.fold == f)].sort_values(["i", "j"])
            np.testing.assert_allclose(own["cov"], (c + np.diag(v[at])).reshape(-1), atol=2e-5)
            np.testing.assert_allclose(own["mean"], np.repeat(m, len(at)), atol=2e-5)
            seen += len(own)
    assert seen == len(got)


@pytest.mark.parametrize(
    "name, metric, tolerance",
    [
        ("nll_joint", CV.nll_joint, 1e-3),
        ("chi_squared_cdf_joint", lambda m, c, y, v: float(chi_squared_cdf_values((y - m) @ np.linalg.solve(c + np.diag(v), y - m), len(y))), 1e-3),
        ("wasserstein_2_joint", lambda m, c, y, v: CV.wasserstein_2(m, c + np.diag(v), y, np.diag(v)), 0.05),
        ("energy_score", lambda m, c, y, v: CV.energy_score(m, c, y, v), None),
        ("differential_entropy_joint", lambda m, c, y, v: 0.5 * len(y) * (1 + math.log(2 * math.pi) + np.linalg.slogdet(c + np.diag(v))[1]), 1e-3),
    ],
)
def test_metrics_of_held_out_joints(spark, name, metric, tolerance):
    got = rows(spark, name)
    mine = {(int(r.key), int(r.fold)): r.value for r in got.itertuples()}
    want = {(k, f): metric(m, c, users()[k][2][at], users()[k][3][at]) for k in users() for f, at, m, c in folds(k)}
    assert mine.keys() == want.keys()
    order = sorted(want)
    a, b = np.array([mine[k] for k in order]), np.array([want[k] for k in order])
    if tolerance is None:  # draws
        assert np.abs(a - b).max() < 0.25 * np.abs(b).max() and abs(a.mean() / b.mean() - 1) < 0.05
    else:
        np.testing.assert_allclose(a, b, atol=tolerance, rtol=1e-5)


def test_leave_group_out_likelihood(spark):
    got = rows(spark, "logo_likelihood_gp").set_index("key")["value"]
    for k in users():
        want = sum(CV.nll_joint(m, c, users()[k][2][at], users()[k][3][at]) for _, at, m, c in folds(k)) - PRIOR
        assert got[k] == pytest.approx(want, abs=1e-3)


def test_conditioning_and_fits_from_predictions(spark):
    def given(k):
        ids, x, y, v = users()[k]
        known = ids % 2 == 1
        kk, cross = K.matrix(x[known], x[known]) + np.diag(v[known]), K.matrix(x[~known], x[known])
        m, c = MEAN + cross @ np.linalg.solve(kk, y[known] - MEAN), K.matrix(x[~known], x[~known]) - cross @ np.linalg.solve(kk, cross.T)
        return dict(zip(ids[~known].tolist(), np.column_stack([m, np.diag(c)]), strict=True))

    by_key(spark, "conditional_gaussian", given)

    def kept(k):
        ids, x, _, _ = users()[k]
        kk, y = gram(k), users()[k][2]
        cross = K.matrix(x + 0.5, x)  # the query's new fits have the kernel without noise
        m, c = MEAN + cross @ np.linalg.solve(kk, y - MEAN), K.matrix(x + 0.5, x + 0.5) - cross @ np.linalg.solve(kk, cross.T)
        return dict(zip(ids.tolist(), np.column_stack([m, np.diag(c)]), strict=True))

    got = rows(spark, "gp_fit_from_prediction")
    mine = {(int(r.key), int(r.row_id)): (r.mean, r.variance) for r in got.itertuples()}
    want = {(k, i): v for k in users() for i, v in kept(k).items()}
    np.testing.assert_allclose([mine[k] for k in sorted(want)], [want[k] for k in sorted(want)], atol=2e-4)


def test_estimates_row_by_row(spark):
    def value(k):
        ids, x, _, _ = users()[k]
        out = {}
        for i in range(len(x)):
            m, c = predicted(k, x[i : i + 1], np.arange(len(x)) <= i)
            out[int(ids[i])] = (m[0], c[0, 0])
        return out

    by_key(spark, "iterative_gp", value)


def test_biases_that_sum_to_zero(spark):
    a, b = (rows(spark, n).sort_values(["key", "row_id"]).reset_index(drop=True) for n in ("fit_on_two_datasets", "gp_update_other_kind"))
    np.testing.assert_allclose(a[["mean", "variance"]], b[["mean", "variance"]], atol=1e-5)
    assert a.groupby("key")["mean"].sum().abs().max() < 1e-4
    assert a["mean"].abs().max() > 0.1


def test_draws(spark):
    a, b = (rows(spark, "sample_mvn").sort_values(["key", "row_id"]).reset_index(drop=True) for _ in range(2))
    assert a.equals(b) and len(a) == sum(len(u[0]) for u in users().values())
    z = np.concatenate([np.linalg.solve(np.linalg.cholesky(K.matrix(x, x) + 1e-9 * np.eye(len(x))), a[a.key == k]["value"].to_numpy() - MEAN) for k, (_, x, _, _) in users().items() if len(set(x.tolist())) == len(x)])
    assert abs(z.mean()) < 0.15 and abs(z.std() - 1) < 0.1


# ---- sparse processes


def sparse(x, y, v, u, xs, groups=None):
    """Mean, covariance and log likelihood of the dense sparse process."""
    q = lambda a, b: S.matrix(a, u) @ np.linalg.solve(kuu, S.matrix(u, b))
    kuu = S.matrix(u, u) + 1e-8 * np.eye(len(u))
    same = np.eye(len(x), dtype=bool) if groups is None else groups[:, None] == groups[None, :]
    block = np.where(same, S.matrix(x, x) - q(x, x), 0.0) + np.where(same & (x[:, None] == x[None, :]), 25.0, 0.0) + np.diag(v)
    kuf = S.matrix(u, x)
    w = np.linalg.solve(block, np.column_stack([kuf.T, y - MEAN]))
    inner = kuu + kuf @ w[:, :-1]
    cross = S.matrix(xs, u)
    mean = MEAN + cross @ np.linalg.solve(inner, kuf @ w[:, -1])
    cov = S.matrix(xs, xs) - q(xs, xs) + cross @ np.linalg.solve(inner, cross.T)
    total = q(x, x) + block
    ll = -0.5 * ((y - MEAN) @ np.linalg.solve(total, y - MEAN) + np.linalg.slogdet(total)[1] + len(x) * math.log(2 * math.pi))
    return mean, cov, ll


@cache
def all_events():
    e = table(f"WITH {EV} SELECT * FROM ev ORDER BY row_id")
    x = e["feature"].to_numpy(float)
    return e, x, e["target"].to_numpy(float), e["target_variance"].to_numpy(float), np.linspace(x.min(), x.max(), 24)


@pytest.mark.parametrize("name", ["predict_sparse_gp_mean", "predict_sparse_gp_marginal", "sparse_gp_update", "stream_sparse_gp_update"])
def test_sparse_predictions(spark, name):
    _, x, y, v, u = all_events()
    m, c, _ = sparse(x, y, v, u, x)
    got = rows(spark, name).sort_values("row_id")
    np.testing.assert_allclose(got["mean"], m, atol=2e-3)
    if "variance" in got:
        np.testing.assert_allclose(got["variance"], np.diag(c), atol=2e-3)


def test_sparse_fits(spark):
    e, x, y, v, u = all_events()
    for name, groups in (("fit_sparse_gp", None), ("fit_sparse_gp_groups", np.floor(x))):
        np.testing.assert_allclose(rows(spark, name).sort_values("k")["mean"], sparse(x, y, v, u, u, groups)[0], atol=2e-3)
    r = rows(spark, "sparse_gp_log_likelihood").iloc[0]
    assert r.n == len(x) and r.log_likelihood == pytest.approx(sparse(x, y, v, u, u, np.floor(x))[2], abs=0.05)
    moved = rows(spark, "rebase_inducing_points").sort_values("row_id")["mean"]
    assert np.abs(moved - sparse(x, y, v, u, x)[0]).max() < 0.3


def test_sparse_joints(spark):
    e, x, y, v, u = all_events()
    day = e["user_id"].to_numpy() * 100000 + np.floor(x / 24)
    m, c, _ = sparse(x, y, v, u, x)
    got = rows(spark, "predict_sparse_gp_joint")
    np.testing.assert_allclose(got["mean"], m[got.i], atol=2e-3)
    np.testing.assert_allclose(got["cov"], c[got.i, got.j], atol=2e-3)
    assert len(got) == sum(int(n) ** 2 for n in np.unique(day, return_counts=True)[1])


def test_sparse_folds(spark):
    e, x, y, v, u = all_events()
    got = rows(spark, "sparse_gp_logo").sort_values("row_id")
    for kind in set(e["key"]):
        held = (e["key"] == kind).to_numpy()
        m, c, _ = sparse(x[~held], y[~held], v[~held], u, x[held])
        np.testing.assert_allclose(got["mean"].to_numpy()[held], m, atol=3e-3)
        np.testing.assert_allclose(got["variance"].to_numpy()[held], np.diag(c), atol=3e-3)
    day = e["user_id"].to_numpy() * 100000 + np.floor(x / 24).astype(int)
    joint = rows(spark, "sparse_gp_logo_joint")
    for k in sorted(set(day.tolist()))[:20]:
        held = day == k
        m, c, _ = sparse(x[~held], y[~held], v[~held], u, x[held])
        own = joint[joint.day == k].sort_values(["i", "j"])
        np.testing.assert_allclose(own["cov"].to_numpy().reshape(c.shape), c, atol=3e-3)


def test_sparse_by_key(spark):
    found = {n: rows(spark, n).sort_values(["key", "row_id"]) for n in ("predict_sparse_gp_by_key", "sparse_gp_update_by_key", "rebase_inducing_points_by_key")}
    fits = rows(spark, "fit_sparse_gp_by_key").set_index("key")
    for k, (_, x, y, v) in users().items():
        u = x.min() + np.arange(12) * (x.max() - x.min()) / 11
        xs = places(k)[1]
        m, c, _ = sparse(x, y, v, u, xs)
        for name in ("predict_sparse_gp_by_key", "sparse_gp_update_by_key"):
            own = found[name][found[name].key == k]
            np.testing.assert_allclose(own["mean"], m, atol=0.02)
            np.testing.assert_allclose(own["variance"], np.diag(c), atol=0.02)
        moved = found["rebase_inducing_points_by_key"]
        assert np.abs(moved[moved.key == k]["mean"].to_numpy() - m).max(initial=0) < 1
        assert (fits.m[k], fits.n[k]) == (12, len(x))


# ---- least squares, searches, graphs


def test_planes(spark):
    li = table(f"WITH {LI} SELECT * FROM li")
    a = np.column_stack([np.ones(len(li)), li["x"], li["discount"], li["tax"], li["x"] * li["discount"]]).astype(float)
    w = np.linalg.lstsq(a, li["y"].to_numpy(float), rcond=None)[0]
    np.testing.assert_allclose(rows(spark, "fit_least_squares").sort_values("k")["coef"], w, atol=2e-6)
    got = rows(spark, "predict_least_squares").sort_values(["okey", "line"])
    order = np.lexsort((li["line"], li["okey"]))
    np.testing.assert_allclose(got["prediction"], (a @ w)[order], atol=2e-6)


def test_tuning(spark):
    li = table(f"WITH {LI} SELECT avg(x) AS x, avg(y) AS y FROM li GROUP BY supp")
    got = rows(spark, "greedy_tune").set_index("name")
    loss = lambda a, b: float(((li["y"] - a - b * li["x"]) ** 2).mean())
    assert got.best["a"] == pytest.approx(loss(got.value["a"], got.value["b"]), rel=1e-4) and got.best["a"] < loss(1.0, 1.0)
    tuned = rows(spark, "tune_gp").set_index("name")

    def loo(length, noise):
        k, total = KF.exponential(length, 20.0), 0.0
        for _, x, y, v in users().values():
            inverse = np.linalg.inv(k.matrix(x, x) + noise**2 * (x[:, None] == x[None, :]) + np.diag(v))
            e, var = (inverse @ (y - MEAN)) / np.diag(inverse), 1 / np.diag(inverse)
            total += 0.5 * (np.log(2 * np.pi * var) + e**2 / var).sum()
        return total

    assert tuned.best["length"] == pytest.approx(loo(tuned.value["length"], tuned.value["noise"]), rel=1e-5)
    assert tuned.best["length"] <= loo(5.0, 5.0) + 1e-6


def test_chains(spark):
    step, chain = rows(spark, "ensemble_step"), rows(spark, "ensemble_sampler")
    assert len(step) == 5 and len(chain) == 12 * 5
    first = chain[chain.iteration == 0].sort_values("ensemble_index").reset_index(drop=True)
    np.testing.assert_allclose(first[["a", "b"]], step.sort_values("ensemble_index")[["a", "b"]], atol=1e-9)
    li = table(f"WITH {LI} SELECT avg(x) AS x, avg(y) AS y FROM li GROUP BY supp")
    for r in chain.itertuples():
        assert r.log_probability == pytest.approx(-0.5 * ((li["y"] - r.a - r.b * li["x"]) ** 2).mean(), abs=1e-4)


def test_searches_of_users(spark):
    got = rows(spark, "ransac_gp")
    assert sorted(got.key) == sorted(users()) and set(got.code) <= {"success", "no_consensus", "exceeded_max_failed_candidates", "invalid_arguments"}
    good = got[got.code == "success"]
    assert len(good) and (good["groups"] >= 4).all() and (good["metric"] == -good["rows"]).all()


@pytest.mark.parametrize("maximum", [False, True])
def test_spanning(spark, maximum):
    edges = table(f"WITH {LI} SELECT okey % 997 AS a, 1000 + supp AS b, min(y) AS cost FROM li GROUP BY 1, 2")
    parent: dict = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    kept = set()
    for r in edges.assign(w=edges["cost"] * (-1 if maximum else 1)).sort_values(["w", "a", "b"]).itertuples():
        if root(r.a) != root(r.b):
            parent[root(r.a)] = root(r.b)
            kept.add((int(r.a), int(r.b)))
    kind = "maximum" if maximum else "minimum"
    forest = rows(spark, f"{kind}_spanning_forest")
    assert {(int(r.a), int(r.b)) for r in forest.itertuples()} == kept and len(forest) == len(kept)
    extreme = edges.loc[edges["cost"].idxmax() if maximum else edges["cost"].idxmin()]
    tree = rows(spark, f"{kind}_spanning_tree")
    assert {(int(r.a), int(r.b)) for r in tree.itertuples()} == {e for e in kept if root(e[0]) == root(int(extreme.a))}
