"""Sparse processes by key and leave-one-group-out against single fits and refits."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkreg.functions import kernels as KF
from sparkreg.functions import storage
from sparkreg.operators import sparse_gp as SG

K = KF.squared_exponential(2.0, 3.0) + KF.measurement_noise(0.3)
U = np.linspace(0, 9, 8)
SCHEMA = "key long, row_id long, feature double, target double, target_variance double, part int, fold int"


def data_of(keys=5, n=60, hot=0):
    rng = np.random.default_rng(8)
    out = []
    for k in [*range(keys), None]:
        for i in range(n if k != 0 else n + hot):
            x = float(rng.random() * 9)
            out.append((k, len(out), x, float(np.sin(x + (k or 0)) + 0.1 * rng.standard_normal()), 0.01 * (1 + i % 3), int(x), [None, 0, 1, 2][i % 4]))
    return out


def plain_fit(rows, u, group):
    """All rows in one pass, without Spark."""
    fit = SG.SparseFit.prior(K, u)
    pdf = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])
    parts = [pdf] if group is None else [p for _, p in pdf.groupby(group, dropna=False)]
    blocks = [SG._block(K, u, fit.prior_root, p, SG.zero, 1e-12, group) for p in parts]
    return fit.plus(SG.triangle(np.vstack([b for b, _, _ in blocks])), sum(d for _, d, _ in blocks), sum(q for _, _, q in blocks), len(pdf))


def close(found, fit, data, key, atol=1e-6):
    mine = found[found.key.isna() if key is None else found.key == key].sort_values("row_id")
    own = {r[1]: r[2] for r in data if r[0] == key}
    assert len(mine) == len(own)
    m, v = fit.marginal(K, np.array([own[i] for i in mine.row_id]))
    np.testing.assert_allclose(mine["mean"], m, atol=atol)
    np.testing.assert_allclose(mine["variance"], v, atol=atol)


@pytest.fixture(params=["small", "large"])
def size(request, monkeypatch):
    if request.param == "large":
        from sparkreg.operators import gp

        monkeypatch.setattr(SG, "is_small", lambda *a, **k: False)
        monkeypatch.setattr(gp, "is_small", lambda *a, **k: False)
    return request.param


@pytest.mark.parametrize("group", [None, "part"])
def test_keyed_fits_updates_and_rebases_equal_single_ones(spark, size, group):
    data = data_of(3, 40, hot=200)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    points = spark.createDataFrame([(k, U.tolist()) for k in (0, 1, 2, 7)], "key long, u array<double>").union(spark.createDataFrame([(None, U[:5].tolist())], "key long, u array<double>"))
    fits = SG.update_sparse_gps(SG.prior_fits(points, K), df.where("part < 5"), K, group=group, part_rows=50)
    fits = storage.materialise(SG.update_sparse_gps(fits, df.where("part >= 5"), K, group=group, part_rows=50), "keyed")
    assert sorted(str(r.key) for r in fits.collect()) == ["0", "1", "2", "7", "None"]
    assert {r.key: r.n for r in fits.collect()}[7] == 0
    found = SG.predict_sparse_gps(fits, df, K).toPandas()
    moved = SG.predict_sparse_gps(SG.rebase_sparse_gps(fits, points.where("key < 2").withColumn("u", F.array(*map(F.lit, np.linspace(0, 9, 12).tolist()))), K), df, K).toPandas()
    for k in (0, 1, 2, None):
        u = U if k is not None else U[:5]
        fit = plain_fit([r for r in data if r[0] == k], u, group)
        close(found, fit, data, k)
        close(moved, fit.rebase(K, np.linspace(0, 9, 12)) if k in (0, 1) else fit, data, k, 1e-4)


def test_a_task_writes_one_block_a_key(spark, monkeypatch):
    """Blocks before merging: at most tasks times keys, whatever the batches; merging takes several levels."""
    data = data_of(4, 100)
    df = spark.createDataFrame(data, SCHEMA).repartition(40)
    monkeypatch.setattr(SG, "merged_by_key", lambda blocks, key, fan_in=3, f=SG.merged_by_key: (sizes.append((blocks.count(), blocks.groupBy("key").count().agg(F.max("count")).first()[0])), f(blocks, key, fan_in))[1])
    sizes = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        points = spark.createDataFrame([(k, U.tolist()) for k in range(4)], "key long, u array<double>")
        fits = SG.update_sparse_gps(SG.prior_fits(points, K), df, K)
        found = SG.predict_sparse_gps(fits, df.where("key is not null"), K).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sizes[0][0] <= 40 * 4 and 3 < sizes[0][1] <= 40
    for k in range(4):
        close(found, plain_fit([r for r in data if r[0] == k], U, None), data, k)


@pytest.mark.parametrize("group", [None, "part"])
def test_folds_left_out_by_downdating_equal_refits(spark, group):
    data = [(0, i, *r[2:6], r[6]) for i, r in enumerate(data_of(1, 80))]
    if group:
        data = [(*r[:6], None if r[5] == 0 else r[5] % 3) for r in data]  # a group lies within a fold
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    whole, fits = SG.fold_fits(df, K, U, "fold", group)
    direct = plain_fit(data, U, group)
    xs = np.linspace(-1, 10, 30)
    for a, b in zip(whole.marginal(K, xs), direct.marginal(K, xs), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-8)
    assert abs(whole.log_likelihood() - direct.log_likelihood()) < 1e-6
    found = SG.logo_sparse_gp(df, K, U, "fold", group).toPandas()
    joint = SG.logo_sparse_gp_joint(df, K, U, "fold", group).toPandas()
    assert len(found) == len(data) and found.fold.isna().sum() == sum(r[6] is None for r in data) > 0
    for f in {r[6] for r in data}:
        refit = plain_fit([r for r in data if r[6] != f], U, group)
        mine = found[found.fold.isna() if f is None else found.fold == f].sort_values("row_id")
        x = np.array([data[i][2] for i in mine.row_id])
        m, c = refit.joint(K, x)
        np.testing.assert_allclose(mine["mean"], m, atol=1e-6)
        np.testing.assert_allclose(mine["variance"], np.diag(c), atol=1e-6)
        own = joint[joint.fold.isna() if f is None else joint.fold == f].sort_values(["i", "j"])
        np.testing.assert_allclose(own["cov"].to_numpy().reshape(len(x), len(x)), c, atol=1e-6)
        left = next(SG.SparseFit.from_row(r) for r in fits.collect() if r.fold == f)
        assert left.rows == refit.rows and abs(left.log_likelihood() - refit.log_likelihood()) < 1e-5


def test_groups_that_lie_across_batches():
    frames = [pd.DataFrame({"k": k, "g": g, "v": range(len(k))}) for k, g in (([1, 1, 1], [0, 0, 1]), ([1, 1], [1, 1]), ([1, 2, 2], [1, 1, None]), ([2], [None]))]
    got = [list(zip(p["k"], p["g"].map(lambda v: -1 if v is None or v != v else v), strict=True)) for p in SG.whole_groups(iter(frames), ["k", "g"], 10)]
    assert sum(map(len, got)) == 9
    seen = [x for part in got for x in dict.fromkeys(part)]
    assert len(seen) == len(set(seen))  # no group in two parts
    with pytest.raises(ValueError, match="more than 2"):
        list(SG.whole_groups(iter(frames), ["k", "g"], 2))


def test_empty_tables(spark):
    points = spark.createDataFrame([(1, U.tolist())], "key long, u array<double>")
    none = spark.createDataFrame([], SCHEMA)
    fits = SG.update_sparse_gps(SG.prior_fits(points, K), none, K)
    assert [r.n for r in fits.collect()] == [0]
    assert SG.predict_sparse_gps(fits, none, K).count() == 0
    assert SG.logo_sparse_gp(none, K, U, "fold").count() == 0


def test_small_folds_left_out_in_closed_form_equal_refits(spark):
    """Folds of one to nine rows, a null one among them, some larger than there are points."""
    data, fold, left = [], None, 3
    for i, r in enumerate(data_of(1, 90)):
        data.append((0, i, *r[2:6], fold))
        left -= 1
        if left == 0:
            fold, left = (0 if fold is None else fold + 1), 1 + i % 9
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    joint = SG.logo_sparse_gp_joint(df, K, U, "fold").toPandas()
    assert len(joint) == sum(sum(r[6] == f for r in data) ** 2 for f in {r[6] for r in data})
    for f in {r[6] for r in data}:
        refit = plain_fit([r for r in data if r[6] != f], U, None)
        own = joint[joint.fold.isna() if f is None else joint.fold == f].sort_values(["i", "j"])
        ids = sorted(r[1] for r in data if r[6] == f)
        m, c = refit.joint(K, np.array([data[i][2] for i in ids]))
        assert own["i"].tolist() == np.repeat(ids, len(ids)).tolist() and own["j"].tolist() == ids * len(ids)
        np.testing.assert_allclose(own["mean"].to_numpy().reshape(len(ids), -1)[:, 0], m, atol=1e-6)
        np.testing.assert_allclose(own["cov"].to_numpy().reshape(len(ids), -1), c, atol=1e-6)


@pytest.mark.parametrize("places", [None, 1])
def test_large_groups_without_their_covariance_equal_dense_ones(monkeypatch, places):
    """Also where rows share their features (and with them the noise of measurements), and beyond max_rows."""
    rng = np.random.default_rng(3)
    x = rng.random(700) * 4
    x = x if places is None else x.round(places)
    pdf = pd.DataFrame({"feature": x, "target": np.sin(3 * x) + rng.standard_normal(700), "target_variance": 0.1 * (1 + np.arange(700) % 5), "g": np.arange(700) // 400})
    root = SG.SparseFit.prior(K, U).prior_root
    dense = SG._block(K, U, root, pdf, SG.zero, 1e-12, "g")
    monkeypatch.setattr(SG, "_DENSE_ROWS", 100)
    large = SG._block(K, U, root, pdf, SG.zero, 1e-12, "g", 50)
    assert len(large[0]) == 2 * (len(U) + 2)  # a triangle a group and a row
    np.testing.assert_allclose(large[0].T @ large[0], dense[0].T @ dense[0], rtol=1e-8, atol=1e-7)
    np.testing.assert_allclose(large[1:], dense[1:], rtol=1e-9)
    rough = KF.exponential(0.01, 3.0) + KF.measurement_noise(0.3)  # no low rank
    if places is None:
        with pytest.raises(ValueError, match="at most 50"):
            SG._block(rough, U, SG.SparseFit.prior(rough, U).prior_root, pdf, SG.zero, 1e-12, "g", 50)
    shared = KF.squared_exponential(2.0, 3.0) + KF.measurements_of(KF.squared_exponential(0.5, 1.0))  # measurements share more than the process
    assert SG._large_group(shared, x, root @ shared.matrix(x, U).T, np.column_stack([shared.matrix(x, U), x]), np.full(700, 0.1)) is None
