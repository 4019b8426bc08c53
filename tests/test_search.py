"""Durable samplers, consensus of processes, alignment in several dimensions, station files and large samples."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreg.functions import kernels as KF
from sparkreg.functions.versions import Versions
from sparkreg.jobs.common import gap6
from sparkreg.operators import dataset as D
from sparkreg.operators import gp as GP
from sparkreg.operators import ransac as RS
from sparkreg.operators import tuning as T
from sparkreg.sources import tables as S

# ---- sampler


def density(sets):
    """log N(log a; 1, 1) + log N(b; 2, 0.25) with c fixed."""
    return sets.select("set_id", (-0.5 * F.pow(F.log("a") - 1, F.lit(2.0)) - 2 * F.pow(F.col("b") - F.col("c"), F.lit(2.0))).alias("value"))


START = {"a": T.Parameter(2.0, 0.01, 100.0, log_scale=True), "b": T.Parameter(1.0), "c": T.Parameter(2.0, fixed=True)}


def test_a_chain_that_was_stopped_is_the_unbroken_one(spark, tmp_path):
    whole = T.sample_ensemble(spark, START, density, 8, every=3, folder=f"file://{tmp_path}/whole").toPandas()
    seen = []
    folder = f"file://{tmp_path}/parts"
    T.sample_ensemble(spark, START, density, 5, every=3, folder=folder, callbacks=(lambda rows, last: seen.append((last, rows.count())),))
    Versions(folder, "upto").drop(spark, [4])  # what was not written is done again
    again = T.sample_ensemble(spark, START, density, 8, every=3, folder=folder, callbacks=(lambda rows, last: seen.append((last, rows.count())),)).toPandas()
    order = ["iteration", "ensemble_index"]
    a, b = (x.sort_values(order).reset_index(drop=True) for x in (whole, again))
    assert a.equals(b) and len(a) == 8 * 5 and set(a["c"]) == {2.0} and (a["a"] > 0).all()
    assert seen == [(2, 15), (4, 10), (5, 15), (7, 10)]
    assert len(T.sample_ensemble(spark, START, density, 4, every=3, folder=folder).collect()) == 20


def test_draws_follow_the_density(spark):
    log = T.sample_ensemble(spark, START, density, 60, walkers=30, every=60).toPandas()
    late = log[log.iteration >= 20]
    assert abs(np.log(late["a"]).mean() - 1) < 0.4 and abs(late["b"].mean() - 2) < 0.2


def test_last_state_in_tuning_space(spark):
    log = spark.createDataFrame([("0", "0", "1", "5"), ("1", "0", "-2.5", "1000"), ("1", "1", "x", "bad")], "iteration string, ensemble_index string, log_probability string, p string")
    got = {r.ensemble_index: r for r in S.last_sampler_state(log, {"p": T.Parameter(1.0, 0.1, 10.0, log_scale=True)}).collect()}
    assert got[0].p == 10.0 and got[0].tuned_p == pytest.approx(math.log(10)) and math.isnan(got[1].p) and math.isnan(got[1].tuned_p) and math.isnan(got[1].log_probability)


# ---- consensus

K = KF.squared_exponential(3.0, 2.0)
ROWS = "key long, row_id long, feature double, target double, target_variance double, g int"


def outlier_rows(keys=(1, 2)):
    rng = np.random.default_rng(6)
    out = []
    for k in keys:
        for i in range(30):
            g = i // 3
            y = float(np.sin(0.3 * i) + 0.05 * rng.standard_normal() + (6 if g in (2, 7) else 0))
            out.append((k, i, 0.3 * i, y, 0.01, None if g == 9 else g))
    return out


def plain_search(rows, s, inlier, consensus, valid):
    """One key by itself, draw by draw."""
    x, y, v = (np.array([r[c] for r in rows]) for c in (2, 3, 4))
    codes = np.array([99 if r[5] is None else r[5] for r in rows])
    labels = sorted(set(codes.tolist()))
    codes = np.searchsorted(labels, codes)
    names, prior, cov = list(range(len(labels))), np.zeros(len(x)), K.measured(x, x)
    best, failed, done, draw = None, 0, 0, 0
    while done < s.iterations:
        chosen = RS.drawn_groups(names, s, rows[0][0], draw)
        known = np.flatnonzero(np.isin(codes, chosen))
        draw += 1
        if not valid(prior[known], cov[np.ix_(known, known)], y[known], v[known]):
            failed += 1
            if failed >= s.max_failed:
                return "exceeded_max_failed_candidates", -1, 0
            continue
        agreed = set(chosen)
        for g in names:
            at = np.flatnonzero(codes == g)
            if g not in agreed and inlier(*GP.condition(prior, cov, known, y[known], v[known], at), y[at], v[at]) <= s.threshold:
                agreed.add(g)
        at = np.flatnonzero(np.isin(codes, list(agreed)))
        metric = consensus(prior[at], cov[np.ix_(at, at)], y[at], v[at]) if len(agreed) >= s.consensus else math.nan
        if metric == metric and (best is None or metric < best[0]):
            best = (metric, draw - 1, len(at))
        done += 1
    return ("success", best[1], best[2]) if best else ("no_consensus", -1, 0)


@pytest.mark.parametrize("consensus", [RS.feature_count, RS.chi_squared, RS.entropy])
@pytest.mark.parametrize("valid", [RS.chi_squared_valid(0.9), RS.always_valid])
def test_searches_agree_with_plain_ones(spark, consensus, valid):
    data, s = outlier_rows(), RS.Settings(0.999, 3, 5, 12, max_failed=60)
    df = spark.createDataFrame(data, ROWS)
    found = {r.key: r for r in RS.consensus_gp(df, K, "g", s, consensus_metric=consensus, is_valid=valid).collect()}
    for k in (1, 2):
        assert (found[k].code, found[k].iteration, found[k].rows) == plain_search([r for r in data if r[0] == k], s, RS.chi_squared, consensus, valid)
    if consensus is RS.feature_count:
        assert all(r.rows == 24 for r in found.values())  # the eight groups without outliers


def test_the_draws_of_one_key_are_shared_by_all_tasks(spark):
    df = spark.createDataFrame(outlier_rows((1,)), ROWS)
    s = RS.Settings(0.999, 3, 5, 40, max_failed=100)
    one = RS.consensus_gp(df, K, "g", s).first()
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert RS.consensus_gp(df, K, "g", s).first() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert RS.consensus_gp(df, K, "g", RS.Settings(0.999, 3, 5, 5, max_failed=1), is_valid=lambda *a: False).first().code == "exceeded_max_failed_candidates"
    assert RS.consensus_gp(df, K, "g", RS.Settings(-1.0, 3, 5, 5), is_valid=RS.always_valid).first().code == "no_consensus"


# ---- alignment


def points(spark, n, d, seed, hot=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, d)) * 4 - 2
    x[:hot] = 0.5 + 0.01 * rng.random((hot, d))
    names = ["a", "b", "c"][:d]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(n, *([None] * d)), (n + 1, *([float("nan")] * d)), (n + 2, *([float("inf")] * d))]
    return x, names, spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} double" for c in names))


@pytest.mark.parametrize("d", [1, 2, 3])
def test_points_in_several_dimensions(spark, d):
    x, names, left = points(spark, 120, d, 1, hot=60)
    y, _, right = points(spark, 90, d, 2, hot=10)
    got = D.align_points(left, right, names, 0.35, hot_rows=10).select("row_id", "r_row_id").collect()
    want = set(zip(*(v.tolist() for v in np.nonzero(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)) <= 0.35)), strict=True))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_hot_cell_does_not_run_in_one_task(spark):
    x, names, left = points(spark, 400, 2, 1, hot=200)
    _, _, right = points(spark, 50, 2, 2, hot=5)
    plan = D.align_points(left, right, names, 0.3, hot_rows=20)
    tasks = plan.where("a > 0.49 and a < 0.52 and r_a > 0.49 and r_a < 0.52").withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()
    assert plan.count() > 0 and len(tasks) >= 1
    parts = left.where("a is not null").withColumn("p", F.pmod(F.xxhash64("row_id", "a", "b"), F.lit(10))).where("row_id < 200").groupBy("p").count().count()
    assert parts == 10


def test_places_on_the_sphere(spark):
    rng = np.random.default_rng(4)
    a = [(i, float(v[0]), float(v[1])) for i, v in enumerate(np.column_stack([rng.random(80) * 180 - 90, rng.random(80) * 360 - 180]))] + [(80, 89.9, 10.0), (81, 10.0, 179.99)]
    b = [(i, float(v[0]), float(v[1])) for i, v in enumerate(np.column_stack([rng.random(80) * 180 - 90, rng.random(80) * 360 - 180]))] + [(80, 89.9, -170.0), (81, 10.0, -179.99)]
    left, right = (spark.createDataFrame(t, "row_id long, lat double, lon double") for t in (a, b))

    def metres(p, q):
        la, lo, lb, lp = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    for limit in (50_000.0, 1_500_000.0):
        got = {(r.row_id, r.r_row_id) for r in D.align_on_sphere(left, right, "lat", "lon", limit).collect()}
        assert got == {(p[0], q[0]) for p in a for q in b if metres(p, q) <= limit}
        assert {(80, 80), (81, 81)} <= got


# ---- files and samples


def test_station_files(spark, tmp_path):
    lines = [(i, f"{i % 40:06d}-99999-2018.op", f"STN--- WBAN   {'20180501' if i % 2 else '20180502'}  {i / 10:6.1f}") for i in range(200)]
    lines += [(1000 + k, f"{k:06d}-99999-2018.op", "STN--- WBAN   YEARMODA    TEMP") for k in range(40)]
    folder = f"file://{tmp_path}/stations"
    df = spark.createDataFrame(lines, "row_id long, name string, value string")
    for _ in range(2):  # written again, files are replaced
        made = S.write_station_files(df, folder)
    assert made.count() == 40 and len([p for p in (tmp_path / "stations").iterdir() if not p.name.startswith(".")]) == 40
    got = S.station_observations(S.read_station_files(spark, folder), "20180501").collect()
    assert sorted((r.usaf, r.temp) for r in got) == sorted((n[:6], i / 10) for i, n, v in lines if "20180501" in v)
    with pytest.raises(Exception, match="at most 3"):
        S.write_station_files(df, folder, max_lines=3)


@pytest.mark.parametrize("n", [0, 1, 37, 500, 999, 1000])
def test_samples_of_any_size(spark, n):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.lit("x").alias("v"))
    got = [r.row_id for r in D.sample_without_replacement(df, n, 7, bits=8, few=5).collect()]
    want = sorted(range(1000), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())[:n]
    assert sorted(got) == sorted(want)


def test_samples_beyond_the_table_are_an_error(spark):
    with pytest.raises(ValueError, match="more rows"):
        D.sample_without_replacement(spark.range(10).select(F.col("id").alias("row_id")), 11, 7)


def test_groups_of_several_sizes_are_judged_as_one_by_one(spark):
    """Stacked metrics, a factor a draw, and no draws after the last that counts: as a strategy that is called for each group."""
    rng, rows = np.random.default_rng(8), []
    for k in range(6):
        for i in range(23):  # a group of three rows at the end
            rows.append((k, i, 0.4 * i, float(np.sin(i) + (9 if i // 4 == k else 0) + 0.3 * rng.standard_normal()), 0.1, i // 4))
    df = spark.createDataFrame(rows, "key long, row_id long, feature double, target double, target_variance double, g long")
    kernel, settings = KF.exponential(3.0, 2.0) + KF.independent_noise(1.0), RS.Settings(threshold=0.9, sample=2, consensus=3, iterations=6, seed=5, max_failed=4)
    got = RS.consensus_gp(df, kernel, "g", settings).fillna({"metric": -1.0}).orderBy("key").collect()
    each = RS.consensus_gp(df, kernel, "g", settings, inlier_metric=lambda m, c, y, v: RS.chi_squared(m, c, y, v)).fillna({"metric": -1.0}).orderBy("key").collect()
    assert got == each and len(got) == 6 and RS.chi_squared.of_stack(*(np.stack([a, a]) for a in (np.zeros(2), np.eye(2), np.ones(2), np.ones(2)))).tolist() == [RS.chi_squared(np.zeros(2), np.eye(2), np.ones(2), np.ones(2))] * 2


def test_printed_halves_and_rounded_halves_are_those_of_binary_numbers(spark):
    """Exact halves go to even, and a product just below a half goes down, as in SQL; Java formats both up."""
    values = [0.0078125, 0.0234375, -0.0078125, 1234567.0, 0.1234565, -1e-9, 1e22, float("nan"), float("inf"), None]
    values += np.random.default_rng(1).normal(0, 50, 200).tolist()
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    got = {r.k: r.t for r in df.select("k", S.fixed(F.col("v")).alias("t")).collect()}
    assert got == {k: None if v is None else f"{v:.6f}" for k, v in enumerate(values)}
    halves = [(2 * k + 1) * 0.00005 for k in range(0, 200_000, 7)] + [-0.00015, -7.00005, 0.0, 3.0, 1e17, 123.45675]
    import duckdb

    want = [r[0] for r in duckdb.connect().execute("select round(v, 4) from (select unnest(?::double[]) as v)", [halves]).fetchall()]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(halves)], "k long, v double").select("k", S.rounded(F.col("v"), 4).alias("r")).orderBy("k").collect()
    assert [r.r for r in rows] == want


def test_points_of_one_cell_are_dealt_out_by_their_pairs(spark):
    """Few left rows and many right ones in one cell: the pairs, not the left rows, decide how many tasks there are."""
    left = spark.range(40).select(F.col("id").alias("row_id"), F.lit(0.5).alias("x"), (F.col("id") / 100).alias("y"))
    right = spark.range(500).select(F.col("id").alias("row_id"), F.lit(0.25).alias("x"), (F.col("id") / 1000).alias("y"))
    pairs = D.align_points(left, right, ["x", "y"], 1.0, hot_rows=1)
    counts = [r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(counts) == 40 * 500 and len(counts) > 4 and max(counts) < 10_000
    found = pairs.select("row_id", "r_row_id").distinct().count()
    assert found == 40 * 500


@pytest.mark.parametrize("sizes", [(40, 900), (900, 40)])
def test_points_of_the_larger_side_are_not_copied_to_neighbours(spark, monkeypatch, sizes):
    """What is shuffled: each row of the larger side once, each of the smaller for the 27 cells about it at most."""
    (x, names, left), (y, _, right) = points(spark, sizes[0], 3, 1), points(spark, sizes[1], 3, 2)
    dealt, deal = [], type(left).repartition

    def seen(df, *args):
        dealt.append(df.agg(F.sum(F.size("__run")) if "__run" in df.columns else F.count(F.lit(1))).first()[0])
        return deal(df, *args)

    monkeypatch.setattr(type(left), "repartition", seen)
    got = {tuple(r) for r in D.align_points(left, right, names, 0.5).select("row_id", "r_row_id").collect()}
    assert got == set(zip(*(v.tolist() for v in np.nonzero(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)) <= 0.5)), strict=True))
    assert 0 < sum(dealt) <= 900 + 27 * 40


@pytest.mark.parametrize("d", [1, 2, 3])
@pytest.mark.parametrize("sizes", [(150, 400), (400, 150)])
def test_points_in_small_runs_and_many_parts(spark, monkeypatch, d, sizes):
    """Either side larger, points on the edges of cells and at equal places: every pair once, with its columns in order."""
    for name, small in (("_RUN", 4), ("_GROUP", 12), ("_PARTS", 40), ("_CARRIED", 50), ("MAX_ROWS", sizes[0] - 150)):  # 0: too many cells to know all
        monkeypatch.setattr(D, name, small)
    rng, names = np.random.default_rng(d), ["a", "b", "c"][:d]

    def table(n, extra):
        x = np.round(rng.random((n, d)) * 3 - 1.5, 1)
        x[: n // 3] = 0.25 * rng.integers(-2, 3, (n // 3, d))
        return x, spark.createDataFrame([(i, *v, f"{extra}{i}") for i, v in enumerate(x.tolist())], "row_id long, " + ", ".join(f"{c} double" for c in names) + f", {extra} string")

    (x, left), (y, right) = table(sizes[0], "one"), table(sizes[1], "two")
    pairs = D.align_points(left, right, names, 0.25, hot_rows=1)
    assert pairs.columns == ["row_id", *names, "one", "r_row_id", *(f"r_{c}" for c in names), "r_two"]
    rows = [(r.row_id, r.r_row_id) for r in pairs.collect() if r.one == f"one{r.row_id}" and r.r_two == f"two{r.r_row_id}" and r.r_a == y[r.r_row_id, 0]]
    gap = np.abs(x[:, None, 0] - y[None, :, 0]) if d == 1 else np.sqrt(sum((x[:, None, k] - y[None, :, k]) ** 2 for k in range(d)))
    want = set(zip(*(v.tolist() for v in np.nonzero(gap <= 0.25)), strict=True))
    assert set(rows) == want and len(rows) == len(want) == pairs.count()


@pytest.mark.parametrize("names", [["a"], ["a", "b"]])
def test_points_two_cells_apart_by_their_last_digit(spark, names):
    """1.0 - 0.49999999999999994 and 0.5 + 1e-17 are 0.5 in binary numbers, though a whole cell of 0.5 lies between them."""
    left = spark.createDataFrame([(0, 0.49999999999999994, 0.0), (1, -1e-17, 0.0)], "row_id long, a double, b double")
    right = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.5, 0.0)], "row_id long, a double, b double")
    for one, two in ((left, right), (right, left), (left, right.union(right.select(F.col("row_id") + 2, "a", "b")))):
        got = D.align_points(one, two, names, 0.5).select(F.least("row_id", F.col("r_row_id") % 2), F.greatest("row_id", F.col("r_row_id") % 2)).collect()
        near = one.alias("l").join(two.alias("r"), F.abs(F.col("l.a") - F.col("r.a")) <= 0.5)
        assert len(got) == near.count() >= 3


def test_distances_are_rounded_as_sql_does(spark):
    """Halves of the millionfold go up, what is just below a half does not, whatever the shortest decimal form says."""
    values = [0.0, 1.0000005, 0.0000005, 0.4999995, 2.5e-6, 1.5e-6, 1.2345, 123.4567895, *np.random.default_rng(3).random(300).tolist()]
    values += [(2 * k + 1) * 5e-7 for k in range(0, 3_000_000, 9_973)]
    import duckdb

    want = [r[0] for r in duckdb.connect().execute("select round(v, 6) from (select unnest(?::double[]) as v)", [values]).fetchall()]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double")
    assert [r.g for r in df.select("k", gap6(F.col("v")).alias("g")).orderBy("k").collect()] == want
