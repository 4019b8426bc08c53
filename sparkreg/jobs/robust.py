"""Queries on consensus, tuning, sampling, graphs, sources, sinks and streams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkreg.functions import kernels as KF
from sparkreg.functions.storage import bounded_broadcast, materialise, new_folder
from sparkreg.jobs.common import EV, LI, Registry, events, lines, r6, table
from sparkreg.jobs.models import KERNEL, SPARSE, _grid, _points, _shown, _users, fifty
from sparkreg.operators import gp as GP
from sparkreg.operators import graph as GR
from sparkreg.operators import ransac as RS
from sparkreg.operators import tuning as T
from sparkreg.operators.sparse_gp import predict_sparse_gp
from sparkreg.sources import tables as S
from sparkreg.streaming import updates as U
from sparkreg.streaming.event_time import event_time_filter

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add

# ---- consensus

SETTINGS = RS.Settings(threshold=30.0, sample=5, consensus=10, iterations=20)


def _by_supplier(spark, d):
    return lines(spark, d).select(F.col("supp").alias("key"), "x", "y")


_DRAWN = "c AS (SELECT i AS iteration, key FROM (SELECT i, key, row_number() OVER (PARTITION BY i ORDER BY md5('17:' || i || ':' || key), key) AS k FROM (SELECT DISTINCT supp AS key FROM li), (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS i)) WHERE k <= 5)"


@add("ransac_candidates", f"WITH {LI}, {_DRAWN} SELECT * FROM c")
def _(spark, d):
    return RS.candidates(_by_supplier(spark, d).select("key").distinct(), SETTINGS)


def _fixed_draw(spark, d):
    """Given candidates: of iteration i the suppliers with key mod 20 = i."""
    return table(spark, d, "supplier").select((F.col("s_suppkey") % 20).cast("int").alias("iteration"), F.col("s_suppkey").alias("key"))


_JUDGED = "f AS (SELECT iteration, regr_intercept(y, x) AS o, regr_slope(y, x) AS s FROM c JOIN li ON supp = key GROUP BY 1), m AS (SELECT iteration, supp AS key, sqrt(avg((y - o - s * x) ** 2)) AS metric FROM li, f GROUP BY 1, 2), j AS (SELECT m.iteration, m.key, CASE WHEN c.key IS NOT NULL THEN 'candidate' WHEN metric <= 30.0 THEN 'inlier' ELSE 'outlier' END AS role, metric FROM m LEFT JOIN c ON c.key = m.key AND c.iteration = m.iteration)"
_RANSAC = f"c AS (SELECT CAST(s_suppkey % 20 AS INTEGER) AS iteration, s_suppkey AS key FROM supplier), {_JUDGED}"


@add("ransac_inliers", f"WITH {LI}, {_RANSAC} SELECT iteration, key, role, round(metric, 6) AS metric FROM j")
def _(spark, d):
    return RS.inliers(_by_supplier(spark, d), _fixed_draw(spark, d), SETTINGS).select("iteration", "key", "role", r6("metric").alias("metric"))


@add("ransac_consensus", f"WITH {LI}, {_RANSAC} SELECT iteration, count(*) AS size, round(avg(metric), 6) AS metric FROM j WHERE role <> 'outlier' GROUP BY 1 HAVING count(*) >= 10")
def _(spark, d):
    return RS.consensus(RS.inliers(_by_supplier(spark, d), _fixed_draw(spark, d), SETTINGS), SETTINGS).select("iteration", "size", r6("metric").alias("metric"))


@add("ransac_fit", f"WITH {LI}, {_DRAWN}, {_JUDGED}, g AS (SELECT iteration, avg(metric) AS metric FROM j WHERE role <> 'outlier' GROUP BY 1 HAVING count(*) >= 10), b AS (SELECT iteration FROM g ORDER BY metric, iteration LIMIT 1) SELECT CASE WHEN (SELECT count(DISTINCT supp) FROM li) <= 10 THEN 'invalid_arguments' WHEN count(*) = 0 THEN 'no_consensus' ELSE 'success' END AS code, coalesce(round(regr_intercept(y, x), 6), 'nan'::DOUBLE) AS \"offset\", coalesce(round(regr_slope(y, x), 6), 'nan'::DOUBLE) AS slope FROM li WHERE supp IN (SELECT key FROM j JOIN b USING (iteration) WHERE role <> 'outlier') AND (SELECT count(DISTINCT supp) FROM li) > 10")
def _(spark, d):
    code, _, fitted = RS.fit(_by_supplier(spark, d), SETTINGS)
    row = fitted if fitted is not None else spark.range(1).select(F.lit(math.nan).alias("offset"), F.lit(math.nan).alias("slope"))
    return row.select(F.lit(code).alias("code"), r6("offset").alias("offset"), r6("slope").alias("slope"))


_CODES = [(1, 2, 20, 0, 0, 4), (0, 2, 20, 0, 0, 4), (3, 2, 20, 0, 0, 4), (3, 10**9, 20, 0, 0, 4), (3, 5, 0, 0, 0, 4), (1, 2, 20, 0, 0, 0), (1, 2, 20, 1, 0, 4), (1, 2, 20, 3, 3, 4), (1, 2, 20, 2, 3, 4)]


@add("ransac_return_code", f"WITH {LI}, g AS (SELECT count(DISTINCT supp) AS n FROM li), a AS (SELECT * FROM (VALUES {', '.join(map(str, _CODES))}) t(sample, consensus, iterations, failed, max_failed, agreed)) SELECT sample, consensus, iterations, failed, max_failed, agreed, CASE WHEN iterations <= 0 OR sample <= 0 OR sample >= n OR consensus >= n OR consensus < sample THEN 'invalid_arguments' WHEN failed > 0 AND failed >= max_failed THEN 'exceeded_max_failed_candidates' WHEN agreed = 0 THEN 'no_consensus' ELSE 'success' END AS code FROM a, g")
def _(spark, d):
    """Outcomes of searches among the suppliers, by settings and counts."""
    columns = ("sample", "consensus", "iterations", "failed", "max_failed", "agreed")
    asked = spark.createDataFrame(_CODES, "sample int, consensus long, iterations int, failed int, max_failed int, agreed int")
    groups = F.broadcast(_by_supplier(spark, d).agg(F.count_distinct("key").alias("groups")))
    code = RS.return_code(*(F.col(c) for c in ("groups", "sample", "consensus", "iterations", "failed", "max_failed", "agreed")))
    return asked.crossJoin(groups).select(*columns, code.alias("code"))


def _mean_line() -> RS.Model:
    return RS.Model(lambda pdf: np.polyfit(pdf["x"], pdf["y"], 1), lambda w, pdf: float(np.sqrt(((pdf["y"] - np.polyval(w, pdf["x"])) ** 2).mean())))


@add("ransac_model", f"WITH {LI}, {_DRAWN}, {_JUDGED} SELECT iteration, key, role, round(metric, 6) AS metric FROM j WHERE (SELECT count(DISTINCT supp) FROM li) > 10")
def _(spark, d):
    """The search with a model given as functions."""
    rows = lines(spark, d).select(F.col("supp").alias("key"), "x", "y", (F.col("okey") * 10 + F.col("line")).alias("row_id"))
    _, judged, _ = RS.fit_model(rows, SETTINGS, _mean_line())
    return judged.select("iteration", "key", "role", r6("metric").alias("metric"))


@add("ransac_gp")
def _(spark, d):
    """Per user: groups of five events, consensus by held-out chi-squared on a joint prior as wide as the events are; draws are
    shared by the tasks."""
    rows = _users(spark, d).withColumn("group", F.expr("(row_id - 1) div 5"))
    settings = RS.Settings(threshold=0.999, sample=3, consensus=4, iterations=10, seed=3, max_failed=10)
    return RS.consensus_gp(rows, KF.exponential(5.0, 20.0) + KF.independent_noise(50.0), "group", settings, mean=fifty)


# ---- tuning

_PARAMS = [("a", 1.0, 0.0, 10.0, True, "uniform", 0.0, 10.0), ("b", 0.5, 0.5, math.inf, False, "gaussian", 1.0, 2.0), ("c", 3.0, -math.inf, math.inf, False, "log_normal", 0.5, 1.5), ("d", 2.0, 0.1, 20.0, True, "log_scale_uniform", 0.1, 20.0)]
_PARAMS_SQL = "pa AS (SELECT * FROM (VALUES ('a', 1.0::DOUBLE, 0.0::DOUBLE, 10.0::DOUBLE, true, 'uniform', 0.0::DOUBLE, 10.0::DOUBLE), ('b', 0.5, 0.5, 'inf'::DOUBLE, false, 'gaussian', 1.0, 2.0), ('c', 3.0, '-inf'::DOUBLE, 'inf'::DOUBLE, false, 'log_normal', 0.5, 1.5), ('d', 2.0, 0.1, 20.0, true, 'log_scale_uniform', 0.1, 20.0)) t(name, value, low, high, log_scale, kind, p, q))"
_SETS = "ps AS (SELECT user_id AS set_id, value AS v FROM (SELECT user_id, avg(value) AS value FROM events GROUP BY 1))"


def _parameter_rows(spark, d):
    """Parameter rows of every user: the fixed rows, moved by the user's mean value."""
    params = spark.createDataFrame(_PARAMS, "name string, value double, low double, high double, log_scale boolean, kind string, p double, q double")
    users = events(spark, d).groupBy("user_id").agg(F.avg("target").alias("m"))
    moved = F.least(F.greatest(F.col("value") + F.col("m") / 100, F.col("low")), F.col("high"))
    return users.join(F.broadcast(params)).withColumn("value", F.when(F.col("name") == "b", F.col("value")).otherwise(moved))


_MOVED = f"{_PARAMS_SQL}, mv AS (SELECT user_id, name, CASE WHEN name = 'b' THEN value ELSE least(greatest(value + m / 100, low), high) END AS value, low, high, log_scale, kind, p, q FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY 1), pa)"


@add("tune_candidates", f"WITH {_MOVED}, e AS (SELECT *, CASE WHEN isinf(low) THEN -1e8 ELSE low END AS lo, CASE WHEN isinf(high) THEN 1e8 ELSE high END AS hi FROM mv), k AS (SELECT *, CASE WHEN value <= lo THEN 0 WHEN value >= hi THEN 8 ELSE 4 END AS below FROM e), s AS (SELECT user_id, name, value, below AS k, lo - value AS way FROM k UNION ALL SELECT user_id, name, value, 8 - below, hi - value FROM k) SELECT user_id, name, round(value + 10 ** (-5 + 4.9 * i / (k - 1)) * way, 4) AS query FROM (SELECT *, unnest(range(0, k)) AS i FROM s WHERE k > 0)")
def _(spark, d):
    rows = _parameter_rows(spark, d).withColumn("name", F.struct("user_id", "name"))
    return T.proposal_table(rows).select("name.user_id", "name.name", F.round("query", 4).alias("query"))


def _squares(rows, *by):
    """Mean squared error of y against a + b x for every parameter set (and group of rows), from power sums."""
    sums = materialise(rows.groupBy(*by).agg(*U.power_sums(F.col("x"), F.col("y")), F.sum(F.col("y") * F.col("y")).alias("syy")), "sums")

    def value(sets):
        a, b = F.col("a"), F.col("b")
        square = F.col("syy") + a * a * F.col("n") + b * b * F.col("sxx") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + 2 * a * b * F.col("sx")
        return sets.join(bounded_broadcast(sums)).select("set_id", *by, (square / F.col("n")).alias("value"))

    return value


def _objective(rows):
    return _squares(rows)


@add("evaluate_param_sets", f"WITH {LI}, ps AS (SELECT user_id AS set_id, avg(value) / 10 AS a FROM events GROUP BY 1) SELECT set_id, round(avg((y - a - 1.5 * x) ** 2), 6) AS value FROM li, ps GROUP BY 1")
def _(spark, d):
    sets = events(spark, d).groupBy(F.col("user_id").alias("set_id")).agg((F.avg("target") / 10).alias("a")).withColumn("b", F.lit(1.5))
    return _objective(lines(spark, d))(sets).select("set_id", r6("value").alias("value"))


@add("evaluate_over_datasets", f"WITH {LI}, ps AS (SELECT user_id AS set_id, avg(value) / 10 AS a FROM events GROUP BY 1), m AS (SELECT set_id, flag, avg((y - a - 1.5 * x) ** 2) AS value FROM li, ps GROUP BY 1, 2) SELECT set_id, round(avg(value), 6) AS value FROM m GROUP BY 1")
def _(spark, d):
    """Each return flag a dataset of its own; the mean of their objectives."""
    sets = events(spark, d).groupBy(F.col("user_id").alias("set_id")).agg((F.avg("target") / 10).alias("a")).withColumn("b", F.lit(1.5))
    return T.over_dataset_table(_squares(lines(spark, d), "flag"))(sets).select("set_id", r6("value").alias("value"))


@add("tune_gp")
def _(spark, d):
    """Length and noise of the users' processes by their leave-one-out likelihood."""
    kernel = lambda p: KF.exponential(p["length"], 20.0) + KF.measurement_noise(p["noise"])
    objective = T.gp_objective(materialise(_users(spark, d), "users"), kernel, mean=fifty)
    params, best = T.greedy_tune(spark, {"length": T.Parameter(5.0, 0.1, 100.0), "noise": T.Parameter(5.0, 0.1, 50.0)}, objective, sweeps=1, n=2)
    return spark.createDataFrame([(k, float(round(p.value, 6)), float(round(best, 4))) for k, p in params.items()], "name string, value double, best double")


@add("greedy_tune")
def _(spark, d):
    rows = materialise(lines(spark, d).groupBy("supp").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "means")
    params, best = T.greedy_tune(spark, {"a": T.Parameter(1.0, -50.0, 50.0), "b": T.Parameter(1.0, 0.0, 10.0)}, _objective(rows), sweeps=3)
    return spark.createDataFrame([(k, float(round(p.value, 6)), float(round(best, 6))) for k, p in params.items()], "name string, value double, best double")


@add("finite_difference_gradient", f"WITH {LI}, m AS (SELECT avg(x) AS x, avg(y) AS y FROM li GROUP BY supp) SELECT name, round(g, 2) AS gradient FROM (SELECT 'a' AS name, -2 * avg(y - 1 - 2 * x) AS g FROM m UNION ALL SELECT 'b', -2 * avg((y - 1 - 2 * x) * x) FROM m)")
def _(spark, d):
    rows = materialise(lines(spark, d).groupBy("supp").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "means")
    g = T.gradient(spark, {"a": T.Parameter(1.0), "b": T.Parameter(2.0)}, _objective(rows))
    return spark.createDataFrame([(k, float(round(v, 2))) for k, v in g.items()], "name string, gradient double")


@add("param_prior_loglik", f"WITH {_MOVED} SELECT user_id, round(sum(CASE kind WHEN 'uniform' THEN -ln(q - p) WHEN 'log_scale_uniform' THEN -ln(value) - ln(ln(q) - ln(p)) WHEN 'gaussian' THEN -0.5 * (ln(2 * pi()) * 2 * ln(q) + ((value - p) / q) ** 2) ELSE -0.5 * ln(2 * pi()) - ln(q) - ln(value) - ((ln(value) - p) / q) ** 2 END), 6) AS log_prior FROM mv GROUP BY 1")
def _(spark, d):
    log_pdf = T.prior_log_pdf(F.col("kind"), F.col("value"), F.col("p"), F.col("q"))
    return _parameter_rows(spark, d).groupBy("user_id").agg(r6(F.sum(log_pdf)).alias("log_prior"))


@add("tuning_space", f"WITH {_MOVED} SELECT user_id, name, round(CASE WHEN log_scale THEN ln(value) ELSE value END, 6) AS tuned, round(value, 6) AS back FROM mv")
def _(spark, d):
    rows = _parameter_rows(spark, d).withColumn("t", T.to_tuning_space(F.col("value"), F.col("low"), F.col("high"), F.col("log_scale")))
    return rows.select("user_id", "name", r6("t").alias("tuned"), r6(T.from_tuning_space(F.col("t"), F.col("low"), F.col("high"), F.col("log_scale"))).alias("back"))


def _chain(spark, d, iterations: int = 12):
    rows = materialise(lines(spark, d).groupBy("supp").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "means")
    value = _objective(rows)
    density = lambda sets: value(sets).select("set_id", (-0.5 * F.col("value")).alias("value"))
    return T.sample_ensemble(spark, {"a": 30.0, "b": 1.0}, density, iterations)


@add("ensemble_step")
def _(spark, d):
    """The first step of the chain: which walkers moved, and where they are."""
    return _chain(spark, d, 1).select("ensemble_index", "accepted", r6("a").alias("a"), r6("b").alias("b"))


@add("ensemble_sampler")
def _(spark, d):
    return _chain(spark, d).select("iteration", "ensemble_index", r6("log_probability").alias("log_probability"), r6("a").alias("a"), r6("b").alias("b"))


def _log(spark, d):
    """A sampler log made of the events: ten walkers an iteration."""
    e = events(spark, d)
    return e.select(F.expr("int(row_id div 10)").alias("iteration"), (F.col("row_id") % 10).cast("int").alias("ensemble_index"), (-F.col("target")).alias("log_probability"), S.rounded(F.col("feature"), 4).alias("p"), F.col("target").alias("q"))


_LOG = "lg AS (SELECT CAST(row_id // 10 AS INTEGER) AS iteration, CAST(row_id % 10 AS INTEGER) AS ensemble_index, -target AS log_probability, round(feature, 4) AS p, target AS q FROM ev)"


@add("sampler_summary", f"WITH {EV}, {_LOG}, k AS (SELECT * FROM lg WHERE iteration >= 50 AND (iteration - 50) % 3 = 0), c AS (SELECT quantile_cont(log_probability, 0.1) AS c FROM k), t AS (SELECT unnest([{{'name': 'p', 'v': p}}, {{'name': 'q', 'v': q}}]) AS s FROM k, c WHERE log_probability >= c), l AS (SELECT s.name AS name, quantile_cont(s.v, 0.05) AS a, quantile_cont(s.v, 0.95) AS b FROM t GROUP BY 1) SELECT name, round(a - 0.05 * (b - a), 4) AS low, round(b + 0.05 * (b - a), 4) AS high FROM l")
def _(spark, d):
    return T.sampler_summary(_log(spark, d), ["p", "q"], 50, 3).select("name", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


# ---- graphs


def _edges(spark, d):
    """Parts and suppliers joined by line items: the least price in thousands of each pair."""
    pair = lines(spark, d).groupBy((F.col("okey") % 997).alias("a"), (1000 + F.col("supp")).alias("b"))
    return pair.agg(F.min("y").alias("cost")).withColumn("id", F.col("a") * 10_000 + F.col("b"))


@add("graph_vertices", f"WITH {LI} SELECT DISTINCT okey % 997 AS vertex FROM li UNION SELECT 1000 + supp FROM li")
def _(spark, d):
    return GR.vertices(_edges(spark, d))


@add("adjacency", f"WITH {LI}, g AS (SELECT okey % 997 AS a, 1000 + supp AS b, min(y) AS cost FROM li GROUP BY 1, 2), t AS (SELECT a AS source, b AS target, cost FROM g UNION ALL SELECT b, a, cost FROM g) SELECT source, count(*) AS degree, round(sum(cost), 6) AS cost FROM t GROUP BY 1")
def _(spark, d):
    return GR.adjacency(_edges(spark, d)).groupBy("source").agg(F.count(F.lit(1)).alias("degree"), r6(F.sum("cost")).alias("cost"))


def _forest(df):
    return df.select("a", "b", "id", r6("cost").alias("cost"))


@add("minimum_spanning_forest")
def _(spark, d):
    return _forest(GR.spanning_forest(_edges(spark, d)))


@add("maximum_spanning_forest")
def _(spark, d):
    return _forest(GR.spanning_forest(_edges(spark, d), maximum=True))


@add("minimum_spanning_tree")
def _(spark, d):
    return _forest(GR.spanning_tree(_edges(spark, d)))


@add("maximum_spanning_tree")
def _(spark, d):
    return _forest(GR.spanning_tree(_edges(spark, d), maximum=True))


# ---- sources and sinks


@add("read_observations_thin", f"WITH {EV} SELECT row_id AS station, round(feature, 6) AS lat, target AS temp FROM ev WHERE row_id % 5 = 0")
def _(spark, d):
    path = new_folder(spark, "observations")
    S.write_csv(events(spark, d).select(F.col("row_id").alias("STATION"), F.col("feature").alias("LAT"), F.lit("x").alias("EXTRA"), F.col("target").alias("TEMP")), path)
    rows = S.read_thinned(spark, path, "STATION long, LAT double, EXTRA string, TEMP double", ["STATION"], ["STATION", "LAT", "TEMP"])
    return rows.select(F.col("STATION").alias("station"), r6("LAT").alias("lat"), F.col("TEMP").alias("temp"))


@add("read_prediction_csv", f"WITH {EV} SELECT round(feature, 6) AS feature, target FROM ev")
def _(spark, d):
    path = new_folder(spark, "predictions")
    S.write_csv(events(spark, d).select("feature", F.lit(0.0).alias("prediction"), F.lit(1.0).alias("prediction_variance"), "target", "target_variance"), path)
    return S.read_predictions(spark, path).select(r6("feature").alias("feature"), "target")


def _stations(spark, d):
    """Customers as a station list: places spread over and beyond the United States, ids that repeat."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("row_id"), F.format_string("%06d", k % 700).alias("usaf"), F.when(k % 3 == 0, "BUOY 7").otherwise(F.col("c_name")).alias("station_name"), F.when(k % 5 == 0, "CA").otherwise("US").alias("ctry"),
        F.when(k % 7 == 0, None).otherwise("TX").alias("state"), (20 + k % 40).cast("double").alias("lat"), (-130 + k % 80).cast("double").alias("lon"), F.col("c_acctbal").alias("elev"), (20170000 + (k % 4) * 10101).cast("int").alias("end"),
    )


_ST = "st AS (SELECT c_custkey AS row_id, printf('%06d', c_custkey % 700) AS usaf, CASE WHEN c_custkey % 3 = 0 THEN 'BUOY 7' ELSE c_name END AS station_name, CASE WHEN c_custkey % 5 = 0 THEN 'CA' ELSE 'US' END AS ctry, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'TX' END AS state, CAST(20 + c_custkey % 40 AS DOUBLE) AS lat, CAST(-130 + c_custkey % 80 AS DOUBLE) AS lon, c_acctbal AS elev, 20170000 + (c_custkey % 4) * 10101 AS ed FROM customer), us AS (SELECT usaf, arg_min(lat, row_id) AS lat, arg_min(lon, row_id) AS lon, arg_min(elev, row_id) AS elev FROM st WHERE lat <> 0 AND lon <> 0 AND elev > -999 AND usaf <> '999999' AND ed >= 20180101 AND ctry = 'US' AND lat BETWEEN 25 AND 50 AND lon BETWEEN -125 AND -60 AND state IS NOT NULL AND station_name NOT LIKE '%BUOY%' GROUP BY 1)"


@add("gsod_station_filter", f"WITH {_ST} SELECT usaf, lat, lon, elev FROM us")
def _(spark, d):
    return S.usable_stations(_stations(spark, d)).select("usaf", "lat", "lon", "elev")


@add("ecef_from_llh", f"WITH {_ST}, n AS (SELECT *, 6378137.0 / sqrt(1 - (2 - 1 / 298.257223563) / 298.257223563 * sin(radians(lat)) ** 2) AS n FROM us) SELECT usaf, round((n + elev) * cos(radians(lat)) * cos(radians(lon)) / 1000, 6) AS x, round((n + elev) * cos(radians(lat)) * sin(radians(lon)) / 1000, 6) AS y, round((n * (1 - (2 - 1 / 298.257223563) / 298.257223563) + elev) * sin(radians(lat)) / 1000, 6) AS z FROM n")
def _(spark, d):
    return S.usable_stations(_stations(spark, d)).select("usaf", *(r6(F.col(c) / 1000).alias(c) for c in "xyz"))


@add("gsod_observations", f"WITH {_ST} SELECT usaf, lat, lon, round(c_acctbal / 100, 1) AS temp FROM customer JOIN us ON usaf = printf('%06d', c_custkey % 700) WHERE c_custkey % 2 = 0")
def _(spark, d):
    """A file of fixed-width lines for each of 700 stations, derived from the customers, written and read back; the station is in
    the file's name, every other line is of another date."""
    k, folder = F.col("c_custkey"), new_folder(spark, "gsod")
    value = F.format_string("%-14s%s  %6.1f", F.lit("001 99999"), F.when(k % 2 == 0, "20180501").otherwise("20180502"), r6(F.round(F.col("c_acctbal") / 100, 1)))
    lines_ = table(spark, d, "customer").select(k.alias("row_id"), value.alias("value"), F.format_string("%06d-99999-2018.op", k % 700).alias("name"))
    S.write_station_files(lines_, folder)
    found = S.station_observations(S.read_station_files(spark, folder), "20180501")
    stations = S.usable_stations(_stations(spark, d)).select("usaf", "lat", "lon")
    return found.join(stations, "usaf").select("usaf", "lat", "lon", "temp")


@add("prediction_grid", "WITH g AS (SELECT c_custkey, 20 + c_custkey % 40 AS lat, ((190 + c_custkey * 7 % 360 + 180) % 360) - 180 AS lon FROM customer) SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS station, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM g WHERE lat BETWEEN 25 AND 50 AND lon BETWEEN -125 AND -60")
def _(spark, d):
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select("c_custkey", (20 + k % 40).cast("double").alias("lat"), (190 + k * 7 % 360).cast("double").alias("lon"))
    return S.prediction_grid(points, (25, 50, -125, -60), ["c_custkey"]).select("station", "lat", "lon")


def _nested(spark, d):
    inner = F.struct(F.col("p_size").alias("one"), F.col("p_brand").alias("two"))
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("row_id"), F.struct(F.col("p_type").alias("foo"), inner.alias("feature")).alias("feature"), F.col("p_retailprice").alias("target"), F.lit(0.25).alias("target_variance"))


@add("flatten_features", 'SELECT p_partkey AS row_id, p_type AS foo, p_size AS "feature.one", p_brand AS "feature.two" FROM part')
def _(spark, d):
    flat = S.flatten(_nested(spark, d))
    return flat.select("row_id", F.col("`feature.foo`").alias("foo"), F.col("`feature.feature.one`").alias("feature.one"), F.col("`feature.feature.two`").alias("feature.two"))


@add("custom_feature_columns", "SELECT p_partkey AS row_id, p_brand || '/' || p_size AS three FROM part")
def _(spark, d):
    three = F.concat_ws("/", "feature.feature.two", F.col("feature.feature.one").cast("string"))
    return S.flatten(_nested(spark, d), custom={"three": three}).select("row_id", "three")


def _csv(spark, d, name: str, rows):
    """rows, written as CSV and read back as text."""
    path = new_folder(spark, name)
    S.write_csv(rows, path)
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in rows.columns), emptyValue="")


@add("write_dataset_csv", f"WITH {EV} SELECT printf('%.6f', round(feature, 4)) AS feature, printf('%.6f', target) AS target, printf('%.6f', target_variance) AS target_variance, CASE WHEN row_id % 2 = 0 THEN printf('%.6f', target + 1) END AS prediction, CASE WHEN row_id % 2 = 0 THEN '2.000000' END AS prediction_variance, CASE WHEN row_id % 2 = 0 THEN 'later' ELSE key END AS note FROM ev")
def _(spark, d):
    e = events(spark, d).withColumnRenamed("key", "note").drop("user_id").withColumn("feature", S.rounded(F.col("feature"), 4))
    p = e.where("row_id % 2 = 0").select("row_id", (F.col("target") + 1).alias("mean"), F.lit(2.0).alias("variance"), F.lit("later").alias("note"))
    return _csv(spark, d, "dataset", S.csv_rows(e, p, ["note"]))


@add("write_dataset_only_csv", f"WITH {EV} SELECT printf('%.6f', round(feature, 4)) AS feature, printf('%.6f', target) AS target, printf('%.6f', target_variance) AS target_variance, '0.000000' AS prediction, '0.000000' AS prediction_variance FROM ev")
def _(spark, d):
    return _csv(spark, d, "dataset", S.csv_rows(events(spark, d).drop("key", "user_id").withColumn("feature", S.rounded(F.col("feature"), 4)), None))


@add("write_many_datasets_csv", "SELECT s_name AS note, printf('%.6f', s_acctbal) AS target FROM supplier UNION ALL SELECT NULL, printf('%.6f', c_acctbal) FROM customer")
def _(spark, d):
    first = table(spark, d, "supplier").select(F.col("s_name").alias("note"), S.fixed(F.col("s_acctbal")).alias("target"))
    second = table(spark, d, "customer").select(F.col("c_mktsegment").alias("unknown"), S.fixed(F.col("c_acctbal")).alias("target"))
    return _csv(spark, d, "many", S.many_csv_rows([first, second]))


@add("write_matrix_csv", "SELECT vec_id AS i, array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') AS line FROM embeddings")
def _(spark, d):
    m = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return S.matrix_lines(m)


@add("write_sampler_csv", f"WITH {EV}, {_LOG} SELECT iteration, ensemble_index, printf('%.6f', log_probability) AS log_probability, printf('%.6f', p) AS p, printf('%.6f', q) AS q FROM lg")
def _(spark, d):
    log = _log(spark, d)
    rows = log.select("iteration", "ensemble_index", *(S.fixed(F.col(c)).alias(c) for c in ("log_probability", "p", "q")))
    back = _csv(spark, d, "sampler", rows)
    return back.withColumns({c: F.col(c).cast("int") for c in ("iteration", "ensemble_index")})


@add("read_sampler_last_state", f"WITH {EV}, {_LOG} SELECT iteration, ensemble_index, round(log_probability, 6) AS log_probability, CASE WHEN ensemble_index = 3 THEN -99.0 ELSE round(least(greatest(p, 1.0), 2.0), 6) END AS p, CASE WHEN ensemble_index = 3 THEN -99.0 ELSE round(ln(least(greatest(p, 1.0), 2.0)), 6) END AS tuned FROM lg WHERE iteration = (SELECT max(iteration) FROM lg)")
def _(spark, d):
    log = _log(spark, d).select("iteration", "ensemble_index", "log_probability", F.when(F.col("ensemble_index") == 3, "bad").otherwise(F.col("p").cast("string")).alias("p"))
    path = new_folder(spark, "sampler")
    S.write_csv(log, path)
    state = S.last_sampler_state(spark.read.csv(path, header=True), {"p": T.Parameter(1.5, 1.0, 2.0, log_scale=True)})
    shown = lambda c: F.when(F.isnan(c), -99.0).otherwise(r6(c))
    return state.select("iteration", "ensemble_index", r6("log_probability").alias("log_probability"), shown("p").alias("p"), shown("tuned_p").alias("tuned"))


def _saved(spark, d) -> str:
    path = new_folder(spark, "fit")
    S.save_fit(GP.fit_gp(_users(spark, d), KERNEL, mean=fifty), path)
    return path


@add("save_fit")
def _(spark, d):
    saved = spark.read.parquet(_saved(spark, d))
    return saved.select("key", "n", F.size("x").alias("features"), F.size("root").alias("factor"), F.size("information").alias("information"))


@add("load_fit")
def _(spark, d):
    path = _saved(spark, d)
    return _shown(GP.predict_gp(S.load_fit(spark, path), _grid(spark, d), KERNEL, mean=fifty))


# ---- streams


def _streamed(spark, d, keep: str):
    """Events written as a few files, read as a stream."""
    path = new_folder(spark, "stream")
    rows = events(spark, d).select("row_id", "feature", "target", "target_variance", "key", "user_id").where(keep)
    rows.repartitionByRange(4, "feature").sortWithinPartitions("feature").write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _run(spark, writer) -> None:
    query = writer.option("checkpointLocation", new_folder(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()


@add("stream_regression_update", f'WITH {EV} SELECT key, CAST(count(*) AS DOUBLE) AS n, round(regr_intercept(target, feature), 6) AS "offset", round(regr_slope(target, feature), 6) AS slope FROM ev GROUP BY 1')
def _(spark, d):
    model = U.RegressionStream(new_folder(spark, "regression"), "feature", "target", ["key"], compact_every=3)
    _run(spark, _streamed(spark, d, "true").writeStream.foreachBatch(model.update))
    return model.fits(spark).select("key", "n", r6("offset").alias("offset"), r6("slope").alias("slope"))


@add("stream_sparse_gp_update")
def _(spark, d):
    model = U.SparseStream(SPARSE, _points(spark, d), new_folder(spark, "sparse-state"), mean=fifty)
    _run(spark, _streamed(spark, d, "true").writeStream.foreachBatch(model.update))
    return predict_sparse_gp(events(spark, d), SPARSE, model.fit(spark), fifty).select("row_id", F.round("mean", 4).alias("mean"), F.round("variance", 4).alias("variance"))


def _decay(step: float) -> float:
    return 100.0 * math.exp(-abs(step) / 10.0)


_KALMAN = "s AS (SELECT user_id AS key, row_id, feature AS x, CASE WHEN row_id % 4 = 0 THEN NULL ELSE target - 50 END AS y, row_number() OVER (PARTITION BY user_id ORDER BY feature, row_id) AS i FROM ev), k(key, row_id, i, x, m, p) AS (SELECT key, row_id, i, x, CASE WHEN y IS NULL THEN 0.0 ELSE 100.0 / 125 * y END, CASE WHEN y IS NULL THEN 100.0 ELSE 100.0 * 25 / 125 END FROM s WHERE i = 1 UNION ALL SELECT s.key, s.row_id, s.i, s.x, CASE WHEN y IS NULL THEN f * m ELSE f * m + pq / (pq + 25) * (y - f * m) END, CASE WHEN y IS NULL THEN pq ELSE 25 * pq / (pq + 25) END FROM (SELECT s.*, exp(-(s.x - k.x) / 10) AS f, k.m, k.p + 100 - 100 * exp(-(s.x - k.x) / 10) ** 2 AS pq FROM k JOIN s ON s.key = k.key AND s.i = k.i + 1) s)"


def _series_rows(spark, d):
    y = F.when(F.col("row_id") % 4 == 0, float("nan")).otherwise(F.col("target") - 50)
    return events(spark, d).select(F.col("user_id").alias("key"), "row_id", "feature", y.alias("target"))


@add("kalman_filter", f"WITH RECURSIVE {EV}, {_KALMAN} SELECT key, row_id, round(m, 6) AS mean, round(p, 6) AS variance FROM k")
def _(spark, d):
    return _shown(U.kalman_filter(_series_rows(spark, d), _decay, 25.0))


_STREAMED = _KALMAN.replace("CASE WHEN row_id % 4 = 0 THEN NULL ELSE target - 50 END AS y", "target - 50 AS y")


@add("stream_kalman_filter", f"WITH RECURSIVE {EV}, {_STREAMED} SELECT key, row_id, round(m, 6) AS mean, round(p, 6) AS variance FROM k")
def _(spark, d):
    """Events that arrive in disorder: in four waves, one after the other, each shuffled, under a watermark that is as late as a
    wave is long; a heartbeat at the end lets the watermark pass the last of them."""
    path, out = new_folder(spark, "stream"), new_folder(spark, "filtered")
    rows = events(spark, d).select(F.col("user_id").alias("key"), "row_id", F.timestamp_micros(F.round(F.col("feature") * 3.6e9).cast("long")).alias("ts"), "feature", (F.col("target") - 50).alias("target"))
    ends = rows.agg(F.min("feature").alias("a"), F.max("feature").alias("b")).first()
    width = (ends.b - ends.a) / 4 + 1
    wave = F.floor((F.col("feature") - ends.a) / width)
    beat = rows.agg((F.max("feature") + 10 * width).alias("feature")).select(F.lit(None).cast(dict(rows.dtypes)["key"]).alias("key"), F.lit(None).cast("long").alias("row_id"), F.timestamp_micros((F.col("feature") * 3.6e9).cast("long")).alias("ts"), "feature", F.lit(0.0).alias("target"))
    for w in range(4):
        rows.where(wave == w).repartition(4, F.xxhash64("row_id")).sortWithinPartitions(F.xxhash64("row_id")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    progress = new_folder(spark, "progress")

    def run() -> None:
        found = event_time_filter(stream, _decay, 25.0, delay=f"{math.ceil(width)} hours", unit_us=3.6e9, outage_us=10 * 86_400_000_000, expire_us=20 * 86_400_000_000)
        sink = found.writeStream.outputMode("append").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
        sink.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()

    run()
    beat.write.mode("append").parquet(path)
    run()
    return _shown(spark.read.option("basePath", out).parquet(f"{out}/batch=*").where("not outage"))


@add("iterative_gp")
def _(spark, d):
    return _shown(U.iterative_gp(_users(spark, d), KERNEL, mean=fifty))
