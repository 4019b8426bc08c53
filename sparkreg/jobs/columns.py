"""Queries on scalar functions, uncertain columns and pairwise kernels."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sparkreg.functions import columns as C
from sparkreg.functions import kernels as KF
from sparkreg.functions.storage import bounded_broadcast, materialise
from sparkreg.jobs.common import EV, LI, Registry, events, lines, r6, table
from sparkreg.operators import distribution as DI
from sparkreg.operators import pairs as P

_R = Registry()
QUERIES, SQL = _R.queries, _R.sql
add = _R.add


def erf_sql(z: str) -> str:
    """The error function in SQL, by the same series."""
    return f"(CASE WHEN abs({z}) >= 6 THEN sign({z}) WHEN abs({z}) < 1e-12 THEN 0.0 ELSE sign({z}) * list_sum(list_transform(range(0, 160), lambda kk: exp(-({z}) * ({z}) + (2 * kk + 1) * ln(abs({z})) - lgamma(kk + 1.5)))) END)"


def chi_sql(x: str, dof: str) -> str:
    return f"(CASE WHEN {x} >= 200 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, 400), lambda kk: exp(-({x}) / 2 + ({dof} / 2.0 + kk) * ln(greatest({x}, 1e-300) / 2) - lgamma({dof} / 2.0 + kk + 1))))) END)"  # of few degrees of freedom


_DEV = "p AS (SELECT row_id, key, target, target_variance AS v, target - 50 AS e, (target - 50) / 20 AS z FROM ev)"


def _scored(spark, d):
    """Events with e = target - 50, z = e / 20 and v, the variance."""
    return events(spark, d).select("row_id", "key", "target", F.col("target_variance").alias("v"), (F.col("target") - 50).alias("e"), ((F.col("target") - 50) / 20).alias("z"))


@add("gaussian_pdf", f"WITH {EV}, {_DEV} SELECT row_id, round(exp(-0.5 * (ln(2 * pi()) + ln(v) + z * z / v)), 6) AS pdf FROM p")
def _(spark, d):
    return _scored(spark, d).select("row_id", r6(C.gaussian_pdf(F.col("z"), F.col("v"))).alias("pdf"))


@add("gaussian_log_pdf", f"WITH {EV}, {_DEV} SELECT row_id, round(-0.5 * (ln(2 * pi()) + ln(v) + z * z / v), 6) AS log_pdf FROM p")
def _(spark, d):
    return _scored(spark, d).select("row_id", r6(C.gaussian_log_pdf(F.col("z"), F.col("v"))).alias("log_pdf"))


@add("negative_log_likelihood", f"WITH {EV}, {_DEV} SELECT key, round(sum(0.5 * (ln(2 * pi()) + ln(v) + z * z / v)), 6) AS nll FROM p GROUP BY 1")
def _(spark, d):
    return _scored(spark, d).groupBy("key").agg(r6(F.sum(C.negative_log_likelihood(F.col("z"), F.col("v")))).alias("nll"))


@add("chi_squared_cdf", f"WITH {EV}, {_DEV}, q AS (SELECT row_id, z * z / v AS x, 1 + row_id % 5 AS dof FROM p) SELECT row_id, round({chi_sql('x', 'dof')}, 6) AS cdf FROM q")
def _(spark, d):
    q = _scored(spark, d).select("row_id", (F.col("z") * F.col("z") / F.col("v")).alias("x"), (1 + F.col("row_id") % 5).cast("double").alias("dof"))
    return q.select("row_id", r6(C.chi_squared_cdf("x", "dof")).alias("cdf"))


_CRPS = f"sqrt(v) * ((z / sqrt(v)) * {erf_sql('z / sqrt(v) / sqrt(2.0)')} + 2 * exp(-0.5 * z * z / v) / sqrt(2 * pi()) - 1 / sqrt(pi()))"


@add("crps_normal", f"WITH {EV}, {_DEV} SELECT row_id, round({_CRPS}, 6) AS crps FROM p")
def _(spark, d):
    return _scored(spark, d).select("row_id", r6(C.crps_normal(F.col("z"), F.lit(0.0), F.sqrt("v"))).alias("crps"))


@add("expected_abs_normal", f"WITH {EV}, {_DEV} SELECT row_id, round(sqrt(2 * v / pi()) * exp(-0.5 * z * z / v) + z * {erf_sql('z / sqrt(v) / sqrt(2.0)')}, 6) AS first, round(z * z + v, 6) AS second FROM p")
def _(spark, d):
    s = F.sqrt("v")
    return _scored(spark, d).select("row_id", r6(C.expected_abs_normal(F.col("z"), s)).alias("first"), r6(C.expected_abs_normal(F.col("z"), s, 2)).alias("second"))


@add("standardised_error", f"WITH {EV}, {_DEV} SELECT greatest(-5, least(4, CAST(floor(e / sqrt(v) / 10) AS BIGINT))) AS bin, count(*) AS n FROM p GROUP BY 1")
def _(spark, d):
    cell = F.greatest(F.lit(-5), F.least(F.lit(4), F.floor(F.col("e") / F.sqrt("v") / 10))).cast("long")
    return _scored(spark, d).groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_UNIT = "u AS (SELECT row_id, greatest(-1.0, least(1.0, (target - 50) / 61)) AS x FROM ev)"


def _unit(spark, d):
    return events(spark, d).select("row_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - 50) / 61)).alias("x"))


@add("chebyshev_t", f"WITH {EV}, {_UNIT} SELECT row_id, round(cos(7 * acos(x)), 6) AS t FROM u")
def _(spark, d):
    return _unit(spark, d).select("row_id", r6(C.chebyshev_t(F.col("x"), 7)).alias("t"))


@add("chebyshev_u", f"WITH {EV}, {_UNIT} SELECT row_id, round(32 * x**5 - 32 * x**3 + 6 * x, 6) AS u FROM u")
def _(spark, d):
    return _unit(spark, d).select("row_id", r6(C.chebyshev_u(F.col("x"), 5)).alias("u"))


@add("chebyshev_t_basis", f"WITH {EV}, {_UNIT}, n AS (SELECT unnest(range(0, 5)) AS n) SELECT row_id, CAST(n AS INTEGER) AS n, round(cos(n * acos(x)), 6) AS value FROM u, n")
def _(spark, d):
    return _unit(spark, d).select("row_id", F.posexplode(C.chebyshev_basis(F.col("x"), 4)).alias("n", "v")).select("row_id", "n", r6("v").alias("value"))


@add("chebyshev_u_basis", f"WITH {EV}, {_UNIT} SELECT row_id, n, round(CASE n WHEN 0 THEN 1 WHEN 1 THEN 2 * x WHEN 2 THEN 4 * x * x - 1 ELSE 8 * x**3 - 4 * x END, 6) AS value FROM u, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS n)")
def _(spark, d):
    return _unit(spark, d).select("row_id", F.posexplode(C.chebyshev_basis(F.col("x"), 3, "u")).alias("n", "v")).select("row_id", "n", r6("v").alias("value"))


@add("linear_features", f"WITH {EV} SELECT row_id, 1.0 AS f0, round(feature, 6) AS f1 FROM ev")
def _(spark, d):
    rows = events(spark, d).select("row_id", F.array(F.lit(1.0), F.col("feature")).alias("f"))
    return rows.select("row_id", F.col("f")[0].alias("f0"), r6(F.col("f")[1]).alias("f1"))


_PAIRED = "e AS (SELECT a.vec_id AS i, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _neighbours(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("x"))
    return a.join(a.select((F.col("i") - 1).alias("i"), F.col("x").alias("y")), "i")


@add("distance_euclidean", f"WITH {_PAIRED} SELECT i, round(sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - y[k]) ** 2))), 6) AS d FROM e")
def _(spark, d):
    return _neighbours(spark, d).select("i", r6(C.distance_euclidean(F.col("x"), F.col("y"), arrays=True)).alias("d"))


@add("distance_radial", f"WITH {_PAIRED} SELECT i, round(abs(sqrt(list_dot_product(x, x)) - sqrt(list_dot_product(y, y))), 6) AS d FROM e")
def _(spark, d):
    return _neighbours(spark, d).select("i", r6(C.distance_radial(F.col("x"), F.col("y"))).alias("d"))


@add("distance_angular", f"WITH {_PAIRED} SELECT i, round(acos(list_dot_product(x, y) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(y, y))), 6) AS d FROM e")
def _(spark, d):
    return _neighbours(spark, d).select("i", r6(C.distance_angular(F.col("x"), F.col("y"))).alias("d"))


@add("elevation_scaling", f"WITH {LI} SELECT supp, round(avg(1 + 0.02 * greatest(0.0, 25 - x)), 6) AS s FROM li GROUP BY 1")
def _(spark, d):
    return lines(spark, d).groupBy("supp").agg(r6(F.avg(C.elevation_scaling(F.col("x"), 25.0, 0.02))).alias("s"))


# ---- uncertain columns

_AB = "a AS (SELECT row_id, target AS mean, target_variance AS variance FROM ev), b AS (SELECT o_orderkey AS row_id, o_totalprice / 1000 AS mean, 0.25 AS variance FROM orders)"


def _marginals(spark, d):
    a = events(spark, d).select("row_id", F.col("target").alias("mean"), F.col("target_variance").alias("variance"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000).alias("mean"), F.lit(0.25).alias("variance"))
    return a, b


def _shown(df):
    return df.select("row_id", r6("mean").alias("mean"), r6("variance").alias("variance"))


@add("marginal_add", f"WITH {EV}, {_AB} SELECT row_id, round(a.mean + b.mean, 6) AS mean, round(a.variance + b.variance, 6) AS variance FROM a JOIN b USING (row_id)")
def _(spark, d):
    return _shown(DI.combine_marginals(*_marginals(spark, d)))


@add("marginal_subtract", f"WITH {EV}, {_AB} SELECT row_id, round(a.mean - b.mean, 6) AS mean, round(a.variance + b.variance, 6) AS variance FROM a JOIN b USING (row_id)")
def _(spark, d):
    return _shown(DI.combine_marginals(*_marginals(spark, d), sign=-1))


@add("marginal_scale", f"WITH {EV}, {_AB} SELECT row_id, round(-1.5 * mean, 6) AS mean, round(2.25 * variance, 6) AS variance FROM a")
def _(spark, d):
    return _shown(DI.scale_marginal(_marginals(spark, d)[0], -1.5))


@add("approximately_equal", f"WITH {EV}, {_AB} SELECT sqrt(sum((0.0005 * mean)**2)) <= 0.001 * sqrt(sum(mean**2)) AS equal FROM a")
def _(spark, d):
    a = _marginals(spark, d)[0]
    return DI.approximately_equal(a, a.withColumn("mean", 1.0005 * F.col("mean")))


#: Groups of a user's events of one day; n numbers them from 1.
_DAY = "user_id * 100000 + CAST(floor(feature / 24) AS BIGINT)"
_JOINT = f"j AS (SELECT {_DAY} AS g, row_number() OVER (PARTITION BY {_DAY} ORDER BY row_id) AS n, row_id AS r, feature AS x, target AS m FROM ev), k AS (SELECT a.g, a.n AS i, b.n AS j, a.r AS ra, b.r AS rb, exp(-abs(a.x - b.x) / 2) AS cov FROM j a JOIN j b ON a.g = b.g)"


def day_of_user() -> Column:
    return F.col("user_id") * 100000 + F.floor(F.col("feature") / 24)


def _series(spark, d):
    """All events by user and day: (group, i, x, y, variance), i from 1."""
    n = F.row_number().over(Window.partitionBy("group").orderBy("row_id")).cast("long")
    rows = events(spark, d).select(day_of_user().alias("group"), "row_id", F.col("feature").alias("x"), F.col("target").alias("y"), F.col("target_variance").alias("variance"))
    return rows.withColumn("i", n)


def _kernel_table(spark, d):
    return P.within_groups(_series(spark, d), KF.exponential(2.0, 1.0).column)


@add("joint_add_subtract_scale", f'WITH {EV}, {_JOINT} SELECT g AS "group", i, j, round(9 * (cov + CASE WHEN i = j THEN 0.5 ELSE 0 END), 6) AS cov FROM k')
def _(spark, d):
    k = _kernel_table(spark, d)
    diagonal = DI.joint_marginal(k).select("group", "i", F.col("i").alias("j"), F.lit(0.5).alias("cov"))
    return DI.combine_joints(k, diagonal).select("group", "i", "j", r6(9 * F.col("cov")).alias("cov"))


@add("joint_marginal", f'WITH {EV}, {_JOINT} SELECT g AS "group", i, round(cov, 6) AS variance FROM k WHERE i = j')
def _(spark, d):
    return DI.joint_marginal(_kernel_table(spark, d)).select("group", "i", r6("variance").alias("variance"))


@add("joint_subset", f'WITH {EV}, {_JOINT} SELECT g AS "group", -(i // 2) AS i, -(j // 2) AS j, round(cov, 6) AS cov FROM k WHERE i % 2 = 0 AND j % 2 = 0')
def _(spark, d):
    """Every second row of each group, in reverse order."""
    positions = _series(spark, d).select("i").distinct().where("i % 2 = 0").select((-F.expr("i div 2")).alias("pos"), "i")
    return DI.joint_subset(_kernel_table(spark, d), positions).select("group", "i", "j", r6("cov").alias("cov"))


_MAT = "mat AS (SELECT row_id // 10 AS i, row_id AS k, 1.0 / (1 + row_id % 10) AS v FROM ev)"


def _averages(spark, d):
    """A sparse matrix: ten neighbouring rows to one."""
    return events(spark, d).select(F.expr("row_id div 10").alias("i"), F.col("row_id").alias("k"), (1.0 / (1 + F.col("row_id") % 10)).alias("v"))


@add("transform_marginal", f"WITH {EV}, {_MAT} SELECT i, round(sum(v * target), 6) AS mean, round(sum(v * v * target_variance), 6) AS variance FROM mat JOIN ev ON k = row_id GROUP BY 1")
def _(spark, d):
    t = DI.transform_marginal(_averages(spark, d), _marginals(spark, d)[0])
    return t.select("i", r6("mean").alias("mean"), r6("variance").alias("variance"))


@add("transform_joint", f"WITH {EV}, {_JOINT}, s AS (SELECT ra AS k, rb AS l, cov FROM k), mm AS (SELECT DISTINCT k // 4 AS i, k, 0.25 AS v FROM s) SELECT a.i, b.i AS j, round(sum(a.v * cov * b.v), 6) AS cov FROM mm a JOIN s ON a.k = s.k JOIN mm b ON b.k = s.l GROUP BY 1, 2")
def _(spark, d):
    s = P.within_groups(_series(spark, d), KF.exponential(2.0, 1.0).column, index="row_id").select(F.col("i").alias("k"), F.col("j").alias("l"), "cov")
    m = s.select(F.expr("k div 4").alias("i"), "k", F.lit(0.25).alias("v")).distinct()
    return DI.transform_joint(m, s).select("i", "j", r6("cov").alias("cov"))


@add("transform_dataset", f"WITH {EV}, {_MAT} SELECT i, count(*) AS terms, round(sum(v), 6) AS weight, round(min(feature), 6) AS first_feature, round(sum(v * target), 6) AS target, round(sum(v * v * target_variance), 6) AS target_variance FROM mat JOIN ev ON k = row_id GROUP BY 1")
def _(spark, d):
    e = events(spark, d)
    combos = _averages(spark, d).join(e.select(F.col("row_id").alias("k"), "feature"), "k").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("feature", F.col("v").alias("coef")))).alias("feature"))
    t = DI.transform_marginal(_averages(spark, d), _marginals(spark, d)[0])
    weight = F.aggregate("feature", F.lit(0.0), lambda s, f: s + f["coef"])
    return combos.join(t, "i").select("i", F.size("feature").cast("long").alias("terms"), r6(weight).alias("weight"), r6(F.col("feature")[0]["feature"]).alias("first_feature"), r6("mean").alias("target"), r6("variance").alias("target_variance"))


@add("linear_combination_mean", f"WITH {EV} SELECT user_id, count(*) AS terms, round(1.0 / count(*), 6) AS coef FROM ev GROUP BY 1")
def _(spark, d):
    """In long form, a row a term, so that a user may have any number of them."""
    e = events(spark, d).select("user_id", "feature")
    sizes = materialise(e.groupBy(F.col("user_id").alias("u")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    terms = e.join(bounded_broadcast(sizes), F.col("user_id").eqNullSafe(F.col("u"))).select("user_id", "feature", (1.0 / F.col("n")).alias("coef"))
    return terms.groupBy("user_id").agg(F.count(F.lit(1)).alias("terms"), r6(F.max("coef")).alias("coef"))


@add("linear_combination_difference", f"WITH {EV} SELECT a.row_id, round(a.feature, 6) AS x, round(b.feature, 6) AS y, -1.0 AS second_coef FROM ev a JOIN ev b ON b.row_id = a.row_id + 1")
def _(spark, d):
    e = events(spark, d).select("row_id", "feature")
    both = e.join(e.select((F.col("row_id") - 1).alias("row_id"), F.col("feature").alias("y")), "row_id")
    combo = F.array(F.struct(F.col("feature").alias("value"), F.lit(1.0).alias("coef")), F.struct(F.col("y").alias("value"), F.lit(-1.0).alias("coef")))
    return both.select("row_id", combo.alias("c")).select("row_id", r6(F.col("c")[0]["value"]).alias("x"), r6(F.col("c")[1]["value"]).alias("y"), F.col("c")[1]["coef"].alias("second_coef"))


@add("linear_combination_sum", f"WITH {EV}, t AS (SELECT feature FROM ev WHERE row_id = 0) SELECT row_id, 1.0 AS c0, 1.0 AS c1, round(ev.feature + t.feature, 6) AS value FROM ev, t")
def _(spark, d):
    e = events(spark, d)
    origin = F.broadcast(e.where("row_id = 0").select(F.col("feature").alias("o")))
    combo = F.array(*(F.struct(F.col(c).alias("value"), F.lit(1.0).alias("coef")) for c in ("feature", "o")))
    rows = e.crossJoin(origin).select("row_id", combo.alias("c"))
    value = F.aggregate("c", F.lit(0.0), lambda s, f: s + f["value"] * f["coef"])
    return rows.select("row_id", F.col("c")[0]["coef"].alias("c0"), F.col("c")[1]["coef"].alias("c1"), r6(value).alias("value"))


# ---- kernels

_PAIRS = f"s AS (SELECT {_DAY} AS g, row_number() OVER (PARTITION BY {_DAY} ORDER BY row_id) AS i, feature AS x FROM ev), pr AS (SELECT a.g, a.i, b.i AS j, a.x, b.x AS y, abs(a.x - b.x) AS d FROM s a JOIN s b ON a.g = b.g)"


def _kernel_query(name: str, sql: str, kernel) -> None:
    @add(name, f'WITH {EV}, {_PAIRS} SELECT g AS "group", i, j, round({sql}, 6) AS cov FROM pr')
    def _(spark, d):
        return P.within_groups(_series(spark, d), kernel.column).select("group", "i", "j", r6("cov").alias("cov"))


_kernel_query("distance_matrix", "d", KF.Kernel.of(C.distance_euclidean, KF._pairwise))
_kernel_query("cov_squared_exponential", "4 * exp(-((d / 3) ** 2))", KF.squared_exponential(3.0, 2.0))
_kernel_query("cov_exponential", "4 * exp(-d / 3)", KF.exponential(3.0, 2.0))
_kernel_query("cov_matern_32", "4 * (1 + sqrt(3.0) * d / 3) * exp(-sqrt(3.0) * d / 3)", KF.matern_32(3.0, 2.0))
_kernel_query("cov_matern_52", "4 * (1 + sqrt(5.0) * d / 3 + 5 * d * d / 27) * exp(-sqrt(5.0) * d / 3)", KF.matern_52(3.0, 2.0))
_kernel_query("cov_constant", "2.25 + 0 * d", KF.constant(1.5))
_kernel_query("cov_polynomial", "1 + 0.01 * x * y + 0.0001 * (x * y) ** 2", KF.polynomial([1.0, 0.1, 0.01]))
_kernel_query("cov_scaling_term", "(1 + x / 100) * (1 + y / 100) + 0 * d", KF.scaling(lambda x: 1 + x / 100, lambda x: 1 + x / 100))
_kernel_query("cov_sum", "4 * exp(-((d / 3) ** 2)) + exp(-d / 5)", KF.squared_exponential(3.0, 2.0) + KF.exponential(5.0, 1.0))
_kernel_query("cov_product", "4 * exp(-((d / 3) ** 2)) * exp(-d / 5)", KF.squared_exponential(3.0, 2.0) * KF.exponential(5.0, 1.0))
_kernel_query("covariance_matrix", "4 * exp(-((d / 3) ** 2)) + CASE WHEN x = y THEN 0.01 ELSE 0 END", KF.squared_exponential(3.0, 2.0) + KF.independent_noise(0.1))


@add("cov_independent_noise", "SELECT a.p_partkey AS i, b.p_partkey AS j, 0.25 AS cov FROM part a JOIN part b ON a.p_retailprice = b.p_retailprice")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))
    return P.noise(p, 0.5)


@add("cov_noise_blocks", "SELECT l_orderkey * 10 + l_linenumber AS i, min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_discount) AS block, 0.25 AS cov FROM lineitem")
def _(spark, d):
    """Line items share eleven discounts: a block each, where pairs would be a square."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), F.col("l_discount").alias("x"))
    return P.noise_blocks(li, 0.5)


@add("cov_nugget", "SELECT a.s_suppkey AS i, b.s_suppkey AS j, 1e16 * 1e-16 AS scaled FROM supplier a JOIN supplier b ON a.s_acctbal = b.s_acctbal")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))
    return P.noise(s, 1e-8).select("i", "j", F.round(1e16 * F.col("cov"), 4).alias("scaled"))


@add("cov_measurement_only", f'WITH {EV}, {_PAIRS} SELECT g AS "group", i, j, CASE WHEN i % 2 = 1 AND j % 2 = 1 THEN round(exp(-d), 6) ELSE 0.0 END AS cov FROM pr')
def _(spark, d):
    rows = _series(spark, d).select("group", "i", F.struct("x", (F.col("i") % 2 == 1).alias("m")).alias("f"))
    k = KF.measurements_of(KF.exponential(1.0, 1.0))
    return P.within_groups(rows, lambda a, b: k.form(a["x"], b["x"], a["m"], b["m"]), feature="f").select("group", "i", "j", r6("cov").alias("cov"))


@add("cov_linear_combination", f'WITH {EV}, {_PAIRS} SELECT g AS "group", i // 4 AS c, j // 4 AS d, round(sum((1 + i % 4) * (1 + j % 4) * exp(-pr.d / 2)), 6) AS cov FROM pr GROUP BY 1, 2, 3')
def _(spark, d):
    combos = _series(spark, d).select("group", F.expr("i div 4").alias("c"), "x", (1 + F.col("i") % 4).cast("double").alias("coef"))
    return P.of_combinations(combos, KF.exponential(2.0, 1.0).column).select("group", "c", "d", r6("cov").alias("cov"))


@add("cov_tagged_union", f"WITH {EV}, {_PAIRS} SELECT g AS \"group\", i, j, round(CASE WHEN i % 3 = 0 AND j % 3 = 0 THEN exp(-d) WHEN i % 3 = 1 AND j % 3 = 1 THEN exp(-d * d) ELSE 0 END, 6) AS cov FROM pr")
def _(spark, d):
    rows = _series(spark, d).select("group", "i", F.struct((F.col("i") % 3).cast("string").alias("kind"), F.col("x").alias("value")).alias("f"))
    k = KF.of_kind("0", KF.exponential(1.0, 1.0)) + KF.of_kind("1", KF.squared_exponential(1.0, 1.0))
    return P.within_groups(rows, k.column, feature="f").select("group", "i", "j", r6("cov").alias("cov"))


@add("cross_covariance", f"WITH {EV}, u AS (SELECT CAST(n AS INTEGER) AS j, (SELECT min(feature) FROM ev) + n * ((SELECT max(feature) FROM ev) - (SELECT min(feature) FROM ev)) / 9 AS y FROM (SELECT unnest(range(0, 10)) AS n)) SELECT row_id AS i, j, round(4 * exp(-(((feature - y) / 50) ** 2)), 6) AS cov FROM ev, u")
def _(spark, d):
    e = events(spark, d)
    return P.against(e.select(F.col("row_id").alias("i"), F.col("feature").alias("x")), inducing_uniform(e, 10), KF.squared_exponential(50.0, 2.0).column).select("i", "j", r6("cov").alias("cov"))


@add("covariance_diagonal", f"WITH {EV} SELECT row_id AS i, round(4 + 0.01 * feature * feature, 6) AS variance FROM ev")
def _(spark, d):
    k = KF.squared_exponential(3.0, 2.0) + KF.polynomial([0.0, 0.1])
    return events(spark, d).select(F.col("row_id").alias("i"), r6(k.column(F.col("feature"), F.col("feature"))).alias("variance"))


@add("mean_linear", f"WITH {EV} SELECT row_id, round(0.5 * feature + 2, 6) AS mean FROM ev")
def _(spark, d):
    return events(spark, d).select("row_id", r6(KF.mean_linear(F.col("feature"), 2.0, 0.5)).alias("mean"))


@add("mean_zero", f"WITH {EV} SELECT row_id, 0.0 AS mean FROM ev")
def _(spark, d):
    return events(spark, d).select("row_id", F.lit(0.0).alias("mean"))


@add("mean_sum", f"WITH {EV} SELECT row_id, round(0.5 * feature + 2 + 0.1 * feature - 1, 6) AS mean FROM ev")
def _(spark, d):
    x = F.col("feature")
    return events(spark, d).select("row_id", r6(KF.mean_linear(x, 2.0, 0.5) + KF.mean_linear(x, -1.0, 0.1)).alias("mean"))


@add("mean_product", f"WITH {EV} SELECT row_id, round((0.5 * feature + 2) * (0.1 * feature - 1) / 100, 6) AS mean FROM ev")
def _(spark, d):
    x = F.col("feature")
    return events(spark, d).select("row_id", r6(KF.mean_linear(x, 2.0, 0.5) * KF.mean_linear(x, -1.0, 0.1) / 100).alias("mean"))


@add("mean_combination", f"WITH {EV}, {_MAT} SELECT i, round(sum(v * (0.5 * feature + 2)), 6) AS mean FROM mat JOIN ev ON k = row_id GROUP BY 1")
def _(spark, d):
    rows = _averages(spark, d).join(events(spark, d).select(F.col("row_id").alias("k"), "feature"), "k")
    return rows.groupBy("i").agg(r6(F.sum(F.col("v") * KF.mean_linear(F.col("feature"), 2.0, 0.5))).alias("mean"))


@add("mean_add_to", f"WITH {EV} SELECT row_id, round(target + 0.5 * feature + 2, 6) AS target FROM ev")
def _(spark, d):
    return events(spark, d).select("row_id", r6(F.col("target") + KF.mean_linear(F.col("feature"), 2.0, 0.5)).alias("target"))


@add("mean_remove_from", f"WITH {EV} SELECT row_id, round(target - 0.5 * feature - 2, 6) AS target FROM ev")
def _(spark, d):
    return events(spark, d).select("row_id", r6(F.col("target") - KF.mean_linear(F.col("feature"), 2.0, 0.5)).alias("target"))


@add("process_noise_equivalent", f"WITH {EV} SELECT row_id, round(sqrt(4 - (4 * exp(-feature / 50)) ** 2 / 4), 6) AS sd FROM ev")
def _(spark, d):
    return events(spark, d).select("row_id", r6(KF.process_noise(4.0, KF.exponential(50.0, 2.0).column(F.col("feature"), F.lit(0.0)))).alias("sd"))


def inducing_uniform(df, n: int, feature: str = "feature"):
    """(j, y): n evenly spaced points over the range of a scalar feature."""
    span = df.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"))
    return span.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"), "lo", "hi").select("j", (F.col("lo") + F.col("j") * (F.col("hi") - F.col("lo")) / (n - 1)).alias("y"))


@add("inducing_uniform", f"WITH {EV}, r AS (SELECT min(feature) AS lo, max(feature) AS hi FROM ev) SELECT CAST(n AS INTEGER) AS j, round(lo + n * (hi - lo) / 9, 6) AS y FROM r, (SELECT unnest(range(0, 10)) AS n)")
def _(spark, d):
    return inducing_uniform(events(spark, d), 10).select("j", r6("y").alias("y"))


@add("inducing_state_space", f"WITH {EV}, r AS (SELECT min(feature) AS lo, max(feature) AS hi FROM ev), c AS (SELECT 'se' AS part, lo, hi, greatest(3, CAST(ceil(10 * (hi - lo) / 50) AS BIGINT)) AS n FROM r UNION ALL SELECT 'exp', lo, hi, CAST(ceil(20 * (hi - lo) / 80) AS BIGINT) FROM r) SELECT part, k AS j, round(lo + k * (hi - lo) / (n - 1), 6) AS y FROM (SELECT part, lo, hi, n, unnest(range(0, n)) AS k FROM c)")
def _(spark, d):
    span = events(spark, d).agg(F.min("feature").alias("lo"), F.max("feature").alias("hi"))
    width = F.col("hi") - F.col("lo")
    se = span.select(F.lit("se").alias("part"), "lo", "hi", F.greatest(F.lit(3), F.ceil(10 * width / 50)).cast("long").alias("n"))
    ex = span.select(F.lit("exp").alias("part"), "lo", "hi", F.ceil(20 * width / 80).cast("long").alias("n"))
    rows = se.union(ex).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("part", "j", r6(F.col("lo") + F.col("j") * width / (F.col("n") - 1)).alias("y"))
