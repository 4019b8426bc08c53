"""Tuning and sampling: many parameter sets are rows, evaluated together by one job."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.functions.kernels import Kernel
from sparkreg.functions.order import global_row_number
from sparkreg.functions.storage import bounded_broadcast, materialise, new_folder
from sparkreg.functions.versions import Versions
from sparkreg.operators.gp import MAX_ROWS, Fit, Mean, arrays, leave_one_out, per_group, zero

Objective = Callable[[DataFrame], DataFrame]  # (set_id, <params>) -> (set_id, value)


@dataclass(frozen=True)
class Parameter:
    """A value with its bounds; log_scale and fixed tell how it enters tuning space."""

    value: float
    low: float = -math.inf
    high: float = math.inf
    log_scale: bool = False
    fixed: bool = False


def proposals(p: Parameter, n: int = 4) -> list[float]:
    """Values around p: log-spaced shares 1e-5 .. 10^-0.1 of the way to each bound; at a bound 2n on the free side."""
    low, high = (b if math.isfinite(b) else s * 1e8 for b, s in ((p.low, -1), (p.high, 1)))
    below, above = (0, 2 * n) if p.value <= low else (2 * n, 0) if p.value >= high else (n, n)
    shares = lambda k: np.logspace(-5, -0.1, k) if k else np.empty(0)
    return [*(p.value - shares(below) * (p.value - low)), *(p.value + shares(above) * (high - p.value))]


def proposal_table(params: DataFrame, n: int = 4) -> DataFrame:
    """(name, query) for a table (name, value, low, high): the same rule as Columns."""
    low = F.when(F.abs("low") < float("inf"), F.col("low")).otherwise(-1e8)
    high = F.when(F.abs("high") < float("inf"), F.col("high")).otherwise(1e8)
    rows = params.withColumn("lo", low).withColumn("hi", high)
    below = F.when(F.col("value") <= F.col("lo"), 0).when(F.col("value") >= F.col("hi"), 2 * n).otherwise(n)
    sides = F.array(F.struct(below.alias("k"), (F.col("lo") - F.col("value")).alias("way")), F.struct((2 * n - below).alias("k"), (F.col("hi") - F.col("value")).alias("way")))
    rows = rows.withColumn("s", F.explode(sides)).where("s.k > 0")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("s.k") - 1)))
    share = F.pow(F.lit(10.0), -5 + 4.9 * F.col("i") / (F.col("s.k") - 1))
    return rows.select("name", (F.col("value") + share * F.col("s.way")).alias("query"))


def to_tuning_space(value: Column, low: Column, high: Column, log_scale: Column) -> Column:
    held = F.least(F.greatest(value, low), high)
    return F.when(log_scale, F.log(held)).otherwise(held)


def from_tuning_space(value: Column, low: Column, high: Column, log_scale: Column) -> Column:
    return F.least(F.greatest(F.when(log_scale, F.exp(value)).otherwise(value), low), high)


def prior_log_pdf(kind: Column, value: Column, a: Column, b: Column, corrected: bool = False) -> Column:
    """Log density of a prior: fixed 0, uniform and log_scale_uniform on [a, b], gaussian and log_normal with mean a, sd b.

    By default the normal forms have the constants of long use, -(log 2 pi * 2 log b + z^2) / 2 and no half on z^2 for
    log_normal; corrected gives the textbook ones.
    """
    z, w = (value - a) / b, (F.log(value) - a) / b
    log_2pi = math.log(2 * math.pi)
    if corrected:
        normal, log_normal = -0.5 * (log_2pi + 2 * F.log(b) + z * z), -0.5 * (log_2pi + w * w) - F.log(b) - F.log(value)
    else:
        normal, log_normal = -0.5 * (log_2pi * 2 * F.log(b) + z * z), -0.5 * log_2pi - F.log(b) - F.log(value) - w * w
    inside = (value >= a) & (value <= b)
    uniform = F.when(inside, -F.log(b - a)).otherwise(float("-inf"))
    log_uniform = F.when(inside, -F.log(value) - F.log(F.log(b) - F.log(a))).otherwise(float("-inf"))
    return F.when(kind == "uniform", uniform).when(kind == "log_scale_uniform", log_uniform).when(kind == "gaussian", normal).when(kind == "log_normal", log_normal).otherwise(0.0)


def log_prior(priors: list[tuple[str, float, float, float]]) -> Column:
    """The log density of parameters given as (kind, value, a, b), as one Column."""
    return reduce(lambda s, p: s + prior_log_pdf(*map(F.lit, p)), priors, F.lit(0.0))


def evaluate(spark: SparkSession, sets: list[dict[str, float]], objective: Objective) -> list[float]:
    """The objective of each parameter set, by one job."""
    names = sorted(sets[0])
    table = spark.createDataFrame([(k, *(float(s[n]) for n in names)) for k, s in enumerate(sets)], "set_id int, " + ", ".join(f"`{n}` double" for n in names))
    found = {r.set_id: r.value for r in objective(table).collect()}  # one row a set
    return [found.get(k, math.nan) for k in range(len(sets))]


def over_datasets(objectives: list[Objective], aggregate: Callable[[str], Column] = F.avg) -> Objective:
    """The objective of several datasets: an aggregate (the mean) of their own values, all in one job."""

    def value(sets: DataFrame) -> DataFrame:
        parts = [f(sets).select("set_id", "value") for f in objectives]
        return reduce(DataFrame.union, parts).groupBy("set_id").agg(aggregate("value").alias("value"))

    return value


def over_dataset_table(values: Objective, aggregate: Callable[[str], Column] = F.avg) -> Objective:
    """The same for datasets that are a column of a table, however many: values gives (set_id, dataset, value)."""
    return lambda sets: values(sets).groupBy("set_id").agg(aggregate("value").alias("value"))


FitMetric = Callable[[Fit, np.ndarray, np.ndarray], float]


def loo_nll(fit: Fit, y: np.ndarray, variance: np.ndarray) -> float:
    """Negative log likelihood of each row as the others predict it, summed."""
    m, v = leave_one_out(fit, y)
    return float(0.5 * (np.log(2 * np.pi * v) + (y - m) ** 2 / v).sum())


def gp_objective(df: DataFrame, kernel_of: Callable[[dict], Kernel], metric: FitMetric = loo_nll, key: str = "key", mean: Mean = zero, max_rows: int = MAX_ROWS) -> Objective:
    """The sum over all keys of a metric of their exact fits (key, row_id, feature, target, target_variance), for kernels that
    kernel_of makes of parameters. Rows are grouped once for all sets; the sets of one evaluation go to every task."""

    def value(sets: DataFrame) -> DataFrame:
        asked = [r.asDict() for r in sets.collect()]  # the proposals of one step

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y, v = arrays(pdf)
            return pd.DataFrame([(s["set_id"], metric(Fit.of(kernel_of(s), x, y, v, mean), y, v)) for s in asked], columns=["set_id", "value"])

        rows = per_group(df.select(key, "row_id", "feature", "target", "target_variance"), run, "set_id int, value double", key, max_rows)
        return rows.groupBy("set_id").agg(F.sum("value").alias("value"))

    return value


def greedy_tune(spark: SparkSession, params: dict[str, Parameter], objective: Objective, sweeps: int = 10, n: int = 4) -> tuple[dict[str, Parameter], float]:
    """Coordinate search: all proposals of one parameter at a time, the best stays."""
    best = math.inf
    names = [k for k, p in params.items() if not p.fixed]
    for sweep in range(sweeps):
        for name in names:
            queries = proposals(params[name], n)
            if sweep == 0 and name == names[0]:
                queries = [params[name].value, *queries]
            values = evaluate(spark, [{k: q if k == name else p.value for k, p in params.items()} for q in queries], objective)
            ranked = [(v, k) for k, v in enumerate(values) if not math.isnan(v)]
            if ranked and min(ranked)[0] < best:
                best, at = min(ranked)
                params = {**params, name: replace(params[name], value=float(queries[at]))}
    return params, best


def gradient(spark: SparkSession, params: dict[str, Parameter], objective: Objective) -> dict[str, float]:
    """Forward differences, p + 1 sets in one job; a step that leaves the bounds turns round."""
    steps = {}
    for k, p in params.items():
        e = 1e-8 * (p.high - p.low) if math.isfinite(p.high - p.low) else 1e-6
        steps[k] = -e if p.value + e > p.high else e
    sets = [{k: p.value for k, p in params.items()}]
    sets += [{**sets[0], k: params[k].value + e} for k, e in steps.items()]
    base, *moved = evaluate(spark, sets, objective)
    slopes = {k: (v - base) / steps[k] for k, v in zip(steps, moved, strict=True)}
    at_bound = lambda k: (params[k].value <= params[k].low and slopes[k] > 0) or (params[k].value >= params[k].high and slopes[k] < 0)
    return {k: 0.0 if at_bound(k) else v for k, v in slopes.items()}


# ---- ensemble sampling


def ensemble_step(walkers: np.ndarray, log_p: np.ndarray, log_density: Callable[[np.ndarray], np.ndarray], rng: np.random.Generator, a: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One affine-invariant stretch move: each half (index mod 2) moves against the other, its densities in one call."""
    walkers, log_p, accepted = walkers.copy(), log_p.copy(), np.zeros(len(walkers), bool)
    for half in (0, 1):
        own, other = np.arange(half, len(walkers), 2), np.arange(1 - half, len(walkers), 2)
        z = ((a - 1) * rng.random(len(own)) + 1) ** 2 / a
        partner = walkers[rng.choice(other, len(own))]
        delta = walkers[own] - partner
        delta[delta == 0] = 1e-6
        trial = partner + z[:, None] * delta
        value = log_density(trial)
        ratio = (walkers.shape[1] - 1) * np.log(z) + value - log_p[own]
        take = np.isfinite(value) & (np.log(rng.random(len(own))) < ratio)
        walkers[own[take]], log_p[own[take]], accepted[own[take]] = trial[take], value[take], True
    return walkers, log_p, accepted


def into_tuning_space(p: Parameter, value: float) -> float:
    """As ``to_tuning_space``, of a number."""
    held = min(max(value, p.low), p.high)
    return math.log(held) if p.log_scale else held


def out_of_tuning_space(p: Parameter, value: float) -> float:
    return min(max(math.exp(value) if p.log_scale else value, p.low), p.high)


Callback = Callable[[DataFrame, int], None]  # (rows of the iterations just written, the last of them)


def sample_ensemble(
    spark: SparkSession, start: dict[str, Parameter | float], objective: Objective, iterations: int, walkers: int | None = None, jitter: float = 0.1, seed: int = 5, *,
    folder: str | None = None, every: int = 10, callbacks: tuple[Callback, ...] = (),
) -> DataFrame:
    """(iteration, ensemble_index, log_probability, accepted, <params>) with the objective as log density, a job a half step.

    Walkers move in tuning space. Every ``every`` iterations the steps go to ``folder`` and to the callbacks, and the driver keeps
    the walkers alone. With a folder that holds steps, the chain goes on after the last of them: draws depend on the seed and the
    number of the iteration, so it is the chain that was never interrupted; steps that had not been written are done again.
    """
    params = {k: v if isinstance(v, Parameter) else Parameter(float(v)) for k, v in start.items()}
    names = sorted(k for k, p in params.items() if not p.fixed)
    n = max(2 * len(names) + 1, walkers or 0)
    steps = Versions(folder or new_folder(spark, "sampler"), "upto")
    schema = "iteration int, ensemble_index int, log_probability double, accepted boolean, state array<double>, " + ", ".join(f"`{k}` double" for k in sorted(params))

    def real(row: np.ndarray) -> dict[str, float]:
        moved = {k: out_of_tuning_space(params[k], float(v)) for k, v in zip(names, row, strict=True)}
        return {k: moved.get(k, p.value) for k, p in params.items()}

    def density(x: np.ndarray) -> np.ndarray:
        return np.array(evaluate(spark, [real(row) for row in x], objective))

    done = steps.numbers(spark)
    if done:
        last = spark.read.parquet(steps.path(done[-1])).where(F.col("iteration") == done[-1]).orderBy("ensemble_index").collect()  # a row a walker
        state, log_p, first = np.array([r.state for r in last]), np.array([r.log_probability for r in last]), done[-1] + 1
    else:
        rng, first = np.random.default_rng([seed, 0]), 0
        state = np.array([into_tuning_space(params[k], params[k].value) for k in names]) + jitter * rng.standard_normal((n, len(names)))
        log_p = density(state)
        while (bad := ~np.isfinite(log_p)).any():  # replaced by random mixtures of two good walkers
            good = np.flatnonzero(~bad)
            if len(good) < 2:
                raise ValueError("fewer than two walkers have a finite density")
            w = rng.random((bad.sum(), 1))
            state[bad] = w * state[rng.choice(good, bad.sum())] + (1 - w) * state[rng.choice(good, bad.sum())]
            log_p[bad] = density(state[bad])
    rows: list[tuple] = []  # of the iterations that have not been written
    for it in range(first, iterations):
        state, log_p, accepted = ensemble_step(state, log_p, density, np.random.default_rng([seed, 1, it]))
        for k in range(n):
            values = real(state[k])
            rows.append((it, k, float(log_p[k]), bool(accepted[k]), [float(v) for v in state[k]], *(float(values[p]) for p in sorted(params))))
        if (it + 1) % every == 0 or it == iterations - 1:
            steps.write(spark.createDataFrame(rows, schema), it)
            rows = []
            for f in callbacks:
                f(spark.read.parquet(steps.path(it)).drop("state"), it)
    done = [steps.path(k) for k in steps.numbers(spark)]
    found = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    return found.where(F.col("iteration") < iterations).drop("state")


def sampler_summary(log: DataFrame, params: list[str], burn_in: int, thin: int, share: float = 0.9) -> DataFrame:
    """(name, low, high): 5 % and 95 % limits widened by 5 %, of finite rows after burn_in, every thin-th iteration, and of
    these the top share by log probability."""
    kept = log.where((F.abs("log_probability") < float("inf")) & ~F.isnan("log_probability") & (F.col("iteration") >= burn_in))
    order = global_row_number(kept.select("iteration").distinct(), "iteration", name="__k").where(F.col("__k") % thin == 0)
    kept = materialise(kept.join(bounded_broadcast(materialise(order.select("iteration"), "kept-iterations")), "iteration", "left_semi"), "kept-steps")
    cut = quantiles(kept.select(F.lit("").alias("name"), F.col("log_probability").alias("v")), [1 - share]).select(F.col("q")[0].alias("__cut"))
    long = kept.crossJoin(F.broadcast(cut)).where("log_probability >= __cut").select(F.explode(F.array(*(F.struct(F.lit(p).alias("name"), F.col(p).alias("v")) for p in params))).alias("s")).select("s.*")
    limits = quantiles(long, [0.05, 0.95]).select("name", F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    wide = 0.05 * (F.col("b") - F.col("a"))
    return limits.select("name", (F.col("a") - wide).alias("low"), (F.col("b") + wide).alias("high"))


def quantiles(rows: DataFrame, shares: list[float]) -> DataFrame:
    """(name, q): interpolated quantiles of v for each name, in the order of shares. Ranks come from one range shuffle, so
    no task gathers a name's values; what meets is the two neighbours of each quantile."""
    ranked = global_row_number(rows.select("name", "v"), "name", "v", name="__p")
    spans = ranked.groupBy(F.col("name").alias("__name")).agg(F.min("__p").alias("__first"), F.max("__p").alias("__last"))  # one row a name
    wanted = F.array(*(F.col("__first") + F.lit(float(s)) * (F.col("__last") - F.col("__first")) for s in shares))
    places = spans.select("__name", F.posexplode(wanted).alias("__k", "__at"))
    near = ranked.join(F.broadcast(places), (F.col("name") == F.col("__name")) & (F.abs(F.col("__p") - F.col("__at")) < 1))
    own = near.groupBy("name", "__k").agg(F.sum((1 - F.abs(F.col("__p") - F.col("__at"))) * F.col("v")).alias("q"))
    return own.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "q"))), lambda x: x["q"]).alias("q"))  # one a share
