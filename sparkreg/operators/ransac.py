"""Random sample consensus: iterations are a grouping key and run together.

Rows have a group key; an iteration draws candidate groups, fits a model to their rows, takes every other group whose metric
is within the threshold as an inlier, and the consensus is candidates and inliers. Draws whose candidates are not valid fail;
``iterations`` counts those that are. Lines need only the sums of each group, so no iteration copies a row (``inliers``); for
any other ``Model`` an iteration copies the rows of its candidates, and every group is judged once for all iterations.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkreg.functions.columns import chi_squared_cdf_values
from sparkreg.functions.kernels import Kernel
from sparkreg.functions.order import spread
from sparkreg.functions.storage import bounded_broadcast, materialise
from sparkreg.operators.crossval import differential_entropy
from sparkreg.operators.gp import MAX_ROWS, Mean, arrays, root_of, zero
from sparkreg.operators.linear import SUMS, fit_line, line, power_sums


@dataclass(frozen=True)
class Settings:
    threshold: float
    sample: int
    consensus: int
    iterations: int
    seed: int = 17
    max_failed: int = 0  # draws that may fail: as many end the search


@dataclass(frozen=True)
class Model:
    """fit(rows) -> state; metric(state, rows of a group) -> number; is_valid(rows of the candidates) -> bool; the consensus
    metric is an aggregate over the judged groups (columns metric and n, their rows)."""

    fit: Callable[[pd.DataFrame], object]
    metric: Callable[[object, pd.DataFrame], float]
    is_valid: Callable[[pd.DataFrame], bool] | None = None
    consensus_metric: Callable[[], Column] = lambda: F.avg("metric")


INVALID, EXCEEDED, NO_CONSENSUS, SUCCESS = "invalid_arguments", "exceeded_max_failed_candidates", "no_consensus", "success"


def bad_arguments(groups: Column, sample: Column, consensus: Column, iterations: Column) -> Column:
    return (iterations <= 0) | (sample <= 0) | (sample >= groups) | (consensus >= groups) | (consensus < sample)


def return_code(groups: Column, sample: Column, consensus: Column, iterations: Column, failed: Column, max_failed: Column, agreed: Column) -> Column:
    """The outcome of a search: of how many groups, by its settings, with how many failed draws before the last iteration
    that counts, and how many iterations whose consensus is large enough."""
    code = F.when(bad_arguments(groups, sample, consensus, iterations), INVALID).when((failed > 0) & (failed >= max_failed), EXCEEDED)
    return code.when(agreed == 0, NO_CONSENSUS).otherwise(SUCCESS)


def candidates(keys: DataFrame, s: Settings, draws: int | None = None) -> DataFrame:
    """(iteration, key): s.sample keys of each draw, without replacement, by the MD5 sum of seed, iteration and key.

    Each partition first keeps its own least sums of an iteration through the rank limit, so no task sees all keys.
    """
    every = keys.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit((draws or s.iterations) - 1))))
    every = every.withColumn("__u", F.md5(F.concat(F.lit(f"{s.seed}:"), F.col("iteration").cast("string"), F.lit(":"), F.col("key").cast("string"))))
    rank = F.row_number().over(Window.partitionBy("iteration").orderBy("__u", "key"))
    return every.withColumn("__k", rank).where(F.col("__k") <= s.sample).select("iteration", "key")


def counted(validity: DataFrame, s: Settings) -> tuple[list[int], int]:
    """(iterations that count, draws that failed before the last of them) from (iteration, valid), one row a draw."""
    used, failed = [], 0
    for r in validity.orderBy("iteration").collect():  # iterations + max_failed rows
        if len(used) == s.iterations or (failed and failed >= s.max_failed):
            break
        if r.valid:
            used.append(r.iteration)
        else:
            failed += 1
    return used, failed


def inliers(df: DataFrame, drawn: DataFrame, s: Settings, x: str = "x", y: str = "y", key: str = "key") -> DataFrame:
    """(iteration, key, role, metric) with role candidate, inlier or outlier; the metric is the group's RMSE."""
    centre = F.broadcast(df.agg(F.avg(x).alias("__cx"), F.avg(y).alias("__cy")))
    cx, cy = F.col(x) - F.col("__cx"), F.col(y) - F.col("__cy")
    sums = materialise(df.crossJoin(centre).groupBy(F.col(key).alias("key")).agg(*power_sums(cx, cy), F.sum(cy * cy).alias("syy")), "group-sums")
    offset, slope = line()
    fits = drawn.join(sums, "key").groupBy("iteration").agg(*(F.sum(c).alias(c) for c in SUMS)).select("iteration", offset.alias("o"), slope.alias("s"))
    fits = fits.withColumnRenamed("iteration", "it")  # one row an iteration
    rows = sums.join(F.broadcast(fits))
    o, b = F.col("o"), F.col("s")
    square = F.col("syy") + F.col("n") * o * o + b * b * F.col("sxx") - 2 * o * F.col("sy") - 2 * b * F.col("sxy") + 2 * o * b * F.col("sx")
    rows = rows.withColumn("metric", F.sqrt(F.greatest(square, F.lit(0.0)) / F.col("n")))
    mark = drawn.select(F.col("iteration").alias("di"), F.col("key").alias("dk"))
    rows = rows.join(mark, (F.col("it") == F.col("di")) & (F.col("key") == F.col("dk")), "left")
    role = F.when(F.col("dk").isNotNull(), "candidate").when(F.col("metric") <= s.threshold, "inlier").otherwise("outlier")
    return rows.select(F.col("it").alias("iteration"), "key", role.alias("role"), "metric")


def consensus(judged: DataFrame, s: Settings, metric: Column | None = None) -> DataFrame:
    """(iteration, size, metric) of iterations whose consensus is large enough; the metric is the mean over the consensus
    unless another aggregate is given."""
    inside = judged.where("role <> 'outlier'").groupBy("iteration")
    return inside.agg(F.count(F.lit(1)).alias("size"), (F.avg("metric") if metric is None else metric).alias("metric")).where(F.col("size") >= s.consensus)


def best(agreed: DataFrame) -> DataFrame:
    """The iteration with the least metric; the first wins a tie; NaN never wins."""
    return agreed.where(~F.isnan("metric")).agg(F.min(F.struct("metric", "iteration")).alias("b")).select("b.iteration", "b.metric").where("iteration is not null")


def _code(spark: SparkSession, groups: int, s: Settings, failed: int = 0, agreed: int = 0) -> str:
    row = spark.range(1).select(return_code(*(F.lit(v) for v in (groups, s.sample, s.consensus, s.iterations, failed, s.max_failed, agreed))).alias("c"))
    return row.first().c


def fit(df: DataFrame, s: Settings, x: str = "x", y: str = "y", key: str = "key") -> tuple[str, DataFrame, DataFrame | None]:
    """(code, judged, line): the line refitted to the rows of the best consensus, or None without one."""
    keys = df.select(F.col(key).alias("key")).distinct()
    groups = keys.count()
    if (code := _code(df.sparkSession, groups, s, agreed=1)) != SUCCESS:
        return code, _none(df.sparkSession, dict(df.dtypes)[key]), None
    judged = materialise(inliers(df, candidates(keys, s), s, x, y, key), "ransac")
    top = best(consensus(judged, s)).first()
    if top is None:
        return NO_CONSENSUS, judged, None
    return SUCCESS, judged, fit_line(consensus_rows(df, judged, top.iteration, key), x, y)


def _none(spark: SparkSession, kind: str) -> DataFrame:
    """Judged groups of a search that did not begin."""
    return spark.createDataFrame([], f"iteration int, key {kind}, role string, metric double, n long")


def consensus_rows(df: DataFrame, judged: DataFrame, iteration: int, key: str = "key") -> DataFrame:
    chosen = judged.where((F.col("iteration") == iteration) & (F.col("role") != "outlier")).select(F.col("key").alias("__key"))
    return df.join(bounded_broadcast(chosen), F.col(key) == F.col("__key"), "left_semi")


_states: tuple[str, dict] = ("", {})


def _unpickled(name: str, states: dict[int, bytes]) -> dict:
    """The states of all iterations of the search of that name, unpickled once a worker."""
    global _states
    if _states[0] != name:
        _states = (name, {i: pickle.loads(state) for i, state in states.items()})
    return _states[1]


def fit_model(df: DataFrame, s: Settings, model: Model, key: str = "key", max_rows: int = 200_000, max_state_bytes: int = 256 << 20) -> tuple[str, DataFrame, DataFrame | None]:
    """(code, judged, rows): judged is (iteration, key, role, metric, n); rows are those of the best consensus, to which the
    caller fits the model, or None without one. max_rows bounds the rows of a group, and of an iteration's candidates;
    max_state_bytes the fitted states of all iterations, which every task gets."""
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    keys = materialise(df.select(F.col(key).alias("key")).distinct(), "ransac-keys")
    groups = keys.count()
    if (code := _code(spark, groups, s, agreed=1)) != SUCCESS:
        return code, _none(spark, kind), None
    drawn = materialise(candidates(keys, s, s.iterations + s.max_failed), "ransac-draws")
    names = df.columns
    rows = df.join(bounded_broadcast(drawn.withColumnRenamed("key", "__key")), F.col(key) == F.col("__key")).drop("__key")

    def guard(pdf: pd.DataFrame) -> None:
        if len(pdf) > max_rows:
            raise ValueError(f"{len(pdf)} rows are modelled together; at most {max_rows}")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        guard(pdf)
        own = pdf[names].sort_values("row_id")
        valid = model.is_valid is None or bool(model.is_valid(own))
        return pd.DataFrame({"iteration": [pdf["iteration"].iloc[0]], "valid": [valid], "state": [cloudpickle.dumps(model.fit(own)) if valid else None]})

    fits = materialise(spread(rows, "iteration").groupBy("iteration").applyInPandas(train, "iteration int, valid boolean, state binary"), "ransac-fits")
    used, failed = counted(fits.select("iteration", "valid"), s)
    held = fits.agg(F.coalesce(F.sum(F.octet_length("state")), F.lit(0)).alias("b")).first().b
    if held > max_state_bytes:
        raise ValueError(f"the states of all iterations have {held} bytes; at most {max_state_bytes} are sent to the tasks")
    states = {r.iteration: bytes(r.state) for r in fits.where(F.col("iteration").isin(used)).collect()}  # one an iteration
    sent, name = spark.sparkContext.broadcast(states), uuid.uuid4().hex

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        guard(pdf)
        own = pdf.sort_values("row_id")
        found = [(i, own[key].iloc[0], float(model.metric(state, own)), len(own)) for i, state in _unpickled(name, sent.value).items()]
        return pd.DataFrame(found, columns=["iteration", "key", "metric", "n"])

    metrics = spread(df, key).groupBy(key).applyInPandas(judge, f"iteration int, key {kind}, metric double, n long")
    mark = drawn.select(F.col("iteration").alias("di"), F.col("key").alias("dk"))
    judged = metrics.join(bounded_broadcast(mark), (F.col("iteration") == F.col("di")) & (F.col("key") == F.col("dk")), "left")
    role = F.when(F.col("dk").isNotNull(), "candidate").when(F.col("metric") <= s.threshold, "inlier").otherwise("outlier")
    judged = materialise(judged.select("iteration", "key", role.alias("role"), "metric", "n"), "ransac")
    agreed = materialise(consensus(judged, s, model.consensus_metric()), "ransac-agreed")
    top = best(agreed).first()
    code = _code(spark, groups, s, failed, 0 if top is None else 1)
    return code, judged, consensus_rows(df, judged, top.iteration, key) if code == SUCCESS else None


# ---- strategies of process searches: of (prior mean, prior covariance, targets, target variances)

Strategy = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], float]


def chi_squared(m: np.ndarray, c: np.ndarray, y: np.ndarray, v: np.ndarray) -> float:
    """The chi-squared probability of the targets."""
    r = y - m
    return float(chi_squared_cdf_values(r @ np.linalg.solve(c + np.diag(v), r), len(y)))


def _chi_squared_of_stack(m: np.ndarray, c: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    r, n = y - m, y.shape[1]
    return chi_squared_cdf_values((r * np.linalg.solve(c + v[:, None, :] * np.eye(n), r[:, :, None])[:, :, 0]).sum(1), n)


chi_squared.of_stack = _chi_squared_of_stack  # of groups of one size at once; a strategy without it is called for each


def feature_count(m: np.ndarray, c: np.ndarray, y: np.ndarray, v: np.ndarray) -> float:
    """Least for the largest consensus."""
    return -float(len(y))


def entropy(m: np.ndarray, c: np.ndarray, y: np.ndarray, v: np.ndarray) -> float:
    """The differential entropy of the prior."""
    return differential_entropy(c)


def chi_squared_valid(threshold: float = 0.999) -> Callable[..., bool]:
    return lambda m, c, y, v: chi_squared(m, c, y, v) <= threshold


def always_valid(*_) -> bool:
    return True


def drawn_groups(names: list, s: Settings, key: object, draw: int) -> list:
    """The candidates of a draw: they depend on the seed, the key and the draw alone."""
    rng = np.random.default_rng([s.seed, draw, *str(key).encode()])
    return [names[k] for k in rng.choice(len(names), s.sample, replace=False)]


def _held_out(prior: np.ndarray, cov: np.ndarray, y: np.ndarray, var: np.ndarray, known: np.ndarray, members: dict[int, np.ndarray], metric: Strategy) -> np.ndarray:
    """The metric of each group's joint prediction by the known rows, whose factor is made once. members: the rows of the groups
    of each size, a row a group."""
    root, out = root_of(cov[np.ix_(known, known)] + np.diag(var[known])), []
    half = root @ cov[known]
    mean, many = prior + half.T @ (root @ (y[known] - prior[known])), getattr(metric, "of_stack", None)
    for at in members.values():
        own = half[:, at].transpose(1, 0, 2)
        stack = mean[at], cov[at[:, :, None], at[:, None, :]] - own.transpose(0, 2, 1) @ own, y[at], var[at]
        out.append(many(*stack) if many else np.array([metric(*one) for one in zip(*stack, strict=True)], float))
    return np.concatenate(out)


def consensus_gp(
    df: DataFrame, kernel: Kernel, group: str, s: Settings, key: str = "key", mean: Mean = zero, *, inlier_metric: Strategy = chi_squared, consensus_metric: Strategy = feature_count,
    is_valid: Callable[..., bool] = chi_squared_valid(), max_rows: int = MAX_ROWS,
) -> DataFrame:
    """(key, code, iteration, groups, rows, metric): for every key a search among its groups on one joint prior.

    A group agrees while the inlier metric of its joint prediction by the candidates is at most s.threshold; candidates count
    while is_valid of their prior holds; the consensus with the least metric of its prior wins, the first of equals. Draws are
    dealt out beside the keys: with few keys, the draws of one are shared by all tasks, each of which builds the prior once.
    A null group is a group.
    """
    kinds, spark = dict(df.dtypes), df.sparkSession
    rows = df.select(key, "row_id", "feature", "target", "target_variance", F.col(group).alias("__g"))
    draws, tasks = s.iterations + max(0, s.max_failed), int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(key).distinct().limit(tasks).count()  # as many as there are tasks need no parts
    parts = max(1, min(draws, -(-tasks // max(1, keys))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_rows:
            raise ValueError(f"group {pdf[key].iloc[0]} has {len(pdf)} rows; at most {max_rows} make an exact process")
        pdf = pdf.sort_values("row_id")
        x, y, var = arrays(pdf)
        codes, names = pd.factorize(pdf["__g"], sort=True, use_na_sentinel=False)
        names, own = list(range(len(names))), pdf[key].iloc[0]
        out = []
        if not (s.iterations <= 0 or s.sample <= 0 or s.sample >= len(names) or s.consensus >= len(names) or s.consensus < s.sample):
            prior, cov = mean(x), kernel.measured(x, x)

            def of(strategy: Callable, at: np.ndarray):
                return strategy(prior[at], cov[np.ix_(at, at)], y[at], var[at])

            rows_of = [np.flatnonzero(codes == g) for g in names]
            sizes = np.array([len(at) for at in rows_of])
            done = failed = 0
            for draw in range(int(pdf["__part"].iloc[0]), draws, parts):
                if done == s.iterations or failed and failed >= s.max_failed:
                    break  # what is left of the draws decides nothing
                chosen = drawn_groups(names, s, own, draw)
                known = np.flatnonzero(np.isin(codes, chosen))
                if not of(is_valid, known):
                    failed += 1
                    out.append((draw, False, 0, 0, np.nan))
                    continue
                done += 1
                others = np.setdiff1d(names, chosen)
                by_size = {int(n): others[sizes[others] == n] for n in np.unique(sizes[others])}
                found = _held_out(prior, cov, y, var, known, {n: np.stack([rows_of[g] for g in own_size]) for n, own_size in by_size.items()}, inlier_metric)
                agreed = [*chosen, *np.concatenate(list(by_size.values()))[found <= s.threshold]]
                inside = np.flatnonzero(np.isin(codes, agreed))
                out.append((draw, True, len(agreed), len(inside), of(consensus_metric, inside) if len(agreed) >= s.consensus else np.nan))
        else:
            out.append((-1, False, 0, 0, np.nan))
        return pd.DataFrame(out, columns=["draw", "valid", "groups", "rows", "metric"]).assign(**{key: own})[[key, "draw", "valid", "groups", "rows", "metric"]]

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, code, iteration, groups, size, least = pdf.sort_values("draw"), NO_CONSENSUS, -1, 0, 0, np.nan
        failed = done = 0
        for r in pdf.itertuples():
            if r.draw < 0:
                code = INVALID
                break
            if done == s.iterations:
                break
            if not r.valid:
                failed += 1
                if failed >= s.max_failed:
                    code, iteration, groups, size, least = EXCEEDED, -1, 0, 0, np.nan
                    break
                continue
            done += 1
            if r.metric == r.metric and not r.metric >= least:
                code, iteration, groups, size, least = SUCCESS, r.draw, r.groups, r.rows, r.metric
        return pd.DataFrame({key: [pdf[key].iloc[0]], "code": [code], "iteration": [iteration], "groups": [groups], "rows": [size], "metric": [least]})

    copied = rows.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    judged = spread(copied, key, "__part").groupBy(key, "__part").applyInPandas(run, f"{key} {kinds[key]}, draw int, valid boolean, groups int, rows int, metric double")
    return spread(judged, key).groupBy(key).applyInPandas(decide, f"{key} {kinds[key]}, code string, iteration int, groups int, rows int, metric double")
