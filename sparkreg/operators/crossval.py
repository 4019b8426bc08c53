"""Cross-validation and scores. A fold is a key on the row: test rows have it, train rows are all others."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.functions.order import spread
from sparkreg.functions.storage import bounded_broadcast, materialise
from sparkreg.operators.linear import SUMS, line, power_sums

MAX_FOLDS = 50
MAX_MODEL_BYTES = 256 << 20  # of the models of all folds
MAX_TEST = 5_000  # rows of a fold that are predicted together
MAX_TRAIN = 500_000  # rows of a fold's training set, for models that need them together


def create_folds(df: DataFrame, key: str = "key", max_folds: int = MAX_FOLDS) -> DataFrame:
    """(fold, role, row): every row as test of its own fold and train of all others. Replicates rows: few folds only.

    Additive models and processes need no such table; see cv_predict_line and gp.leave_group_out.
    """
    keys = df.select(F.col(key).alias("__fold")).distinct()
    if (n := keys.limit(max_folds + 1).count()) > max_folds:
        raise ValueError(f"over {n - 1} folds: use a closed form instead of one copy of the rows a fold")
    rows = df.join(F.broadcast(keys))  # at most max_folds keys
    rows = rows.withColumn("role", F.when(F.col(key).eqNullSafe(F.col("__fold")), "test").otherwise("train"))
    return (rows.drop("fold") if "fold" in df.columns else rows).withColumnRenamed("__fold", "fold")


def fold_fits(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """(key, offset, slope): the line fitted without each fold, from totals less the fold's own sums."""
    centre = F.broadcast(df.agg(F.avg(x).alias("__cx"), F.avg(y).alias("__cy")))
    sums = df.crossJoin(centre).groupBy(key).agg(*power_sums(F.col(x) - F.col("__cx"), F.col(y) - F.col("__cy")), F.first("__cx").alias("cx"), F.first("__cy").alias("cy"))
    totals = F.broadcast(sums.agg(*(F.sum(c).alias(f"t_{c}") for c in SUMS)))
    rest = sums.crossJoin(totals).select(key, "cx", "cy", *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in SUMS))
    offset, slope = line()
    rest = rest.withColumn("o", offset).withColumn("slope", slope)
    return rest.select(F.col(key).alias("fold"), (F.col("o") + F.col("cy") - F.col("slope") * F.col("cx")).alias("offset"), "slope")


def cv_predict_line(df: DataFrame, x: str, y: str, key: str, name: str = "prediction") -> DataFrame:
    """df with the prediction of the line fitted without the row's fold: two passes, no copy of a row."""
    rows = df.join(bounded_broadcast(materialise(fold_fits(df, x, y, key), "fold-fits")), F.col(key).eqNullSafe(F.col("fold")))
    return rows.withColumn(name, F.col("offset") + F.col("slope") * F.col(x)).drop("fold", "offset", "slope")


def loo_predict_line(df: DataFrame, x: str, y: str, name: str = "prediction") -> DataFrame:
    """df with leave-one-out predictions: y - e / (1 - h) with the leverage h."""
    centre = F.broadcast(df.agg(F.count(x).alias("__n"), F.avg(x).alias("__cx"), F.avg(y).alias("__cy")))
    rows = df.crossJoin(centre)
    dx, dy = F.col(x) - F.col("__cx"), F.col(y) - F.col("__cy")
    sums = F.broadcast(rows.agg(F.sum(dx * dx).alias("__sxx"), F.sum(dx * dy).alias("__sxy")))
    rows = rows.crossJoin(sums)
    error = dy - F.col("__sxy") / F.col("__sxx") * dx
    leverage = 1 / F.col("__n") + dx * dx / F.col("__sxx")
    return rows.withColumn(name, F.col(y) - error / (1 - leverage)).drop("__n", "__cx", "__cy", "__sxx", "__sxy")


def cv_predict(df: DataFrame, fit: Callable[[pd.DataFrame], object], predict: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, key: str = "key", max_folds: int = MAX_FOLDS, max_train: int = MAX_TRAIN, max_model_bytes: int = MAX_MODEL_BYTES, together: bool = False, max_test: int = MAX_TEST) -> DataFrame:
    """Predictions of any model, fold by fold, a null fold being one; schema is that of predict's rows, (row_id and key among those of df).

    A model that needs its rows together is trained in one task a fold, on rows that are copied once a fold: more than
    max_train of them are an error before any row is moved (additive models: ``cv_predict_additive``; processes:
    ``gp.logo_gp``; models that Spark fits: ``predict_folds``). Test rows stay where they are: fold models are sent to the tasks that hold rows. With ``together`` predict
    gets all rows of a fold at once, for joint predictions; folds of more than max_test rows are an error then.
    """
    known, sizes = _fold_models(df, fit, key, max_folds, max_train, max_model_bytes)
    if together:
        if (sizes.agg(F.max("n").alias("m")).first().m or 0) > max_test:
            raise ValueError(f"a fold has more than {max_test} rows, which are predicted together")
        whole = _by_fold(known, predict, key)
        return spread(df, key).groupBy(key).applyInPandas(lambda pdf: pd.concat(list(whole(iter([pdf.sort_values("row_id")])))), schema)
    return df.mapInPandas(_by_fold(known, predict, key), schema)


def _fold_models(df: DataFrame, fit: Callable[[pd.DataFrame], object], key: str, max_folds: int, max_train: int, max_model_bytes: int):
    """(the pickled models of all folds as a broadcast, rows of each fold as (k, n))."""
    folds = create_folds(df, key, max_folds).where("role = 'train'")
    sizes = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg((F.sum("n") - F.min("n")).alias("m")).first().m or 0
    if most > max_train:
        raise ValueError(f"{most} rows train a fold; at most {max_train} are fitted together")
    kind = dict(df.dtypes)[key]
    models = spread(folds, "fold").groupBy("fold").applyInPandas(lambda pdf: pd.DataFrame({"fold": [fold_of(pdf["fold"].iloc[0])], "model": [cloudpickle.dumps(fit(pdf.sort_values("row_id")))]}), f"fold {kind}, model binary")
    models = materialise(models, "fold-models")
    held = models.agg(F.coalesce(F.sum(F.octet_length("model")), F.lit(0)).alias("b")).first().b
    if held > max_model_bytes:
        raise ValueError(f"the models of the folds have {held} bytes; at most {max_model_bytes} are sent to the tasks")
    known = df.sparkSession.sparkContext.broadcast({r.fold: bytes(r.model) for r in models.collect()})  # max_folds models
    return known, sizes


def cv_predict_pairs(df: DataFrame, fit: Callable[[pd.DataFrame], object], predict: Callable[[object, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, key: str = "key", max_folds: int = MAX_FOLDS, max_train: int = MAX_TRAIN, max_model_bytes: int = MAX_MODEL_BYTES, block_rows: int = 1_000) -> DataFrame:
    """Joint predictions of folds of any size: predict(model, rows, other rows) of each pair of blocks of about block_rows rows of
    a fold, so a task holds one block of a covariance at a time. The result has the square of a fold's rows; see ``cv_predict``."""
    known, sizes = _fold_models(df, fit, key, max_folds, max_train, max_model_bytes)
    parts = F.broadcast(materialise(sizes.select(F.col("k").alias("__k"), F.ceil(F.col("n") / block_rows).cast("int").alias("__n")), "fold-parts"))  # max_folds rows
    rows = df.join(parts, F.col(key).eqNullSafe(F.col("__k"))).withColumn("__p", F.pmod(F.xxhash64(*df.columns), F.col("__n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    left, right = rows.withColumn("__q", every), rows.withColumnRenamed("__p", "__q").withColumn("__p", every)
    names, columns = [x.strip().split(" ")[0] for x in schema.split(", ")], df.columns

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        model = pickle.loads(known.value[fold_of(a[key].iloc[0])])
        b = b.set_axis([*columns, "__p", "__q"], axis=1)
        return predict(model, *(t[columns].sort_values("row_id").assign(fold=t[key].iloc[0]) for t in (a, b)))

    left = left.select(*columns, "__p", "__q")
    right = right.select(*(F.col(c).alias(f"__r_{c}") for c in left.columns))  # both are of one table, so names must tell them apart
    a, b = (spread(t, *by).groupBy(*by) for t, by in ((left, (key, "__p", "__q")), (right, (f"__r_{key}", "__r___p", "__r___q"))))
    return a.cogroup(b).applyInPandas(run, schema)


def predict_folds(df: DataFrame, models: DataFrame, predict: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, key: str = "key", max_folds: int = MAX_FOLDS) -> DataFrame:
    """Predictions of models that Spark fitted without their folds (fold, model): what ``cv_predict`` does where the rows of a
    training set are too many for one task. models go to the rows, which stay where they are."""
    found = models.select("fold", "model").limit(max_folds + 1).collect()
    if len(found) > max_folds:
        raise ValueError(f"over {max_folds} folds")
    known = df.sparkSession.sparkContext.broadcast({r.fold: cloudpickle.dumps(r.model) for r in found})
    return df.mapInPandas(_by_fold(known, predict, key), schema)


def fold_medians(df: DataFrame, value: str, key: str = "key", max_folds: int = MAX_FOLDS) -> DataFrame:
    """(fold, model): the median of the values of all rows but the fold's; nulls and NaN are left out, a null fold is a fold.

    No row is copied a fold. Counts of distinct values are sorted by range; counts of the ranges tell in which of them the middle
    of each training set lies, and running counts inside those ranges alone where.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    folds = [r[0] for r in df.select(key).distinct().limit(max_folds + 1).collect()]
    if len(folds) > max_folds:
        raise ValueError(f"over {max_folds} folds: medians are found for few folds only")
    v = F.col(value).cast("double")
    counts = df.select(v.alias("v"), F.col(key).alias("f")).where("v is not null and not isnan(v)").groupBy("v", "f").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.repartitionByRange("v").withColumn("pid", F.spark_partition_id()), "value-counts")
    sums: dict = {}
    for r in counts.groupBy("pid", "f").agg(F.sum("n").alias("n")).collect():  # ranges times folds
        sums.setdefault(r.pid, {})[r.f] = r.n
    wanted = []
    for fold in folds:
        inside = {pid: sum(own.values()) - own.get(fold, 0) for pid, own in sorted(sums.items())}
        n = sum(inside.values())
        for rank in sorted({(n - 1) // 2, n // 2}) if n else []:
            before = 0
            for pid, own in inside.items():
                if rank < before + own:
                    wanted.append((fold, pid, rank - before))
                    break
                before += own
    marks = F.broadcast(spark.createDataFrame(wanted, f"fold {kind}, pid int, rank long"))  # two a fold
    rows = counts.join(marks, "pid").where(~F.col("f").eqNullSafe(F.col("fold"))).groupBy("fold", "pid", "rank", "v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("fold", "pid", "rank").orderBy("v"))
    middle = rows.withColumn("upto", upto).where("rank < upto and rank >= upto - n")
    return middle.groupBy("fold").agg(F.avg("v").alias("model"))


def _by_fold(known, predict: Callable[[object, pd.DataFrame], pd.DataFrame], key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """predict(model, rows) of each fold of a batch; a null fold is a fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict = {}
        for pdf in batches:
            for fold, part in pdf.groupby(key, sort=False, dropna=False):
                fold = fold_of(fold)
                if fold not in own:
                    own[fold] = pickle.loads(known.value[fold])
                yield predict(own[fold], part.assign(fold=part[key]))

    return run


def fold_of(value):
    """A fold as pandas gives it, with None where it is null."""
    return None if value is None or value is pd.NA or value is pd.NaT or value != value else value


def cv_predict_additive(df: DataFrame, sums: Callable[[pd.DataFrame], np.ndarray], solve: Callable[[np.ndarray], object], predict: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, key: str = "key", max_folds: int = 5000, max_bytes: int = MAX_MODEL_BYTES) -> DataFrame:
    """Predictions of a model whose training data enter by sums (moments, gram matrices, counts): sums(pdf) of the rows of a
    batch, which add up; solve(total) is a model. A fold is left out by subtraction, so no row is copied or shuffled, and
    tasks send one array a fold."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for fold, own in pdf.groupby(key, sort=False, dropna=False):
                fold = fold_of(fold)
                total[fold] = total.get(fold, 0) + np.asarray(sums(own), float)
        if total:  # a task may have no rows
            yield pd.DataFrame({key: list(total), "s": [t.reshape(-1) for t in total.values()], "shape": [list(t.shape) for t in total.values()]})

    kind = dict(df.dtypes)[key]
    parts = df.mapInPandas(part, f"{key} {kind}, s array<double>, shape array<int>")
    added = parts.select(key, "shape", F.posexplode("s").alias("at", "v")).groupBy(key, "at").agg(F.sum("v").alias("v"), F.first("shape").alias("shape"))
    added = added.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("s"), F.first("shape").alias("shape"))
    added = materialise(added, "fold-sums")
    held = added.agg(F.count(F.lit(1)).alias("n"), F.coalesce(8 * F.sum(F.size("s")), F.lit(0)).alias("b")).first()
    if held.n > max_folds or held.b > max_bytes:
        raise ValueError(f"{held.n} folds with sums of {held.b} bytes; at most {max_folds} and {max_bytes} are sent to the tasks")
    found = added.collect()  # one array a fold
    folds = {r[key]: np.array(r.s).reshape(r["shape"]) for r in found}
    total = sum(folds.values())
    known = df.sparkSession.sparkContext.broadcast({k: cloudpickle.dumps(solve(total - v)) for k, v in folds.items()})
    return df.mapInPandas(_by_fold(known, predict, key), schema)


# ---- metrics: aggregates over rows with an error column


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


def error_std(e: Column) -> Column:
    """Sample standard deviation; of one row 0, of none NaN."""
    return F.when(F.count(e) == 0, float("nan")).when(F.count(e) == 1, 0.0).otherwise(F.stddev_samp(e))


# ---- joint metrics of one group, in NumPy


def nll_joint(mean: np.ndarray, cov: np.ndarray, truth: np.ndarray, variance: np.ndarray) -> float:
    total = cov + np.diag(variance)
    r = truth - mean
    return float(0.5 * (r @ np.linalg.solve(total, r) + np.linalg.slogdet(total)[1] + len(r) * np.log(2 * np.pi)))


def mahalanobis(mean: np.ndarray, cov: np.ndarray, truth: np.ndarray, variance: np.ndarray) -> float:
    r = truth - mean
    return float(r @ np.linalg.solve(cov + np.diag(variance), r))


def _root(a: np.ndarray) -> np.ndarray:
    w, q = np.linalg.eigh(a)
    return (q * np.sqrt(np.maximum(w, 0))) @ q.T


def wasserstein_2(m: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray) -> float:
    """The squared distance of two normal distributions."""
    root = _root(b)
    return float(((m - n) ** 2).sum() + max(0.0, np.trace(a) + np.trace(b) - 2 * np.trace(_root(root @ a @ root))))


def differential_entropy(cov: np.ndarray, textbook: bool = False) -> float:
    """k (1 + log 2 pi + log|cov|) / 2: k multiplies the log determinant too, unless textbook."""
    k, log_det = len(cov), float(np.linalg.slogdet(cov)[1])
    return 0.5 * (k * (1 + np.log(2 * np.pi)) + (log_det if textbook else k * log_det))


def antithetic(rng: np.random.Generator, mean: np.ndarray, cov: np.ndarray, n: int) -> np.ndarray:
    """At least n draws from a normal distribution in blocks of three pairs z, -z."""
    half = -(-n // 6) * 3
    z = rng.standard_normal((half, len(mean)))
    w, q = np.linalg.eigh(cov)
    x = z @ (q * np.sqrt(np.maximum(w, 0))).T
    return np.concatenate([mean + x, mean - x])


def energy_score(mean: np.ndarray, cov: np.ndarray, truth: np.ndarray, variance: np.ndarray, seed: int = 22, n: int = 1000, weights: np.ndarray | None = None) -> float:
    """E|X - y| - E|X - X'| / 2 from two sets of draws, at least 0. Weights scale squared errors in the first term and raw
    differences in the second."""
    rng, total = np.random.default_rng(seed), cov + np.diag(variance)
    a, b = antithetic(rng, mean, total, n), antithetic(rng, mean, total, n)
    w = np.ones(len(mean)) if weights is None else weights
    first = np.sqrt((w * (a - truth) ** 2).sum(1)).mean()
    return float(max(0.0, first - 0.5 * np.sqrt(((w * (a - b)) ** 2).sum(1)).mean()))


def variogram_score(pairs: DataFrame, by: list[str], p: int = 1) -> DataFrame:
    """Score by group from pairs (y_i, y_j, mean and variance of X_i - X_j, optional weight w): sum w (|dy|^p - E|dX|^p)^2."""
    from sparkreg.functions.columns import expected_abs_normal

    d = F.abs(F.col("dy"))
    expected = expected_abs_normal(F.col("dm"), F.sqrt("dv"), p)
    gap = (d if p == 1 else d * d) - expected
    weight = F.col("w") if "w" in pairs.columns else F.lit(1.0)
    return pairs.groupBy(*by).agg(F.sum(weight * gap * gap).alias("score"))
