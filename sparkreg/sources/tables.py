"""Sources and sinks: delimited text, station files, flattened features, fitted models."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkreg.functions.columns import ecef
from sparkreg.functions.order import global_row_number, spread
from sparkreg.functions.storage import materialise
from sparkreg.operators.dataset import first_by
from sparkreg.operators.sparse_gp import SparseFit
from sparkreg.operators.tuning import Parameter, to_tuning_space


def read_thinned(spark: SparkSession, path: str, schema: str, order: list[str], columns: list[str], thin: int = 5) -> DataFrame:
    """Every thin-th row (0, thin, ...) in the given order of a CSV file with a header; other columns are not read."""
    rows = spark.read.csv(path, header=True, schema=schema).select(*dict.fromkeys([*order, *columns]))
    return global_row_number(rows, *order, name="__n").where(F.col("__n") % thin == 0).select(*columns)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """feature and target of a prediction file."""
    schema = "feature double, prediction double, prediction_variance double, target double, target_variance double"
    return spark.read.csv(path, header=True, schema=schema).select("feature", "target")


def usable_stations(stations: DataFrame, since: int = 20180101, row_id: str = "row_id") -> DataFrame:
    """Stations of the contiguous United States that are still at work and no buoys; the first of each USAF id, with ECEF."""
    name = F.upper("station_name")
    keep = (
        (F.col("lat") != 0) & (F.col("lon") != 0) & (F.col("elev") > -999) & (F.col("usaf") != "999999") & (F.col("end") >= since) & (F.col("ctry") == "US")
        & (F.col("lat") >= 25) & (F.col("lat") <= 50) & (F.col("lon") >= -125) & (F.col("lon") <= -60) & F.col("state").isNotNull() & ~F.coalesce(name.contains("BUOY"), F.lit(False))
    )
    first = first_by(stations.where(keep).select(row_id, "usaf", "lat", "lon", "elev"), ["usaf"], row_id)
    x, y, z = ecef(F.col("lat"), F.col("lon"), F.col("elev"))
    return first.withColumns({"x": x, "y": y, "z": z})


def read_station_files(spark: SparkSession, path: str) -> DataFrame:
    """(value, path) of the lines of many small text files; a task reads as many files as fill its share of bytes."""
    lines = spark.read.text(path, recursiveFileLookup=True)
    return lines.select("value", F.col("_metadata.file_path").alias("path"))


def write_station_files(lines: DataFrame, folder: str, name: str = "name", order: str = "row_id", max_lines: int = 1_000_000) -> DataFrame:
    """Lines (name, row_id, value) as one text file for each name below folder; returns (name, lines).

    A file is written under a temporary name and then given its own, so a task that is run again replaces it.
    """
    from pyarrow import fs

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_lines:
            raise ValueError(f"file {pdf[name].iloc[0]} has {len(pdf)} lines; at most {max_lines}")
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        temp, own = f"{root}/.{pdf[name].iloc[0]}.{uuid.uuid4().hex}", f"{root}/{pdf[name].iloc[0]}"
        with system.open_output_stream(temp, compression=None) as out:
            out.write("".join(f"{v}\n" for v in pdf.sort_values(order)["value"]).encode())
        system.move(temp, own)
        return pd.DataFrame({"name": [pdf[name].iloc[0]], "lines": [len(pdf)]})

    return materialise(spread(lines.select(name, order, "value"), name).groupBy(name).applyInPandas(write, "name string, lines long"), "station-files")


def station_observations(lines: DataFrame, date: str) -> DataFrame:
    """(usaf, date, temp) of fixed-width lines (value, path) of one date: station from the file's name. Lines of other forms,
    headers above all, have no date or temperature and are left out."""
    usaf = F.regexp_extract("path", r"([^/-]+)-[^/]*$", 1)
    rows = lines.select(usaf.alias("usaf"), F.substring("value", 15, 8).alias("date"), F.trim(F.substring("value", 25, 6)).try_cast("double").alias("temp"))
    return rows.where((F.col("date") == date) & F.col("temp").isNotNull())


def prediction_grid(points: DataFrame, box: tuple[float, float, float, float], order: list[str]) -> DataFrame:
    """Grid points inside (south, north, west, east): longitudes wrapped to [-180, 180), a NaN target, ids 0 .. n-1."""
    south, north, west, east = box
    rows = points.withColumn("lon", F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180)
    rows = rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return global_row_number(rows, *order, name="station").withColumn("temp", F.lit(float("nan")))


def flat_columns(schema: StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, dotted name) of the leaves of a schema."""
    out = []
    for field in schema.fields:
        path, name = f"{prefix}`{field.name}`", f"{prefix.replace('`', '')}{field.name}"
        out += flat_columns(field.dataType, f"{path}.") if isinstance(field.dataType, StructType) else [(path, name)]
    return out


def flatten(df: DataFrame, feature: str = "feature", custom: dict[str, Column] | None = None) -> DataFrame:
    """df with its nested feature as dotted columns; custom Columns are added, or replace a leaf of that name."""
    custom = custom or {}
    kind = df.schema[feature].dataType
    leaves = flat_columns(StructType([df.schema[feature]])) if isinstance(kind, StructType) else [(f"`{feature}`", feature)]
    rest = [F.col(f"`{c}`") for c in df.columns if c != feature]
    return df.select(*rest, *(F.col(p).alias(n) for p, n in leaves if n not in custom), *(c.alias(n) for n, c in custom.items()))


def rounded(c: Column, places: int) -> Column:
    """round() of SQL engines on binary numbers: c times 10^places to the nearest integer, halves away from zero, and back.
    Spark's round goes by the shortest decimal form of c, which may be a half where the product is not."""
    v = F.abs(c) * 10.0**places
    part = v % 1
    nearest = F.signum(c) * (v - part + F.when(part >= 0.5, 1.0).otherwise(0.0)) / 10.0**places
    return F.when(v < 2.0**52, nearest).otherwise(c)


def fixed(c: Column) -> Column:
    """A number with six decimals, as printf writes it: by its exact binary value, exact halves to even (Java's formatter rounds
    the shortest decimal form up). Null stays empty."""

    @F.pandas_udf("string")
    def six(values: pd.Series) -> pd.Series:
        return pd.Series([f"{v:.6f}" for v in values.tolist()], dtype=object)

    return F.when(c.isNotNull(), six(c.cast("double")))


def csv_rows(dataset: DataFrame, predictions: DataFrame | None, metadata: list[str] = (), row_id: str = "row_id") -> DataFrame:
    """Rows to write: flattened feature, target, target_variance, prediction, prediction_variance and metadata, as text,
    columns sorted by name. Predictions (row_id, mean, variance, metadata) win a clash of metadata; None: zeros."""
    flat = flatten(dataset)
    if predictions is None:
        rows = flat.withColumn("prediction", F.lit(0.0)).withColumn("prediction_variance", F.lit(0.0))
    else:
        theirs = [c for c in metadata if c in predictions.columns]
        right = predictions.select(F.col(row_id).alias("__r"), F.col("mean").alias("prediction"), F.col("variance").alias("prediction_variance"), *(F.col(c).alias(f"__{c}") for c in theirs))
        rows = flat.join(right, F.col(f"`{row_id}`") == F.col("__r"), "left").drop("__r")
        for c in theirs:
            rows = rows.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(f"`{c}`") if c in flat.columns else F.lit(None))).drop(f"__{c}")
    number = dict(rows.dtypes)
    as_text = lambda c: fixed(F.col(f"`{c}`")) if number[c] in ("double", "float") else F.col(f"`{c}`").cast("string")
    return rows.select(*(as_text(c).alias(c) for c in sorted(rows.columns) if c != row_id))


def many_csv_rows(parts: list[DataFrame]) -> DataFrame:
    """Rows of several datasets in one table: the columns of the first; names met only later are dropped."""
    columns = parts[0].columns
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*(F.col(f"`{c}`") for c in columns))


def write_csv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.csv(path, header=header, emptyValue="", nullValue="")


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """(i, line): a row of a long matrix (i, j, v) as comma-separated text."""
    cells = matrix.select("i", "j", fixed(F.col("v")).alias("t")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "t"))).alias("c"))
    return cells.select("i", F.array_join(F.transform("c", lambda x: x["t"]), ",").alias("line"))


def last_sampler_state(log: DataFrame, params: dict[str, Parameter]) -> DataFrame:
    """Rows of the last iteration of a sampler log of text columns: what is no number is NaN, values are held in bounds; for each
    parameter also tuned_<name>, its value in tuning space."""
    number = lambda c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(float("nan")))
    rows = log.select(F.expr("try_cast(iteration as int)").alias("iteration"), F.expr("try_cast(ensemble_index as int)").alias("ensemble_index"), number("log_probability").alias("log_probability"), *(number(p).alias(p) for p in params))
    last = F.broadcast(rows.agg(F.max("iteration").alias("__last")))
    rows = rows.join(last, F.col("iteration") == F.col("__last")).drop("__last")
    bounds = {k: (F.lit(p.low), F.lit(p.high)) for k, p in params.items()}
    held = {k: F.when(F.isnan(k), F.col(k)).otherwise(F.least(F.greatest(F.col(k), low), high)) for k, (low, high) in bounds.items()}
    tuned = {f"tuned_{k}": F.when(F.isnan(k), F.col(k)).otherwise(to_tuning_space(F.col(k), *bounds[k], F.lit(p.log_scale))) for k, p in params.items()}
    return rows.withColumns(held).withColumns(tuned)


def save_fit(fits: DataFrame, path: str, codec: str = "zstd") -> None:
    """Fits, one row a key, as Parquet."""
    fits.write.mode("overwrite").option("compression", codec).parquet(path)


def load_fit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_sparse_fit(spark: SparkSession, fit: SparseFit, path: str) -> None:
    """A sparse fit, as Parquet of one row."""
    fit.table(spark).write.mode("overwrite").parquet(path)


def load_sparse_fit(spark: SparkSession, path: str) -> SparseFit:
    return SparseFit.from_row(spark.read.parquet(path).first())
