"""Deterministic range shards, and files that tasks write to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.functions.order import global_row_number
from sparkreg.functions.storage import materialise

MAX_TASKS = 100_000  # of one pass over shards or files; a task takes several when there are more
LEAST = {"long": -(1 << 63), "string": ""}  # the place of null in key order: first, with the least key


def id_kind(df: DataFrame, key: str) -> str:
    """The type in which ids are ordered: long for integers, else string."""
    return "long" if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else "string"


def sorted_shards(df: DataFrame, key: str, then: list[str], rows_per_shard: int) -> DataFrame:
    """df with a column __shard, a task a shard (or a few), each sorted by key and then; nulls first.

    Shards are cut at every rows_per_shard-th key, so they depend on the rows alone and not on how Spark split the
    input; rows with one key stay in one shard. One key a shard is broadcast. Keys that are no integers
    are ordered as strings, by code point.
    """
    kind = id_kind(df, key)
    place = F.coalesce(F.col(key).cast(kind), F.lit(LEAST[kind]))
    number = global_row_number(df.select(place.alias("k")), "k")
    found = sorted(r.k for r in number.where(F.col("row_number") % rows_per_shard == 0).select("k").collect())
    bounds = df.sparkSession.sparkContext.broadcast(np.array(found, dtype=np.int64 if kind == "long" else object))

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(bounds.value, keys.to_numpy(), side="right") - 1, 0).astype(np.int32))

    placed = df.withColumn("__shard", shard(place))
    return in_tasks(placed, max(1, len(found)), F.col("__shard")).sortWithinPartitions("__shard", F.col(key).cast(kind), *then)


def in_tasks(df: DataFrame, n: int, number: Column) -> DataFrame:
    """df dealt out by a number 0 .. n - 1: a task for each, or for a few neighbours when there are over MAX_TASKS."""
    tasks = max(1, min(n, MAX_TASKS))
    return df.repartitionById(tasks, F.floor(number * tasks / max(1, n)).cast("int") if tasks < n else number.cast("int"))


def file_tasks(files: DataFrame) -> DataFrame:
    """The files of a materialised manifest, each in a task of its own."""
    placed = files.withColumn("__at", F.row_number().over(Window.orderBy("name")) - 1)  # one row a file
    return in_tasks(placed, files.count(), F.col("__at")).drop("__at")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class NewFile:
    """A file under a temporary name; commit() later gives it its own."""

    def __init__(self, folder: str, name: str) -> None:
        self.system, root = fs.FileSystem.from_uri(folder)
        self.name, self.temp = name, f"_temporary/{name}.{uuid.uuid4().hex}"
        self.system.create_dir(f"{root}/_temporary", recursive=True)
        self.out, self.size = self.system.open_output_stream(f"{root}/{self.temp}", compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


def commit(folder: str, manifest: DataFrame) -> DataFrame:
    """Give the files of a materialised manifest (columns name and temp) their names; the manifest is written last.

    Only files of task attempts that ended well are in the manifest; a move that ran before is left as it is, so the
    job can be repeated.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temp in zip(batch.column("name").to_pylist(), batch.column("temp").to_pylist(), strict=True):
                if system.get_file_info(f"{root}/{temp}").type != fs.FileType.NotFound:
                    system.move(f"{root}/{temp}", f"{root}/{name}")
            yield batch

    done = materialise(manifest.mapInArrow(move, manifest.schema), "manifest")
    system, root = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        system.delete_dir(f"{root}/_temporary")  # what failed attempts left
    done.drop("temp").coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    return done
