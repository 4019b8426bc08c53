"""Tables that outlive a job: hand-offs between the passes of a multi-pass operator.

A hand-off is written to the folder in ``spark.checkpoint.dir``, which all executors share, so a lost executor costs
a re-read and never a recomputation of the lineage. Only where that setting is absent on a local master does the
library make a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/sparkreg/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, tag: str, batch_rows: int | None = None, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and return a DataFrame that reads it: cuts the lineage.

    batch_rows: rows of the Arrow batches between Spark and Python while df is written; few where rows hold long texts.
    codec: of the files; "zstd" takes less room for whole texts.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, tag)
    before = spark.conf.get(_BATCH)
    try:
        if batch_rows:
            spark.conf.set(_BATCH, batch_rows)
            df = df.select("*")  # planned anew, with that size
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz")
MAX_ROWS, MAX_BYTES = 200_000, 64 << 20  # of a table that is broadcast


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row. Strings, arrays, structs and maps are measured, not guessed: arrays of numbers by their sizes, what
    nests by the bytes of its JSON."""

    def bytes_of(c: Column, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.octet_length(c)
        if kind.startswith("array<") and kind[6:-1] in _NUMBERS:
            return 8 * F.size(c)
        return F.octet_length(F.to_json(F.struct(c.alias("c"))))

    wide = [F.coalesce(bytes_of(F.col(f"`{c}`"), t), F.lit(0)) for c, t in df.dtypes if t not in _NUMBERS and "decimal" not in t[:7]]
    return sum(wide, F.lit(16 * len(df.columns)))


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows of df and about their bytes (``row_bytes``), summed where the rows are: a limit before the sum would move them to one
    task. df should be a materialised or aggregated table: it is counted here."""
    found = df.select(row_bytes(df).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return found.n, found.b


def is_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether df has at most max_rows rows and, as Spark sizes the rows it holds, about max_bytes (``size_of``)."""
    n, b = size_of(df)
    return n <= max_rows and b <= max_bytes


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small (``is_small``), else df as it is (Spark then shuffles the join)."""
    return F.broadcast(df) if is_small(df, max_rows) else df
