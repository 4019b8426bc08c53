"""Row order and placement: dense global row numbers without moving all rows to one task, and groups spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkreg.functions.storage import materialise

_LOW = (1 << 33) - 1  # monotonically_increasing_id: partition in the bits above, position in the lower 33


def global_row_number(df: DataFrame, *keys, name: str = "row_number") -> DataFrame:
    """df with 0-based positions in the order of keys.

    One range shuffle sorts the rows; their partition and position are written with them, so that both passes see the
    same partitioning; the counts of the partitions (one row each) give the offsets. Rows that tie on all keys get
    their numbers in any order. Pass only the columns that are needed: all of them are shuffled and written.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__mid", F.monotonically_increasing_id())
    placed = materialise(placed, "numbered").withColumn("__pid", F.shiftright("__mid", 33))
    counts = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")
    offsets = counts.select("__pid", before.alias("__before"))
    number = F.col("__before") + F.col("__mid").bitwiseAND(F.lit(_LOW))
    return placed.join(F.broadcast(offsets), "__pid").withColumn(name, number).drop("__pid", "__mid", "__before")


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """df dealt out by keys to ``tasks`` (spark.sql.shuffle.partitions) tasks, for groups that cost more than their bytes tell:
    adaptive execution would merge small partitions, and so run all groups of a narrow table in one task.

    One task more where that is the number Spark itself shuffles to: it would take a table that a window or an aggregate has
    shuffled by the same keys for dealt out already, and drop this step, but still merge that shuffle's partitions.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(usual + 1 if tasks in (None, usual) else tasks, *keys)
