"""Running totals by key as an incremental sink of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreg.functions.versions import Versions


class KeyedTotals:
    """Running totals by key, merged a micro-batch at a time; use ``update`` with foreachBatch.

    sums(batch) gives rows (key columns, totals); totals of a key add up. A batch writes one row for each key that it changed,
    and nothing for others. What is known is the last base, a row for every key, and the batches after it; every
    ``compact_every`` batches a new base is written and what it replaces is removed. A batch that has been written is not counted
    again; one that was cut off is written anew; so a restart goes on where the last complete batch ended.

    A null key is a key; an empty batch writes nothing but its number.
    """

    def __init__(self, folder: str, by: list[str], totals: list[str], sums: Callable[[DataFrame], DataFrame], compact_every: int = 16) -> None:
        self.by, self.totals, self.sums, self.compact_every = by, totals, sums, compact_every
        self.changes, self.bases = Versions(folder, "batch"), Versions(folder, "base")

    def _known(self, spark: SparkSession) -> tuple[int, list[int], int]:
        """(last base or -1, batches after it, last batch or -1)."""
        base = max(self.bases.numbers(spark), default=-1)
        after = [n for n in self.changes.numbers(spark) if n > base]
        return base, after, max([base, *after])

    def _rows(self, spark: SparkSession) -> DataFrame | None:
        """Every version of every key, with the number of its batch."""
        base, after, _ = self._known(spark)
        parts = [spark.read.parquet(self.bases.path(base)).withColumn("__batch", F.lit(base))] if base >= 0 else []
        parts += [spark.read.parquet(self.changes.path(n)).withColumn("__batch", F.lit(n)) for n in after]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def _latest(self, rows: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct(*self.totals), F.col("__batch")).alias("t")
        return rows.groupBy(*self.by).agg(newest).select(*self.by, "t.*")

    def table(self, spark: SparkSession) -> DataFrame | None:
        """The totals of every key so far; None before the first batch."""
        rows = self._rows(spark)
        return None if rows is None else self._latest(rows)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base, after, last = self._known(spark)
        if batch_id <= last:
            return
        new = self.sums(batch).select(*self.by, *self.totals)
        old = self._rows(spark)
        if old is not None:
            own = new.select(*(F.col(c).alias(f"__{c}") for c in self.by)).distinct()
            same = None
            for c in self.by:
                equal = F.col(c).eqNullSafe(F.col(f"__{c}"))
                same = equal if same is None else same & equal
            changed = self._latest(old.join(own, same, "left_semi"))
            new = new.unionByName(changed).groupBy(*self.by).agg(*(F.sum(c).alias(c) for c in self.totals))
        self.changes.write(new, batch_id)
        if len(after) + 1 >= self.compact_every:
            self.bases.write(self.table(spark), batch_id)
            self.changes.drop(spark, [n for n in self.changes.numbers(spark) if n <= batch_id])
            self.bases.drop(spark, [n for n in self.bases.numbers(spark) if n < batch_id])
