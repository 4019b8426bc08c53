"""Numbered tables below a folder: what a long-running job knows after each of its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Tables ``<kind>=<number>`` in a folder; a table counts once its write has ended."""

    def __init__(self, folder: str, kind: str) -> None:
        self.folder, self.kind = folder.rstrip("/"), kind

    def path(self, number: int) -> str:
        return f"{self.folder}/{self.kind}={number:012d}"

    def _files(self, spark: SparkSession):
        make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return make, make(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self, spark: SparkSession) -> list[int]:
        """Those that are complete, in order."""
        make, files = self._files(spark)
        found = files.globStatus(make(f"{self.folder}/{self.kind}=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(self.path(number))

    def drop(self, spark: SparkSession, numbers: list[int]) -> None:
        make, files = self._files(spark)
        for n in numbers:
            files.delete(make(self.path(n)), True)
