"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh


class Scratch:
    """A new subfolder of the shared folder; tables in it cut the lineage and outlive executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = fresh(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table as read again."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_rows(df: DataFrame, *columns: Column) -> DataFrame:
    """``row``, a struct of all columns, and some more; so no name among the columns can clash with one that is added."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *columns)
