"""Tables stored under names, whose readers see whole versions only.

A version is a folder of its own below ``versions``. It counts once a row in
``commits`` names it, which is written last, as one file that appears at once.
A version that was being written when a job ended is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = "name string, turn bigint, version string, shape string"


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(_COMMIT).parquet(f"{path}/commits")


def _last(commits: DataFrame | None, name: str | None) -> Row | None:
    """The newest commit of a name, or of all."""
    if commits is None:
        return None
    found = commits if name is None else commits.where(F.col("name") == name)
    return next(iter(found.orderBy(F.desc("turn"), F.desc("version")).limit(1).collect()), None)


def commit(df: DataFrame, path: str, name: str) -> None:
    """Store ``df`` as the newest version of a name. Of two that are committed at once, one is the newest for all readers."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    before = _last(_commits(spark, path), name)
    df.write.parquet(f"{path}/versions/{version}")
    row = [(name, before["turn"] + 1 if before else 0, version, df.schema.json())]
    spark.createDataFrame(row, _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def latest(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The newest version of a name, with the types it was stored with; None where the name has none."""
    row = _last(_commits(spark, path), name)
    return row and spark.read.schema(T.StructType.fromJson(json.loads(row["shape"]))).parquet(f"{path}/versions/{row['version']}")


def shape(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns of any version there is; None where there is none."""
    row = _last(_commits(spark, path), None)
    return row and T.StructType.fromJson(json.loads(row["shape"]))
