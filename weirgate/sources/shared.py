"""The folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` or checkpoint folder.

    Where neither is set, a session on one machine gets a fresh local folder as
    its checkpoint folder; on a cluster, where such a folder would lose data,
    this raises an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that no later plan computes it again and lost executors lose none of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
