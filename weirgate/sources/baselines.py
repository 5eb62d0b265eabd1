"""Stored baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import versions


def freeze(baseline: DataFrame, path: str, baseline_id: str) -> None:
    """Store a baseline in a folder under an id, which is text as it stands: "01" is not "1". One that has the id is replaced, for readers at once; others stay."""
    versions.commit(baseline, path, str(baseline_id))


def load(spark: SparkSession, path: str, baseline_id: str) -> DataFrame:
    """A stored baseline with the types it was stored with; only its files are read.

    An id that is not stored gives no rows, in the columns of another baseline of
    the folder; a folder without any is an error.
    """
    found = versions.latest(spark, path, str(baseline_id))
    if found is not None:
        return found
    shape = versions.shape(spark, path)
    if shape is None:
        raise ValueError(f"no baseline is stored in {path}")
    return spark.createDataFrame([], shape)
