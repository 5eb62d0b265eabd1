"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again for the next one. All but the last return the columns
of documents.

Rows with nulls, empty or very long texts, ties and repeated rows are handled
as the operators' docstrings say: a null text counts as empty, so ``quality``
drops it; repeated rows leave one in ``exact``; an empty table stays empty; and
further columns, whatever their names, come through to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirgate.llm.exact_dedup import drop_copies
from weirgate.llm.mixing import mix
from weirgate.llm.near_dedup import drop_near_copies
from weirgate.llm.packing import packed_digests
from weirgate.llm.quality import keep_good
from weirgate.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return keep_good(docs, Scratch(spark, "pipeline"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_copies(docs, Scratch(spark, "pipeline"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, one document of each group."""
    return drop_near_copies(docs, Scratch(spark, "pipeline"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs, scratch=Scratch(spark, "pipeline"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packed_digests(docs, Scratch(spark, "pipeline"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixed", mixed), ("packed", packed)]

#: SQL cannot express estimation of the rules or byte-pair encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    scratch = Scratch(spark, "run")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
