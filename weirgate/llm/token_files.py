"""Operator 1: token ids in ORC files.

Documents are range-partitioned and sorted by id, so the files in order hold
the documents in order. ORC encodes the ids by integer run lengths; row
indexes and Bloom filters on ``doc_id`` let a reader skip stripes and row
groups, and Spark deals stripes to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import encoder, give_back, id_lists, list_crcs, per_batch, vocabulary_path

END_ID = 2
#: Rows to an entry of ORC's row index, and the chance of a false hit of its Bloom filters.
INDEX_STRIDE, BLOOM_FPP = 1_000, 0.01

_FILE = "doc_id bigint, block int, local_start bigint, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of each text of ``docs(doc_id, text)`` in ascending ``doc_id`` order.

    Null and empty texts give the end id alone. Repeated ids and rows are all
    kept, next to each other, ordered by text; a null id comes first. Other
    columns are not read. An empty table gives an empty folder of files.
    """
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            give_back()
            for a, b, ids, n in encoder(vocabulary).encode(batch.column("text"), end_id):
                start = at + np.cumsum(n) - n
                at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.full(len(n), block, np.int32)), pa.array(start), pa.array(n.astype(np.int32)), id_lists(ids, n)],
                    names=["doc_id", "block", "local_start", "n_tokens", "ids"],
                )

    (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, _FILE)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: what ``write_tokens`` wrote.

    ``start`` is the number of ids before a document; it adds the sizes of the
    blocks before, read from one column, to the place within the block.
    """
    files = spark.read.schema(_FILE).orc(path)
    sizes = files.groupBy("block").agg(F.sum("n_tokens").alias("_n"))
    before = sizes.select("block", (F.sum("_n").over(Window.orderBy("block")) - F.col("_n")).alias("_before"))
    return files.join(before, "block").select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids")


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the files' statistics and Bloom filters."""
    return spark.read.schema(_FILE).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op1").path("tokens.orc")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "block", "local_start", "n_tokens")), pa.array(list_crcs(batch.column("ids")))], names=["doc_id", "block", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.schema(_FILE).orc(path)
    sizes = files.groupBy("block").agg(F.sum("n_tokens").alias("_n"))
    before = sizes.select("block", (F.sum("_n").over(Window.orderBy("block")) - F.col("_n")).alias("_before"))
    crcs = files.mapInArrow(per_batch(digest), "doc_id bigint, block int, local_start bigint, n_tokens int, ids_crc32 bigint")
    return crcs.join(before, "block").select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids_crc32")
