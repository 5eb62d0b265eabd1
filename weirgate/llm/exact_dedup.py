"""Operator 6: exact duplicates by a log-structured index of digests.

Each task sorts the digests of its rows in memory and flushes them as one run,
an ORC file with a Bloom filter on the digest (level 0). Compaction merges the
runs of a level into sorted runs with one entry a digest. Rows whose digest
others share are hits; their bytes are compared before anything is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, whole_rows

BLOOM_FPP = 0.01


def sha256(value: Column) -> Column:
    """The digest of a binary column, as lower-case hex."""
    return F.sha2(value, 256)


def _run(df: DataFrame, path: str) -> None:
    (
        df.sortWithinPartitions("digest")
        .write.option("orc.bloom.filter.columns", "digest")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .option("compression", "zstd")
        .mode("append")
        .orc(path)
    )


_ENTRY = "digest string, keep_id bigint, keep_batch int, keep_row bigint, n bigint"


class DigestIndex:
    """Sorted runs of digests in two levels of files.

    ``keep`` says which id an entry keeps: "min" or "max". A further batch
    adds runs to level 0; ``compact`` merges them with what level 1 has.
    """

    def __init__(self, spark: SparkSession, root: str, keep: str = "min"):
        self.spark, self.root, self.keep, self.merges = spark, root, keep, 0

    def flush(self, rows: DataFrame, batch: int = 0) -> DataFrame:
        """Write ``rows(id, digest)`` as level-0 runs; each row gets a number of its own within the batch."""
        path = f"{self.root}/level0/batch={batch}"
        _run(rows.select(F.monotonically_increasing_id().alias("row"), "id", "digest"), path)
        return self.spark.read.schema("row bigint, id bigint, digest string").orc(path)

    def entries(self) -> DataFrame:
        """Level 1: for each digest the id that is kept, the batch and row it came in, and the number of rows."""
        return self.spark.read.schema(_ENTRY).orc(f"{self.root}/level1/{self.merges}") if self.merges else self.spark.createDataFrame([], _ENTRY)

    def compact(self, batches: dict[int, DataFrame]) -> DataFrame:
        """Merge level-0 runs with level 1 into a new level 1."""
        pick = F.max if self.keep == "max" else F.min
        every = self.entries()
        for number, rows in batches.items():
            every = every.unionByName(rows.select("digest", F.col("id").alias("keep_id"), F.lit(number).alias("keep_batch"), F.col("row").alias("keep_row"), F.lit(1).cast("bigint").alias("n")))
        # A null id sorts lowest in both directions of a struct's order; a kept row has an id where any row has one.
        has_id = F.col("keep_id").isNull() if self.keep == "min" else F.col("keep_id").isNotNull()
        merged = every.groupBy("digest").agg(pick(F.struct(has_id, "keep_id", "keep_batch", "keep_row")).alias("_b"), F.sum("n").alias("n"))
        _run(merged.select("digest", "_b.keep_id", "_b.keep_batch", "_b.keep_row", "n"), f"{self.root}/level1/{self.merges + 1}")
        self.merges += 1
        return self.entries()

    def find(self, digests: list[str]) -> DataFrame:
        """The entries of some digests; the filter reaches the runs' statistics and Bloom filters, so most of a run isn't read."""
        return self.entries().where(F.col("digest").isin(digests))


def _salted(shared: DataFrame, rows: int, spark: SparkSession) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """A function that adds ``salt`` to rows by digest, and ``shared`` with all salts of each digest.

    A digest with more rows than an eighth of a partition's part is hot: its rows
    are dealt to as many salts as it has such eighths. There are no more hot
    digests than eight times the partitions, so they can be broadcast.
    """
    part = max(1, rows // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = shared.where(F.col("n") > part).select(F.col("digest").alias("_hot"), F.ceil(F.col("n") / part).alias("_salts"))

    def add_salt(df: DataFrame) -> DataFrame:
        marked = df.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")
        salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts")))
        return marked.withColumn("salt", salt.cast("bigint")).drop("_hot", "_salts")

    salts = F.when(F.col("n") > part, F.ceil(F.col("n") / part)).otherwise(1)
    return add_salt, shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))


def group_copies(rows: DataFrame, keep: str = "min", digest: Callable[[Column], Column] = sha256, scratch: Scratch | None = None) -> DataFrame:
    """``id, digest, keep_id, n, kept`` for each row of ``rows(id bigint, payload binary)``.

    Rows with equal payloads form a group; the one with the smallest (or
    largest) id stays. Null counts as an empty payload. Of rows that agree in
    id and payload one stays, the first (or last) in the order of the files. A
    null id stays only if no row of its group has an id. Other columns are not
    read; an empty table gives no rows.

    Rows of a digest that several rows share are read again and compared byte
    by byte with the row that stays. Should a digest be shared by different
    payloads, those rows are grouped by the payload itself.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "dedup")
    rows = rows.select("id", F.coalesce("payload", F.expr("X''")).alias("payload"))
    hashed = rows.withColumn("digest", digest(F.col("payload")))
    index = DigestIndex(spark, scratch.path("index"), keep)
    level0 = index.flush(hashed.select("id", "digest"))
    shared = index.compact({0: level0}).where("n > 1").drop("keep_batch")
    n_rows = level0.count()
    add_salt, salted = _salted(shared, n_rows, spark)

    hits = scratch.write(add_salt(hashed).join(salted.select("digest", "salt", "keep_id", "n"), ["digest", "salt"]), "hits")
    stays = hits.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "n").agg(F.first("payload").alias("_kept"))
    _, stays = _salted(stays, n_rows, spark)
    differs = hits.join(stays.select("digest", "salt", "_kept"), ["digest", "salt"]).where(F.col("payload") != F.col("_kept")).select("digest").distinct()
    collided = scratch.write(differs, "collided")

    grouped = add_salt(level0).join(salted, ["digest", "salt"], "left")
    alone = F.col("n").isNull()
    out = grouped.select("id", "digest", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("n"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"))
    if collided.isEmpty():
        return out
    again = hits.select("id", "digest", "payload").join(collided, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id())
    again = scratch.write(again, "again")
    pick = F.max if keep == "max" else F.min
    best = again.groupBy("digest", "payload").agg(pick(F.struct("id", "row")).alias("_b"), F.count(F.lit(1)).alias("n"))
    fixed = again.join(best, ["digest", "payload"]).select("id", "digest", F.col("_b.id").alias("keep_id"), "n", (F.col("row") == F.col("_b.row")).alias("kept"))
    return out.join(collided, "digest", "left_anti").select(fixed.columns).unionByName(fixed)


def drop_copies(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without the rows whose text an equal row with a larger ``doc_id`` has; a null text counts as empty.

    All columns stay as they are, whatever their names. Of rows that agree in
    ``doc_id`` and text one stays; null ids count as the smallest. An empty
    table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "dedup")
    payload = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    groups = scratch.write(group_copies(docs.select(F.col("doc_id").cast("bigint").alias("id"), payload.alias("payload")), keep="max", scratch=scratch), "groups")
    dropped = groups.where("NOT kept").select("digest", "id").distinct()
    # Rows that agree in id and text have one key for the row that stays and those that go.
    repeated = scratch.write(dropped.alias("d").join(groups.where("kept").alias("k"), (F.col("d.digest") == F.col("k.digest")) & F.col("d.id").eqNullSafe(F.col("k.id")), "left_semi"), "repeated")
    marked = whole_rows(docs, sha256(payload).alias("key"), F.col("doc_id").cast("bigint").alias("of"))
    match = F.col("key").eqNullSafe(F.col("digest")) & F.col("of").eqNullSafe(F.col("id"))
    rest = marked.join(dropped, match, "left_anti").select("row.*")
    if repeated.isEmpty():
        return rest
    return rest.unionByName(marked.join(repeated, match, "left_semi").dropDuplicates(["key", "of"]).select("row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = group_copies(docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("binary").alias("payload")), keep="max", scratch=Scratch(spark, "op6"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
