"""Who is who: stable ids, equal and similar records, clusters, survivors, crosswalks and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import URL_RULES, canonical_key, content_digest, record_id  # noqa: F401
from ..sources import versions
from ..sources.shared import keep
from .components import components
from .neighbours import with_neighbour
from .similar import match_candidates, match_pairs  # noqa: F401

def exact_groups(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """``digest, id, n``: groups of equal content with the smallest id."""
    digest = record_id(*cols) if len(cols) > 1 else content_digest(cols[0])
    return df.groupBy(digest.alias("digest")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))


def clusters(pairs: DataFrame) -> DataFrame:
    """``id, cluster_id``: components of ``pairs(x, y)``, named by their smallest member; the turns this takes grow with the logarithm of the largest."""
    return components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("id"), F.col("label").alias("cluster_id"))


def golden_record(df: DataFrame, cluster: str, order: list[Column], id_col: str) -> DataFrame:
    """One survivor a cluster: the largest in ``order``, then the smallest id, of any type that has an order. A null ranks below all values, a null id behind all ids."""
    ranked = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(f"`{cluster}`").alias("_c"), F.col(f"`{id_col}`").alias("_id"), F.struct(F.lit(0), *order).alias("_o"))
    least = ranked.groupBy("_c", "_o").agg(F.min_by("_row", F.struct(F.col("_id").isNull(), "_id")).alias("_row"))
    return least.groupBy("_c").agg(F.max_by("_row", "_o").alias("_row")).select("_row.*")


def given_ids(*tables: DataFrame) -> DataFrame:
    """``stable_id``: all that occur in crosswalks or registers before, each once."""
    every = tables[0].select("stable_id")
    for x in tables[1:]:
        every = every.unionByName(x.select("stable_id"))
    return every.where("stable_id IS NOT NULL").distinct()


def update_crosswalk(previous: DataFrame, new: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """``id, stable_id, change`` from the ids before and ``clusters`` now.

    A cluster takes the smallest id that its members had; if several clusters
    share that one (a split), the one with the smallest member keeps it. Others
    get their smallest member's number that never was a stable id, or where all
    were, a new one above all numbers in use. So no two clusters share an id.
    ``given(stable_id)`` is the register of all ids ever given; with it none
    that was retired comes again. Without it only ``previous`` is known.
    ``change`` is same, merge, split or new.
    """
    used = given_ids(previous) if given is None else given_ids(previous, given)
    used = used.withColumnRenamed("stable_id", "id")
    joined = new.join(previous.select("id", F.col("stable_id").alias("_old")), "id", "left")
    by = joined.groupBy("cluster_id").agg(F.min("_old").alias("_old"), F.count_distinct("_old").alias("_olds"))
    keeps = by.where("_old IS NOT NULL").groupBy("_old").agg(F.min("cluster_id").alias("cluster_id")).withColumn("_keeps", F.lit(True))
    free = new.join(used, "id", "left_anti").groupBy("cluster_id").agg(F.min("id").alias("_free"))
    top = new.select("id").unionByName(used).agg(F.max("id").alias("_top"))
    low = new.agg(F.min("cluster_id").alias("_low"))
    named = by.join(keeps.drop("_old"), "cluster_id", "left").join(free, "cluster_id", "left").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(low))
    own = F.coalesce("_free", F.col("_top") + 1 + F.col("cluster_id") - F.col("_low"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_olds") > 1, "merge").when(F.col("_keeps"), "same").otherwise("split")
    named = named.select("cluster_id", F.when(F.col("_keeps"), F.col("_old")).otherwise(own).alias("stable_id"), change.alias("change"))
    return new.join(named, "cluster_id").select("id", "stable_id", "change")


def advance_crosswalk(path: str, new: DataFrame) -> DataFrame:
    """The crosswalk stored in a folder, brought up to ``clusters`` now; ``id, stable_id, change`` as it was written.

    The folder keeps the register of all ids ever given with each version of
    the crosswalk, so both change together or not at all; an id that was retired
    is never given again. The first turn starts from nothing.
    """
    spark = new.sparkSession
    stored = versions.latest(spark, path, "crosswalk")
    if stored is None:
        kind = new.schema["id"].dataType
        stored = spark.createDataFrame([], T.StructType().add("id", kind).add("stable_id", kind))
    # A register's row has no member.
    now = keep(update_crosswalk(stored.where("id IS NOT NULL"), new, stored))
    retired = given_ids(stored).join(now.select("stable_id").distinct(), "stable_id", "left_anti")
    versions.commit(now.select("id", "stable_id").unionByName(retired.select(F.lit(None).cast(now.schema["id"].dataType).alias("id"), "stable_id")), path, "crosswalk")
    return now


def attribute_history(df: DataFrame, entity: str, ts: str, attr: str, tie: str, cell: Column | None = None) -> DataFrame:
    """``entity, value, valid_from, valid_to``: runs of one value, in order of time and ``tie``; an open end is null.

    A hot entity is sorted by cells of time: days, or ``cell`` where ``ts`` is no date or timestamp.
    """
    rows = df.select(F.col(entity).alias("entity"), F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(attr).alias("value"), (F.to_date(ts) if cell is None else cell).alias("day"))
    rows = with_neighbour(rows, "entity", ["ts", "tie"], F.struct("value"), F.col("day"))
    changed = rows.where(F.col("_beside").isNull() | ~F.col("value").eqNullSafe(F.col("_beside.value"))).drop("_beside")
    ends = with_neighbour(changed, "entity", ["ts", "tie"], F.struct("ts"), F.col("day"), later=True)
    return ends.select(F.col("entity").alias(entity), "value", F.col("ts").alias("valid_from"), F.col("_beside.ts").alias("valid_to"))
