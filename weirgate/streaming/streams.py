"""The operators on streams. Times that have no zone are taken as UTC for watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.baseline import score
from ..operators.contracts import RowRule, violations

#: Cells that entities of ``stream_silence`` are dealt over; it stays as it is for as long as a stream's checkpoint lives.
CELLS = 1024


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream."""
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if name.endswith(".parquet") else path)


def drain(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, into a Parquet folder, and return what it wrote."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_violations(stream: DataFrame, rules: list[RowRule], key) -> DataFrame:
    """``violations`` of a stream, in append mode."""
    return violations(stream, rules, key)


def stream_first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key within ``delay``."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_rollup(stream: DataFrame, entity: str, ts: str, period: str, metric: str, delay: str) -> DataFrame:
    """``entity, period, n, total`` of closed periods."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    by = timed.groupBy(entity, F.window(ts, period).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(metric).cast("decimal(18,2)")).cast("double").alias("total"))
    return by.select(entity, F.col("_w.start").cast("timestamp_ntz").alias("period"), "n", "total")


def stream_sessions(stream: DataFrame, entity: str, ts: str, gap: str, delay: str) -> DataFrame:
    """``entity, session_start, n`` of closed sessions; those split by ``gap`` or more without a report."""
    timed = stream.select(entity, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, delay)
    by = timed.groupBy(entity, F.session_window(ts, gap).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    return by.select(entity, F.col("_s.start").cast("timestamp_ntz").alias("session_start"), "n")


def stream_score(stream: DataFrame, baseline: DataFrame, entity: str, metric: str, k: float) -> DataFrame:
    """``score`` of a stream against a fixed baseline."""
    return score(stream, baseline, entity, metric, k)


def _as_text(c: Column, kind: T.DataType) -> Column:
    """A value as a text that tells it from all others that are not equal."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    # There are two zeros, which are equal.
    return (c + F.lit(0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else c).cast("string")


def _from_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(c.cast("bigint"))
    if isinstance(kind, T.BinaryType):
        return F.unhex(c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.from_json(c, kind)
    return c.cast(kind)


def stream_silence(stream: DataFrame, entity: str | list[str], ts: str, seconds: int, delay: str, cells: int | None = None) -> DataFrame:
    """``entity, last_seen`` of reports that no other follows within ``seconds``.

    ``entity`` is one column or several, of any types; a null in one is a value
    like others. An entity's state is its last report and whether its silence
    was told. Entities are dealt over cells, whose states are one table each, so
    calls and timers grow with the cells, not with the entities; a cell's timer
    on event time is that of the first of its entities to fall silent. Rows
    without a time are left out, as are those later than ``delay``.
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    names = [f"_k{i}" for i in range(len(keys))]
    limit = seconds * 1_000_000  # microseconds, as Spark's timestamps
    kept = pa.schema([*((x, pa.string()) for x in names), ("at", pa.int64()), ("told", pa.bool_())])

    def watch(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else kept.empty_table()
        rows = [held.select([*names, "at"])]
        if not state.hasTimedOut:
            rows += [pa.Table.from_pandas(pdf[[*names, "_at"]], pa.schema([*list(kept)[:-2], ("_at", pa.int64())]), preserve_index=False).rename_columns([*names, "at"]) for pdf in parts]
        every = pa.concat_tables(rows).combine_chunks()
        at = every.column("at").to_numpy()
        # Each row's entity by number.
        who = np.zeros(len(at), np.int64)
        for x in names:
            codes = every.column(x).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            who = np.unique(who * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
        old, told = np.arange(len(at)) < held.num_rows, np.zeros(len(at), bool)
        told[: held.num_rows] = held.column("told").to_numpy()
        known = np.full(int(who.max(initial=-1)) + 1, np.iinfo(np.int64).min)
        known[who[old]] = at[old]
        order = np.lexsort((at, who))
        order = order[(old | (at > known[who]))[order]]
        who, at, told = who[order], at[order], told[order]
        last = np.append(who[1:] != who[:-1], True)[: len(who)]
        gap = np.append((np.diff(at) > limit) & ~last[:-1], False)[: len(who)]
        timer = (at + limit) // 1000 + 1
        due = last & (timer <= state.getCurrentWatermarkMs())
        gaps = (gap | due) & ~told
        told |= due
        first = timer[last & ~told]
        if len(first):
            state.setTimeoutTimestamp(int(first.min()))
        ends = every.take(pa.array(order[last])).append_column("told", pa.array(told[last]))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept) as out:
            out.write_table(ends.cast(kept))
        state.update((sink.getvalue().to_pybytes(),))
        if gaps.any():
            yield every.take(pa.array(order[gaps])).to_pandas()

    timed = stream.select(*(F.col(f"`{k}`") for k in keys), F.col(ts).cast("timestamp").alias(ts)).where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    kinds = [timed.schema[k].dataType for k in keys]
    texts = timed.select(ts, F.unix_micros(ts).alias("_at"), *(_as_text(F.col(f"`{k}`"), kind).alias(x) for k, kind, x in zip(keys, kinds, names, strict=True)))
    # Nulls don't change a hash, so where they stand counts too.
    cell = F.pmod(F.xxhash64(*names, *(F.col(x).isNull() for x in names)), F.lit(cells or CELLS)).cast("int")
    out = T.StructType([T.StructField(x, T.StringType()) for x in names]).add("at", "long")
    told = texts.withColumn("_cell", cell).groupBy("_cell").applyInPandasWithState(watch, out, "entities binary", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(*(_from_text(F.col(x), kind).alias(k) for k, kind, x in zip(keys, kinds, names, strict=True)), F.timestamp_micros("at").alias("last_seen"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished or running query dropped as later than its watermark, so far as its progress is kept (``spark.sql.streaming.numRecentProgressUpdates`` batches)."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def drain_counting(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> tuple[DataFrame, DataFrame]:
    """What ``drain`` returns, and one row ``n_late``: how many rows, or groups of them that a task had added up before, came later than the watermark."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), spark.createDataFrame([(late_rows(query),)], "n_late bigint")
