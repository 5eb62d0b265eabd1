"""Streams over files made by hand, a file a batch."""

import datetime

from pyspark.sql import functions as F

from weirgate.sources.shared import fresh
from weirgate.streaming import streams as X

DAY = datetime.datetime(2024, 1, 1)


def batches(spark, schema, *parts):
    """A stream that reads one part after another."""
    path = fresh(spark, "parts")
    for x in parts:
        spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


def test_silence_of_text_and_pairs(spark):
    """Entities of text, of several columns and with nulls; a gap of exactly the limit is none; rows without a time don't count."""
    parts = [
        [("ä", 1, at(0)), ("b", 1, at(0)), ("b", 2, at(1)), (None, 1, at(0)), ("b", 1, None)],
        [("ä", 1, at(5)), ("b", 1, at(6)), ("b", 1, at(3)), ("t", 1, at(20))],
        [("t", 1, at(24)), ("b", 1, at(12))],
        [("t", 1, at(29))],
    ]
    stream = batches(spark, "e string, k int, ts timestamp_ntz", *parts)
    out = X.stream_silence(stream, ["e", "k"], "ts", 5 * 3600, "12 hours")
    got = X.drain(spark, out, fresh(spark, "s"), fresh(spark, "s-check"))
    rows = sorted(((r["e"] or "", r["k"], r["last_seen"].replace(tzinfo=None)) for r in got.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz")).collect()), key=str)
    silent = {(x[0], x[1], (x[2] - DAY).total_seconds() / 3600) for x in rows}
    # "b", 1 reported at 0, 3, 6 and 12: silent from 6 on; later than 12 nothing but "t" came, so far as the watermark (17) says.
    assert silent == {("ä", 1, 5.0), ("b", 2, 1.0), ("", 1, 0.0), ("b", 1, 6.0)} and len(rows) == len(silent)
    one = X.drain(spark, X.stream_silence(stream, "e", "ts", 5 * 3600, "12 hours"), fresh(spark, "s"), fresh(spark, "s-check"))
    assert dict(one.dtypes)["e"] == "string" and {r["e"] for r in one.collect()} == {"ä", "b", None}


def test_silence_calls_grow_with_cells(spark):
    """Many entities of one cell are watched in one call, over batches, as each alone; ids beyond 2^53 beside nulls stay whole."""
    big, rows = 2**60 + 1, [[], [], []]
    for i in range(300):
        rows[0] += [(big + i, float(i % 2), at(0)), (big + i, float(i % 2), at(i % 9))]
        rows[i % 3] += [(big + i, float(i % 2), at(20 + i % 7)), (None, -0.0, at(i % 40))]
    rows[2].append((None, 0.0, at(90)))
    stream = batches(spark, "e bigint, k double, ts timestamp_ntz", *rows)
    out = X.stream_silence(stream, ["e", "k"], "ts", 10 * 3600, "48 hours", cells=1)
    folder = fresh(spark, "s-check")
    got = X.drain(spark, out, fresh(spark, "s"), folder)
    assert [n for n, _ in got.dtypes] == ["e", "k", "last_seen"] and dict(got.dtypes)["e"] == "bigint"
    found = sorted(((r["e"] or 0, r["k"], r["t"]) for r in got.selectExpr("e", "k", "cast(last_seen AS timestamp_ntz) AS t").collect()), key=str)
    want = [(big + i, float(i % 2), at(i % 9)) for i in range(300) if 20 + i % 7 - i % 9 > 10]
    want += [(big + i, float(i % 2), at(20 + i % 7)) for i in range(300)] + [(0, 0.0, at(39))]
    assert found == sorted(want, key=str)
    assert spark.read.format("statestore").load(folder).count() == 1


def test_late_rows_are_counted(spark):
    """Rows behind the watermark, which Spark asks a batch later, are dropped by the rollup and counted; those within the delay are not."""
    parts = [[("a", at(48), 1.0), ("a", at(47), 1.0)], [("a", at(46), 1.0)], [("a", at(0), 1.0), ("b", at(1), 1.0), ("a", at(40), 1.0)], [("a", at(100), 1.0)], [("a", at(101), 1.0)], [("b", at(2), 1.0)]]
    stream = batches(spark, "e string, ts timestamp_ntz, v double", *parts)
    rolled = X.stream_rollup(stream, "e", "ts", "1 hour", "v", "12 hours")
    out, late = X.drain_counting(spark, rolled, fresh(spark, "l"), fresh(spark, "l-check"))
    assert late.collect()[0]["n_late"] == 3
    assert {(r["e"], r["period"]): r["n"] for r in out.collect()} == {("a", at(48)): 1, ("a", at(47)): 1, ("a", at(46)): 1, ("a", at(40)): 1}
