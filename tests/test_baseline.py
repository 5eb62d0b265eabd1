"""Silent baselines on small tables made by hand."""

import datetime
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.operators import baseline as B
from weirgate.operators import contracts as C
from weirgate.plans.registry import QUERIES
from weirgate.sources import baselines
from weirgate.sources.shared import fresh

DAY = datetime.datetime(2024, 1, 1)


def test_null_entities_are_like_others(spark):
    rows = [(None, DAY, 1.0), (None, DAY, 3.0), ("a", DAY, 5.0), ("a", DAY, 6.0)]
    df = spark.createDataFrame(rows, "e string, ts timestamp_ntz, v double")
    filled = B.zero_fill(B.rollup(df, "e", "ts", "1 day", "v"), df, "e", "2024-01-01", "2024-01-02").collect()
    assert {(r["e"], r["period"].day): (r["n"], r["total"]) for r in filled} == {(None, 1): (2, 4.0), (None, 2): (0, 0.0), ("a", 1): (2, 11.0), ("a", 2): (0, 0.0)}
    scored = B.score(df, B.fit(df, ["e"], "v"), "e", "v", 0.5).collect()
    assert sorted((r["e"] or "", round(r["z"], 3), r["flagged"]) for r in scored) == [("", -0.707, True), ("", 0.707, True), ("a", -0.707, True), ("a", 0.707, True)]
    low, high = (spark.createDataFrame([(None, x)] * 50 + [("a", 1.0)] * 50, "e string, v double") for x in (1.0, 99.0))
    psi = {r["e"]: r["psi"] for r in B.drift(low, high, "e", "v", 10.0, 10).collect()}
    p, q = [(x + 0.5) / 55 for x in (50, 0)], [(x + 0.5) / 55 for x in (0, 50)]
    assert psi["a"] == 0 and psi[None] == pytest.approx(sum((b - a) * math.log(b / a) for a, b in zip(p, q)))


def test_score_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1.0, "a", 8, "old", "x"), (2.0, "b", 9, "old", "y")], "v double, e string, _mean int, z string, `a.b` string")
    fitted = spark.createDataFrame([("a", 0.0, 2.0)], "e string, mean double, sd double")
    got = B.score(df, fitted, "e", "v", 0.1).collect()
    assert sorted((r["_mean"], r["a.b"], r["z"], r["flagged"]) for r in got) == [(8, "x", 0.5, True), (9, "y", None, False)]


@pytest.mark.parametrize("seed", range(3))
def test_robust_fit(spark, seed):
    pick = random.Random(seed)
    values = {"wide": [pick.choice([-1, 1]) * 10 ** pick.uniform(-5, 5) for _ in range(301)], "near": [1000 + pick.random() / 50 for _ in range(200)], "ties": [float(pick.randrange(4)) for _ in range(100)], "same": [2.0] * 5, "one": [-7.5], None: [0.0, -0.0, 4.0], "zero": [0.0, 1.0]}
    df = spark.createDataFrame([(e, v) for e, x in values.items() for v in x] + [("wide", None), ("gone", None), ("ties", float("nan"))], "e string, v double")
    got = {r["e"]: (r["median"], r["mad"]) for r in B.fit_robust(df, "e", "v").collect()}
    assert set(got) == set(values)
    for e, x in values.items():
        assert got[e] == pytest.approx((np.median(x), np.median(np.abs(np.array(x) - np.median(x)))), rel=1e-12, abs=1e-12)
    assert B.fit_robust(df.limit(0), "e", "v").count() == 0


def test_quantiles_of_extremes(spark):
    values = [-math.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, math.inf]
    df = spark.createDataFrame([("a", v) for v in values], "e string, v double")
    for k, v in enumerate(values):
        assert B.fit_quantiles(df, "e", "v", {"q": k / 8}).collect()[0]["q"] == v



def test_scans(spark, sf):
    """Two scans for quantiles; after the one that is written, two for the median and the deviation; one a rule or side for a summary."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    count = lambda df: len(re.findall(r"FileScan parquet", df._jdf.queryExecution().executedPlan().toString()))
    assert count(B.fit_quantiles(events, "event_type", "value", {"p50": 0.5, "p95": 0.95})) == 2
    assert count(B.fit_robust(events, "event_type", "value")) == 2
    assert count(QUERIES["c12_contract_summary"](spark, sf)) == 4


def brute_sessions(rows, gap):
    out = []
    for e, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        if out and out[-1][0] == e and t - out[-1][3] <= gap:
            out[-1][2] += 1
            out[-1][3] = t
        else:
            out.append([e, t, 1, t])
    return sorted(((e, t, n) for e, t, n, _ in out), key=str)


@pytest.mark.parametrize("hours", [1, 6, 30])
def test_sessions_over_cells(spark, hours):
    """A hot entity over many days, gaps of exactly the limit, days without a row, null entities."""
    pick, gap = random.Random(hours), datetime.timedelta(hours=hours)
    rows = [(pick.choice([1, 1, 1, 2, None]), DAY + datetime.timedelta(minutes=10 * pick.randrange(6 * 24 * 20))) for _ in range(400)]
    rows += [(7, DAY + k * gap) for k in range(30)] + [(8, DAY + k * gap + datetime.timedelta(microseconds=k)) for k in range(9)] + [(9, DAY), (9, DAY)]
    df = spark.createDataFrame([*rows, (9, None)], "e int, ts timestamp_ntz")
    got = B.sessions(df, "e", "ts", f"{hours} hours")
    want = brute_sessions(rows, gap)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, B.sessions(df, "e", "ts", f"{hours} hours", F.date_trunc("hour", "ts")).collect()), key=str) == want
    assert (7, DAY, 30) in want and sum(x[0] == 8 for x in want) == 9
    assert B.sessions(df.limit(0), "e", "ts", "1 hour").count() == 0


def test_baseline_ids(spark):
    path = fresh(spark, "ids")
    with pytest.raises(ValueError):
        baselines.load(spark, path, "1")
    ids = ["01", "1", "7", "2024-01-22", "train", "a/b=c d"]
    for k, x in enumerate(ids):
        baselines.freeze(spark.createDataFrame([(x, float(k), None)], "e string, mean double, sd double"), path, x)
    for k, x in enumerate(ids):
        assert [tuple(r) for r in baselines.load(spark, path, x).collect()] == [(x, float(k), None)]
    assert baselines.load(spark, path, "100").count() == 0 and baselines.load(spark, path, "100").columns == ["e", "mean", "sd"]
    held = baselines.load(spark, path, "1")
    baselines.freeze(spark.createDataFrame([("new",)], "other string"), path, "1")
    assert [tuple(r) for r in baselines.load(spark, path, "1").collect()] == [("new",)]
    assert [r["e"] for r in held.collect()] == ["1"] and baselines.load(spark, path, "01").count() == 1


def test_half_a_baseline_is_not_read(spark):
    path = fresh(spark, "half")
    baselines.freeze(spark.createDataFrame([("old",)], "e string"), path, "x")
    spark.createDataFrame([("half",)], "e string").write.parquet(f"{path}/versions/unfinished")
    spark.createDataFrame([], "name string, turn bigint, version string, shape string").write.mode("append").parquet(f"{path}/commits")
    assert [r["e"] for r in baselines.load(spark, path, "x").collect()] == ["old"]


def test_key_summaries(spark):
    child = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 9), (None, 9), (3, 9)], "k int, fk int")
    parent = spark.createDataFrame([(1,), (1,), (None,), (5,)], "pk int")
    one = lambda df: [tuple(r) for r in df.collect()]
    assert one(C.unique_summary("u", child, ["k", "fk"])) == [("u", 2, 2, False)]
    assert one(C.references_summary("r", child, "fk", parent, "pk")) == [("r", 5, 3, False)]
    assert C.references(child, "fk", parent, "pk").count() == 3
    assert one(C.references_summary("r", child.limit(0), "fk", parent.limit(0), "pk")) == [("r", 0, 0, True)]
    assert one(C.unique_summary("u", child.limit(0), ["k"])) == [("u", 0, 0, True)]
