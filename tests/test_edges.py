"""Small tables made by hand."""

import datetime
import random
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.operators import baseline as B
from weirgate.operators import contracts as C
from weirgate.operators import identity as I
from weirgate.operators import schema as S
from weirgate.operators.neighbours import with_neighbour
from weirgate.sources.shared import fresh


def test_null_fails_only_not_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", 5)], "id long, a string, b int")
    assert C.not_null(df, ["a"]).count() == 1
    assert C.in_domain(df, "a", ["y"]).count() == 1
    assert C.in_range(df, "b", lo=9).count() == 1
    assert C.matches(df, "a", "^z").count() == 1
    rules = [C.not_null_rule("n", "a"), C.in_range_rule("r", "b", lo=9)]
    valid, rejected = C.quarantine(df, rules)
    assert valid.count() == 0 and rejected.count() == 2
    got = {r["rule_id"]: (r["n_checked"], r["n_violations"]) for r in C.contract_summary(df, rules).collect()}
    assert got == {"n": (2, 1), "r": (1, 1)}
    by_rule = {r["rule_id"]: r["count"] for r in C.violations(df, rules, F.col("id")).groupBy("rule_id").count().collect()}
    assert by_rule == {"n": 1, "r": 1}


def test_record_id_keeps_the_place_of_nulls(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(I.record_id("x", "y", "z").alias("i")).distinct().count() == 2


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 3), (3, 4), (7, 9)], [(4, 3), (9, 7), (3, 2), (2, 1)]])
def test_clusters_of_chains(spark, pairs):
    got = {r["id"]: r["cluster_id"] for r in I.clusters(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 9: 7}


def test_crosswalk_merges_splits_and_news(spark):
    old = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id long, stable_id long")
    new = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4), (9, 9)], "id long, cluster_id long")
    got = {r["id"]: (r["stable_id"], r["change"]) for r in I.update_crosswalk(old, new).collect()}
    assert got[1] == (1, "same") and got[9] == (9, "new") and got[2] == (2, "merge") and got[4] == (3, "same")


def test_crosswalk_gives_no_id_twice(spark):
    old = spark.createDataFrame([(1, 1), (2, 1), (5, 2)], "id long, stable_id long")
    new = spark.createDataFrame([(1, 1), (2, 2), (5, 5)], "id long, cluster_id long")
    got = {r["id"]: (r["stable_id"], r["change"]) for r in I.update_crosswalk(old, new).collect()}
    assert got[1] == (1, "same") and got[5] == (2, "same") and got[2][1] == "split"
    assert len({x for x, _ in got.values()}) == 3


def test_crosswalk_of_random_turns(spark):
    pick = random.Random(3)
    stable = {i: i for i in range(30)}
    for _ in range(4):
        of = {i: pick.randrange(12) for i in range(30)}
        smallest = {k: min(i for i in of if of[i] == k) for k in of.values()}
        new = [(i, smallest[of[i]]) for i in of]
        old = spark.createDataFrame(list(stable.items()), "id long, stable_id long")
        rows = I.update_crosswalk(old, spark.createDataFrame(new, "id long, cluster_id long")).collect()
        now = {r["id"]: r["stable_id"] for r in rows}
        assert len(set(now.values())) == len(set(smallest.values())) and len(now) == 30
        assert all(len({now[i] for i in of if of[i] == k}) == 1 for k in of.values())
        stable = now


def test_crosswalk_without_a_past(spark):
    old = spark.createDataFrame([], "id long, stable_id long")
    got = I.update_crosswalk(old, spark.createDataFrame([(1, 1), (2, 1), (7, 7)], "id long, cluster_id long")).collect()
    assert {r["id"]: (r["stable_id"], r["change"]) for r in got} == {1: (1, "new"), 2: (1, "new"), 7: (7, "new")}


def test_record_id_of_values_with_marks(spark):
    rows = [("a\u001fb", "c"), ("a", "b\u001fc"), (None, "c"), ("\u0000", "c"), ("\\n", "c"), ("\\", "c")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(I.record_id("x", "y").alias("i")).distinct().count() == len(rows)
    groups = I.exact_groups(spark.createDataFrame([(1, None), (2, "\u0000"), (3, None)], "i long, x string"), "i", ["x"]).collect()
    assert sorted((r["id"], r["n"]) for r in groups) == [(1, 2), (2, 1)]


def test_json_types(spark):
    rows = ['{"a": "123", "b.c": 1, "d": "true"}', '{"a": 1.5, "e": "{x", "f": {"g": 1}, "h": [1], "i": null, "j": true}', "[1]", "no json", None, "3"]
    got = {(r["path"], r["json_type"], r["n"]) for r in S.json_shape(spark.createDataFrame([(x,) for x in rows], "j string"), "j").collect()}
    assert got == {("a", "string", 1), ("a", "number", 1), ("b.c", "integer", 1), ("d", "string", 1), ("e", "string", 1), ("f", "object", 1), ("h", "array", 1), ("i", "null", 1), ("j", "boolean", 1)}


def test_drift_of_negative_values(spark):
    before = spark.createDataFrame([("a", -5.0), ("a", -30.0)], "e string, v double")
    after = spark.createDataFrame([("a", 10.0), ("a", None)], "e string, v double")
    p, q = [2.5, 0.5, 0.5, 0.5], [0.5, 1.5, 0.5, 0.5]
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    want = sum((b - a) * log(b / a) for a, b in zip(p, q))
    got = B.drift(before, spark.createDataFrame([("a", 10.0)], "e string, v double"), "e", "v", 10.0, 4).collect()
    assert got[0]["psi"] == pytest.approx(want) and B.drift(before, after, "e", "v", 10.0, 4).collect()[0]["psi"] == pytest.approx(want)


def test_trailing_periods_that_are_missing(spark):
    day = lambda i: datetime.datetime(2024, 1, i)
    df = spark.createDataFrame([("a", day(1), 10), ("a", day(2), 20), ("a", day(9), 5), ("a", day(10), 7)], "e string, period timestamp_ntz, n long")
    got = {r["period"].day: r["mean"] for r in B.fit_trailing(df, "e", 7).collect()}
    assert got == {1: None, 2: 10.0, 9: 20.0, 10: 5.0}


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantiles(spark, p):
    pick = random.Random(9)
    rows = [("many", pick.choice([1.0, 2.0, pick.random()])) for _ in range(501)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("same", 3.0), ("same", 3.0), ("gone", None), (None, 8.0), ("wide", -1e300), ("wide", 1e300), ("wide", 5.0)]
    got = {r["e"]: r["q"] for r in B.fit_quantiles(spark.createDataFrame(rows, "e string, v double"), "e", "v", {"q": p}).collect()}
    by: dict = {}
    for e, v in rows:
        if v is not None:
            by.setdefault(e, []).append(v)
    assert got == {e: pytest.approx(float(np.quantile(v, p))) for e, v in by.items()}


def test_sequences_with_holes(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 0)], "g string, s int")
    assert [tuple(r) for r in C.sequence_steps(df, "g", "s").collect()] == [("a", 3, 1)]


def test_steps_over_cells(spark, monkeypatch):
    """A hot group in many cells, twice the same number, negative numbers, nulls."""
    monkeypatch.setattr(C, "SEQUENCE_CELL", 7)
    pick = random.Random(4)
    rows = [(pick.choice(["hot", "hot", "hot", "b", None]), pick.randrange(-60, 60)) for _ in range(150)]
    df = spark.createDataFrame([*rows, ("hot", None)], "g string, s int")
    by: dict = {}
    for g, s in rows:
        by.setdefault(g, []).append(s)
    want = [(g, b, a) for g, x in by.items() for a, b in zip(sorted(x), sorted(x)[1:]) if b - a != 1]
    assert sorted(map(tuple, C.sequence_steps(df, "g", "s").collect()), key=str) == sorted(want, key=str)


def test_a_cluster_needs_a_shared_folder():
    from weirgate.sources.shared import shared_folder

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_scores_without_spread(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0)], "e string, v double")
    got = B.score(df, B.fit(df, ["e"], "v"), "e", "v", 3.0).collect()
    assert all(r["z"] is None and r["flagged"] is False for r in got)


def test_entry_and_imports(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("later", [False, True])
def test_neighbours_over_cells(spark, later):
    """A hot entity, entities of one row, null entities and null times."""
    r = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(r.choice([None, 1, 1, 1, 2, 3 + i]), r.choice([None, start + datetime.timedelta(hours=r.randrange(200))]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "entity long, ts timestamp_ntz, tie long")
    got = with_neighbour(df, "entity", ["ts", "tie"], F.struct("tie"), F.to_date("ts"), later)
    got = {x["tie"]: x["_beside"] and x["_beside"]["tie"] for x in got.collect()}
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or start, x[2]), reverse=later)
    want = {b[2]: a[2] if a is not None and a[0] == b[0] else None for a, b in zip([None, *ordered], ordered)}
    assert got == want


def test_history_of_odd_rows(spark):
    day = datetime.datetime(2024, 1, 1)
    at = [day + datetime.timedelta(hours=12 * k) for k in range(6)]
    rows = [(1, at[0], 0, None), (1, at[1], 1, None), (1, at[2], 2, "a"), (1, at[4], 3, "a"), (1, at[5], 4, None), (2, at[3], 5, "b")]
    df = spark.createDataFrame(rows, "user long, ts timestamp_ntz, n long, kind string")
    got = {tuple(x) for x in I.attribute_history(df, "user", "ts", "kind", "n").collect()}
    assert got == {(1, None, at[0], at[2]), (1, "a", at[2], at[5]), (1, None, at[5], None), (2, "b", at[3], None)}
    assert I.attribute_history(df.limit(0), "user", "ts", "kind", "n").count() == 0


def test_survivors_of_ties_and_text_ids(spark):
    rows = [("n", 5.0, "b"), ("n", 5.0, "a"), ("n", 1.0, "A"), ("m", None, "x"), ("m", None, None), (None, 2.0, "z"), (None, 3.0, "y"), ("q", 1.0, None)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "c string, v double, i string, _row string")
    got = {tuple(r) for r in I.golden_record(df, "c", [F.col("v")], "i").collect()}
    assert got == {("n", 5.0, "a", "k"), ("m", None, "x", "k"), (None, 3.0, "y", "k"), ("q", 1.0, None, "k")}
    assert I.golden_record(df.limit(0), "c", [F.col("v")], "i").count() == 0


def test_crosswalk_never_gives_a_retired_id_again(spark):
    """Clusters of random turns with members that leave and come back; no id is given to new clusters twice in all history."""
    pick, path = random.Random(8), fresh(spark, "crosswalk")
    owner: dict = {}  # stable id: the members it had last
    before: dict = {}
    for turn in range(6):
        there = [i for i in range(24) if pick.random() < 0.6]
        of = {i: pick.randrange(8) for i in there}
        smallest = {k: min(i for i in of if of[i] == k) for k in of.values()}
        rows = I.advance_crosswalk(path, spark.createDataFrame([(i, smallest[of[i]]) for i in of], "id long, cluster_id long")).collect()
        now = {r["id"]: r["stable_id"] for r in rows}
        assert set(now) == set(there)
        for stable in set(now.values()):
            members = {i for i in now if now[i] == stable}
            assert len({of[i] for i in members}) == 1
            if stable in owner:  # an id that was given before goes on only with a member that had it in the last turn
                assert any(before.get(i) == stable for i in members), (turn, stable)
            owner[stable] = members
        before = now
    assert len(owner) > 12


def test_crosswalk_register(spark):
    old = spark.createDataFrame([(5, 5)], "id long, stable_id long")
    new = spark.createDataFrame([(1, 1), (5, 5)], "id long, cluster_id long")
    given = spark.createDataFrame([(1,), (9,), (9,)], "stable_id long")
    got = {r["id"]: r["stable_id"] for r in I.update_crosswalk(old, new, given).collect()}
    assert got == {5: 5, 1: 10}
