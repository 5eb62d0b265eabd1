"""Repeated passages against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from weirgate.llm import suffix_dedup as S
from weirgate.llm.scratch import Scratch


def brute(rows, least, keep_first=False):
    """Of each row the places of bytes that go."""
    rows = [(k, (text or "").encode()) for k, (_, text) in enumerate(rows)]
    places = defaultdict(list)
    for k, data in rows:
        for i in range(len(data) - least + 1):
            places[data[i : i + least]].append((k, i))
    gone = [set() for _ in rows]
    for found in places.values():
        for k, i in found[1:] if keep_first else found if len(found) > 1 else ():
            gone[k].update(range(i, i + least))
    return gone


def brute_row(doc_id, text, gone):
    data = (text or "").encode()
    return doc_id, len(data), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(bytes(x for i, x in enumerate(data) if i not in gone)).hexdigest()


def made(n, least, seed=3):
    """Texts of few passages and some noise, with copies, long runs and a text of many pieces."""
    pick = random.Random(seed)
    noise = lambda k: "".join(pick.choice("abcdeé ") for _ in range(k))
    passages = [noise(pick.randrange(least // 2, 3 * least)) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(pick.choice([passages[pick.randrange(6)], passages[0], noise(pick.randrange(2 * least))]) for _ in range(pick.randrange(5)))
        rows.append((i, text))
    rows += [(n, "x" * (5 * least)), (n + 1, "yz" * (2 * least)), (n + 2, rows[3][1]), (n + 3, None), (n + 4, ""), (n + 5, "".join(passages) * 3 + noise(700))]
    return rows


@pytest.fixture(params=[(20, 1024, 1_000_000), (20, 3, 90), (1, 2, 7), (9, 1024, 300)])
def settings(request, monkeypatch):
    least, part, size = request.param
    monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "TEXT_BYTES", size)
    monkeypatch.setattr(S, "SORT_BYTES", size)
    return least


def spans_of(spark, rows, least, keep_first):
    df = spark.createDataFrame([(i, t, "t", 7) for i, t in rows], "doc_id long, text string, lang string, r int")
    found = S.repeated_places(S._named(df, "text"), Scratch(spark, "t11"), least, keep_first)
    joined = S._named(df, "text").join(found, "r", "left").collect()
    return {r["doc_id"]: S.removed_spans(r["spans"] or [], least) for r in joined}


@pytest.mark.parametrize("keep_first", [False, True])
def test_places(spark, settings, keep_first):
    rows = made(40, settings)
    want = brute(rows, settings, keep_first)
    got = spans_of(spark, rows, settings, keep_first)
    for (i, _), gone in zip(rows, want, strict=True):
        assert {x for a, b in got[i] for x in range(a, b)} == gone, i
        assert all(a[1] < b[0] for a, b in zip(got[i], got[i][1:]))


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_and_factors(seed):
    pick = np.random.default_rng(seed)
    data = pick.integers(0, 2 + seed, 300).astype(np.uint8)
    for least in (1, 3, 8, 13, 40):
        at = np.sort(pick.choice(len(data) - least + 1, 150, replace=False))
        order, shared = S.suffix_order(data, at, least)
        strings = [data[x : x + least].tobytes() for x in at[order]]
        assert strings == sorted(strings)
        assert shared.tolist() == [a == b for a, b in zip(strings, strings[1:])]
        position = pick.permutation(150)[order]
        source = S.previous_factors(position, shared)
        for k, x in enumerate(strings):
            earlier = [j for j, y in enumerate(strings) if y == x and position[j] < position[k]]
            assert (source[k] in earlier) if earlier else source[k] == -1


def test_stretches_name_equal_strings_alike():
    """Every string of a text is in one stretch, and equal strings have one anchor digest at one distance."""
    least, pick = 25, np.random.default_rng(1)
    data = pick.integers(0, 2, 4000).astype(np.uint8)
    data[2000:2600] = data[100:700]
    starts, ends = np.array([0, 10, 10, 1500, 3990]), np.array([10, 10, 1500, 3990, 4000])
    text, anchor, lo, hi, at = S.stretches(data, starts, ends, least)
    name = {}
    for t, h, a, b, x in zip(text.tolist(), anchor.tolist(), lo.tolist(), hi.tolist(), at.tolist(), strict=True):
        assert starts[t] <= a <= b <= ends[t] - least
        for s in range(a, b + 1):
            assert name.setdefault(data[s : s + least].tobytes(), (h, x - s)) == (h, x - s)
    assert sorted(s for a, b in zip(lo, hi) for s in range(a, b + 1)) == [s for a, b in zip(starts, ends) for s in range(a, b - least + 1)]


def test_query(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = {brute_row(*row, gone) for row, gone in zip(rows, brute(rows, 400), strict=True)}
    got = {tuple(r[x] for x in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in S.op11_repeated_passages(spark, sf).collect()}
    assert got == want and any(x[2] for x in want)


def test_query_of_odd_rows(spark, tmp_path):
    long = "".join(random.Random(2).choices("abcdefgh", k=900))
    rows = [(1, long), (1, long), (None, long[100:600] + "é"), (None, None), (2, ""), (3, "q" * 399), (3, "q" * 401), (4, "".join(random.Random(4).choices("stuv é", k=2_100_000))), (5, long[:399])]
    spark.createDataFrame([(*x, 1, "a") for x in rows], "doc_id long, text string, spans int, h string").write.parquet(f"{tmp_path}/documents.parquet")
    small = [x for x in rows if x[0] != 4]
    want = sorted([brute_row(*row, gone) for row, gone in zip(small, brute(small, 400), strict=True)] + [brute_row(*rows[7], set())], key=str)
    assert sorted(map(tuple, S.op11_repeated_passages(spark, str(tmp_path)).collect()), key=str) == want
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert S.op11_repeated_passages(spark, f"{tmp_path}/empty").count() == 0


def test_rows_of_a_hot_anchor_are_split(spark):
    """Joins with the counts of anchors leave a hot anchor's rows, which may be split, to several tasks."""
    pick = random.Random(7)
    noise = lambda k: "".join(pick.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=k))
    common, texts = noise(25), [noise(60) for _ in range(300)]
    rows = list(enumerate([noise(30) + common + noise(30) for _ in range(1500)] + texts + texts))
    plans = {}

    class Seen(Scratch):
        def write(self, df, name):
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().write(df, name)

    conf = {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "16", "files.openCostInBytes": "64k", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "2k"}
    conf |= {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", v)
        docs = S._named(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "text")
        got = docs.join(S.repeated_places(docs, Seen(spark, "t11h"), 20, keep_first=False), "r", "left").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    for (i, _), gone, r in zip(rows, brute(rows, 20), sorted(got, key=lambda r: r["doc_id"]), strict=True):
        assert {x for a, b in S.removed_spans(r["spans"] or [], 20) for x in range(a, b)} == gone, i
    for name in ("shared", "found"):
        final = plans[name].partition("== Initial Plan ==")[0]
        joins = [x for x in final.splitlines() if "SortMergeJoin" in x and "[h#" in x]
        assert joins and all("skew=true" in x for x in joins), name


def test_drop_repeats_keeps_first_and_columns(spark):
    a = "é" + "".join(random.Random(5).choices("abcdefgh", k=60))
    rows = [(3, "x" + a, "n", 1), (2, a + "yy", "n", 2), (2, a + "yy", "n", 2), (None, "short", None, 3), (7, None, "n", 4), (8, a[:20] + "#" + a[40:], "n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `r.x` string, spans int")
    got = S.drop_repeats(df, Scratch(spark, "t11d"), least=30).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["r.x"], r["spans"], r["removed_bytes"]) for r in got) == sorted(
        [(3, "x", "n", 1, 62), (2, a + "yy", "n", 2, 0), (2, a + "yy", "n", 2, 0), (0, "short", None, 3, 0), (7, "", "n", 4, 0), (8, a[:20] + "#" + a[40:], "n", 5, 0)]
    )
    assert {r["doc_id"]: r["text"] for r in got}[7] is None
