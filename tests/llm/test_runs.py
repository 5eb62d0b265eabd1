"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np

from weirgate.llm import runs

ODD = [
    (1, "x a b a b a b a b y"), (1, "x a b a b a b a b y"), (2, None), (None, "q q q q q q"), (3, ""), (4, " \n"), (5, "q q q q q"),
    (8, " ".join(f"w{i % 4001}" for i in range(40_000))), (7, "z" * 300_000), (30, "a b a b c A a"),
]


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def brute_row(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if w and h % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    hexed = lambda x: hashlib.sha256(x).hexdigest()
    digests = hexed("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), hexed(b" ".join(x for i, x in enumerate(w) if i not in gone))
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests)


def test_runs_of_random_words():
    pick = random.Random(5)
    for _ in range(300):
        docs = []
        for _ in range(pick.choice([1, 3])):
            w = []
            for _ in range(pick.randrange(6)):
                part = [pick.randrange(pick.choice([2, 3, 50])) for _ in range(pick.choice([1, 2, 3, 5, 9, 12, 17, 33]))]
                w += part * pick.choice([1, 2, 4, 5, 7]) + part[: pick.randrange(len(part) + 1)]
            docs.append(w)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in docs]))).astype(np.int64)
        got = [[] for _ in docs]
        for k, *found in zip(*(x.tolist() for x in runs.find_runs(np.array([x for d in docs for x in d], np.int64), bounds)), strict=True):
            got[k].append(tuple(found))
        assert got == [brute_runs(d) for d in docs]


def test_one_word_half_a_million_times():
    n = 500_000
    assert [x.tolist() for x in runs.find_runs(np.zeros(n, np.int64), np.array([0, n]))] == [[0], [0], [n], [1]]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in runs.op13_periodic_runs(spark, sf).collect()}
    want = {brute_row(*r) for r in docs}
    assert got == want and any(r[1] for r in want)


def test_query_of_odd_rows(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, runs.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    (long,) = [x for x in got if x[0] == 8]
    assert got == sorted([long, *(brute_row(*r) for r in ODD if r[0] != 8)], key=str)
    assert long[1:6] == (1, 0, 40_000, 4001, 9997)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert runs.op13_periodic_runs(spark, f"{tmp_path}/empty").count() == 0


def test_collapse_keeps_columns(spark):
    df = spark.createDataFrame([(*x, 3, "r", "é", 1) for x in ODD[:6]], "doc_id long, text string, period int, runs string, _row string, `a.b` int")
    got = runs.collapse_runs(df).collect()
    assert [(r["doc_id"], r["text"], r["period"], r["_row"]) for r in got] == [(*x, 3, "é") for x in ODD[:6]]
    assert [[tuple(x) for x in r["runs"]] for r in got] == [[(1, 8, 2)], [(1, 8, 2)], [], [(0, 6, 1)], [], []]
    assert [r["collapsed"] for r in got] == ["x a b y", "x a b y", "", "q", "", ""]
