"""Whitened embeddings against plain linear algebra."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from weirgate.llm import whitening
from weirgate.llm.scratch import Scratch

NAN, INF = float("nan"), float("inf")
ODD = [
    (1, [0.5, 1.0, -0.26]), (1, [0.5, 1.0, -0.26]), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [1.0, NAN, 2.0]), (6, [INF, 1.0, 2.0]),
    (7, [1.0, 2.0]), (8, [1e30, 0.0, 0.0]), (None, [3.0, -7.1, 0.0]), (9, [-2.0, 4.25, 1.0]), (10, [0.1, 0.2, 0.3]), (11, [2.5, 0.2, 9.0]), (12, [-0.1, -0.2, 3.3]),
]


def brute(vectors):
    """Rows ``component -> (deviation, explained, covariance, x - mean)`` in plain Python and numpy."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    deviation = [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x]
    centred = np.array([[float(r[k] - Fraction(sums[k], n)) for k in range(d)] for r in x])
    return n, deviation, centred, centred.T @ centred / n


def check(rows, vectors):
    """``rows`` are ``key, component, n, deviation, whitened, explained, identity_error``; ``vectors`` by key, all different."""
    keys = sorted(vectors)
    n, deviation, centred, v = brute([vectors[k] for k in keys])
    values, basis = np.linalg.eigh(v)
    got = defaultdict(dict)
    for key, component, *rest in rows:
        got[key][component] = rest
    many = min(32, int(np.sum(values > 1e-9 * values[-1])))
    assert set(got) == set(keys) and all(set(x) == set(range(1, many + 1)) for x in got.values())
    w = np.array([[got[k][c][2] for c in range(1, many + 1)] for k in keys])
    assert np.abs(w.T @ w / n - np.eye(many)).max() < 1e-9
    want = centred @ basis[:, ::-1][:, :many] / np.sqrt(values[::-1][:many])
    for c in range(many):
        assert w[:, c] == pytest.approx(want[:, c], abs=1e-7) or w[:, c] == pytest.approx(-want[:, c], abs=1e-7)
        assert [got[k][c + 1][3] for k in keys] == pytest.approx([values[-1 - c] / values.sum()] * n, rel=1e-9)
    assert [got[k][1][:2] for k in keys] == [[n, x] for x in deviation]
    errors = {x[4] for y in got.values() for x in y.values()}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_query(spark, sf):
    rows = whitening.op12_whitening(spark, sf).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert rows[0].asDict().keys() == set(names)
    check([tuple(r[x] for x in names) for r in rows], vectors)


def test_odd_rows(spark):
    df = spark.createDataFrame([(*x, "w", 1.5, 1) for x in ODD], "vec_id long, embedding array<double>, whitened string, _v double, `a.b` int")
    model = whitening.fit(df, "embedding", Scratch(spark, "t12"), 2)
    assert (model.n, model.size, len(model.values)) == (7, 3, 2)
    got = sorted((r["vec_id"] or 0, r["_v"], len(r["whitened"]), r["deviation"]) for r in whitening.whiten(df, "embedding", model).collect())
    good = [x for x in ODD if x[0] in (None, 1, 9, 10, 11, 12)]
    _, deviation, _, _ = brute([v for _, v in good])
    assert got == sorted((k or 0, 1.5, 2, d) for (k, _), d in zip(good, deviation, strict=True))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows, tmp_path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.op12_whitening(spark, str(tmp_path)).count() == 0


def test_rank_is_found(spark, tmp_path):
    pick = np.random.default_rng(3)
    few = pick.integers(-9, 9, (40, 3)) @ pick.integers(-4, 4, (3, 8))
    vectors = {i: (x / 64).tolist() for i, x in enumerate(few)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    check([tuple(r) for r in whitening.op12_whitening(spark, str(tmp_path)).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()], vectors)


def test_sums_beyond_doubles_are_exact():
    y = np.array([[2**45, 3], [-(2**45) + 1, 2**40], [5, 7]], np.int64)
    assert whitening.scatter(y).tolist() == [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(2)] for i in range(2)]
    assert whitening.scatter(y[:, 1:] % 1000).tolist() == [[sum(int(r[1] % 1000) ** 2 for r in y)]]
