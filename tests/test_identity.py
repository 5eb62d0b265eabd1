"""Similar records against brute force."""

import random

import pytest

from weirgate.operators import identity as I
from weirgate.operators import similar


def brute_sets(rows):
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    return {i: s for i, s in sets.items() if s}


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(7)
    rows = [(1, "Yes"), (2, "yes"), (3, "a b"), (4, "A  b"), (5, "a c"), (6, ""), (7, " "), (8, "a b c"), (9, "a b c d e"), (10, "A b c  d e")]
    for k in range(12):
        base = [f"w{pick.randrange(60)}" for _ in range(pick.choice([4, 12, 40, 90]))]
        for m in range(6):
            made = list(base)
            for _ in range(m):
                made[pick.randrange(len(made))] = f"n{pick.randrange(999)}"
            rows.append((100 * k + 100 + m, " ".join(made)))
    return rows


@pytest.mark.parametrize(("threshold", "part"), [(0.5, 1024), (0.75, 1024), (0.8, 1024), (0.9, 1024), (0.5, 2), (0.75, 3)])
def test_pairs_and_clusters(spark, rows, threshold, part, monkeypatch):
    monkeypatch.setattr(similar, "_PART", part)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = brute_sets(rows)
    by_set: dict = {}
    for i in sorted(sets):
        by_set.setdefault(sets[i], i)
    links = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x in by_set.values() for y in by_set.values() if x < y}
    want = {k: j for k, j in links.items() if j >= threshold} | {(by_set[s], i): 1.0 for i, s in sets.items() if by_set[s] != i}
    pairs = I.match_pairs(df, "doc_id", "text", threshold).persist()
    assert {(r["x"], r["y"]): r["jaccard"] for r in pairs.collect()} == pytest.approx(want)
    label = {i: i for i in sets}
    for _ in sets:
        for x, y in want:
            label[x] = label[y] = min(label[x], label[y])
    linked = {i for pair in want for i in pair}
    assert {r["id"]: r["cluster_id"] for r in I.clusters(pairs).collect()} == {i: label[i] for i in linked}


@pytest.mark.parametrize(("bucket", "dealt"), [(100, 1 << 21), (300, 64)])
def test_pairs_over_buckets(spark, rows, bucket, dealt, monkeypatch):
    """Many buckets, and few keys dealt at once, give what one bucket gives."""
    df = spark.createDataFrame([*rows, *rows[:20], (None, rows[30][1])], "doc_id long, text string")
    want = {tuple(r) for r in I.match_pairs(df, "doc_id", "text").collect()}
    monkeypatch.setattr(similar, "_BUCKET", bucket)
    monkeypatch.setattr(similar, "_DEALT", dealt)
    assert {tuple(r) for r in I.match_pairs(df, "doc_id", "text").collect()} == want and len(want) > 15


def test_shuffled_bytes(spark):
    """Shingles that one text has go through one shuffle, packed."""
    def shuffled(n):
        pick = random.Random(n)
        df = spark.createDataFrame([(i, " ".join(f"w{pick.randrange(10**6)}" for _ in range(1000))) for i in range(n)], "id long, text string")
        store, context = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
        stages = lambda: store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        total = lambda: sum(s.apply(k).shuffleWriteBytes() for s in [stages()] for k in range(s.size()))
        before = total()
        assert I.match_pairs(df, "id", "text").count() == 0
        return total() - before

    small, large = shuffled(300), shuffled(600)
    assert large < 2.2 * small and large < 25 * 600 * 996, (small, large)


def test_null_and_repeated_ids(spark):
    """Rows of one id are texts of their own; the best of their pairs counts, and none is an id with itself."""
    a, b, c = ("a b c d e f g h i j", "a b c d e f g h i k", "p q r s t u v w x y")
    rows = [(1, a), (1, b), (2, b), (None, a), (3, None), (4, " "), (2, c), (5, c.upper()), (5, c), (None, None), (6, "a b c d e f g h i j l")]
    df = spark.createDataFrame(rows, "id long, text string")
    texts = [(i, s) for i, t in rows if i and (s := brute_sets([(0, t or "")]).get(0))]
    best: dict = {}
    for i, s in texts:
        for j, t in texts:
            if i < j and (score := len(s & t) / len(s | t)) >= 0.75:
                best[i, j] = max(best.get((i, j), 0), score)
    got = {(r["x"], r["y"]): r["jaccard"] for r in I.match_pairs(df, "id", "text").collect()}
    assert got == pytest.approx({(1, 2): 1.0, (2, 5): 1.0, (1, 6): 6 / 7})
    assert set(got) <= set(best) and all(got[k] == pytest.approx(best[k]) for k in got)
    label = {r["id"]: r["cluster_id"] for r in I.clusters(I.match_pairs(df, "id", "text")).collect()}
    assert label == {1: 1, 2: 1, 5: 1, 6: 1} and {x for k in best for x in k} == set(label)
    assert I.match_candidates(df.limit(0), "id", "text").count() == I.match_pairs(df.where("id IS NULL"), "id", "text").count() == 0
    named = I.match_pairs(df.selectExpr("concat('k', id) AS id", "text"), "id", "text")
    assert {(r["x"], r["y"]) for r in named.collect()} == {("k1", "k2"), ("k2", "k5"), ("k1", "k6")}


def test_candidates_of_changed_copies(spark):
    """Copies with so many changed words that none is similar: few of all pairs are candidates."""
    pick, n = random.Random(1), 200
    rows = []
    for i in range(n):
        words = [f"p{k}" for k in range(204)]
        for k in pick.sample(range(204), 7):
            words[k] = f"r{i}x{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, text string")
    assert I.match_candidates(df, "id", "text").count() * 20 < n * (n - 1) // 2
    assert I.match_pairs(df, "id", "text").count() == 0
