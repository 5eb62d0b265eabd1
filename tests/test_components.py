"""Components against a plain union of sets."""

import random

import pytest

from weirgate.operators import identity as I
from weirgate.operators.components import components


def brute(links):
    label = {x: x for link in links for x in link}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("kind", ["chain", "bad chain", "random chain"])
def test_turns_of_chains(spark, kind):
    n = 1024
    path = {"chain": range(n), "bad chain": [0, *range(n - 1, 0, -1)], "random chain": random.Random(1).sample(range(n), n)}[kind]
    path, made = list(path), []

    def keep(df, name):
        made.append(name)
        return df.checkpoint()

    got = components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long"), keep)
    assert {r["node"]: r["label"] for r in got.collect()} == dict.fromkeys(range(n), 0)
    assert sum(x.startswith("ways") for x in made) < 16


def test_turns_of_a_star(spark):
    made = []

    def keep(df, name):
        made.append(name)
        return df.checkpoint()

    links = [(5_000, x) for x in range(3_000)] + [(9_000, x) for x in range(2_990, 3_100)]
    got = components(spark.createDataFrame(links, "a long, b long"), keep)
    assert {r["label"] for r in got.collect()} == {0} and got.count() == 3_102
    assert sum(x.startswith("ways") for x in made) <= 4


def test_odd_links(spark):
    pick = random.Random(2)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(150)]
    links += [(500, x) for x in range(501, 700)] + links[:20] + [(b, a) for a, b in links[:20]] + [(800, 800), (3, 3)]
    df = spark.createDataFrame([*links, (None, 4), (900, None), (None, None)], "a long, b long")
    got = [(r["node"], r["label"]) for r in components(df).collect()]
    assert sorted(got) == sorted(brute(links).items())
    assert I.clusters(df.selectExpr("b AS y", "a AS x")).count() == len(got)
    assert components(df.limit(0)).count() == 0


def test_text_ids(spark):
    links = [("b", "a"), ("ö", "b"), ("x", "y")]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "ö": "a", "x": "x", "y": "x"}
