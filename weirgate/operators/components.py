"""Connected components of links between ids of any type that has an order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared


def _kept(df: DataFrame, name: str) -> DataFrame:
    return shared.keep(df)


def components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = _kept) -> DataFrame:
    """``node, label``: each end of ``links(a, b)`` with the smallest id reachable from it.

    A turn gives every node a random number, sends it to the one with the
    smallest among itself and its neighbours, and makes the links between
    nodes those between the ones they were sent to. Every other turn the numbers
    are new; with them at least a quarter of the nodes is expected to go,
    whatever the shape of the graph, so turns grow with the logarithm of the
    largest component and the work is that of the first few. The turn between
    ends stars, whose middle the first one gives the smallest number. Then each node's ways are followed from the last
    turn back to the first. ``keep(df, name)`` cuts the lineage of a table;
    Spark's checkpoint does where none is given.

    A link with a null end is left out, one of an id with itself makes it a
    node. No links give no rows.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    now = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links-0")
    loops = now.where("a = b").select(F.col("a").alias("node"))
    now = now.where("a < b")
    ways: list[DataFrame] = []
    while not now.isEmpty():
        turn = len(ways)
        number = lambda c: F.xxhash64(F.lit(turn // 2), F.col(c))  # noqa: B023, E731
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", number("b")).alias("_near"), F.min(number("b")).alias("_least"))
        way = keep(near.select("node", F.when(number("node") <= F.col("_least"), F.col("node")).otherwise(F.col("_near")).alias("to")), f"ways-{turn}")
        ways.append(way)
        moved = now
        for side in "ab":
            moved = moved.join(way.select(F.col("node").alias(side), F.col("to").alias(f"_{side}")), side)
        moved = moved.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        now = keep(moved, f"links-{turn + 1}")
    if not ways:
        return loops.select("node", F.col("node").alias("label"))
    ends = ways[-1].select("node", F.col("to").alias("end"))
    for turn in range(len(ways) - 2, -1, -1):
        further = ends.select(F.col("node").alias("to"), F.col("end").alias("_end"))
        ends = keep(ways[turn].join(further, "to", "left").select("node", F.coalesce("_end", "to").alias("end")), f"ends-{turn}")
    names = ends.groupBy("end").agg(F.min("node").alias("label"))
    named = ends.join(names, "end").select("node", "label")
    return named.unionByName(loops.join(ends.select("node"), "node", "left_anti").select("node", F.col("node").alias("label")))
