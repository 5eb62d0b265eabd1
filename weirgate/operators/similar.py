"""Pairs of texts with similar sets of word shingles, by an exact prefix filter on packed sets.

Tasks cut texts into shingles and keep a 64-bit key of each; no shingle's text
goes through a shuffle. Sets that are equal, by a 128-bit digest of their texts,
are one class, found in a first pass that keeps digests alone. In a second one
texts meet the classes they stand for by their ids, and each class deals its
keys over buckets, packed with those of its neighbours. The task of a bucket
counts keys and gives back only those that several classes have, which are put
in order by how many have them. The others come first in every order and make
no pair, so sets are also confirmed on what they share with any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared

#: Words of a shingle, and the similarity from which two texts match.
SHINGLE, THRESHOLD = 5, 0.75
#: Keeps rounding from making a bound on counts of shingles too strict.
_SLACK = 1e-6
#: Sets with a common shingle that one part of them holds; each part is compared with all of them apart.
_PART = 1024
#: Keys that a bucket is to hold, and keys that a task deals out at once.
_BUCKET, _DEALT = 1 << 19, 1 << 21


def shingles(text: bytes, n: int) -> list[bytes]:
    """Distinct ``n``-word shingles in order; fewer words are one shingle, no words none."""
    words = text.split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return sorted({b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})


def _texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, text`` in lower case, of rows with both."""
    return df.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def _digest(grams: list[bytes]) -> bytes:
    return hashlib.blake2b(b"\x1e".join(grams), digest_size=16).digest()


def text_classes(texts: DataFrame) -> DataFrame:
    """``id, class, size``: of each of ``texts(id, text)`` that has words, a digest of its set of shingles and how many there are. Rows that share an id have one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, classes, sizes = [], [], []
            for k, body in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                if grams := shingles(body, SHINGLE):
                    kept.append(k)
                    classes.append(_digest(grams))
                    sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept, pa.int32())), pa.array(classes, pa.binary()), pa.array(sizes, pa.int32())], names=["id", "class", "size"])

    # A file of one row group is one task; the work on each text is heavy.
    cores = texts.sparkSession.sparkContext.defaultParallelism
    spread = texts if len(texts.inputFiles()) >= cores else texts.repartition(cores)
    return spread.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, class binary, size int")


def _members(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``x, y``: each further id of a class with its representative."""
    return rows.select("class", F.col("id").alias("y")).join(sets.select("class", F.col("id").alias("x")), "class").where("x < y").select("x", "y").distinct()


def _planes(x: np.ndarray) -> bytes:
    """Numbers, first the low bytes of all; the high ones are alike and take little room in a shuffle."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(data: bytes, n: int, at: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, size * n, at).reshape(size, n).T.copy().view(kind).ravel()


def _deal(texts: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """A row with number, class, id and size for each class of ``rows``, and rows of packed keys: of each key the set's number above the row's ``num``, and its place in the set."""
    kind = texts.schema["id"].dataType.simpleString()
    names = ["bucket", "num", "class", "id", "size", "data"]

    def packed(number: int, classes: list[bytes], ids: pa.Array, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        size, keys = np.fromiter(map(len, sets), np.int64, len(sets)), np.concatenate(sets)
        bucket = (keys % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        of = np.repeat(np.arange(len(sets), dtype="<i4"), size)[order]
        at = (np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)).astype("<i4")[order]
        keys, bucket = keys[order] // np.uint64(buckets), bucket[order]
        head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        data = [_planes(keys[x:y]) + _planes(of[x:y]) + _planes(at[x:y]) for x, y in zip(head.tolist(), [*head[1:].tolist(), len(keys)], strict=True)]
        nums, n, few = number + np.arange(len(sets)), len(sets), len(data)
        yield pa.RecordBatch.from_arrays([pa.array((nums % buckets).astype(np.int32)), pa.array(nums), pa.array(classes, pa.binary()), ids, pa.array(size.astype(np.int32)), pa.nulls(n, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[head]), pa.array(np.full(few, number)), pa.nulls(few, pa.binary()), pa.nulls(few, ids.type), pa.nulls(few, pa.int32()), pa.array(data, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, left = TaskContext.get().partitionId() << 33, None, set()
        for batch in batches:
            kept, classes, sets, n_keys = [], [], [], 0
            ids = batch.column("id")
            for k, (i, name, body) in enumerate(zip(ids.to_pylist(), batch.column("class").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)):
                if i != at:
                    at, left = i, set()
                if name is not None:
                    left.add(name)
                elif left and (grams := shingles(body, SHINGLE)) and (name := _digest(grams)) in left:
                    # Of rows with the same id and set, one.
                    left.remove(name)
                    kept.append(k)
                    classes.append(name)
                    sets.append(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams)))
                    n_keys += len(grams)
                if kept and (n_keys >= _DEALT or k == batch.num_rows - 1):
                    yield from packed(number, classes, ids.take(pa.array(kept)), sets)
                    number += len(kept)
                    kept, classes, sets, n_keys = [], [], [], 0

    representatives = rows.groupBy("class").agg(F.min("id").alias("id")).select("id", "class", F.lit(None).cast("string").alias("text"))
    both = texts.select("id", F.lit(None).cast("binary").alias("class"), "text").unionByName(representatives)
    # Classes first; in a fixed order, so that a task that runs again gives the same numbers.
    both = both.repartition("id").sortWithinPartitions("id", F.col("class").desc_nulls_last(), "text")
    return both.mapInArrow(run, f"bucket int, num bigint, class binary, id {kind}, size int, data binary")


def _in_common(dealt: DataFrame, buckets: int) -> DataFrame:
    """The sets' rows of ``_deal`` as they are, and rows of set, key, how many sets have it and its place, of keys that several have."""
    kind = dealt.schema["id"].dataType.simpleString()
    names = ["num", "class", "id", "size", "g", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, rest_of, packed, ids = [], [], [], pa.null()
        for batch in batches:
            none = pc.is_null(batch.column("data"))
            sets, rest, ids = batch.filter(none), batch.filter(pc.invert(none)), batch.column("id").type
            bases += rest.column("num").to_pylist()
            rest_of += rest.column("bucket").to_pylist()
            packed += rest.column("data").to_pylist()
            if sets.num_rows:
                yield pa.RecordBatch.from_arrays([*(sets.column(x) for x in names[:4]), pa.nulls(sets.num_rows, pa.int64()), *[pa.nulls(sets.num_rows, pa.int32())] * 2], names=names)
        if not packed:
            return
        many = [len(x) // 16 for x in packed]
        keys = np.concatenate([_from_planes(x, m, 0, "<u8") * np.uint64(buckets) + np.uint64(k) for k, x, m in zip(rest_of, packed, many, strict=True)])
        order = np.argsort(keys)
        keys = keys[order]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.append(head, len(keys)))
        several = np.repeat(n > 1, n)
        order, keys, n = order[several], keys[several], np.repeat(n, n)[several].astype(np.int32)
        num = np.concatenate([base + _from_planes(x, m, 8 * m, "<i4").astype(np.int64) for base, x, m in zip(bases, packed, many, strict=True)])[order]
        at = np.concatenate([_from_planes(x, m, 12 * m, "<i4") for x, m in zip(packed, many, strict=True)])[order]
        for a in range(0, len(keys), 100_000):
            some = [pa.array(x[a : a + 100_000]) for x in (num, keys.view(np.int64), n, at)]
            k = len(some[0])
            yield pa.RecordBatch.from_arrays([some[0], pa.nulls(k, pa.binary()), pa.nulls(k, ids), pa.nulls(k, pa.int32()), *some[1:]], names=names)

    return dealt.repartition(buckets, "bucket").mapInArrow(run, f"num bigint, class binary, id {kind}, size int, g bigint, n int, at int")


def ordered_sets(texts: DataFrame, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``num, class, id, size, s, n``: a row for each class of ``texts(id, text)`` and their ``text_classes``, with the keys that other classes have too.

    Keys are in order of how many classes have them; ``n`` says it of those among
    the first that a similar set must share one of. Keys that no other class has
    stand before them.
    """
    keys = rows.agg(F.sum("size")).first()[0] or 0
    buckets = -(-keys // _BUCKET) or 1
    found = _in_common(_deal(texts, rows, buckets), buckets).repartition("num")
    once = [F.first(c, ignorenulls=True).alias(c) for c in ("class", "id", "size")]
    ordered = found.groupBy("num").agg(*once, F.array_sort(F.collect_list(F.when(F.col("g").isNotNull(), F.struct("n", "at", "g")))).alias("v"))
    # Of the prefix what is left behind the keys that stand alone.
    first = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - _SLACK).cast("int") + 1
    asked = F.greatest(first - (F.col("size") - F.size("v")), F.lit(0))
    return ordered.select("num", "class", "id", "size", F.col("v.g").alias("s"), F.slice("v.n", F.lit(1), asked).alias("n"))


def class_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b``: numbers of classes of ``ordered_sets`` that may reach the threshold, each pair once, in no order.

    Sets are ordered from the rarest shingle on; two that reach the threshold
    share a shingle of their first ones, so many that the rest alone is too
    few, and from the first shared one on both still hold as many as they must
    have in common. The smaller of two sets then holds as many as two sets of
    its size need; the larger is in one part of those with a hot shingle.
    """
    prefix = F.arrays_zip(F.slice("s", F.lit(1), F.size("n")).alias("g"), F.col("n"))
    rare = sets.where(F.size("n") > 0).select(F.col("num").alias("c"), "size", F.size("s").alias("shared"), F.posexplode(prefix).alias("place", "v"))
    parts = F.ceil(F.col("v.n") / _PART).cast("int")
    rare = rare.select(F.col("v.g").alias("g"), "c", "size", (F.col("shared") - F.col("place")).alias("left"), parts.alias("parts"))
    share = threshold / (1 + threshold)
    smaller = rare.where(F.col("left") >= F.lit(2 * share) * F.col("size") - _SLACK).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    larger = rare.select("g", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"), F.col("c").alias("_c"), F.col("size").alias("_size"), F.col("left").alias("_left"))
    in_order = (F.col("size") < F.col("_size")) | ((F.col("size") == F.col("_size")) & (F.col("c") < F.col("_c")))
    common = F.lit(share) * (F.col("size") + F.col("_size")) - _SLACK
    return smaller.join(larger, ["g", "part"]).where(in_order & (F.least("left", "_left") >= common)).select(F.col("c").alias("a"), F.col("_c").alias("b")).distinct()


def _named(pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    """``x, y`` with ``x < y``, the representatives of ``pairs(a, b)``; classes that one id stands for make no pair."""
    for side, name in zip("ab", "xy", strict=True):
        pairs = pairs.join(sets.select(F.col("num").alias(side), F.col("id").alias(f"_{name}"), *(F.col(c).alias(f"{c}_{side}") for c in more)), side)
    return pairs.where("_x <> _y").withColumns({"x": F.least("_x", "_y"), "y": F.greatest("_x", "_y")})


def match_candidates(df: DataFrame, id_col: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``x, y`` with ``x < y``: all pairs that may reach the threshold.

    Equal shingle sets are one class. Its smallest id stands for it in pairs
    with other classes, and each other id is paired with that one. Rows without
    an id, null texts and texts without words are in no pair. Rows that share an
    id are texts of their own; what links them is the id, so pairs of one id
    with itself are left out. No rows give no pairs, and other columns are not
    read.
    """
    texts = _texts(df, id_col, text)
    rows = shared.keep(text_classes(texts))
    sets = shared.keep(ordered_sets(texts, rows, threshold))
    return _named(class_pairs(sets, threshold), sets).select("x", "y").unionByName(_members(rows, sets)).distinct()


def match_pairs(df: DataFrame, id_col: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``x, y, jaccard``: ``match_candidates`` confirmed on full sets; of several rows with the same two ids, the best."""
    texts = _texts(df, id_col, text)
    rows = shared.keep(text_classes(texts))
    sets = shared.keep(ordered_sets(texts, rows, threshold))
    pairs = _named(class_pairs(sets, threshold), sets, "size", "s")
    common = F.size(F.array_intersect("s_a", "s_b"))
    scored = pairs.select("x", "y", (common / (F.col("size_a") + F.col("size_b") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return scored.unionByName(_members(rows, sets).withColumn("jaccard", F.lit(1.0))).groupBy("x", "y").agg(F.max("jaccard").alias("jaccard"))
