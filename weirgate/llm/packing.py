"""Operator 4: documents packed into sequences of a fixed number of tokens.

Lengths are whole numbers up to the capacity, so a histogram of them holds all
that matters, at any number of documents. The plan is made on the histogram:
pieces above a third of the capacity are matched greedily, two to a sequence
at most; shorter ones then go, longest first, where the gap fits best. The
plan says for each length which sequence and place the first, second, ... piece
of that length gets; ranks of pieces within their length then find their place.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .tokens import encoder, gather, give_back, id_lists, list_crcs, per_batch, vocabulary_path

CAPACITY, END_ID = 2048, 0

_PIECES = "doc_id bigint, piece int, start bigint, length int, block int, nth bigint, ids array<int>"


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go: ``(length, first_rank, count, first_sequence, offset)``.

    The ``count`` pieces of a length from ``first_rank`` on go to as many
    sequences from ``first_sequence`` on, each at ``offset``. ``counts`` maps
    each length, from 1 to ``capacity``, to its number of pieces. Time and
    memory depend on the number of lengths, not on that of pieces.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap: (first sequence, number of them, tokens in them)
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    def leave(first: int, n: int, offset: int) -> None:
        if n and offset < capacity:
            gaps.setdefault(capacity - offset, []).append((first, n, offset))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        if a == b and not n:
            b = large[at - 1] if at else None
            n = 1
        put(a, n, sequences, 0)
        if b is None:
            leave(sequences, n, a)
        else:
            put(b, n, sequences, a)
            leave(sequences, n, a + b)
        sequences += n
        large = [k for k in large if left[k]]

    order = sorted(gaps)
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(order, s)
            if at == len(order):  # no gap: open sequences, as full of this length as they get
                each = capacity // s
                n = max(1, left[s] // each)
                first, offset, gap = sequences, 0, capacity
                sequences += n
            else:
                gap = order[at]
                first, n, offset = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                for k in range(each):
                    put(s, full, first, offset + k * s)
            new = [(first, full, offset + each * s)]
            if full < n:
                some = left[s]  # too few to fill one more
                for k in range(some):
                    put(s, 1, first + full, offset + k * s)
                new += [(first + full, 1, offset + some * s), (first + full + 1, n - full - 1, offset)]
            for x in new:
                gap = capacity - x[2]
                if x[1] and gap:
                    if gap not in gaps:
                        insort(order, gap)
                    gaps.setdefault(gap, []).append(x)
    return rows


def cut(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Pieces of the ids of each text of ``docs(doc_id, text)``, with an end id to each document.

    Null texts count as empty and give the end id alone. Only documents longer
    than ``capacity`` are cut, so that all pieces but the first are full.
    Repeated rows are cut each, an empty table gives no rows, and other columns
    are not read.
    ``block`` and ``nth`` name the task and the place of a piece among the
    task's pieces of its length; the result must be written before use.
    """
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            give_back()
            for first, upto, ids, n in encoder(vocabulary).encode(batch.column("text"), end_id):
                pieces = -(-n // capacity)
                at = np.repeat(np.arange(len(n)), pieces)
                piece = gather(np.zeros(len(n), dtype=np.int64), pieces)
                head = n[at] - (pieces[at] - 1) * capacity  # length of the first piece
                length = np.where(piece == 0, head, capacity)
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                places = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(length), dtype=np.int64)
                nth[order] = gather(seen, places)
                seen += places
                doc_id = batch.column("doc_id").slice(first, upto - first).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(np.full(len(length), block, np.int32)), pa.array(nth), id_lists(ids, length)],
                    names=["doc_id", "piece", "start", "length", "block", "nth", "ids"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def place(rows: DataFrame, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` of written ``pieces`` with ``sequence_id`` and ``offset`` in place of ``block`` and ``nth``.

    The driver sees one count for each length, ``capacity`` of them at most; the
    plan made of them, some ten thousand rows for a capacity of 2048 and any
    number of pieces, is what tasks get. Rows are joined only with the numbers of
    pieces of a length in the tasks before.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("block", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("_before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = np.array(sorted(plan_sequences(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast((plan[:, 0], plan[:, 1], plan[:, 3], plan[:, 4], np.searchsorted(plan[:, 0], np.arange(capacity + 2))))
    kept = [c for c in rows.columns if c not in ("block", "nth")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, first_rank, sequence, offset, of_length = sent.value
        length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
        at = np.empty(len(rank), dtype=np.int64)
        for n in np.unique(length):
            mine = length == n
            lo, hi = of_length[n], of_length[n + 1]
            at[mine] = lo + np.searchsorted(first_rank[lo:hi], rank[mine], side="right") - 1
        return pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(sequence[at] + rank - first_rank[at]), pa.array(offset[at])], names=[*kept, "sequence_id", "offset"])

    ranked = rows.join(before, ["block", "length"]).select(*kept, (F.col("_before") + F.col("nth")).alias("_rank"))
    schema = T.StructType([rows.schema[c] for c in kept]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(per_batch(run), schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` for each piece of ``docs(doc_id, text)``.

    Repeated documents are packed as often as they occur. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(cut(docs, capacity, end_id, vocabulary), "pieces")
    return place(pieces, pieces, capacity).select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, from ``pack``."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return parts.select("sequence_id", F.flatten(F.col("_parts.ids")).alias("ids"))


def packed_digests(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """The pieces and their places, with a checksum in place of the ids."""
    pieces = scratch.write(cut(docs, capacity), "pieces")

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = ["doc_id", "piece", "start", "length", "block", "nth"]
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(list_crcs(batch.column("ids")))], names=[*names, "ids_crc32"])

    crcs = pieces.mapInArrow(per_batch(digest), "doc_id bigint, piece int, start bigint, length int, block int, nth bigint, ids_crc32 bigint")
    return place(crcs, pieces, capacity).select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op4"))
