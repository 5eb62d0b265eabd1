"""Operator 13: periodic runs of words, found and collapsed.

A run is a stretch of words that repeats with its smallest period four times or
more, so each of its words occurs four times in it. Words that occur less often
in a segment can't be in one and split it; that is repeated until nothing
changes, and only the segments that are left are scanned by lags. A run of
period ``q`` holds a multiple of ``q`` from which ``q`` words and some more
repeat, so longer lags are asked at multiples of themselves only, by digests of
as many words as the largest power of two up to ``q``; what is asked for a
segment of ``m`` words grows with ``m log m``. Hits are extended word by word.

Each row is a task's own work: nothing is shuffled, and memory is bounded by
the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import by_bytes, gather

#: Times that a run repeats its period, and words that it has at least.
TIMES, LEAST = 4, 6
#: Lags up to which every word is asked.
_SHORT = 8
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.array([0xD6E8FEB86659FD93], np.uint64)

_RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))


def split_rare(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments within the given ones in which every word occurs ``TIMES`` times or more, in order; shorter ones than ``LEAST`` are left out."""
    done: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    names = int(codes.max()) + 1 if len(codes) else 1
    while True:
        long = end - start >= LEAST
        start, end = start[long], end[long]
        if not len(start):
            break
        n = end - start
        at = gather(start, n)
        order = np.argsort(key := np.repeat(np.arange(len(n)), n) * names + codes[at])
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(first, len(key)))
        rare = np.empty(len(key), bool)
        rare[order] = np.repeat(times < TIMES, times)
        head = np.cumsum(n) - n
        split = np.logical_or.reduceat(rare, head)
        done.append((start[~split], end[~split]))
        keep = ~rare & np.repeat(split, n)
        # Stretches of words that stay, cut where one segment ends and the next begins.
        before = np.concatenate(([False], keep[:-1]))
        before[head] = False
        after = np.concatenate((keep[1:], [False]))
        after[head[1:] - 1] = False
        start, end = at[keep & ~before], at[keep & ~after] + 1
    start, end = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(start)
    return start[order], end[order]


def _stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The places around ``at``, first and behind the last, that equal the ones ``lag`` further on."""
    hi, step = at, 64
    while hi < (top := len(words) - lag):
        upto = min(top, hi + step)
        odd = words[hi:upto] != words[hi + lag : upto + lag]
        if odd.any():
            hi += int(odd.argmax())
            break
        hi, step = upto, 2 * step
    lo, step = at, 64
    while lo > 0:
        down = max(0, lo - step)
        odd = words[down:lo] != words[down + lag : lo + lag]
        if odd.any():
            lo -= int(odd[::-1].argmax())
            break
        lo, step = down, 2 * step
    return lo, hi


def scan_lags(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of one segment, by period and start."""
    m = len(words)
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, min(_SHORT, m // TIMES) + 1):
        same = np.concatenate(([False], words[:-lag] == words[lag:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        lo, hi = edge[::2], edge[1::2] + lag
        for x in np.flatnonzero(hi - lo >= max(LEAST, TIMES * lag)).tolist():
            found.setdefault((int(lo[x]), int(hi[x])), lag)
    if TIMES * _SHORT >= m:
        return [(lo, hi - lo, q) for (lo, hi), q in found.items()]
    inside, behind = np.ones(m, np.int64), np.zeros(m, np.int64)  # period and end of a run that each word is in, the longest of the short lags
    for (lo, hi), q in sorted(found.items(), key=lambda x: x[0][1] - x[0][0]):
        inside[lo:hi], behind[lo:hi] = q, hi
    digest, size = (words.astype(np.uint64) + np.uint64(1)) * _MIX, 1
    digest ^= digest >> np.uint64(29)
    turn = _TURN
    while TIMES * size <= m:
        for lag in range(max(size, _SHORT + 1), min(2 * size, m // TIMES + 1)):
            top = m - lag - size + 1
            hits = np.flatnonzero(digest[:top:lag] == digest[lag : top + lag : lag]) * lag
            if not len(hits):
                continue
            # Both words in a run whose period divides the lag: the stretch around them is that run.
            upto = 0
            for at in hits[(hits + lag >= behind[hits]) | (lag % inside[hits] != 0)].tolist():
                if at < upto:
                    continue
                lo, upto = _stretch(words, at, lag)
                hi = upto + lag
                if upto > lo and hi - lo >= TIMES * lag and (lo, hi) not in found:
                    found[lo, hi] = lag
                    inside[lo:hi], behind[lo:hi] = lag, hi
        if len(digest) <= size:
            break
        digest, size, turn = digest[:-size] * turn + digest[size:], 2 * size, turn * turn
    return [(lo, hi - lo, q) for (lo, hi), q in found.items()]


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """``text, start, length, period`` of all runs, by text, start and period; words are numbers, ``bounds`` says where texts begin and end."""
    rows = []
    start, end = split_rare(codes, bounds[:-1], bounds[1:])
    for lo, hi in zip(start.tolist(), end.tolist(), strict=True):
        rows += [(lo + s, n, q) for s, n, q in scan_lags(codes[lo:hi])]
    s, n, q = np.array(sorted(rows, key=lambda x: (x[0], x[2])), np.int64).reshape(-1, 3).T
    text = np.searchsorted(bounds, s, side="right") - 1
    return text, s - bounds[text], n, q


def kept_words(total: int, bounds: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words no run has behind its first period."""
    edge = np.zeros(total + 1, np.int64)
    first = bounds[text] + start
    np.add.at(edge, first + period, 1)
    np.add.at(edge, first + length, -1)
    return np.cumsum(edge[:-1]) == 0


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts in a row, and where each text's begin and end; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    bounds, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return before[bounds - bounds[0]], flat.filter(some)


def joined(words: pa.Array, at: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of each text its next ``n`` words from those at the places ``at``, with a space between two."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), words.take(pa.array(at)))
    return pc.binary_join(lists, pa.scalar(" ", words.type))


def _per_text(n: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, ``n`` of them for each text."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with two columns more: ``runs``, an array of start, length and period, and ``collapsed``, the text's words without the runs' repeats.

    Rows are worked on each for itself, so ids may be null or repeated and
    equal rows get equal results. A null or empty text, and one without a run,
    has an empty array; its ``collapsed`` is its words joined by one space.
    Long texts are not cut. An empty table stays empty. Columns of ``docs`` named
    ``runs`` or ``collapsed`` are replaced, others come through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column("_text")):
                bounds, words = split_words(batch.column("_text").slice(a, b - a))
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                of, start, length, period = find_runs(codes, bounds)
                keep = kept_words(len(codes), bounds, of, start, length, period)
                structs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                offsets = pa.array(np.searchsorted(of, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(a, b - a), pa.ListArray.from_arrays(offsets, structs), joined(words, np.flatnonzero(keep), _per_text(np.diff(bounds), keep)).cast(pa.string())],
                    names=["_row", "runs", "collapsed"],
                )

    others = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    out = rows.mapInArrow(run, T.StructType().add(rows.schema["_row"]).add("runs", _RUNS).add("collapsed", "string"))
    return out.select("_row.*", "runs", "collapsed")


def _planted(doc_ids: list[int | None], n: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which word stands at each place once a tenth of the documents have a periodic end; a null id has none."""
    at = np.arange(bounds[-1])
    for k, (doc_id, words) in enumerate(zip(doc_ids, n.tolist(), strict=True)):
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if words and h is not None and h % 10 == 0:
            g = h // 10
            a = g % words
            p = 1 + (words - a) // (3 + g % 8)
            at[bounds[k] + a : bounds[k + 1]] = bounds[k] + a + np.arange(words - a) % p
    return at


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's runs and collapsed words, once a tenth of the documents have a periodic end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column("text")):
                doc_id = batch.column("doc_id").slice(a, b - a)
                bounds, words = split_words(batch.column("text").slice(a, b - a))
                at = _planted(doc_id.to_pylist(), np.diff(bounds), bounds)
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[at]
                of, start, length, period = find_runs(codes, bounds)
                keep = kept_words(len(codes), bounds, of, start, length, period)
                texts = joined(words, at[keep], _per_text(np.diff(bounds), keep))
                ends = np.searchsorted(of, np.arange(b - a + 1))
                longest: list[tuple | None] = [None] * (b - a)
                listed = [hashlib.sha256(b"").hexdigest()] * (b - a)
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    runs = list(zip(*(x[ends[k] : ends[k + 1]].tolist() for x in (start, length, period)), strict=True))
                    listed[k] = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
                    longest[k] = min(runs, key=lambda x: (-x[1], x[0], x[2]))
                each = [[x and x[i] for x in longest] for i in range(3)]
                collapsed = [hashlib.sha256(x).hexdigest() for x in texts.cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(np.diff(ends)), *(pa.array(x, pa.int64()) for x in each), pa.array([x and 1000 * x[1] // x[2] for x in longest], pa.int64()), pa.array(listed), pa.array(collapsed)],
                    names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
                )

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
