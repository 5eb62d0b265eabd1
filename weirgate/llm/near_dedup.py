"""Operator 2: near duplicates by SetSketch registers.

A document's set is that of its 5-word shingles. Each of 128 registers holds,
on an exponential scale, the smallest value of one hash function over the set;
registers of a union are the larger ones of its parts. Documents that agree in
the four registers of a band share a bucket. Pairs from buckets are estimated
from all registers by maximum likelihood, then confirmed on the full sets.

Equal sets are one class first. Within a bucket members are paired with a hub,
not with each other; links merge labels, and only buckets with several labels
go on. Small ones pair members of different labels. Members of large ones, as a
frequent passage makes them, get new buckets: the rarest shingles of each set,
as many as a linked pair cannot all differ in. Pairs are sought from the smaller
set, whose own part of these shingles is shorter still, and members of a hot
bucket are dealt over parts, so no task compares all of them. No bucket is cut
short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .scratch import Scratch, whole_rows
from .tokens import per_batch, utf8, words

SHINGLE, PERCENT = 5, 75
REGISTERS, BAND, BASE, RATE = 128, 4, 1.02, 20.0
#: Pairs whose estimated similarity is lower are not confirmed; about four standard deviations below 0.75.
ESTIMATE_FROM = 0.6
#: Buckets up to this size pair all members of different labels.
SMALL = 32
#: Members of a bucket that one part of it holds; each part is compared with the whole bucket apart.
PART = 1024
#: Counters by which shingles of large buckets' members are ordered from rare to frequent, and blocks in which tasks' counts are added up.
COUNTERS, COUNTER_BLOCKS = 65_536, 64
#: Distinct words whose hash a worker keeps.
CACHE_WORDS = 100_000

_word_hashes: dict[bytes, int] = {}
_rng = np.random.default_rng(20_240_229)
_PLACES = (_rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_FACTORS = (_rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(found: list[bytes]) -> np.ndarray:
    known = _word_hashes
    new = set(found).difference(known)
    if new:
        if len(known) > CACHE_WORDS:
            known.clear()
            new = set(found)
        known.update((w, int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")) for w in new)
    return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles; of all its words if there are fewer; none without words."""
    h = _hash_words(words(text))
    n = len(h)
    if not n:
        return h
    if n < SHINGLE:
        total = np.array([n], dtype=np.uint64)
        for i in range(n):
            total = total + h[i : i + 1] * _PLACES[i]
        return _mix(total)
    total = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
    for i in range(SHINGLE):
        total += h[i : n - SHINGLE + 1 + i] * _PLACES[i]
    return np.unique(_mix(total))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set that isn't empty."""
    low = np.empty((REGISTERS, len(sets)), dtype=np.uint32)
    done = 0
    while done < len(sets):  # about 100,000 shingles at a time
        upto, size = done, 0
        while upto < len(sets) and (upto == done or size + len(sets[upto]) <= 100_000):
            size += len(sets[upto])
            upto += 1
        x = (np.concatenate(sets[done:upto]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[done : upto - 1])])
        for j in range(REGISTERS):
            low[j, done:upto] = np.minimum.reduceat(x * _FACTORS[j] + _SHIFTS[j], starts)
        done = upto
    value = -np.log1p(-(low.T + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65_535).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of pairs from their registers and set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    # A set cannot be more similar to another than the smaller size over the larger.
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p_more, p_less = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(k[:, None] > 0, k[:, None] * np.log(np.maximum(q, 1e-12)), 0) for k, q in ((more, p_more), (less, p_less), (same, 1 - p_more - p_less))]
    return j[np.arange(len(j)), np.argmax(sum(parts), axis=1)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(x) for x in utf8(batch.column("text"))]
        full = [s for s in sets if len(s)]
        regs = iter(registers(full)) if full else iter(())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "n", "class", "regs"],
        )


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


#: Members of buckets; ``left``: how many shingles of the set come at or after the one that makes the bucket.
_BUCKETS = "bucket bigint, id bigint, n bigint, left bigint"


@per_batch
def _bands(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys = _regs(batch.column("regs")).view("<u8").astype(np.uint64)
    keys = _mix(_mix(keys) + np.arange(keys.shape[1], dtype=np.uint64))
    at = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
    n = batch.column("n").take(at)
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column("id").take(at), n, n], names=["bucket", "id", "n", "left"])


def _slots(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(13)).astype(np.int64) % COUNTERS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts, in blocks."""
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for x in batch.column("set").to_pylist():
            total += np.bincount(_slots(np.frombuffer(x, "<u8")), minlength=COUNTERS)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_BLOCKS), pa.int32()), pa.array([x.tobytes() for x in total.reshape(COUNTER_BLOCKS, -1)], pa.binary())], names=["block", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all tasks' blocks of counts."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, x in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(x, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def _rarest(order):
    """The rarest shingles of each set, as buckets.

    A pair with a similarity of 0.75 shares three quarters of either set or
    more, so it shares one of the first quarter and one more of each, in any
    order that holds for all sets.
    """

    @per_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, at, left = [], [], []
        for i, x in enumerate(batch.column("set").to_pylist()):
            x = np.frombuffer(x, "<u8")
            first = np.lexsort((x, order.value[_slots(x)]))[: len(x) - -(-len(x) * PERCENT // 100) + 1]
            found.append(x[first])
            at.append(np.full(len(first), i))
            left.append(len(x) - np.arange(len(first)))
        at = pa.array(np.concatenate(at))
        n = pa.array([len(x) // 8 for x in batch.column("set").to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), batch.column("id").take(at), n.take(at), pa.array(np.concatenate(left))], names=["bucket", "id", "n", "left"])

    return run


@per_batch
def _likely(batch: pa.RecordBatch) -> pa.RecordBatch:
    j = estimate(_regs(batch.column("regs_a")), _regs(batch.column("regs_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
    keep = pa.array(np.flatnonzero(j >= ESTIMATE_FROM))
    return pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])


@per_batch
def _linked(batch: pa.RecordBatch) -> pa.RecordBatch:
    keep = []
    for i, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        common = len(x) + len(y) - len(np.union1d(x, y))
        if 100 * common >= PERCENT * (len(x) + len(y) - common):
            keep.append(i)
    keep = pa.array(keep, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])


@per_batch
def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingles(x).astype("<u8").tobytes() for x in utf8(batch.column("text"))], pa.binary())], names=["id", "set"])


class _Matcher:
    """The state of one run: sketches and sets of class representatives, links so far, labels by them."""

    def __init__(self, docs: DataFrame, reps: DataFrame, scratch: Scratch):
        self.docs, self.reps, self.scratch = docs, reps, scratch
        self.steps, self.by_shingle = 0, False
        self.labels: DataFrame | None = None
        self.sets: DataFrame | None = None

    def name(self, what: str) -> str:
        self.steps += 1
        return f"{self.steps}-{what}"

    def components(self, links: DataFrame) -> DataFrame:
        """``node, label`` of ``links(a, b)``; turns and the result are written tables."""
        name = self.name("labels")
        found = components(links, lambda df, turn: self.scratch.write(df, f"{name}-{turn}"))
        return self.scratch.write(found, name)

    def several(self, rows: DataFrame) -> DataFrame:
        """The rows of buckets that have several ids, as a written table."""
        shared = rows.groupBy("bucket").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo < _hi").select("bucket")
        return self.scratch.write(rows.join(shared, "bucket"), self.name("buckets"))

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("label", F.col("id"))
        return rows.join(self.labels.withColumnRenamed("label", "_l"), F.col("id") == F.col("node"), "left").select("bucket", "id", "n", "left", F.coalesce("_l", "id").alias("label"))

    def mixed(self, rows: DataFrame, seed: int) -> DataFrame:
        """Buckets of several labels, each with a hub chosen by a hash, as a written table."""
        hub = F.min(F.struct(F.xxhash64("id", F.lit(seed)), "id", "n", "left", "label"))
        found = rows.groupBy("bucket").agg(hub.alias("_h"), F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_size")).where("_lo < _hi")
        return self.scratch.write(found.select("bucket", "_size", F.col("_h.id").alias("_id"), F.col("_h.n").alias("_n"), F.col("_h.left").alias("_left"), F.col("_h.label").alias("_label")), self.name("mixed"))

    @staticmethod
    def may_link():
        """What sizes, and places of the shared shingle, allow: as many shingles in common as a link needs."""
        return (100 + PERCENT) * F.least("left", "_left") >= PERCENT * (F.col("n") + F.col("_n"))

    def confirm(self, pairs: DataFrame) -> None:
        """Estimate and confirm ``pairs(a, b)``; add the links to the labels.

        Pairs that share a rare shingle are few and mostly close to a link, so they are not estimated.
        """
        if not self.by_shingle:
            sketches = self.reps.select("id", "n", "regs")
            for side in "ab":
                pairs = pairs.join(sketches.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("regs").alias(f"regs_{side}")), side)
            pairs = self.scratch.write(pairs.mapInArrow(_likely, "a bigint, b bigint"), self.name("likely"))
            if pairs.isEmpty():
                return
        for side in "ab":
            pairs = pairs.join(self.sets.select(F.col("id").alias(side), F.col("set").alias(f"set_{side}")), side)
        links = self.scratch.write(pairs.mapInArrow(_linked, "a bigint, b bigint"), self.name("links"))
        if links.isEmpty():
            return
        if self.labels is None:
            self.labels = self.components(links)
            return
        for side in "ab":
            links = links.join(self.labels.select(F.col("node").alias(side), F.col("label").alias(f"l_{side}")), side, "left")
        merged = links.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")).where("a <> b")
        moved = self.components(merged)
        both = self.labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("_new")), "label", "left").select("node", F.coalesce("_new", "label").alias("label"))
        new = moved.join(self.labels.select("node"), "node", "left_anti").select("node", "label")
        self.labels = self.scratch.write(both.unionByName(new), self.name("all-labels"))

    def with_hubs(self, rows: DataFrame, seed: int) -> bool:
        """Pair the members of buckets of several labels with a hub; False if there are none."""
        rows = self.labelled(rows)
        mixed = self.mixed(rows, seed)
        pairs = rows.join(mixed, "bucket").where((F.col("label") != F.col("_label")) & self.may_link())
        pairs = self.scratch.write(pairs.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct(), self.name("pairs"))
        if pairs.isEmpty():
            return not mixed.isEmpty()
        self.confirm(pairs)
        return True

    def among(self, rows: DataFrame, mixed: DataFrame) -> None:
        """Pair the members of different labels of some buckets.

        The smaller set of a pair (at a tie the one with the smaller id) has as
        many shingles from the shared one on as two sets of its size need in
        common; the larger is in one of the bucket's parts.
        """
        parts = mixed.select("bucket", F.ceil(F.col("_size") / PART).cast("int").alias("_parts"))
        rows = rows.join(parts, "bucket")
        smaller = rows.where((100 + PERCENT) * F.col("left") >= 2 * PERCENT * F.col("n")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("_part")
        other = rows.select("bucket", part, F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("left").alias("_left"), F.col("label").alias("_label"))
        in_order = (F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("id") < F.col("_id")))
        pairs = smaller.join(other, ["bucket", "_part"]).where(in_order & (F.col("label") != F.col("_label")) & self.may_link())
        pairs = self.scratch.write(pairs.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct(), self.name("pairs"))
        if not pairs.isEmpty():
            self.confirm(pairs)

    def run(self) -> DataFrame | None:
        rows = self.several(self.reps.select("id", "n", "regs").mapInArrow(_bands, _BUCKETS))
        wanted = rows.select(F.col("id").alias("doc_id")).distinct()
        texts = self.docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "id bigint, set binary")
        self.sets = self.scratch.write(texts, self.name("sets"))
        for by_shingle in (False, True):
            self.by_shingle = by_shingle
            if not all(self.with_hubs(rows, seed) for seed in range(1 if by_shingle else 2)):
                return self.labels
            left = self.labelled(rows)
            mixed = self.mixed(left, 3)
            self.among(left, mixed if by_shingle else mixed.where(f"_size <= {SMALL}"))
            large = mixed.where(f"_size > {SMALL}")
            if by_shingle or large.isEmpty():
                return self.labels
            members = rows.join(large.select("bucket"), "bucket").select("id").distinct()
            chosen = self.scratch.write(self.sets.join(members, "id", "left_semi"), self.name("members"))
            counted = chosen.select("set").mapInArrow(_count, "block int, counts binary").repartition("block").mapInArrow(_add, "block int, counts binary").collect()
            order = self.reps.sparkSession.sparkContext.broadcast(np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(counted, key=lambda r: r["block"])]))
            rows = self.several(chosen.mapInArrow(_rarest(order), _BUCKETS))
        return self.labels


def near_groups(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Null and empty texts, and texts without words, have an empty set and are
    linked with nothing. Rows that repeat an id count as one document. A row
    without an id has no component and is kept. Long texts are taken whole.
    Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = scratch.write(docs.mapInArrow(_sketch, "doc_id bigint, n bigint, class binary, regs binary"), "sketches")
    able = sketched.where("class IS NOT NULL AND doc_id IS NOT NULL")
    reps = scratch.write(able.groupBy("class").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("_hi"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
    labels = _Matcher(docs, reps, scratch).run()
    named = reps.where("id < _hi").select(F.col("class").alias("_c"), F.col("id").alias("_rep"))
    out = sketched.select("doc_id", F.col("n").alias("n_shingles"), "class").join(named, F.col("class") == F.col("_c"), "left")
    out = out.withColumn("_rep", F.coalesce("_rep", "doc_id"))
    if labels is not None:
        out = out.join(labels.where("node <> label").select(F.col("node").alias("_rep"), "label"), "_rep", "left").withColumn("_rep", F.coalesce("label", "_rep"))
    return out.select("doc_id", "n_shingles", F.col("_rep").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("_rep"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with their columns as they are, whatever their names.

    Rows without a ``doc_id`` stay, as do empty texts. Rows that repeat an id
    stay or go together. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    gone = scratch.write(near_groups(docs, scratch).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return whole_rows(docs, F.col("doc_id").cast("bigint").alias("id")).join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op2"))
