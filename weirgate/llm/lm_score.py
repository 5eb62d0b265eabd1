"""Operator 3: language-model scores from a log-frequency Bloom filter.

All pairs of neighbouring words of the training texts are counted. A count is
quantised to the level 1 + floor(log2 count), and a pair enters the filter once
for each level up to its own; a lookup probes level after level until one is
missing. The filter is as large as its entries ask for, so it is a table of
slices: pairs are dealt to slices by the first word, those of very frequent
words by the second, and blocks of texts send the distinct pairs they have to
the slices and get levels back. With q the count a level stands for,

    P(w | v) = max(q(v, w) - D, 0) / S(v) + D * T(v) / S(v) * (c(w) + 1) / (N + V + 1)

where S and T are the sum of q and the number of the words that follow v, c, N
and V are exact counts, and D is Ney's discount. That sums to one over all words
and one unknown word, apart from false hits of the filter.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import by_bytes, word_lists

#: Bits of the filter for each entry, and probes for each.
BITS_PER_ENTRY, PROBES = 16, 8
#: Slices at least; there are as many as shuffle partitions, if these are more.
SLICES = 64
#: Bytes of texts that make a block; one longer text is a block of its own.
BLOCK_BYTES = 8_000_000
#: Pairs a task gathers before it sums them.
PAIRS_AT_ONCE = 4_000_000
#: A word with a larger share of all words than one part of ``HOT_PARTS`` slices has its pairs spread over all slices.
HOT_PARTS = 8

END = "\n"  # no word holds it
_UNIT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(words: list[str]) -> np.ndarray:
    """64-bit digests; they stand for words, so counts are exact unless two words share one (V * V / 2**65 such pairs are expected)."""
    return np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in words]), ">u8").astype(np.uint64)


def level(count: np.ndarray) -> np.ndarray:
    """The quantised count."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def twice_counted(levels: np.ndarray) -> np.ndarray:
    """Twice the count a level stands for, the middle of its range; a whole number."""
    return np.where(levels > 0, 3 * np.left_shift(1, np.maximum(levels, 1) - 1) - 1, 0)


class LogFrequencyFilter:
    """A slice of the filter: bits for pairs of a first word's key and a second word's short key."""

    def __init__(self, data: np.ndarray):
        self.data = data

    @staticmethod
    def _bits(first: np.ndarray, second: np.ndarray, at: int, bits: int) -> Iterator[np.ndarray]:
        x = _mix(_mix(first + second.astype(np.uint64) * _UNIT) + np.uint64(at))
        step = (x >> np.uint64(32)) | np.uint64(1)
        for _ in range(PROBES):
            yield (x % np.uint64(bits)).astype(np.int64)
            x = x + step

    @classmethod
    def of(cls, first: np.ndarray, second: np.ndarray, levels: np.ndarray) -> LogFrequencyFilter:
        bits = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 8) * 8)
        data = np.zeros(bits, dtype=bool)
        for at in range(1, int(levels.max(initial=0)) + 1):
            some = levels >= at
            for where in cls._bits(first[some], second[some], at, bits):
                data[where] = True
        return cls(np.packbits(data, bitorder="little"))

    def levels(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The quantised counts of pairs, 0 for those not seen; never too low."""
        found = np.zeros(len(first), dtype=np.int64)
        alive, at = np.arange(len(first)), 0
        while len(alive) and at < 64:
            at += 1
            yes = np.ones(len(alive), dtype=bool)
            for where in self._bits(first[alive], second[alive], at, 8 * len(self.data)):
                yes &= (self.data[where >> 3] >> (where & 7).astype(np.uint8)) & 1 == 1
            alive = alive[yes]
            found[alive] = at
        return found


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes, then all second ones and so on."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return planes.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).ravel()


#: A row is a block: keys of its words by falling frequency, the place of each token among them, the ids and numbers
#: of tokens of its documents, whether to learn from them, and words that may be hot.
_BLOCK = "block bigint, keys binary, tokens binary, doc_ids array<bigint>, lengths array<int>, learn array<boolean>, hot array<struct<key: bigint, n: bigint>>"
_HOT_ARROW = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))


def slices_of(spark: SparkSession) -> int:
    """A power of two, no less than the shuffle partitions: more input asks for more partitions, so slices keep their size."""
    n = max(SLICES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (n - 1).bit_length()


def read_blocks(docs: DataFrame, scratch: Scratch, name: str = "blocks") -> DataFrame:
    """The texts of ``docs(doc_id, text, learn)`` as a written table of blocks of whole texts, each with an end before and after its words."""
    share = 1 / (2 * HOT_PARTS * slices_of(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            text = batch.column("text")
            for a, b in by_bytes(text, BLOCK_BYTES):
                at, words = word_lists(text.slice(a, b - a))
                coded = words.dictionary_encode()
                keys = word_keys([*coded.dictionary.to_pylist(), END])
                found = coded.indices.to_numpy().astype(np.int64)
                tokens = np.insert(found, np.repeat(at, [1, *[2] * (len(at) - 2), 1]), len(keys) - 1)
                n = np.bincount(tokens, minlength=len(keys))
                order = np.argsort(-n, kind="stable")
                place = np.empty(len(order), dtype=np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                keys, n = keys[order], n[order]
                hot = int(np.searchsorted(-n, -share * len(tokens), side="right"))
                row = [
                    pa.array([block], pa.int64()),
                    pa.array([_packed(keys)], pa.binary()),
                    pa.array([_packed(place[tokens])], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("doc_id").slice(a, b - a)),
                    pa.array([(np.diff(at) + 2).astype(np.int32)], pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("learn").slice(a, b - a)),
                    pa.array([[{"key": k, "n": m} for k, m in zip(keys[:hot].view(np.int64).tolist(), n[:hot].tolist(), strict=True)]], _HOT_ARROW),
                ]
                yield pa.RecordBatch.from_arrays(row, names=["block", "keys", "tokens", "doc_ids", "lengths", "learn", "hot"])
                block += 1

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("learn", F.lit(False)).alias("learn"))
    return scratch.write(docs.mapInArrow(run, _BLOCK), name)


class _Pairs:
    """A block's distinct pairs by slice and first word."""

    def __init__(self, keys: np.ndarray, first: np.ndarray, second: np.ndarray, hot: np.ndarray, slices: int):
        n = np.uint64(len(keys))
        code, self.at, self.counts = np.unique(first.astype(np.uint64) * n + second, return_inverse=True, return_counts=True)
        words, seconds = code // n, code % n
        short = (_mix(keys) >> np.uint64(32)).astype(np.uint32)
        self.hot = np.isin(keys, hot)
        part = np.where(self.hot[words], short[seconds], keys[words]) % np.uint64(slices)
        order = np.argsort(part.astype(np.uint16 if slices <= 65_536 else np.uint32), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.at, self.counts, part = place[self.at], self.counts[order], part[order]
        self.words, self.seconds = words[order].astype(np.int64), seconds[order].astype(np.int64)
        self.second_keys = short[self.seconds]
        # Groups: the pairs of a first word in a slice.
        change = np.ones(len(part), dtype=bool)
        change[1:] = (part[1:] != part[:-1]) | (self.words[1:] != self.words[:-1])
        self.starts = np.flatnonzero(change)
        self.sizes = np.diff(self.starts, append=len(part)).astype(np.uint32)
        self.group_words = self.words[self.starts]
        self.group_keys = keys[self.group_words]
        parts = part[self.starts].astype(np.int64)
        ends = np.searchsorted(parts, np.arange(slices + 1))
        self.slices = [(p, slice(a, b), slice(int(self.starts[a]), int(self.starts[b]) if b < len(parts) else len(part))) for p, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if a < b]


def _neighbours(tokens: np.ndarray, lengths: np.ndarray, learn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each token but the first of a text, after the one before it; of all texts or those to learn from."""
    within = np.ones(len(tokens), dtype=bool)
    within[np.cumsum(lengths) - 1] = False
    if learn is not None:
        within &= np.repeat(learn, lengths)
    first = np.flatnonzero(within)
    return tokens[first], tokens[first + 1]


def _blocks_in(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Block number, keys, tokens, numbers of tokens and the row of each block."""
    for i in range(batch.num_rows):
        lengths = batch.column("lengths")[i].values.to_numpy(zero_copy_only=False)
        yield batch.column("block")[i].as_py(), _unpacked(batch.column("keys")[i].as_py(), np.uint64), _unpacked(batch.column("tokens")[i].as_py(), np.uint32), lengths, i


class _Counts:
    """Counts of pairs of one slice, summed now and then."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.summed = 0, 0

    def add(self, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> None:
        self.held.append((first, second, n))
        self.size += len(first)
        if self.size > PAIRS_AT_ONCE + 2 * self.summed:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First keys, second keys and counts of the distinct pairs, by first key."""
        first, second, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        starts = np.flatnonzero(new)
        self.held = [(first[starts], second[starts], np.add.reduceat(n[order], starts))]
        self.size = self.summed = len(starts)
        return self.held[0]


#: A slice: its part of the filter, keys of first words with exact counts, sums and numbers of following words, the same
#: of its part of hot words, and how many pairs were seen once and twice.
_SLICE = "slice int, filter binary, keys binary, stats binary, hot array<struct<key: bigint, c: bigint, s: bigint, t: bigint>>, tokens bigint, types bigint, once bigint, twice bigint"
_HOT_STATS = pa.list_(pa.struct([("key", pa.int64()), ("c", pa.int64()), ("s", pa.int64()), ("t", pa.int64())]))


class Model:
    """What scoring needs: the table of slices, hot words' statistics, at most 2 * HOT_PARTS a slice, and totals."""

    def __init__(self, grams: DataFrame, slices: int, hot: np.ndarray, hot_stats: np.ndarray, tokens: int, types: int, discount: float):
        self.grams, self.slices, self.hot, self.hot_stats = grams, slices, hot, hot_stats
        self.tokens, self.types, self.discount = tokens, types, discount


def train(blocks: DataFrame, scratch: Scratch) -> Model:
    """Learn from the documents of ``read_blocks`` that are to be learned from: all their words and pairs, however many there are."""
    spark = blocks.sparkSession
    slices = slices_of(spark)
    # A word of a larger share than one part of HOT_PARTS slices has half that share in blocks with at least half of all such words' tokens.
    listed = blocks.select(F.inline("hot")).groupBy("key").agg(F.sum("n").alias("n"))
    total = blocks.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()[0]
    hot = np.sort(np.array([r["key"] for r in listed.where(F.col("n") > total / (2 * HOT_PARTS * slices)).collect()], dtype=np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, tokens, lengths, i in _blocks_in(batch):
                learn = batch.column("learn")[i].values.to_numpy(zero_copy_only=False).astype(bool)
                if not learn.any():
                    continue
                p = _Pairs(keys, *_neighbours(tokens, lengths, learn), sent.value, slices)
                rows = [(s, _packed(p.group_keys[g]), _packed(p.sizes[g]), _packed(p.second_keys[x]), _packed(p.counts[x].astype(np.uint32))) for s, g, x in p.slices]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["slice", "keys", "sizes", "seconds", "counts"])

    def merged(at: int, counts: _Counts) -> pa.RecordBatch:
        first, second, n = counts.total()
        levels = level(n)
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        keys = first[starts]
        stats = np.stack([np.add.reduceat(x, starts) for x in (n, twice_counted(levels), np.ones_like(n))]).astype(np.int64)
        is_hot = np.isin(keys, sent.value)
        spread = [dict(zip("key c s t".split(), x, strict=True)) for x in zip(keys[is_hot].view(np.int64).tolist(), *stats[:, is_hot].tolist(), strict=True)]
        own = stats[:, ~is_hot]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([at], pa.int32()),
                pa.array([LogFrequencyFilter.of(first, second, levels).data.tobytes()], pa.binary()),
                pa.array([_packed(keys[~is_hot])], pa.binary()),
                pa.array([_packed(own.ravel())], pa.binary()),
                pa.array([spread], _HOT_STATS),
                *(pa.array([int(x)], pa.int64()) for x in (own[0].sum(), own.shape[1], (n == 1).sum(), (n == 2).sum())),
            ],
            names=["slice", "filter", "keys", "stats", "hot", "tokens", "types", "once", "twice"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, _Counts()
        for batch in batches:
            for s, *data in zip(*(batch.column(x).to_pylist() for x in ("slice", "keys", "sizes", "seconds", "counts")), strict=True):
                if s != at:
                    if at is not None:
                        yield merged(at, counts)
                    at, counts = s, _Counts()
                keys, sizes, seconds, n = (_unpacked(x, kind) for x, kind in zip(data, (np.uint64, np.uint32, np.uint32, np.uint32), strict=True))
                counts.add(np.repeat(keys, sizes), seconds, n.astype(np.int64))
        if at is not None:
            yield merged(at, counts)

    counted = blocks.select("keys", "tokens", "lengths", "learn", "block").mapInArrow(count, "slice int, keys binary, sizes binary, seconds binary, counts binary")
    grams = scratch.write(counted.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(merge, _SLICE), "slices")
    sums = grams.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "types", "once", "twice"))).first()
    by_key = {r["key"]: (r["c"], r["s"], r["t"]) for r in grams.select(F.inline("hot")).groupBy("key").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    hot_stats = np.array([by_key.get(k, (0, 0, 0)) for k in hot.view(np.int64).tolist()], dtype=np.int64).reshape(-1, 3)
    once, twice = sums[2], sums[3]
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once and twice else 0.5
    return Model(grams.select("slice", "filter", "keys", "stats"), slices, hot, hot_stats, sums[0] + int(hot_stats[:, 0].sum()), sums[1] + int((hot_stats[:, 0] > 0).sum()), discount)


def probabilities(levels: np.ndarray, twice_sum: np.ndarray, followers: np.ndarray, base: np.ndarray, discount: float) -> np.ndarray:
    """P(w | v) of pairs: levels of the pairs, statistics of the first words, base probabilities of the second ones."""
    s = twice_sum / 2
    seen = np.maximum(twice_counted(levels) / 2 - discount, 0)
    return np.where(s > 0, (seen + discount * followers * base) / np.maximum(s, 1), base)


def score(blocks: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for each document of ``read_blocks``.

    Null and empty texts have one token, the end. Repeated rows are scored
    each; an empty table gives no rows, and without training texts every score
    is 0, as all words are the unknown one.
    """
    spark, slices, discount = blocks.sparkSession, model.slices, model.discount
    tokens_seen, types = model.tokens, model.types
    sent = spark.sparkContext.broadcast((model.hot, model.hot_stats))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's distinct pairs, a row for each slice that it asks."""
        for batch in batches:
            for block, keys, tokens, lengths, _ in _blocks_in(batch):
                p = _Pairs(keys, *_neighbours(tokens, lengths), sent.value[0], slices)
                rows = [(block, s, _packed(p.group_keys[g]), _packed(p.sizes[g]), _packed(p.second_keys[x])) for s, g, x in p.slices]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["block", "slice", "keys", "a", "b"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Levels of each block's pairs and statistics of their first words; the slice itself, if it has entries, comes first, without a block."""
        at, grams, known, stats = -1, None, None, None
        for batch in batches:
            rows = []
            for block, s, keys, a, b in zip(*(batch.column(x).to_pylist() for x in ("block", "slice", "keys", "a", "b")), strict=True):
                keys = _unpacked(keys, np.uint64)
                if block is None:
                    at, known, stats, grams = s, keys, _unpacked(b, np.int64).reshape(3, -1), LogFrequencyFilter(np.frombuffer(a, np.uint8))
                    continue
                sizes, seconds = _unpacked(a, np.uint32), _unpacked(b, np.uint32)
                found = np.zeros((3, len(keys)), dtype=np.int64)
                levels = np.zeros(len(seconds), dtype=np.int64)
                if at == s:
                    if len(known):
                        where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                        found = np.where(known[where] == keys, stats[:, where], 0)
                    asked = np.flatnonzero(np.repeat((found[0] > 0) | np.isin(keys, sent.value[0]), sizes))
                    levels[asked] = grams.levels(np.repeat(keys, sizes)[asked], seconds[asked])
                rows.append((block, s, _packed(levels.astype(np.uint8)), _packed(found.ravel())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 2), strict=True)], names=["block", "slice", "levels", "stats"])

    def add_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's documents with their scores; its answers come first, by slice."""
        of_block, levels, stats = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if block != of_block:
                    of_block, levels, stats = block, [], []
                if batch.column("levels")[i].is_valid:
                    levels.append(_unpacked(batch.column("levels")[i].as_py(), np.uint8))
                    stats.append(_unpacked(batch.column("stats")[i].as_py(), np.int64).reshape(3, -1))
                    continue
                _, keys, tokens, lengths, _ = next(_blocks_in(batch.slice(i, 1)))
                p = _Pairs(keys, *_neighbours(tokens, lengths), sent.value[0], slices)
                of_word = np.zeros((3, len(keys)), dtype=np.int64)
                of_word[:, p.group_words] = np.concatenate(stats, axis=1)
                if p.hot.any():
                    of_word[:, p.hot] = sent.value[1][np.searchsorted(sent.value[0], keys[p.hot])].T
                base = (of_word[0] + 1) / (tokens_seen + types + 1)
                pair = np.log10(probabilities(np.concatenate(levels).astype(np.int64), of_word[1][p.words], of_word[2][p.words], base[p.seconds], discount))
                of_token = _neighbours(tokens, lengths)[1]
                starts = np.cumsum(lengths - 1) - (lengths - 1)
                columns = [lengths.astype(np.int64) - 1, np.add.reduceat((of_word[0] > 0)[of_token], starts, dtype=np.int64), np.add.reduceat(np.log10(base)[of_token], starts), np.add.reduceat(pair[p.at], starts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, *map(pa.array, columns)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    asked = blocks.select("block", "keys", "tokens", "lengths").mapInArrow(ask, "block bigint, slice int, keys binary, a binary, b binary")
    routed = asked.unionByName(model.grams.select(F.lit(None).cast("bigint").alias("block"), "slice", "keys", F.col("filter").alias("a"), F.col("stats").alias("b")))
    routed = routed.repartition(slices, "slice").sortWithinPartitions("slice", F.asc_nulls_first("block"))
    answers = routed.mapInArrow(look_up, "block bigint, slice int, levels binary, stats binary")
    whole = blocks.select("block", F.lit(slices).alias("slice"), "keys", "tokens", "lengths", "doc_ids")
    both = answers.unionByName(whole, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "slice")
    return both.mapInArrow(add_scores, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def scores(docs: DataFrame, learn: Column, scratch: Scratch | None = None) -> tuple[DataFrame, Model]:
    """``score`` of all ``docs(doc_id, text, ...)`` by a model of those where ``learn`` holds; other columns are not read."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    blocks = read_blocks(docs.select("doc_id", "text", learn.alias("learn")), scratch)
    model = train(blocks, scratch)
    gc.collect()
    spark._jvm.System.gc()  # Spark deletes shuffle files of plans that nothing holds any more
    return score(blocks, model), model


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    out, model = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out, Scratch(spark, "op3"))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
