"""Operator 11: passages of some length that the corpus has more than once.

A place counts as repeated if the ``least`` bytes from it on also start
elsewhere. Suffixes of the whole corpus can't be sorted in one order at scale,
and needn't be: only those with the same content can match. So each string of
``least`` bytes is named by its anchor, the smallest digest among its shorter
strings (grams) and the first of those: equal strings have equal anchors at
equal places. Neighbouring strings share anchors, about one in 170 places is
one, and a stretch of strings with one anchor is one row:

1. ``anchors``: rows of each text with the anchor's digest and a 128-bit digest
   of all bytes of the stretch. Anchors that occur once have no repeats.
2. Equal stretches are a class; all their strings are repeated.
3. Where one anchor has several classes, the first member of each gives its
   bytes, and a task sorts their suffixes. Previous and next smaller positions
   in that order give each suffix's longest previous factor, and the same from
   the other side the longest next one, up to ``least`` bytes.
4. An anchor with very many classes is dealt over parts. Each part names its
   different strings by 128-bit digests, in blocks of strings at neighbouring
   distances from the anchor; only blocks whose common bytes other parts have
   too are unpacked, and their strings meet by their digests.

With ``keep_first`` only places with an earlier match go, in order of
``doc_id``; otherwise all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .tokens import by_bytes, gather

#: Bytes of a repeated string; stretches of one anchor that a task sorts together; bytes of texts and of stretches at once.
LEAST, PART, TEXT_BYTES, SORT_BYTES = 400, 1024, 1_000_000, 800_000
_PLACE = np.uint64((1 << 21) - 1)  # room for a place in a piece of text; the rest of 64 bits orders grams
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

#: Strings of a block, at most; they need some bytes in common.
BLOCK = 16

_ANCHORS = "h bigint, d binary, r binary, doc_id bigint, n bigint, lo int, hi int, at int, more array<int>"
_STRETCHES = "h bigint, part int, parts int, r binary, doc_id bigint, lo int, at int, n bigint, body binary"
_FOUND = "r binary, doc_id bigint, part int, lo int, hi int, d binary, strings array<struct<lo: int, d: binary, n: bigint>>"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a number for each byte; all wrap around at 64 bits."""
    global _made
    if len(_made[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = (np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))) for x in (_BASE, inverse))
        _made = np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)
    return _made


_made: tuple[np.ndarray, ...] = (np.zeros(0, np.uint64),) * 3


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """``text, anchor digest, lo, hi, anchor``: stretches of the strings of ``least`` bytes of texts that lie in ``data``; places are those of ``data``."""
    gram = max(1, 4 * least // 25)
    width = least - gram + 1
    up, down, values = _powers(len(data) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)])))
    keys = (prefix[gram:] - prefix[:-gram]) * down[: len(data) - gram + 1]
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0xD6E8FEB86659FD93)
    keys ^= keys >> np.uint64(32)
    digests = keys
    least_key = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least_key = np.minimum(least_key[:-size], least_key[size:])
        size *= 2
    if size < width:
        least_key = np.minimum(least_key[: len(least_key) - (width - size)], least_key[width - size :])
    at = (least_key & _PLACE).astype(np.int64)
    behind = ends - least + 1  # of each text the first place that starts no string
    long = behind > starts
    turn = np.empty(len(at), bool)
    turn[0] = True
    np.not_equal(at[1:], at[:-1], out=turn[1:])
    turn[starts[long]] = True
    turn[behind[long & (behind < len(at))]] = True
    lo = np.flatnonzero(turn)
    hi = np.append(lo[1:], len(at)) - 1
    text = np.searchsorted(starts, lo, side="right") - 1
    inside = lo < behind[text]
    lo, hi, text = lo[inside], hi[inside], text[inside]
    return text, digests[at[lo]], lo, hi, at[lo]


def _pieces(texts: pa.Array, least: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """``first text, bytes, starts, ends, bytes of the text before`` of some whole texts, or of a piece of a long one."""
    for a, b in by_bytes(texts, size):
        some = texts.slice(a, b - a).cast(pa.large_binary())
        offsets = np.frombuffer(some.buffers()[1], np.int64, len(some) + 1, 8 * some.offset)
        data = np.frombuffer(some.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        for at in range(0, max(1, len(data) - least + 1), size) if b - a == 1 else (0,):
            piece = data[at : at + size + least - 1] if b - a == 1 else data
            if len(piece) >= least:
                yield a, piece, *((np.zeros(1, np.int64), np.array([len(piece)])) if b - a == 1 else (starts, ends)), at


def anchors(rows: DataFrame, least: int) -> DataFrame:
    """A row for each text of ``rows(r, doc_id, text)`` and content of a stretch: anchor, digest, how often, its first place and further ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            for first, data, starts, ends, before in _pieces(texts, least, TEXT_BYTES):
                text, anchor, lo, hi, at = stretches(data, starts, ends, least)
                held = memoryview(data)
                digests = [hashlib.blake2b(held[x : y + least], digest_size=16, salt=z.to_bytes(8, "little")).digest() for x, y, z in zip(lo.tolist(), hi.tolist(), (at - lo).tolist(), strict=True)]
                text_of, from_ = text.tolist(), (lo - starts[text] + before).tolist()
                to = (hi - starts[text] + before).tolist()
                kept: dict[tuple[int, bytes], int] = {}
                times, more = [1] * len(digests), {}
                for k, name in enumerate(zip(text_of, digests, strict=True)):
                    f = kept.setdefault(name, k)
                    if f != k:
                        times[f] += 1
                        places = more.setdefault(f, [])
                        if places and places[-1] + 1 == from_[k]:
                            places[-1] = to[k]
                        else:
                            places += [from_[k], to[k]]
                rows = np.fromiter(kept.values(), np.int64, len(kept))
                of = pa.array(first + text[rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[rows].view(np.int64)), pa.array([digests[k] for k in rows], pa.binary()), batch.column("r").take(of), batch.column("doc_id").take(of),
                        pa.array([times[k] for k in rows], pa.int64()), pa.array([from_[k] for k in rows], pa.int32()), pa.array([to[k] for k in rows], pa.int32()), pa.array((at - lo)[rows].astype(np.int32)), pa.array([more.get(k) for k in rows], pa.list_(pa.int32())),
                    ],
                    names=["h", "d", "r", "doc_id", "n", "lo", "hi", "at", "more"],
                )

    return rows.mapInArrow(run, _ANCHORS)


def suffix_order(data: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes at the places ``at`` the order by their first ``least`` bytes, and of each but the first in that order whether it shares them all with the one before."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    rank, size = np.zeros(n, np.uint64), min(8, least)
    for k in range(size):
        rank = (rank << np.uint64(8)) | padded[k : n + k]

    def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        new = keys[order]
        new = np.concatenate(([False], new[1:] != new[:-1]))
        out = np.empty(len(keys), np.uint64)
        out[order] = np.cumsum(new)
        return out, order, ~new[1:]

    rank, order, same = ranked(rank)
    while size < least:
        step = min(size, least - size)
        further = np.concatenate((rank[step:], np.zeros(min(step, n), np.uint64)))[:n]
        keys = (rank << np.uint64(32)) | further
        size += step
        if size == least:
            _, order, same = ranked(keys[at])
            return order, same
        rank, order, same = ranked(keys)
    _, order, same = ranked(rank[at])
    return order, same


def previous_factors(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Of suffixes in their order which one is the longest previous factor's source: the place in that order, or -1.

    ``position`` is where each stands in the corpus; ``shared`` says of each but
    the first whether it shares enough with the one before. A suffix's earlier
    matches are longest at the nearest smaller positions on both sides, which
    are found by following pointers over larger ones.
    """
    n = len(position)
    source = np.full(n, -1)
    for side in (-1, 1):
        near = np.arange(n) + side
        ok = np.concatenate(([False], shared) if side < 0 else (shared, [False]))
        near = np.where(ok, near, -1)
        todo = np.flatnonzero(near >= 0)
        while len(todo):
            todo = todo[position[near[todo]] > position[todo]]
            near[todo] = near[near[todo]]
            todo = todo[near[todo] >= 0]
        source = np.where(source < 0, near, source)
    return source


def _sort_stretches(rows: DataFrame, least: int, keep_first: bool) -> DataFrame:
    """Repeated places of the stretches of anchors, and of anchors in several parts each part's different strings, in blocks; ``d``, null else, names a block's common bytes."""
    block = max(1, min(BLOCK, least // 4))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        # Of equal rows in different tasks each gave its stretches.
        once = {x: k for k, x in enumerate(zip(*(batch.column(x).to_pylist() for x in ("h", "r", "lo")), strict=True))}
        if len(once) < batch.num_rows:
            batch = batch.take(pa.array(sorted(once.values())))
        body = batch.column("body").cast(pa.large_binary())
        offsets = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, 8 * body.offset)
        data, first = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]
        many = np.diff(offsets) - least + 1
        at, of = gather(first, many), np.repeat(np.arange(len(many)), many)
        ids = batch.column("doc_id")
        names = list(zip(ids.is_valid().to_pylist(), ids.fill_null(0).to_pylist(), batch.column("r").to_pylist(), strict=True))
        rank_of = {x: k for k, x in enumerate(sorted(set(names)))}
        lo = batch.column("lo").to_numpy().astype(np.int64)
        place = lo[of] + at - first[of]
        position = np.array([rank_of[x] for x in names], np.int64)[of] << 32 | place
        order, shared = suffix_order(data, at, least)
        position = position[order]
        earlier = previous_factors(position, shared) >= 0
        times = batch.column("n").to_numpy()
        later = previous_factors(-position, shared) >= 0
        hit = np.empty(len(at), bool)
        hit[order] = earlier if keep_first else (earlier | later) & (times[of[order]] == 1)
        split = batch.column("parts").to_numpy() > 1
        edge = np.concatenate(([True], (of[1:] != of[:-1]) | (hit[1:] != hit[:-1])))
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(at)) - 1
        begin, end = begin[hit[begin]], end[hit[begin]]
        rows = [(k, a, b, None, None) for k, a, b in zip(of[begin].tolist(), place[begin].tolist(), place[end].tolist(), strict=True)]
        if split.any():
            # Each string of a part once: its earliest place, and how often the part has it.
            group = np.concatenate(([0], np.cumsum(~shared)))
            lead = np.flatnonzero(~earlier & split[of[order]])
            total = np.bincount(group, weights=times[of[order]])[group[lead]].astype(np.int64)
            where = order[lead]
            back = batch.column("at").to_numpy()[of[where]] - (at - first[of])[where]
            turn = np.lexsort((back, of[where]))
            where, total, back = where[turn], total[turn], back[turn]
            head = np.flatnonzero(np.concatenate(([True], (of[where][1:] != of[where][:-1]) | (back[1:] // block != back[:-1] // block)))[: len(where)])
            held, hashed = memoryview(data), lambda x: hashlib.blake2b(x, digest_size=16).digest()
            begins, places, totals = at[where].tolist(), place[where].tolist(), total.tolist()
            for x, y in zip(head.tolist(), [*head[1:].tolist(), len(where)], strict=True):
                nearest = begins[x] + int(back[x]) - int(back[x]) // block * block  # where the block's string next to the anchor starts
                common = hashed(held[nearest : nearest - block + 1 + least])
                strings = [{"lo": places[k], "d": hashed(held[begins[k] : begins[k] + least]), "n": totals[k]} for k in range(x, y)]
                rows.append((int(of[where[x]]), None, None, common, strings))
        if not rows:
            return None
        which, a, b, common, strings = zip(*rows, strict=True)
        which = pa.array(which)
        kinds = pa.list_(pa.struct([("lo", pa.int32()), ("d", pa.binary()), ("n", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("r").take(which), ids.take(which), batch.column("part").take(which), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(common, pa.binary()), pa.array(strings, kinds)],
            names=["r", "doc_id", "part", "lo", "hi", "d", "strings"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(upto: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(upto).combine_chunks() if upto else None
            if table is not None and table.num_rows and (out := some(table.to_batches()[0])) is not None:
                yield out

        size = 0
        for batch in batches:
            h, part = batch.column("h").to_numpy(), batch.column("part").to_numpy()
            lengths = pc.binary_length(batch.column("body")).to_numpy()
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
            if held:
                last = held[-1]
                new[0] = last.column("h")[-1].as_py() != h[0] or last.column("part")[-1].as_py() != part[0]
            begin = 0
            for at in np.flatnonzero(new).tolist():
                size += int(lengths[begin:at].sum())
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                begin = at
                if size >= SORT_BYTES:
                    yield from flush(held)
                    held, size = [], 0
            held.append(batch.slice(begin))
            size += int(lengths[begin:].sum())
        yield from flush(held)

    return rows.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(run, _FOUND)


def _key(text: str) -> tuple[Column, Column, Column]:
    """A row's name, id and text."""
    doc_id, body = F.col("`doc_id`").cast("bigint"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), body), 256), 1, 32)), doc_id, body


def _named(docs: DataFrame, text: str) -> DataFrame:
    """``r, doc_id, text``: rows are named by a digest of id and text; equal rows share it."""
    r, doc_id, body = _key(text)
    return docs.select(r.alias("r"), doc_id.alias("doc_id"), body.alias("text"))


def repeated_places(rows: DataFrame, scratch: Scratch, least: int = LEAST, keep_first: bool = True) -> DataFrame:
    """``r, spans``: of ``rows(r, doc_id, text)`` that have any, the places ``lo`` to ``hi`` where repeated strings of ``least`` bytes start, in any order."""
    every = scratch.write(anchors(rows, least), "anchors")
    # Counts by anchor are written before they are joined: Spark splits a hot anchor's rows only where a join reads plain shuffles.
    twice = scratch.write(every.groupBy("h").agg(F.sum("n").alias("_n")).where("_n > 1").select("h"), "twice")
    every = scratch.write(every.join(twice, "h", "left_semi"), "shared")
    scratch.drop("anchors", "twice")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "r", "lo", "hi", "at")).alias("first")
    classes = scratch.write(every.groupBy("d").agg(F.min("h").alias("h"), F.sum("n").alias("n"), first), "classes")
    groups = classes.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("_least")).where("many > 1" if keep_first else "many > 1 AND _least = 1")
    groups = scratch.write(groups, "groups")
    parts = F.ceil(F.col("many") / PART).cast("int")
    sought = classes.join(groups, "h").select("first.r", F.struct("h", F.pmod(F.xxhash64("d"), parts).cast("int").alias("part"), parts.alias("parts"), "first.lo", "first.hi", "first.at", "n").alias("s"))
    sought = sought.groupBy("r").agg(F.collect_list("s").alias("s"))
    found = scratch.write(_sort_stretches(_bodies(rows.join(sought, "r"), least), least, keep_first), "found")

    members = every.join(classes.where("n > 1").select("d", F.col("first.r").alias("_r"), F.col("first.lo").alias("_lo")), "d")
    pairs = F.transform(F.sequence(F.lit(0), (F.size("more") / 2).cast("int") - 1), lambda k: F.struct(F.element_at("more", 2 * k + 1).alias("lo"), F.element_at("more", 2 * k + 2).alias("hi")))
    further = F.when(F.size("more") > 0, pairs).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))
    own = F.array(F.struct("lo", "hi"))
    spans = F.when((F.col("r") == F.col("_r")) & (F.col("lo") == F.col("_lo")), further).otherwise(F.concat(own, further)) if keep_first else F.concat(own, further)
    settled = members.select("r", F.inline(spans))
    fine = found.where("d IS NULL").select("r", "lo", "hi")
    blocks = found.where("d IS NOT NULL")
    several = blocks.groupBy("d").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).where("_lo < _hi").select("d")
    lone = scratch.write(blocks.join(several, "d", "left_semi").select("r", "doc_id", "part", F.inline("strings")), "lone")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "r", "lo")
    across = lone.groupBy("d").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    gone = order != F.col("_first") if keep_first else F.col("n") == 1
    apart = lone.join(across, "d").where(gone).select("r", "lo", F.col("lo").alias("hi"))
    return settled.unionByName(fine).unionByName(apart).distinct().groupBy("r").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _bodies(rows: DataFrame, least: int) -> DataFrame:
    """The bytes of the sought stretches ``s`` of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # equal rows are one
        for batch in batches:
            for a, b in by_bytes(batch.column("text"), TEXT_BYTES):
                out = []
                for r, doc_id, text, sought in zip(*(batch.column(x).slice(a, b - a).to_pylist() for x in ("r", "doc_id", "text", "s")), strict=True):
                    if r in seen:
                        continue
                    seen.add(r)
                    data = text.encode()
                    out += [(s["h"], s["part"], s["parts"], r, doc_id, s["lo"], s["at"], s["n"], data[s["lo"] : s["hi"] + least]) for s in sought]
                for at in range(0, len(out), 2000):
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[at : at + 2000], strict=True), kinds, strict=True)], names=["h", "part", "parts", "r", "doc_id", "lo", "at", "n", "body"])

    return rows.select("r", "doc_id", "text", "s").mapInArrow(run, _STRETCHES)


def removed_spans(spans: list[dict], least: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings starting at the places of ``spans`` cover, as begin and end."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] + least) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def drop_repeats(docs: DataFrame, scratch: Scratch, text: str = "text", least: int = LEAST, keep_first: bool = True) -> DataFrame:
    """``docs(doc_id, ...)`` with repeated passages cut from ``text``; ``removed_bytes`` says how many bytes went.

    Of a passage the first place stays, by ``doc_id`` (null first), then by a
    digest of the row, then within the text; without ``keep_first`` all go.
    Rows equal in id and text are one here: they lose and keep the same bytes.
    Null texts stay null, texts shorter than ``least`` bytes are whole. Long
    texts are worked on in pieces but not cut. Cuts fall between bytes; what is
    left of a character goes too. An empty table stays empty. A column named
    ``removed_bytes`` is replaced, others come through.
    """
    others = [c for c in docs.columns if c != "removed_bytes"]
    rows = _named(docs, text)
    spans = repeated_places(rows, scratch, least, keep_first)
    whole = F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row")
    keyed = docs.select(whole, F.col(f"`{text}`").cast("string").alias("_text"), _key(text)[0].alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column("_text"), TEXT_BYTES):
                texts, n = [], []
                for body, found in zip(batch.column("_text").slice(a, b - a).to_pylist(), batch.column("spans").slice(a, b - a).to_pylist(), strict=True):
                    cut = removed_spans(found or [], least)
                    n.append(sum(y - x for x, y in cut))
                    texts.append(_kept(body.encode(), cut).decode(errors="ignore") if cut else body)
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(a, b - a), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["_row", "_text", "removed_bytes"])

    out = keyed.join(spans, "r", "left").select("_row", "_text", "spans").mapInArrow(run, T.StructType().add(keyed.schema["_row"]).add("_text", "string").add("removed_bytes", "long"))
    return out.select(*(F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in others), "removed_bytes")


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")
    spans = repeated_places(rows, Scratch(spark, "op11"), LEAST, keep_first=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column("text"), TEXT_BYTES):
                out = []
                for doc_id, text, found in zip(*(batch.column(x).slice(a, b - a).to_pylist() for x in ("doc_id", "text", "spans")), strict=True):
                    data, cut = text.encode(), removed_spans(found or [], LEAST)
                    out.append((doc_id, len(data), sum(y - x for x, y in cut), len(cut), hashlib.sha256(_kept(data, cut)).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.join(spans, "r", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
