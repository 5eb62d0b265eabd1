"""Token ids of whole texts from a public tokenizer file, and the byte-level words other operators share."""

from __future__ import annotations

import ctypes
import os
import sys
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs between spaces whose ids a worker keeps, and the ids of them all; with more, it starts over.
CACHE_RUNS, CACHE_IDS = 750_000, 5_000_000
#: Bytes of texts that are encoded at once, and characters that the library gets in one call, which takes some hundred bytes for each; one longer text is encoded alone.
TEXT_BYTES, CALL_CHARS = 3_000_000, 100_000
#: Runs that are joined to one text.
JOINED_RUNS = 500

_encoders: dict[str, Encoder] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public tokenizers has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def by_bytes(column: pa.Array, limit: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string column with up to ``limit`` bytes each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield at, upto
        at, done = upto, int(ends[upto - 1])


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of runs of some lengths, one run after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Encoder:
    """Encodes with the ``tokenizers`` library, once for each distinct run of text between spaces.

    A byte-level BPE file cuts text by a pattern before it merges, and a single
    space before a character that is no white space always starts a new part
    there. So a text's ids are those of its runs in a row, each with the space
    before it. New runs go to the library joined, as the texts they come from
    would; the bytes of their ids tell where each run ends. Texts with a space
    before white space or at the end are encoded whole, in one batch.
    """

    def __init__(self, path: str):
        # A task has one core; threads of the library's own would take it from others.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Of byte-level tokens each character is a byte.
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.n_bytes[k] = len(token)
        for k, token in self.tokenizer.get_added_tokens_decoder().items():
            self.n_bytes[k] = len(token.content.encode())
        self._clear()

    def _clear(self) -> None:
        self.runs: dict[str, int] = {}
        # Entries and their ids, with room for more at the end.
        self.n_entries, self.n_values = 0, 0
        self.starts, self.lengths, self.values = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, "<u4")

    def _append(self, values: np.ndarray, lengths: np.ndarray) -> int:
        """Add entries; the place of the first."""
        first, upto, end = self.n_entries, self.n_entries + len(lengths), self.n_values + len(values)
        if upto > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros(upto - len(x) + len(x) // 2, x.dtype))) for x in (self.starts, self.lengths))
        if end > len(self.values):
            self.values = np.concatenate((self.values, np.zeros(end - len(self.values) + len(self.values) // 2, "<u4")))
        self.starts[first:upto] = self.n_values + np.cumsum(lengths) - lengths
        self.lengths[first:upto] = lengths
        self.values[self.n_values : end] = values
        self.n_entries, self.n_values = upto, end
        return first

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of texts in a row, and their numbers."""
        values, lengths, at = [np.zeros(0, "<u4")], np.zeros(len(texts), np.int64), 0
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CALL_CHARS, side="right")))
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts[at:upto], add_special_tokens=False)]
            values.append(np.fromiter(chain.from_iterable(ids), dtype="<u4"))
            lengths[at:upto] = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            at = upto
        return np.concatenate(values), lengths

    def _encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs, each with the space before it, and their numbers."""
        values, lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(runs), JOINED_RUNS):
            some = runs[at : at + JOINED_RUNS]
            joined = " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            data = np.frombuffer(joined.encode(), np.uint8)
            # No run has a space in it.
            until = np.append(np.flatnonzero(data == 32)[1:], len(data))
            place = np.cumsum(self.n_bytes[ids])
            last = np.searchsorted(place, until)
            if len(place) and place[-1] == len(data) and np.array_equal(place[last], until):
                n = np.diff(last, prepend=-1)
            else:
                # Something in a run isn't encoded byte by byte.
                ids, n = self._encode([" " + x for x in some])
            values.append(ids)
            lengths.append(n)
        return np.concatenate(values), np.concatenate(lengths)

    def _slots(self, runs: list[str]) -> np.ndarray:
        """Which entries the runs have; new ones are learned."""
        if len(self.runs) > CACHE_RUNS or self.n_values > CACHE_IDS:
            self._clear()
        known = self.runs
        new = [x for x in runs if x not in known]
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            first = self._append(*self._encode_runs(some))
            known.update(zip(some, range(first, first + len(some)), strict=True))
        return np.fromiter(map(known.__getitem__, runs), dtype=np.int64, count=len(runs))

    def _some(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds, coded = bounds - bounds[0], lists.flatten().dictionary_encode()
        runs, token = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy().astype(np.int64)
        heads = bounds[:-1]
        head = pc.utf8_slice_codeunits(coded.dictionary, 0, 1)
        odd_run = pc.or_(pc.equal(head, ""), pc.utf8_is_space(head)).to_numpy(zero_copy_only=False)
        odd_token = odd_run[token]
        odd_token[heads] = False
        odd = np.logical_or.reduceat(odd_token, heads)
        # An odd text is one entry, its whole ids; of another the first run has no space before it.
        in_rest = np.ones(len(token), dtype=bool)
        in_rest[heads] = False
        in_rest &= ~np.repeat(odd, np.diff(bounds))
        asked = np.zeros(len(runs), dtype=bool)
        asked[token[in_rest]] = True
        wanted = np.flatnonzero(asked)
        slot = np.zeros(len(runs), dtype=np.int64)
        slot[wanted] = self._slots(runs[wanted].tolist())
        first = runs[token[heads]].tolist()
        for i in np.flatnonzero(odd).tolist():
            first[i] = texts[i].as_py()
        kept = self.n_entries, self.n_values
        opening = self._append(*self._encode(first))
        closing = self._append(np.array([end], dtype="<u4"), np.ones(1, np.int64))
        # Of each text the entries: the first one, the runs after it, the end.
        of_token = slot[token]
        of_token[heads] = opening + np.arange(len(heads))
        in_rest[heads] = True
        after = np.cumsum(np.add.reduceat(in_rest, heads, dtype=np.int64))
        entries = np.insert(of_token[in_rest], after, closing)
        n_ids = self.lengths[entries].astype(np.int64)
        ids = self.values[gather(self.starts[entries], n_ids)]
        self.n_entries, self.n_values = kept
        last = np.cumsum(n_ids)[after + np.arange(len(after))]
        return ids, np.diff(last, prepend=0)

    def encode(self, column: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ranges of rows with their ids in a row and the number of each row's; null counts as empty, ``end`` closes each text."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        for a, b in by_bytes(texts):
            yield (a, b, *self._some(texts.slice(a, b - a), end))


def give_back() -> None:
    """Return memory that is free in this worker to the system; allocators keep it otherwise, for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; workers serve many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_lists(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow column of int32 lists from ids in a row."""
    if len(ids) > np.iinfo(np.int32).max:
        raise ValueError("a text holds more ids than an Arrow list can")
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))


def list_crcs(column: pa.ListArray) -> np.ndarray:
    """Unsigned CRC-32 of each list's ids as little-endian 32-bit integers."""
    offsets = column.offsets.to_numpy()
    data = memoryview(column.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
    return np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def word_lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z lower-cased, one after another, and where each text's begin and end."""
    # A copy, as Arrow lower-cases slices of arrays wrongly.
    whole = column.take(pa.array(np.arange(len(column)))).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole, "")))
    bounds, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))
    return before[bounds - bounds[0]], flat.filter(keep)


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; both hold for bytes of UTF-8."""
    return (text or b"").lower().split()


def per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A function for ``mapInArrow`` from one for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := make(batch)) is not None:
                yield out

    return run
