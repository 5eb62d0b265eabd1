"""Operator 10: language by unigram pieces summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a
probability for each piece; a word's probability is the sum over all ways to
cut it into pieces, by a forward pass over its characters that is scaled where
values get small, so words of any length have one. Probabilities come from
expectation-maximisation on a sample of labelled documents of bounded number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import by_bytes, vocabulary_path

#: Documents of each language the model is fitted on, and rounds of estimation.
SAMPLE_DOCS, ROUNDS = 400, 4
#: Words whose forward passes go together; longer ones than LONG characters go apart, so that short ones needn't wait.
WORDS_AT_ONCE, LONG = 20_000, 64
#: Distinct words whose scores a worker keeps.
CACHE_WORDS = 300_000
#: Share of the uniform distribution in each language's pieces, and a character outside the vocabulary.
SMOOTHING, UNKNOWN = 0.02, 1e-7
#: A sum below ``SMALL`` is scaled up by ``1 / SMALL``; sums are looked at every ``EVERY`` characters.
SMALL, EVERY = 1e-100, 8
UNDETERMINED = "und"

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 20  # bits of a hash that tell most strings apart


def pieces_of(path: str | None = None) -> list[str]:
    """The distinct lower-case pieces of the vocabulary, in order; a word starts with U+2581."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path("piece_bpe_32k.model"))
    plain = (p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)))
    return list(dict.fromkeys(x.lower() for x in plain))


def letters(token: str) -> str:
    """A lower-case token without the marks around it; empty if it holds no letter."""
    word = token.strip(_MARKS)
    return word if any(map(str.isalpha, word)) else ""


class Pieces:
    """Finds pieces in words by 64-bit hashes of strings, for many words at once."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        hashes = np.array([self._hash(x) for x in pieces], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        begins = {x[:k] for x in pieces for k in range(1, len(x))}
        self.may_be, self.may_begin = np.zeros(1 << _CELLS, bool), np.zeros(1 << _CELLS, bool)
        self.may_be[self._cell(hashes)] = True
        self.may_begin[self._cell(np.array([self._hash(x) for x in begins], dtype=np.uint64))] = True

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for x in text:
            h = (h * int(_FACTOR) + ord(x)) % 2**64
        return h

    @staticmethod
    def _cell(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * _FACTOR >> np.uint64(64 - _CELLS)).astype(np.int64)

    def lattice(self, words: list[str]) -> Lattice:
        """All pieces in words; a character that is no piece is an edge of its own, of the number after the last piece."""
        marked = ["▁" + w for w in words]
        codes = np.frombuffer("\0".join([*marked, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
        # Each word has a place for each character and one for its end.
        first = np.cumsum(lengths + 1) - lengths - 1
        offset = np.arange(len(codes)) - np.repeat(first, lengths + 1)
        end = np.repeat(first + lengths, lengths + 1)
        at = np.flatnonzero(np.arange(len(codes)) < end)
        starts, ends, found = [], [], []
        h, n = np.zeros(len(at), dtype=np.uint64), 0
        while len(at):
            h = h * _FACTOR + codes[at + n]
            n += 1
            cell = self._cell(h)
            likely = np.flatnonzero(self.may_be[cell])
            k = np.minimum(np.searchsorted(self.hashes, h[likely]), self.n - 1)
            sure = self.hashes[k] == h[likely]
            hit = likely[sure]
            if n == 1:
                alone = np.ones(len(at), dtype=bool)
                alone[hit] = False
                starts.append(at[alone])
                ends.append(at[alone] + 1)
                found.append(np.full(int(alone.sum()), self.n))
            starts.append(at[hit])
            ends.append(at[hit] + n)
            found.append(self.order[k[sure]])
            go = self.may_begin[cell] & (at + n < end[at])
            at, h = at[go], h[go]
        start, stop, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(found)
        order = np.argsort(offset[start], kind="stable")
        return Lattice(first, lengths, start[order], stop[order], piece[order], np.searchsorted(offset[start][order], np.arange(int(lengths.max(initial=0)) + 1)), self.longest)


class Lattice:
    """Edges of words, sorted by their start within the word."""

    def __init__(self, first: np.ndarray, lengths: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, bounds: np.ndarray, longest: int):
        self.first, self.last = first, first + lengths
        self.start, self.end, self.piece, self.bounds, self.longest = start, end, piece, bounds, longest
        self.size = int(self.last[-1]) + 1 if len(first) else 0

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place and column of ``p``: the scaled sum over all ways to get there, and how often it was scaled."""
        alpha, scaled = np.zeros((self.size, p.shape[1])), np.zeros((self.size, p.shape[1]), dtype=np.int32)
        alpha[self.first] = 1.0
        lengths = self.last - self.first
        for t, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)):
            if t and t % EVERY == 0:
                self._scale(alpha, scaled, t, lengths)
            s, e = self.start[a:b], self.end[a:b]
            alpha[e] += alpha[s] * p[self.piece[a:b]]
        # Until here how often at each place; now how often up to it, from its word's start.
        total = np.cumsum(scaled, axis=0)
        return alpha, total - np.repeat(total[self.first] - scaled[self.first], lengths + 1, axis=0)

    def _scale(self, alpha: np.ndarray, scaled: np.ndarray, t: int, lengths: np.ndarray) -> None:
        # Every place can be reached by single characters, so no sum is 0.
        at = self.first[lengths >= t] + t
        small = alpha[at] < SMALL
        row = np.flatnonzero(small.any(axis=1))
        if len(row):
            at, small, last = at[row], small[row], self.last[lengths >= t][row]
            scaled[at] += small
            times = np.where(small, 1 / SMALL, 1.0)
            for k in range(self.longest):  # what has come further is not yet complete and gets the same scale
                here = at + k <= last
                alpha[at[here] + k] *= times[here]

    def log_totals(self, p: np.ndarray) -> np.ndarray:
        """A row for each word: its log probability by each column of ``p``."""
        alpha, scaled = self.forward(p)
        return np.log(alpha[self.last]) + scaled[self.last] * np.log(SMALL)

    def expected(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words that occur ``n`` times, by the column ``p``."""
        alpha, scaled = (x[:, 0] for x in self.forward(p[:, None]))
        mass = np.zeros(self.size)
        mass[self.last] = n
        out = np.zeros(len(p))
        for a, b in reversed(list(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True))):
            s, e, k = self.start[a:b], self.end[a:b], self.piece[a:b]
            share = alpha[s] * p[k] / alpha[e] * np.power(1 / SMALL, scaled[e] - scaled[s])
            came = mass[e] * share
            out += np.bincount(k, weights=came, minlength=len(p))
            mass += np.bincount(s, weights=came, minlength=self.size)
        return out


def _chunks(words: list[str]) -> Iterator[list[int]]:
    """Places of words that go together."""
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for a in range(0, len(short), WORDS_AT_ONCE):
        yield short[a : a + WORDS_AT_ONCE]
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    if long:
        yield long


def log_probabilities(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """A row for each word: its log probability in each language; ``p`` has a row for each piece and one more for unknown characters."""
    out = np.zeros((len(words), p.shape[1]))
    for some in _chunks(words):
        out[some] = pieces.lattice([words[i] for i in some]).log_totals(p)
    return out


def fit_language(words: dict[str, int], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over all segmentations."""
    found, n = list(words), np.array(list(words.values()), dtype=float)
    lattices = [(pieces.lattice([found[i] for i in some]), n[some]) for some in _chunks(found)]
    p = np.full(pieces.n, 1.0 / pieces.n)
    for _ in range(rounds):
        expected = sum((x.expected(np.append(p, UNKNOWN), m) for x, m in lattices), np.zeros(pieces.n + 1))[:-1]
        total = expected.sum()
        p = (1 - SMOOTHING) * (expected / total if total else 1.0 / pieces.n) + SMOOTHING / pieces.n
    return p


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray]]:
    """Some texts at a time: their number, where each one's tokens begin and end, the distinct tokens, and each token's place among them."""
    whole = pc.utf8_lower(pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), ""))
    for a, b in by_bytes(whole):
        lists = pc.utf8_split_whitespace(whole.slice(a, b - a))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        yield b - a, bounds - bounds[0], coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def fit(docs: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from ``docs(doc_id, text, lang)`` with a language and a text.

    Takes the first ``sample`` documents of each language in order of a hash of
    the id, at any size of the table, and all words of these; each language is
    fitted by a task.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", "doc_id", F.xxhash64("doc_id", F.lit("lang")).alias("_h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, 0))
    # Hashes below a bound hold somewhat more than the sample, so no language is sorted whole.
    bound = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, (2 * sample + 200) / n))))[F.col("lang")]
    few = labelled.where((F.col("_h") / 2.0**64 + 0.5) <= bound)
    chosen = few.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text")))).where(F.col("_rank") <= sample)

    def estimate(key: tuple, table: pa.Table) -> pa.Table:
        words: dict[str, int] = {}
        for _, _, found, at in _tokens(table.column("text").combine_chunks()):
            for token, n in zip(found, np.bincount(at, minlength=len(found)).tolist(), strict=True):
                if w := letters(token):
                    words[w] = words.get(w, 0) + n
        p = fit_language(words, Pieces(pieces_of(vocabulary)))
        return pa.table({"lang": pa.array([key[0].as_py()]), "p": pa.array([p.tobytes()], pa.binary())})

    rows = chosen.select("lang", "text").groupBy("lang").applyInArrow(estimate, "lang string, p binary").collect()
    found = sorted((r["lang"], np.frombuffer(r["p"])) for r in rows)
    return [lang for lang, _ in found], np.stack([np.append(p, UNKNOWN) for _, p in found], axis=1)


class _Scores:
    """Log probabilities of words by one model, remembered."""

    def __init__(self, p: np.ndarray, vocabulary: str | None):
        self.p, self.vocabulary = p, vocabulary
        self.pieces = Pieces(pieces_of(vocabulary))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.used = np.zeros((1, self.p.shape[1])), 1  # the first row is that of tokens without a letter

    def rows_of(self, tokens: list[str]) -> np.ndarray:
        """The row of each token; those that aren't known are scored."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        known = self.known
        new = [x for x in tokens if x not in known]
        if new:
            words = [letters(x) for x in new]
            distinct = {w: self.used + i for i, w in enumerate(dict.fromkeys(w for w in words if w))}
            known.update((x, distinct[w] if w else 0) for x, w in zip(new, words, strict=True))
            upto = self.used + len(distinct)
            if upto > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros((upto - len(self.rows) + len(self.rows) // 2, self.p.shape[1]))))
            self.rows[self.used : upto] = log_probabilities(list(distinct), self.pieces, self.p)
            self.used = upto
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))


_latest: list[_Scores] = []


def scores_of(p: np.ndarray, vocabulary: str | None) -> _Scores:
    """The worker's scores for a model; workers serve many tasks."""
    if not _latest or _latest[0].p is not p or _latest[0].vocabulary != vocabulary:
        _latest[:] = [_Scores(p, vocabulary)]
    return _latest[0]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs(doc_id, text)``; the score is the posterior at equal priors.

    ``und`` with score 0 where the text is null or holds no letter, or nothing
    was learned. Ties go to the language first in order. Repeated rows are
    judged each; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, p = sent.value
        for batch in batches:
            predicted, posterior = [], []
            for n, bounds, found, at in _tokens(batch.column("text")):
                best, sure = np.full(n, -1), np.zeros(n)
                if languages and len(at):
                    words = scores_of(p, vocabulary)
                    row = words.rows_of(found)[at]
                    before = np.concatenate(([0], np.cumsum(row > 0)))[bounds]
                    some = np.flatnonzero(np.diff(before))  # texts with words
                    total = np.add.reduceat(words.rows[row[row > 0]], before[some])
                    best[some] = np.argmax(total, axis=1)
                    sure[some] = 1 / np.exp(np.maximum(total - total.max(axis=1)[:, None], -700)).sum(axis=1)
                predicted += [languages[k] if k >= 0 else UNDETERMINED for k in best.tolist()]
                posterior.append(sure)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(predicted, pa.string()), pa.array(np.concatenate([*posterior, np.zeros(0)]))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    out = identify(docs, fit(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
