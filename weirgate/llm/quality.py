"""Operator 5: quality by weak supervision, with DataFrame functions only.

Rules vote good (1), bad (0) or abstain (null) on a document. The votes of all
documents that pass the base rules are counted by pattern, at most three to the
power of the number of rules; expectation-maximisation on those counts, from
several starts of which the likeliest end counts, estimates how often each rule
says what on good and bad documents; a document stays if its posterior
probability of being good is a half or more. Documents that fail the base rules
go anyway, and would else become the bad class.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, whole_rows

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Posterior probability from which a document stays; rounds of estimation.
KEEP_FROM, ROUNDS = 0.5, 100
#: Where estimation begins: how often a rule votes good on good documents and bad on bad ones; and the share of good documents.
STARTS, BEGIN_SHARE = [(0.95, 0.3), (0.9, 0.5), (0.8, 0.8), (0.7, 0.6), (0.99, 0.1)], 0.8

_SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a packed number that hold a word's place; texts of more words take the plain way.
_PLACE_BITS = 24


def _measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the base columns and ``_words``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", F.array_remove(F.split(text, _SPACE), ""))
    out = out.withColumns({"_n": F.size("_words"), "_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.col("_n").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
            "_bare": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")),
            "_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")),
            # Each 3-word window as 40 bits of a hash before 24 bits of its place, in order: equal windows stand next to each other.
            "_packed": F.when(
                (F.col("_n") >= 3) & (F.col("_n") < 2**_PLACE_BITS),
                F.sort_array(F.expr(f"transform(sequence(0, _n - 3), i -> shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), {_PLACE_BITS}) | i)")),
            ),
        }
    )
    same_hash = f"shiftright(_packed[i], {_PLACE_BITS}) = shiftright(_packed[i - 1], {_PLACE_BITS})"
    place = lambda i: f"cast(_packed[{i}] & {2**_PLACE_BITS - 1} AS int)"
    same_words = " AND ".join(f"_words[{place('i')} + {k}] = _words[{place('i - 1')} + {k}]" for k in range(3))
    out = out.withColumn("_twins", F.expr(f"CASE WHEN size(_packed) > 1 THEN filter(sequence(1, size(_packed) - 1), i -> {same_hash}) ELSE array() END"))
    out = out.withColumns(
        {
            "_places": F.expr(f"array_sort(array_distinct(flatten(transform(_twins, i -> array({place('i - 1')}, {place('i')})))))"),
            # Two windows of one hash that differ, or a text too long to pack: compare the windows themselves.
            "_plain": F.expr(f"(_n >= 3 AND _packed IS NULL) OR exists(_twins, i -> NOT ({same_words}))"),
        }
    )
    out = out.withColumn("_windows", F.expr("CASE WHEN _plain THEN array_sort(transform(sequence(0, _n - 3), i -> struct(concat_ws(' ', _words[i], _words[i + 1], _words[i + 2]) AS w, i AS i))) END"))
    plain = "array_sort(transform(filter(transform(_windows, (x, k) -> struct(x.i AS i, (k > 0 AND _windows[greatest(k - 1, 0)].w = x.w) OR (k + 1 < size(_windows) AND _windows[least(k + 1, size(_windows) - 1)].w = x.w) AS r)), x -> x.r), x -> x.i))"
    out = out.withColumn("_places", F.expr(f"CASE WHEN _plain THEN {plain} ELSE _places END"))
    covered = "aggregate(_places, struct(cast(-3 AS int) AS last, cast(0 AS bigint) AS n), (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n)"
    return out.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("bigint"))


def _rules() -> dict[str, Column]:
    """Votes on a row of ``_measures`` with words: good (1), bad (0) or null."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    vote = lambda good, bad: F.when(bad, 0).when(good, 1)
    mean = F.col("word_chars") / n
    symbols, repeats = F.col("n_symbols") / n, F.col("n_repeat_words") / n
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    letters = F.col("_letters") / F.greatest(F.col("word_chars"), F.lit(1))
    capitals = F.col("_capitals") / F.greatest(F.col("_letters"), F.lit(1))
    distinct = F.size(F.array_distinct("_words")) / n
    return {
        "length": vote((F.col("n_words") >= 50) & (F.col("n_words") <= 100_000), F.col("n_words") < 50),
        "word_length": vote((mean >= 3.5) & (mean <= 7), (mean < 2) | (mean > 10)),
        "symbols": vote(symbols < 0.05, symbols > 0.1),
        "lines": vote(lines < 0.2, lines > 0.4),
        "repeats": vote(repeats < 0.2, repeats > 0.5),
        "letters": vote(letters > 0.85, letters < 0.7),
        "bare": vote(F.col("_bare") / n < 0.15, F.col("_bare") / n > 0.3),
        "capitals": vote(capitals < 0.2, capitals > 0.5),
        "distinct": vote((distinct > 0.4) | (F.col("n_words") > 2000), distinct < 0.15),
    }


Patterns = list[tuple[tuple[int | None, ...], int]]
Weights = tuple[float, list[tuple[float, float]]]


def _climb(patterns: Patterns, right: list[tuple[float, float]], rounds: int) -> tuple[float, Weights]:
    """Where expectation-maximisation ends from chances of right votes on good and on bad documents: the log likelihood and the weights."""
    k, good = len(right), BEGIN_SHARE
    total = sum(n for _, n in patterns)
    weights = lambda: (log(good / (1 - good)), [(log(g / (1 - b)), log((1 - g) / b)) for g, b in right])
    before = like = float("-inf")
    for _ in range(rounds):
        prior, add = weights()
        sums = [[1.0, 2.0, 1.0, 2.0] for _ in range(k)]
        all_good = 1.0
        # The made-up votes count in the likelihood as well, so no round lowers it.
        like = log(good) + log(1 - good) + sum(log(x) + log(1 - x) for pair in right for x in pair)
        for votes, n in patterns:
            said = [(j, v) for j, v in enumerate(votes) if v is not None]
            bad = log(1 - good) + sum(log(1 - right[j][1]) if v else log(right[j][1]) for j, v in said)
            z = prior + sum(add[j][0] if v else add[j][1] for j, v in said)
            like += n * (bad + (z + log(1 + exp(-z)) if z > 0 else log(1 + exp(z))))
            p = 1 / (1 + exp(-max(-500.0, min(500.0, z))))
            all_good += n * p
            for j, v in said:
                s = sums[j]
                s[0] += n * p * v
                s[1] += n * p
                s[2] += n * (1 - p) * (1 - v)
                s[3] += n * (1 - p)
        good = all_good / (total + 2)
        right = [(a / b, c / d) for a, b, c, d in sums]
        if like - before < 1e-10 * total:
            break
        before = like
    # The good class is the one on which rules vote good more often.
    if sum(g - (1 - b) for g, b in right) < 0:
        good, right = 1 - good, [(1 - b, 1 - g) for g, b in right]
    return like, weights()


def fit(patterns: Patterns, rounds: int = ROUNDS, starts: list[tuple[float, float]] | None = None) -> Weights:
    """The log odds of a good document, and for each rule what a good and a bad vote add to them.

    ``patterns`` are votes with their numbers of documents. A rule's accuracy on
    good and on bad documents is estimated apart, over the documents it votes
    on, with one made-up vote for and against, so that no chance is 0. Of all
    starts the end of the greatest likelihood is taken, at a tie the first.
    Without documents nothing adds anything.
    """
    k = len(patterns[0][0]) if patterns else 0
    if not sum(n for _, n in patterns):
        return 0.0, [(0.0, 0.0)] * k
    ends = [_climb(patterns, [start] * k, rounds) for start in starts or STARTS]
    return max(ends, key=lambda x: x[0])[1]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def vote(docs: DataFrame) -> DataFrame:
    """``docs`` with the base columns, ``base_failed`` and ``_votes``, a character for each rule: 1, 0 or -.

    A null or empty text has no words and fails. Repeated rows are judged each.
    Columns of ``docs`` that have the name of a result column are replaced.
    Write the votes before filtering on them: a filter would move below the
    measures and repeat them for each word.
    """
    docs = docs.drop(*BASE, "base_failed", "quality", "kept")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    votes = F.concat(*(F.coalesce(v.cast("string"), F.lit("-")) for v in _rules().values()))
    return _measures(docs).select(*docs.columns, *BASE, failed.alias("base_failed"), votes.alias("_votes"))


def _counts(voted: DataFrame) -> DataFrame:
    """``_votes, n``: documents that pass the base rules by pattern. Those that fail are not filtered out, since a filter would move below the measures of votes not yet written, and split the text again for each word."""
    return voted.groupBy("_votes").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")).where("n > 0")


def learn(voted: DataFrame) -> Weights:
    """``fit`` on the votes of all documents that pass the base rules; the driver gets one count a pattern, 3 ** 9 at most."""
    counts = _counts(voted).collect()
    as_vote = {"1": 1, "0": 0, "-": None}
    model = fit(sorted(((tuple(as_vote[x] for x in r["_votes"]), r["n"]) for r in counts), key=str))
    return model if counts else (0.0, [(0.0, 0.0)] * len(_rules()))


def judge(voted: DataFrame, model: Weights) -> DataFrame:
    """The base columns, ``quality`` (the posterior probability) and ``kept`` in place of the votes."""
    prior, add = model
    z = F.lit(prior)
    for j, (good, bad) in enumerate(add):
        said = F.substring("_votes", j + 1, 1)
        z = z + F.when(said == "1", good).when(said == "0", bad).otherwise(0.0)
    judged = voted.withColumn("quality", 1 / (1 + F.exp(-z)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)).drop("_votes")


def keep_good(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs(text, ...)`` that the rules keep, with their columns as they are, whatever their names.

    A null or empty text fails. Repeated rows are judged each; an empty table gives no rows.

    The votes are written first: a filter on them would otherwise move below
    the measures and repeat them.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    voted = scratch.write(vote(whole_rows(docs, F.col("text"))).drop("text"), "votes")
    return judge(voted, learn(voted)).where("kept").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    voted = Scratch(spark, "op5").write(vote(docs.select("doc_id", "text")).drop("text"), "votes")
    return judge(voted, learn(voted)).select("doc_id", *BASE, "base_failed", "kept", "quality")
