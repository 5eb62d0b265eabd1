"""The operators of a training-data pipeline against brute force on small tables."""

import base64
import hashlib
import struct
import time
import zlib
from collections import Counter
from math import log10

import duckdb
import pandas as pd
import pytest
from tokenizers import Tokenizer

from weirgate.llm import exact_dedup, html_text, language_id, lm_score, mixing, near_dedup, packing, quality, token_files, tokens, warc
from weirgate.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, extra int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [
    (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", None, None, 1), (2, "a b c d e f g", None, None, 2),
    (3, None, None, None, None), (4, "", "en", "s", 1), (5, " \n\t ", "en", "t", 1), (6, LONG, "en", "s", 1),
    (7, "Ünï cödé  two  spaces \n and 'tis 12,5!! x", "de", "t", 1), (None, "a b", "en", "s", 1), (9, "a b", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def brute_ids():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, odd, docs):
    ids_of = brute_ids()
    for df in (odd, docs):
        path = Scratch(spark, "t1").path("x")
        token_files.write_tokens(df, path)
        got = sorted((r["start"], r["n_tokens"], list(r["ids"])) for r in token_files.read_tokens(spark, path).collect())
        rows = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        want, at = [], 0
        for r in rows:
            ids = [*ids_of(r["text"]), 2]
            want.append((at, len(ids), ids))
            at += len(ids)
        assert got == want
    assert [r["doc_id"] for r in token_files.find_tokens(spark, path, [3]).collect()] == [3]


def test_token_query(spark, sf, docs):
    ids_of = brute_ids()
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.op1_token_files(spark, sf).collect()}
    want, at = {}, 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*ids_of(r["text"]), 2]
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert got == want


@pytest.mark.parametrize("limit", [1, 40, 10**6])
def test_encoder_on_odd_texts(limit, monkeypatch):
    monkeypatch.setattr(tokens.by_bytes, "__defaults__", (limit,))
    monkeypatch.setattr(tokens, "CACHE_RUNS", 3)
    monkeypatch.setattr(tokens, "CALL_CHARS", limit)
    ids_of, e = brute_ids(), tokens.Encoder(tokens.vocabulary_path())
    texts = ["", None, " ", "  a", "a  b", "a <|endoftext|> b", "x<|endoftext|>y z", "a\n", "a \n b", "\n\n x", "it's 'tis don't", "a b c  d", "é ü 12,5!! x ", "\x1c a \x1cb", "日本 語", "a\u00a0 b", "q" * 300 + " z", "One, two. (Three) a,b été! don't. x... y' é, 5, !, ,", "a, a, one, one. <|endoftext|>, b"]
    got = []
    for a, b, ids, n in e.encode(tokens.pa.array(texts), 7):
        ends = n.cumsum()
        got += [ids[x - k : x].tolist() for x, k in zip(ends, n, strict=True)]
        assert b - a == len(n) and ends[-1] == len(ids)
    assert got == [[*ids_of(x), 7] for x in texts]


def test_word_lists():
    texts = [" A b\x0b\x0cc\x1cd\r\ne ", None, "", "É x\u00a0y", " "]
    for skip in range(3):
        at, words = tokens.word_lists(tokens.pa.array([*["é longer than the others"] * skip, *texts]).slice(skip))
        assert [words[a:b].to_pylist() for a, b in zip(at, at[1:])] == [[w.decode() for w in tokens.words((x or "").encode())] for x in texts]


def test_find_tokens_skips_files(spark, docs):
    """The files of other ids are left out by their statistics; within a file, a missing id meets no row group."""
    path = Scratch(spark, "t1f").path("x")
    token_files.write_tokens(docs, path)
    for i in docs.select("doc_id").limit(3).toPandas().doc_id.tolist():
        found = token_files.find_tokens(spark, path, [i])
        assert [r["doc_id"] for r in found.collect()] == [i]
        assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString() or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in found._jdf.queryExecution().toString()


def brute_components(rows):
    sets = {}
    for doc_id, text in rows:
        w = tuple((text or "").encode().lower().split())
        sets[doc_id] = {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()
    label = {i: i for i in sets}
    moved = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_groups(spark, docs):
    base = [f"word{i}" for i in range(120)]
    made = [(10_000 + k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]])) for k in range(60)]  # one large group of near copies
    passage = " ".join(f"p{i}" for i in range(60))
    made += [(20_000 + k, passage + " " + " ".join(f"q{k}x{i}" for i in range(20 + k % 9))) for k in range(80)]  # one frequent passage
    more = spark.createDataFrame([*made, (3_000_000, None), (3_000_001, " "), (3_000_002, "a b"), (3_000_003, "A  b")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(every).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in every.collect()])


@pytest.mark.parametrize(("small", "part"), [(32, 1024), (2, 3)])
def test_near_groups_in_parts(spark, monkeypatch, small, part):
    """Texts of the same passages with tails of their own, from far below the threshold to far above it."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "PART", part)
    passages = [" ".join(f"p{i}x{j}" for j in range(20)) for i in range(6)]
    texts = [" ".join([*(passages[(k + i) % 6] for i in range(4)), *(f"t{k}y{j}" for j in range(k % 25))]) for k in range(90)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(made).collect()}
    assert got == brute_components(enumerate(texts))


def test_near_groups_of_odd_rows(odd, spark):
    got = Counter(tuple(r[x] for x in ("doc_id", "n_shingles", "component_id", "kept")) for r in near_dedup.near_groups(odd).collect())
    want = brute_components([(r[0], r[1]) for r in ODD if r[0] is not None])
    assert got == Counter((r[0], *(want[r[0]] if r[0] else (1, None)), not r[0] or want[r[0]][1] == r[0]) for r in ODD)
    assert near_dedup.near_groups(odd.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    a, b = near_dedup.shingles(b"a b c d e f g h i j k l"), near_dedup.shingles(b"c d e f g h i j k l m n o")
    union = near_dedup.np.union1d(a, b)
    r = near_dedup.registers([a, b, union])
    assert (near_dedup.merge(r[0], r[1]) == r[2]).all()
    n = near_dedup.np.array([float(len(a))])
    assert near_dedup.estimate(r[:1], r[:1], n, n)[0] == 1.0


def brute_model(sequences):
    """Counts of pairs as the filter holds them, sums and numbers of following words, exact counts, the discount."""
    np = lm_score.np
    pairs = Counter(p for ws in sequences for p in zip(ws, ws[1:]))
    c = Counter()
    q, s, t = {}, Counter(), Counter()
    for (v, w), n in pairs.items():
        q[v, w] = int(lm_score.twice_counted(lm_score.level(np.array([n])))[0]) / 2
        c[v] += n
        s[v] += q[v, w]
        t[v] += 1
    once, twice = (sum(n == k for n in pairs.values()) for k in (1, 2))
    return q, s, t, c, once / (once + 2 * twice) if once and twice else 0.5


def test_lm_scores(spark, sf, docs):
    """Every column against brute force; false hits of the filter move few scores, and those a little."""
    got = {r["doc_id"]: r for r in lm_score.op3_lm_score(spark, sf).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = {r["doc_id"]: [b"\n", *tokens.words(r["text"].encode()), b"\n"] for r in docs.collect()}
    q, s, t, c, d = brute_model([ws for i, ws in words.items() if not out(i)])
    n, v = sum(c.values()), len(c)
    near, total = 0, 0.0
    for i, ws in words.items():
        base = {w: (c[w] + 1) / (n + v + 1) for w in ws}
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (out(i), len(ws) - 1, sum(c[w] > 0 for w in ws[1:]), n)
        assert got[i]["base_score"] == pytest.approx(sum(log10(base[w]) for w in ws[1:]))
        want = sum(log10((max(q.get((a, b), 0) - d, 0) + d * t[a] * base[b]) / s[a] if s[a] else base[b]) for a, b in zip(ws, ws[1:]))
        near += got[i]["score"] == pytest.approx(want, rel=1e-9)
        total += want
    assert sum(r["score"] for r in got.values()) == pytest.approx(total, rel=0.01)
    assert near > 0.75 * len(words)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_probabilities_sum_to_one(spark):
    """Over all words, the end and an unknown word, after each word."""
    vocabulary = [f"w{i}" for i in range(20)]
    texts = [" ".join(vocabulary[(i * k) % 20] for i in range(1, 30)) for k in range(1, 9)]
    rows = [(k, t, True) for k, t in enumerate(texts)]
    asked = [(1000 + 100 * i + j, f"{v} {w}".strip(), False) for i, v in enumerate(vocabulary) for j, w in enumerate([*vocabulary, "unknown"])]
    asked += [(10_000 + i, v, False) for i, v in enumerate(vocabulary)]
    df = spark.createDataFrame([*rows, *asked], "doc_id long, text string, learn boolean")
    got, _ = lm_score.scores(df, lm_score.F.col("learn"), Scratch(spark, "t3"))
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    q, s, t, c, d = brute_model([["\n", *x.split(), "\n"] for x in texts])
    total = sum(c.values()) + len(c) + 1
    p = lambda a, b: (max(q.get((a, b), 0) - d, 0) + d * t[a] * (c[b] + 1) / total) / s[a]
    for i, v in enumerate(vocabulary):
        after = [10 ** score[1000 + 100 * i + j] / p("\n", v) / p(w, "\n") for j, w in enumerate(vocabulary)]
        unknown = 10 ** score[1000 + 100 * i + 20] / p("\n", v) / ((c["\n"] + 1) / total)
        end = 10 ** score[10_000 + i] / p("\n", v)
        assert sum(after) + unknown + end == pytest.approx(1)


def test_lm_scores_of_odd_rows(spark, odd):
    got, model = lm_score.scores(odd, lm_score.F.col("doc_id") > 0, Scratch(spark, "t3o"))
    rows = got.collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == Counter((i, len((t or "").split()) + 1) for i, t, *_ in ODD)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2) and r["n_tokens"] == 8}) == 1
    assert lm_score.scores(odd.limit(0), lm_score.F.lit(True))[0].count() == 0
    assert {r["score"] for r in lm_score.scores(odd, lm_score.F.lit(False))[0].collect()} == {0.0}


def test_filter_never_loses_an_entry():
    np = lm_score.np
    first, second = np.arange(1, 3000, dtype=np.uint64) * np.uint64(2654435761), np.arange(1, 3000, dtype=np.uint32)
    real = 1 + np.arange(2999) % 7
    grams = lm_score.LogFrequencyFilter.of(first, second, real)
    found = grams.levels(first, second)
    assert (found >= real).all() and (found == real).mean() > 0.99
    assert (grams.levels(first, second + np.uint32(7_000)) > 0).mean() < 0.01


@pytest.mark.parametrize("parts", [0.001, 64])
def test_hot_words_are_spread(spark, docs, monkeypatch, parts):
    """Which words count as hot doesn't change a score, but for false hits."""
    learn = lm_score.F.lit(True)
    want = {r["doc_id"]: r["score"] for r in lm_score.scores(docs, learn)[0].collect()}
    monkeypatch.setattr(lm_score, "HOT_PARTS", parts)
    out, model = lm_score.scores(docs, learn)
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert (len(model.hot) > 20) == (parts == 64) and (len(model.hot) == 0) == (parts != 64)
    assert sum(got[i] == pytest.approx(x) for i, x in want.items()) > 0.7 * len(want)
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.01)


def test_packing(spark, odd, docs):
    ids_of = brute_ids()
    for df in (odd, docs):
        got = packing.pack(df, capacity=512).collect()
        want = Counter()
        for r in df.collect():
            want[r["doc_id"], tuple([*ids_of(r["text"]), 0])] += 1
        seqs: dict = {}
        for r in got:
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert r["length"] == len(r["ids"]) <= 512 and (r["length"] == 512 or r["piece"] == 0)
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 512
        total = sum(len(ids) * n for (_, ids), n in want.items())
        assert sum(r["length"] for r in got) == total
        assert len(seqs) <= 1.02 * total / 512 + 1
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_query(spark, sf, docs):
    ids_of = brute_ids()
    want = {}
    for r in docs.collect():
        ids = [*ids_of(r["text"]), 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want |= {(r["doc_id"], k): (a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = packing.op4_best_fit_packing(spark, sf).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= 1.02 * sum(ends.values()) / 2048 + 1


def brute_measures(text):
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, counted word by word."""
    ws = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    repeated = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(x in "#*$%&|<>" for x in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated)


def check_measures(rows, texts):
    for r in rows:
        n, *rest = brute_measures(texts[r["doc_id"]])
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == [n, *rest]
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n)


def test_quality(spark, sf, docs):
    rows = quality.op5_quality_rules(spark, sf).collect()
    check_measures(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert all(0 <= r["quality"] <= 1 and r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5) for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [r["kept"] == (labels[r["doc_id"]] == 1) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(judged) > 0.9 * len(judged)


@pytest.mark.parametrize("bits", [24, 3])
def test_quality_measures_of_odd_rows(spark, bits, monkeypatch):
    """Also with so few bits for places that the windows themselves are compared."""
    monkeypatch.setattr(quality, "_PLACE_BITS", bits)
    texts = [None, "", " \n\t ", "a b c", "a b c a b c d", "x\n x\nx\n\n \nx", "#a |b| <c> $%&*", "a a a a a a", "Ünï cödé\u00a0x ünï", LONG[:3000], "a b c d e a b c d e", "ab c a bc ab c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check_measures(quality.vote(df).collect(), dict(enumerate(texts)))


def brute_votes(text):
    """The nine votes in plain Python."""
    import regex

    n_words, word_chars, n_symbols, n_dup, n_repeat = brute_measures(text)
    ws = [w.decode() for w in text.encode().split()]
    n = max(n_words, 1)
    lines = [x for x in text.split("\n") if x.encode().split()]
    letters, capitals = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
    bare = sum(not regex.search(r"\p{L}", w) for w in ws)
    distinct = len(set(ws)) / n
    pick = lambda good, bad: "0" if bad else "1" if good else "-"
    mean, symbols, dups, repeats, share, caps = word_chars / n, n_symbols / n, n_dup / max(len(lines), 1), n_repeat / n, letters / max(word_chars, 1), capitals / max(letters, 1)
    return "".join([
        pick(50 <= n_words <= 100_000, n_words < 50), pick(3.5 <= mean <= 7, mean < 2 or mean > 10), pick(symbols < 0.05, symbols > 0.1),
        pick(dups < 0.2, dups > 0.4), pick(repeats < 0.2, repeats > 0.5), pick(share > 0.85, share < 0.7),
        pick(bare / n < 0.15, bare / n > 0.3), pick(caps < 0.2, caps > 0.5), pick(distinct > 0.4 or n_words > 2000, distinct < 0.15),
    ])


def test_quality_votes_and_posterior(spark, docs):
    """Votes of whole documents and the posterior of each, by plain Python; every start ends at the same verdicts or at a lower likelihood."""
    from math import exp

    voted = quality.vote(docs.select("doc_id", "text")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["_votes"] for r in voted} == {i: brute_votes(t) for i, t in texts.items()}
    as_vote = {"1": 1, "0": 0, "-": None}
    counts = Counter(tuple(as_vote[x] for x in r["_votes"]) for r in voted if not r["base_failed"])
    prior, add = quality.fit(sorted(counts.items(), key=str))
    odds = lambda votes, m: m[0] + sum(a if v else b for v, (a, b) in zip(votes, m[1], strict=True) if v is not None)
    want = {r["doc_id"]: 1 / (1 + exp(-odds([as_vote[x] for x in r["_votes"]], (prior, add)))) for r in voted}
    got = {r["doc_id"]: r["quality"] for r in quality.judge(quality.vote(docs.select("doc_id", "text")), (prior, add)).collect()}
    assert got == pytest.approx(want)
    patterns = sorted(counts.items(), key=str)
    ends = [quality._climb(patterns, [s] * 9, quality.ROUNDS) for s in quality.STARTS]
    best = max(x for x, _ in ends)
    for like, m in ends:
        assert like < best - 1e-3 or all((odds(v, m) >= 0) == (odds(v, (prior, add)) >= 0) for v, _ in patterns)


def test_quality_estimates():
    """Accuracies of made-up votes are found again, from a beginning that is off."""
    np = quality.F and __import__("numpy")
    rng = np.random.default_rng(4)
    good = rng.random(40_000) < 0.7
    right = [(0.9, 0.8), (0.97, 0.6), (0.85, 0.9), (0.99, 0.5)]
    votes = np.stack([np.where(good, rng.random(len(good)) < g, rng.random(len(good)) >= b) for g, b in right], axis=1)
    spoken = rng.random(votes.shape) < 0.8
    patterns = Counter(tuple(int(v) if s else None for v, s in zip(a, b)) for a, b in zip(votes, spoken))
    prior, add = quality.fit(sorted(patterns.items(), key=str))
    from math import exp, log

    assert 1 / (1 + exp(-prior)) == pytest.approx(0.7, abs=0.05)
    for (g, b), (up, down) in zip(right, add):
        assert (up, down) == pytest.approx((log(g / (1 - b)), log((1 - g) / b)), abs=0.35)


def brute_copies(rows):
    keep: dict = {}
    for r in rows:
        keep.setdefault(r["text"] or "", []).append(r["doc_id"])
    return keep


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: (exact_dedup.F.length(c) % 3).cast("string")])
def test_exact_copies(spark, odd, docs, digest):
    for df in (odd, docs):
        payload = exact_dedup.F.col("text").cast("binary").alias("payload")
        got = exact_dedup.group_copies(df.select(exact_dedup.F.col("doc_id").alias("id"), payload), keep="max", digest=digest).collect()
        want = brute_copies(df.collect())
        assert len(got) == df.count()
        assert sum(r["kept"] for r in got) == len(want)
        assert Counter((r["keep_id"], r["n"]) for r in got if r["kept"]) == Counter((max((i for i in ids if i is not None), default=None), len(ids)) for ids in want.values())
        if digest is exact_dedup.sha256:
            assert exact_dedup.drop_copies(df).count() == len(want)


def test_index_merges_with_what_it_has(spark):
    """Two batches, compacted one after another, give one entry a digest; lookups find it by the filters."""
    index = exact_dedup.DigestIndex(spark, Scratch(spark, "t6").path("i"), "min")
    first = index.flush(spark.createDataFrame([(5, "a"), (7, "b"), (9, "b")], "id long, digest string"), 0)
    index.compact({0: first})
    second = index.flush(spark.createDataFrame([(3, "b"), (4, "c"), (None, "a")], "id long, digest string"), 1)
    got = {r["digest"]: (r["keep_id"], r["keep_batch"], r["n"]) for r in index.compact({1: second}).collect()}
    assert got == {"a": (5, 0, 2), "b": (3, 1, 3), "c": (4, 1, 1)} and index.entries().count() == 3
    found = index.find(["b", "zz"])
    assert [r["keep_id"] for r in found.collect()] == [3] and "PushedFilters: [In(digest" in found._jdf.queryExecution().toString()


def test_a_large_group_is_dealt_out(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, text string").select("id", exact_dedup.F.col("text").cast("binary").alias("payload"))
    got = {r["id"]: (r["keep_id"], r["n"], r["kept"]) for r in exact_dedup.group_copies(df, keep="max").collect()}
    assert got == {i: (899, 600, i == 899) if i % 3 else (i, 1, True) for i in range(900)}
    add_salt, salted = exact_dedup._salted(spark.createDataFrame([("d", 600)], "digest string, n long"), 900, spark)
    assert salted.count() == -(-600 // (900 // 32)) and add_salt(spark.range(600).selectExpr("'d' AS digest")).select("salt").distinct().count() > 10


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(5, "u", "ab\r\n\r\ncd é", 1), (3, "u", "ab\r\n\r\ncd é", 1), (3, "u", "ab\r\n\r\ncd é", 1), (7, None, None, 1), (2, "x\ny", "", 1), (9, "z", LONG, 1), (None, "n", "lone", 1)], "page_id long, url string, html string, digest int")
    scratch = Scratch(spark, "t7")
    warc.write_archives(pages, scratch.path("a"), scratch)
    got = warc.read_archives(spark, scratch.path("a")).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter([(3, "response", None), (3, "revisit", 3), (5, "revisit", 3), (2, "response", None), (7, "revisit", 2), (9, "response", None), (None, "response", None)])
    fields = [warc._fields(r["headers"]) for r in got]
    ids = Counter(f["WARC-Record-ID"] for f in fields)
    assert max(ids.values()) == 1 and all(f["WARC-Refers-To"] in ids for f in fields if f["WARC-Type"] == "revisit")
    assert {f["WARC-Target-URI"] for f in fields} == {"u", "", "x%0Ay", "z", "n"}
    back = warc.restore(spark, scratch.path("a")).collect()
    assert Counter(bytes(r["payload"]).decode() for r in back) == Counter(r["html"] or "" for r in pages.collect())
    assert Counter(r["headers"].rstrip() for r in back) == Counter(r["headers"] for r in got)
    scratch = Scratch(spark, "t7")
    warc.write_archives(pages.limit(0), scratch.path("b"), scratch)
    assert warc.read_archives(spark, scratch.path("b")).count() == 0


def test_warc_query(spark, sf):
    got = {r["page_id"]: r.asDict() for r in warc.op7_warc(spark, sf).collect()}
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first: dict = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for i, page in pages.items():
        data, lead = page.encode(), first[page]
        assert got[i] == {"page_id": i, "payload_bytes": len(data), "payload_digest": base64.b32encode(hashlib.sha1(data).digest()).decode(), "record_type": "response" if lead == i else "revisit", "refers_to": None if lead == i else lead}
    assert len(got) == len(pages)


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    weights, size = {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 10, "b": 1000, "c": 0, None: 100}
    want, full = {}, set()
    while True:  # stop at twice the size, share the rest by weight, until none is above
        rest = 1.5 * 1110 - sum(2 * size[s] for s in full)
        want = {s: 2 * size[s] if s in full else rest * w / sum(weights[x] for x in weights if x not in full) for s, w in weights.items()}
        above = {s for s in weights if s not in full and want[s] > 2 * size[s]}
        if not above:
            break
        full |= above
    assert got == pytest.approx(want)


def test_mix(spark, sf, odd, docs):
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd).columns == odd.columns
    first, second = (Counter(r["doc_id"] for r in mixing.mix(docs).collect()) for _ in range(2))
    assert first == second and max(first.values()) <= 2
    rows = mixing.op8_mix_sources(spark, sf).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: first[r["doc_id"]] * r["size"] for r in rows}
    size, source = {r["doc_id"]: r["size"] for r in rows}, {r["doc_id"]: r["source"] for r in docs.collect()}
    assert all(size[r["doc_id"]] == len((r["text"] or "").encode().split()) for r in docs.collect())
    for s in set(source.values()):
        mine = [r for r in rows if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2 + 1


def check_mix(rows, taken):
    """Each source's taken words are as near its target as its longest document allows, and no row is taken more than twice."""
    words = lambda t: len((t or "").encode().split())
    sizes, longest, got = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += words(r["text"])
        longest[r["source"]] = max(longest[r["source"]], words(r["text"]))
    for r in taken:
        got[r["source"]] += words(r["text"])
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weights = {x: (3, 1, 2)[i % 3] for i, x in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = left / sum(weights[x] for x in free)
        full = {x for x in free if share * weights[x] > 2 * sizes[x]}
        target |= {x: 2 * sizes[x] for x in full} if full else {x: share * weights[x] for x in free}
        left -= sum(target[x] for x in full)
        free = free - full if full else set()
    assert sum(got.values()) > 0
    for x in order:
        assert abs(got[x] - target[x]) <= longest[x], x
    key = lambda r: (r["doc_id"], r["text"], r["source"])
    there = Counter(map(key, rows))
    assert all(n <= 2 * there[k] for k, n in Counter(map(key, taken)).items())


def test_mix_of_odd_rows(spark, odd, docs):
    """Nulls, ties and repeated rows: rows of an id in a source are taken alike, sources without words give none."""
    for df in (odd, docs):
        check_mix(df.collect(), mixing.mix(df).collect())
    taken = Counter((r["doc_id"], r["text"]) for r in mixing.mix(odd).collect())
    rows = Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert all(n % rows[k] == 0 and n <= 2 * rows[k] for k, n in taken.items())


def test_expected_copies_differ(spark, docs):
    """Longer documents of a source are taken more often, and the expected words are the target."""
    sizes = mixing.measure(docs)
    plan = mixing.plan_sources(sizes, Scratch(spark, "t8")).toPandas()
    assert (plan.groupby("_s")["_expected"].nunique() > 1).any() and plan["_expected"].max() <= 2
    expected = sizes.join(plan_df := spark.createDataFrame(plan[["_s", "_class", "_expected", "target"]]), (mixing.F.col("source") == plan_df["_s"]) & (mixing.length_class(mixing.F.col("size")) == plan_df["_class"]))
    for r in expected.groupBy("source").agg(mixing.F.sum(mixing.F.col("size") * mixing.F.col("_expected")).alias("e"), mixing.F.max("target").alias("t")).collect():
        assert r["e"] == pytest.approx(r["t"])


def duck_rows(sf, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return con.execute(sql).df()


@pytest.mark.parametrize(("query", "sql"), [(exact_dedup.op6_exact_dedup, exact_dedup.OP6_SQL), (mixing.op8_mix_sources, mixing.OP8_SQL)])
def test_same_as_sql(spark, sf, query, sql):
    got, want = query(spark, sf).toPandas(), duck_rows(sf, sql)
    pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True)[sorted(got)], want.sort_values("doc_id", ignore_index=True)[sorted(want)], check_dtype=False)


#: Columns with names that the operators use themselves.
CLASHES = ["quality", "kept", "_words", "n_words", "_votes", "digest", "id", "n", "_gone", "gone", "row", "_expected", "_copies", "_s", "_class", "key", "of", "label", "length", "piece", "target", "size"]


@pytest.mark.parametrize("stage", [quality.keep_good, exact_dedup.drop_copies, near_dedup.drop_near_copies, mixing.mix])
def test_stages_leave_columns_alone(spark, odd, docs, stage):
    """Whatever their names, the columns of rows that stay come back as they were."""
    rows = docs.limit(60).unionByName(odd.where("doc_id IS NOT NULL").withColumn("doc_id", odd.doc_id + 5_000_000).drop("extra"), allowMissingColumns=True)
    extra = rows.withColumns({c: quality.F.concat(quality.F.lit(c), quality.F.col("doc_id").cast("string")) for c in CLASHES})
    got = stage(extra)
    assert got.columns == extra.columns and got.schema == extra.schema
    assert Counter(got.select(rows.columns).collect()) == Counter(stage(rows).collect())
    assert all(r[c] == f"{c}{r['doc_id']}" for r in got.collect() for c in CLASHES)
    assert stage(extra.limit(0)).count() == 0 and stage(odd).columns == odd.columns


def test_operators_leave_other_columns_unread(spark, docs):
    """Extra columns of any name change nothing."""
    rows = docs.select("doc_id", "text", "lang").limit(40)
    extra = rows.withColumns({c: quality.F.lit(1) for c in ["ids", "block", "class", "regs", "learn", "score", "start", "word", "_h", "_rank", "bucket"]})
    for run in (lambda d: packing.pack(d).select("doc_id", "piece", "length"), near_dedup.near_groups, lambda d: lm_score.scores(d, lm_score.F.lit(True))[0].select("doc_id", "n_tokens"), lambda d: language_id.identify(d, language_id.fit(d))):
        assert Counter(run(rows).collect()) == Counter(run(extra).collect())


def test_html(spark, odd):
    page = "<html><head><title>T</title></head><body><nav>Home</nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>One<b>two</b><br>three<p>Four &lt;</article><footer>F</footer>"
    assert [t for k, t in html_text.blocks(page) if k == "main"] == ["A & B", "Onetwo three", "Four <"]
    plain = [(i, f"http://h/{i}", f"<body><div>Welcome to our very nice site, all of you!</div><p>Text {i} is here once only {i}.</p>") for i in range(4)]
    rows = html_text.extract(spark.createDataFrame([*plain, (9, None, None), (10, "x", "")], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {**{i: f"Text {i} is here once only {i}." for i in range(4)}, 9: "", 10: ""}


def test_html_outside_articles(spark):
    notice = "All our readers get ten percent off every book"
    page = lambda i: f"<body><div>{notice} code{i}</div><div>Story {i} told once and for all {i}</div><article>Teaser {i}</article></body>"
    rows = html_text.extract(spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(4)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: f"code{i} Story {i} told once and for all {i} Teaser {i}" for i in range(4)}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_html_in_articles(spark):
    """A block of articles that half of the host's pages have goes; one that fewer have, and passages within blocks, stay."""
    page = lambda i: f"<article><p>Sign up for our letter today</p><p>Story {i} was told.</p>{'<p>Shared by some</p>' if i < 3 else ''}<p>All the same words in here but {i}</p></article>"
    rows = html_text.extract(spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {i: f"Story {i} was told. {'Shared by some ' if i < 3 else ''}All the same words in here but {i}" for i in range(8)}


def brute_repeats(pages):
    """Places of tokens outside articles in runs of RUN tokens or more (or whole shorter blocks) that so many pages of distinct content of a host have, by all substrings."""
    n = html_text.RUN
    seen: dict = {}
    for host, found in pages:
        i = tuple((k, *ws) for k, ws in found if k != "furniture")
        for k, ws in found:
            if k != "main":
                for a in range(max(1, len(ws) - n + 1)):
                    seen.setdefault((host, tuple(ws[a : a + n])), set()).add(i)
    out = []
    for host, found in pages:
        kept = []
        for k, ws in found:
            covered = set()
            if k == "other":
                for a in range(max(1, len(ws) - n + 1)):
                    if len(seen[host, tuple(ws[a : a + n])]) >= html_text.MIN_PAGES:
                        covered.update(range(a, min(len(ws), a + n)))
            if k != "furniture":
                kept.append(" ".join(w for j, w in enumerate(ws) if j not in covered))
        out.append(" ".join(x for x in kept if x))
    return out


@pytest.mark.parametrize("strip", [False, True])
def test_html_query(spark, sf, strip):
    """Whole pages against brute force, as they are and without the tags that name articles and furniture."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    if strip:
        for x in ("article", "nav", "footer", "aside", "main", "header", "form"):
            pages = pages.withColumn("html", html_text.F.regexp_replace("html", f"<(/?){x}\\b", "<$1div"))
        got = html_text.extract(pages)
    else:
        got = html_text.op9_html_text(spark, sf)
    rows = pages.orderBy("page_id").collect()
    want = brute_repeats([(html_text.host_of(r["url"]), [(k, t.split()) for k, t in html_text.blocks(r["html"])]) for r in rows])
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in got.collect()}
    assert found == {r["page_id"]: (r["url"], t, len(t)) for r, t in zip(rows, want, strict=True)}


def test_html_copies_keep_their_text(spark):
    """An article at three addresses of a host of four pages, with other furniture around, and equal pages without tags."""
    article = "<article><p>A story that is told here once.</p><p>And it goes on for a while longer.</p></article>"
    rows = [(i, f"http://h/a?x={i}", f"<div>Seen {i} times today by all of you</div>{article}") for i in range(3)] + [(3, "http://h/b", "<article><p>Another one</p></article>")]
    rows += [(10 + i, f"http://k/?s={i}", "<div>All of these words are on this page alone.</div>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story = "A story that is told here once. And it goes on for a while longer."
    assert all(story in got[i] for i in range(3)) and got[3] == "Another one"
    assert {got[10 + i] for i in range(3)} == {"All of these words are on this page alone."}


def test_html_of_odd_rows(spark):
    rows = [(1, "http://h/", None, 1), (1, "http://h/", None, 1), (2, None, "", 2), (3, "x", "<p>" + LONG, 3), (None, "y", "<b>a", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row int")
    got = html_text.extract(df).collect()
    assert Counter((r["page_id"], r["text"]) for r in got) == Counter([(1, ""), (1, ""), (2, ""), (3, LONG), (None, "a")])
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<a " * 200_000, '<a "' * 100_001, "<p>x" * 100_000 + "<a '", "<a b='" * 100_001 + ">", "<!--" * 100_000, "<b><" * 100_000])
def test_html_of_broken_pages_takes_linear_time(page):
    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("before", ["<form><datalist><option value=a><option value=b></datalist></form>", "<button>Go", "<svg><path d=x>", "<object>", "<noscript>No", "<div><iframe>x</div>", "<select><option>x</select>", "<template><article>No</article></template>"])
def test_html_unclosed(before):
    page = f"<body>{before}<article><p>One <button>x</button>two</p><select><option>y<option>z</select>three</article><div>Four<svg></div><p>Five</body>"
    assert html_text.blocks(page) == [("main", "One two"), ("main", "three"), ("other", "Four"), ("other", "Five")]


def test_language(spark, sf, odd, docs):
    got = language_id.op10_language_id(spark, sf).toPandas()
    real = pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]]
    held = got.merge(real, on="doc_id").query("held_out")
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert [bool(x) for x in got.held_out] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    model = (["de", "en"], language_id.np.full((len(language_id.pieces_of()) + 1, 2), 1e-4))
    out = language_id.identify(odd, model).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in out) == Counter((i, "de" if any(map(str.isalpha, t or "")) else "und") for i, t, *_ in ODD)
    assert language_id.identify(odd.limit(0), model).count() == 0
    assert language_id.fit(odd.limit(0))[0] == [] and {r["lang_pred"] for r in language_id.identify(odd, language_id.fit(odd.where("lang IS NULL"))).collect()} == {"und"}


def test_language_sample_is_bounded(spark, docs, monkeypatch):
    """However many labelled rows there are, so many of each language reach the fit."""
    monkeypatch.setattr(language_id, "fit_language", lambda words, pieces: language_id.np.full(pieces.n, float(sum(words.values()))))
    _, p = language_id.fit(docs.withColumn("text", language_id.F.lit("one word")), sample=7)
    assert (p[:-1] == 14).all()


def brute_log(word, index, p):
    """The sum over all segmentations, one character at a time, in exact fractions of logarithms."""
    from math import exp, log

    marked = "▁" + word
    out = []
    for lang in range(p.shape[1]):
        a = [float("-inf")] * (len(marked) + 1)
        a[0] = 0.0
        for i in range(len(marked)):
            for j in range(i + 1, min(len(marked), i + 20) + 1):
                part = marked[i:j]
                q = p[index[part], lang] if part in index else p[-1, lang] if j == i + 1 else 0
                if q:
                    x, y = a[i] + log(q), a[j]
                    a[j] = max(x, y) + log(1 + exp(-abs(x - y))) if y > float("-inf") else x
        out.append(a[-1])
    return out


def test_forward_sums_all_segmentations():
    np = language_id.np
    names = ["▁a", "a", "▁", "b", "ab", "▁ab"]
    p = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2], [language_id.UNKNOWN]])
    want = 0.2 + 0.1 * 0.15 + 0.3 * 0.05 + 0.3 * 0.2 * 0.15
    assert language_id.log_probabilities(["ab"], language_id.Pieces(names), p)[0, 0] == pytest.approx(np.log(want))


def test_forward_on_real_pieces_and_long_words():
    """Words of any length, in any company, against brute force; very unlikely ones don't underflow."""
    np = language_id.np
    names = language_id.pieces_of()
    index = {x: i for i, x in enumerate(names)}
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.dirichlet(np.full(len(names), 0.05), 2).T + 1e-9, np.full((1, 2), language_id.UNKNOWN)])
    words = ["the", "zusammengehörigkeit", "x" * 60, "日本語", "\U0001f600a", "a\0b", "z" * 700, "tion" * 300, *("".join(rng.choice(list("abcdeéß"), k)) for k in range(1, 120))]
    got = language_id.log_probabilities(words, language_id.Pieces(names), p)
    for w, row in zip(words, got, strict=True):
        assert row.tolist() == pytest.approx(brute_log(w, index, p), rel=1e-9)


def test_forward_on_a_text_without_spaces():
    """One word of 150,000 characters, by plain scaled sums; time grows with the length."""
    np = language_id.np
    names = ["▁a", "a", "▁", "b", "ab", "▁ab", "ba"]
    p = np.array([[0.1, 0.2], [0.2, 0.1], [0.2, 0.1], [0.15, 0.1], [0.05, 0.3], [0.2, 0.1], [0.1, 0.1], [language_id.UNKNOWN] * 2])
    word = "".join(np.random.default_rng(3).choice(list("abc"), 150_000))
    began = time.process_time()
    got = language_id.log_probabilities([word, "ab"], language_id.Pieces(names), p)
    assert time.process_time() - began < 60
    index, marked = {x: i for i, x in enumerate(names)}, "▁" + word
    for lang in range(2):
        sums, scale = [1.0, 0.0, 0.0, 0.0], 0.0  # ways to the next places
        for i in range(len(marked)):
            here = sums[0]
            if here < 1e-100:
                sums, scale = [x * 1e100 for x in sums], scale - 100 * np.log(10)
                here = sums[0]
            for k in range(1, 4):
                part = marked[i : i + k]
                q = p[index[part], lang] if part in index and i + k <= len(marked) else p[-1, lang] if k == 1 else 0
                sums[k] += here * q
            sums = [*sums[1:], 0.0]
        assert got[0, lang] == pytest.approx(np.log(sums[0]) + scale, rel=1e-9)
    assert got[1].tolist() == pytest.approx(brute_log("ab", index, p), rel=1e-9)


def test_expected_pieces():
    """Expected counts are what changes of a piece's probability do to the likelihood."""
    np = language_id.np
    pieces = language_id.Pieces(["▁a", "a", "▁", "b", "ab", "▁ab"])
    p = np.array([0.1, 0.2, 0.3, 0.15, 0.05, 0.2, language_id.UNKNOWN])
    words, n = ["ab", "aab", "cab", "ab" * 90], np.array([3.0, 1.0, 2.0, 1.0])
    got = pieces.lattice(words).expected(p, n)
    like = lambda q: (language_id.log_probabilities(words, pieces, q[:, None])[:, 0] * n).sum()
    for k in range(len(p)):
        step = p[k] * 1e-5
        up, down = p.copy(), p.copy()
        up[k] += step
        down[k] -= step
        assert got[k] == pytest.approx((like(up) - like(down)) / (2e-5), rel=1e-4, abs=1e-6)


def test_counts_of_votes_split_texts_once(spark):
    """Votes that are not yet written are counted without repeating the measures."""
    voted = quality.vote(spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60))), (2, "few words"), (3, None)], "doc_id long, text string"))
    splits = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert splits(quality._counts(voted)) <= splits(voted)
    passed = Counter(r["_votes"] for r in voted.collect() if not r["base_failed"])
    assert {r["_votes"]: r["n"] for r in quality._counts(voted).collect()} == passed and sum(passed.values()) == 1


def test_pipeline(spark, sf, docs):
    """Each stage by brute force on what the one before it kept."""
    import corpus_pipeline

    stages, now = dict(corpus_pipeline.STAGES), docs
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    voted = quality.vote(docs)
    kept = {r["doc_id"] for r in quality.judge(voted, quality.learn(voted)).collect() if r["kept"]}
    now = Scratch(spark, "tp").write(stages["quality"](spark, now, sf), "a")
    assert set(texts(now)) == kept and now.columns == docs.columns
    want = {max(ids) for ids in brute_copies(now.collect()).values()}
    now = Scratch(spark, "tp").write(stages["exact"](spark, now, sf), "b")
    assert set(texts(now)) == want
    want = {i for i, (_, label) in brute_components(list(texts(now).items())).items() if i == label}
    now = Scratch(spark, "tp").write(stages["near"](spark, now, sf), "c")
    assert set(texts(now)) == want
    once = texts(now)
    now = Scratch(spark, "tp").write(stages["mixed"](spark, now, sf), "d")
    times = Counter(r["doc_id"] for r in now.collect())
    assert set(times) <= set(once) and max(times.values()) <= 2 and now.columns == docs.columns
    ids_of = brute_ids()
    n_ids = {i: len(ids_of(once[i])) + 1 for i in times}
    got = stages["packed"](spark, now, sf).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == {i: n_ids[i] * n for i, n in times.items()}
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.run(spark, sf).count() == len(got)
