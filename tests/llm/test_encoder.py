"""The encoder against the library on whole texts."""

import random

import pyarrow as pa
import pytest

from weirgate.llm.tokens import Encoder, vocabulary_path


class Counted:
    """A tokenizer that counts the texts it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.n = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.n += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


@pytest.mark.parametrize("odd", [[], ["a<|endoftext|>b", "<|endoftext|>", "<|endof"], ["﻿x", "\x00", "é", "'s", "don't\n", "\r\n\tz", "中文。\n\n", "🙂🙂", "x ", "12.50%"]])
def test_new_runs_go_joined(odd):
    """Thousands of new runs reach the library as a few texts, and every text has its ids, whatever stands beside what."""
    pick = random.Random(3)
    runs = ["".join(pick.choice("abcdeéßñ.,\n") for _ in range(pick.randrange(1, 12))) for _ in range(4000)]
    runs = [x for x in runs if not x[0].isspace()] + odd * 20
    pick.shuffle(runs)
    texts = [" ".join(runs[k : k + 40]) for k in range(0, len(runs), 40)] + [*odd, "", " ", "a  b", "a ", None, " <|endoftext|> a"]
    encoder = Encoder(vocabulary_path())
    want = [x.ids for x in encoder.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    encoder.tokenizer = Counted(encoder.tokenizer)
    got = []
    for _, _, ids, n in encoder.encode(pa.array(texts), 7):
        ends = n.cumsum()
        got += [ids[b - k : b].tolist() for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
    assert got == [[*x, 7] for x in want]
    assert encoder.tokenizer.n < len(texts) + 50
