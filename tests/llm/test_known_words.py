"""Words of packing are looked up all at once, within a bound, and get the library's ids."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mnemolake.llm import packing


def test_new_words_are_made_in_one_go_and_few_are_held(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, library, calls = packing.WordTokens(path), Tokenizer.from_file(path), []
    for known in (tokens.chunks, tokens.words):
        monkeypatch.setattr(known, "make", lambda keys, make=known.make: (calls.append(len(keys)), make(keys))[1])
    random.seed(4)
    parts = ["Über", "l'été", "don't", "x9", "--", "…", "a" * 70, "ERÖ", "z.", "\n\n", "\t", " ", "", "señor", "'ll", "1234"]
    for n in range(12):
        texts = ["".join(random.choice(parts) + random.choice(["", " ", "\n", "é"]) for _ in range(random.randrange(40))) for _ in range(20)]
        texts += ["", " ", "\r\n", "word" + str(n), "<|endoftext|> x", "中文 text"]
        got = tokens.encode_all(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(calls) <= 2 * (n + 1)  # chunks once, words once
        assert len(tokens.chunks) <= 60 and len(tokens.words) <= 60


def test_the_half_asked_for_last_stays():
    import pyarrow as pa

    made = []

    def make(keys):
        made.extend(keys.to_pylist())
        return np.full(len(keys), 2, np.int64), np.repeat(np.array([int(k) for k in keys.to_pylist()], "<u4"), 2)

    known = packing.Known(make, 4)
    ask = lambda *keys: known(pa.array([str(k) for k in keys], pa.large_string()))[1].tolist()
    assert ask(1, 2, 3) == [1, 1, 2, 2, 3, 3]
    assert ask(2) == [2, 2] and made == ["1", "2", "3"]
    assert ask(4, 5) == [4, 4, 5, 5] and len(known) == 2
    assert ask(5, 2, 4) == [5, 5, 2, 2, 4, 4] and made == ["1", "2", "3", "4", "5", "2"]
    assert ask() == []
