"""SentencePiece by the prefix table, against the library."""

import functools
import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemolake.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def both():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH), pieces.PiecePrefix(PATH)


def same(text):
    lib, own = both()
    ids = lib.encode(text, add_eos=True)
    got = own.encode(text)
    assert got == pieces.pack_ids(ids) and own.spelled(got) == " ".join(map(str, ids)) and own.decode(got) == lib.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text(" ▁\n\t\r ab", max_size=40), st.text("etaoinshrdlu ETAOI'.,-", max_size=60), st.text("aábß日本語한국어नी́😀\0", max_size=30)))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "  lead", "trail  ", "\n\n x\n", " " * 300, "▁▁ ▁", "a" * 3000, "ab" * 1500, "<s> </s><unk><0x0A>", "\0", "don't stop", "=" * 700, "\t" * 90, "  \n" * 50])
def test_odd_texts(text):
    same(text)


def test_rows_of_random_pieces():
    lib, _ = both()
    rng = random.Random(8)
    for _ in range(1500):
        same("".join(lib.id_to_piece(rng.randrange(259, 32000)) for _ in range(rng.randint(2, 12))).replace("▁", rng.choice(["", " ", "▁"])))


def test_every_piece_alone_and_every_cut_of_it():
    lib, own = both()
    rng = random.Random(4)
    for i in rng.sample(sorted(own.text), 3000):
        same(own.text[i])


def test_documents(spark, docs, none):
    lib, _ = both()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = pieces.encode_documents(docs, PATH, with_ids=True).collect()
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)), ids))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert pieces.encode_documents(none, PATH).count() == 0
    plan = pieces.encode_documents(docs, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_other_models_are_refused(monkeypatch):
    import sentencepiece

    class Other(sentencepiece.SentencePieceProcessor):
        def is_unused(self, i):
            return i == 500

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="unused"):
        pieces.PiecePrefix(PATH)
