"""Packing gives the tokenizer's own ids for texts that hold an added token."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logloom.llm import packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_added_tokens_are_matched():
    plain, own = Tokenizer.from_file(BPE), packing.TokenIds(BPE)
    assert np.frombuffer(own.whole("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    rnd = random.Random(4)
    alphabet = [" ", "  ", "\n", "\t", "a", "Be", "é", "1", "'s", "!", "<|", "|>", "中", "😀", "<|endoftext|>", "̈"]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(14)))
        assert own.whole(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_hold_added_tokens(spark):
    plain = Tokenizer.from_file(BPE)
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 3), (3, "plain words")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), BPE, with_ids=True).collect()
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found}
    assert ids == {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}


@pytest.mark.parametrize("words_at_once, long_text", [(1 << 18, 1 << 24), (3, 6)])
def test_joined_texts_have_the_tokenizers_ids(monkeypatch, words_at_once, long_text):
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", words_at_once)
    monkeypatch.setattr(packing, "LONG_TEXT", long_text)
    plain, own, rnd = Tokenizer.from_file(BPE), packing.TokenIds(BPE), random.Random(6)
    own.words.limit = own.bare.limit = 20
    alphabet = [" ", " ", " ", "\n", "\t", "\xa0", "a", "Be", "é", "1", "'s", "!", "),", "中", "😀", "<|endoftext|>", "̈", "ſ", "\0"]
    for _ in range(150):
        texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(14))) for _ in range(rnd.randrange(25))]
        ids, counts = own.joined(texts)
        want = [plain.encode(text, add_special_tokens=False).ids for text in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_of_joined_texts_are_encoded_once():
    """However few words are kept: 40 words in 400 texts are 40 calls of the model, and the first words."""
    own, calls = packing.TokenIds(BPE), []
    own.words.limit = own.bare.limit = 5

    class Model:
        def tokenize(self, letters, real=own.model):
            calls.append(letters)
            return real.tokenize(letters)

    own.model = Model()
    words = ["".join(random.Random(k).choices("abcdefgh", k=9)) for k in range(40)]
    texts = [" ".join(["Start", *random.Random(k).sample(words, 30)]) for k in range(400)]
    ids, counts = own.joined(texts)
    assert len(counts) == 400 and len(calls) == 41
