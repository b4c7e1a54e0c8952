"""Ids of whole texts."""

import numpy as np
import public_tokenizers
import pytest

from hicweave.llm import tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "one two  three", " \n\t\n a  b\x1c\x1d c ", "it's we'll 12 345!? ..", "　　x  y\x85", "señor ñandú 漢字 かな\U0001f600 \x00", "<|endoftext|> a<|endoftext|>", " " * 300 + "x", "ab1 " * 500]


@pytest.mark.parametrize("long", [1 << 18, 3])
def test_ids_are_the_librarys(monkeypatch, long):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "LONG", long)
    coder, library = tokens.Ids(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for t in TEXTS:
        assert np.frombuffer(coder(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_a_text_is_encoded_at_once(monkeypatch):
    import tiktoken

    calls, encode = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, t: calls.append(t) or encode(self, t))
    tokens.Ids(VOCABULARY)("one two three\nfour")
    assert calls == ["one two three\nfour"]
