"""Cutting and remembering of the encoder, against the regex library and the tokenizer."""

import random

import public_tokenizers
import regex
from tokenizers import Tokenizer

from tracelantern.llm import tokens


def test_pieces_of_any_characters():
    rnd = random.Random(16)
    chars = [chr(k) for k in range(0x30000) if not 0xD800 <= k < 0xE000]
    plane = [c for c in chars if c < "\U00010000"]
    texts = ["".join(plane), "".join(chars), *("".join(rnd.choices(plane, k=300)) + " it's  9\n" for _ in range(500))]
    want = regex.compile(tokens.BYTE_LEVEL.replace(r"\s", tokens.SPACE)).findall
    cut = tokens.Cutter(tokens.BYTE_LEVEL)
    assert [cut(t) for t in texts] == [want(t) for t in texts]


def test_remembered_texts_are_not_learnt_again(monkeypatch):
    path, learnt = public_tokenizers.path("byte_bpe_50k.json"), []
    encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    learn = tokens.Encoder._learn
    monkeypatch.setattr(tokens.Encoder, "_learn", lambda self, pieces: learnt.append(set(pieces)) or learn(self, pieces))
    texts = ["a word, a word", "", "naïve café 12", "a word"]
    want = [b"".join(k.to_bytes(4, "little") for k in plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert encoder.all(texts) == want and encoder.all(texts) == want
    assert encoder.all(["a word", "other"])[0] == want[3]
    assert len(learnt) == 2 and learnt[1] == {"other"}
