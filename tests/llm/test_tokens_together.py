"""Words are learnt, and chunks looked up, for many texts at once."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from resonar.llm import packing, token_files

from .helpers import documents, prose

WORDS, BYTES = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))


def _texts():
    import random

    rng = random.Random(3)
    odd = ["a<|endoftext|>b", "Éa, É. x-1 (942) .&&& 555-2028", "Åİ ab", "a  b\n\nc\td", "\xa0x y"]
    return [t or "" for _, t in documents()] + odd + [prose(rng, 300).upper() for _ in range(5)]


def test_new_words_of_many_texts_are_learnt_in_one_call(monkeypatch):
    texts = [t.encode() for t in _texts()]
    packing._tokenizer(WORDS)
    own, _, last, marks = packing._loaded[WORDS]
    monkeypatch.setitem(packing._loaded, WORDS, (own, packing.WordCache(packing.HALF), last, marks))
    calls, learn = [], packing._learn
    monkeypatch.setattr(packing, "_learn", lambda path, words: (calls.append(len(words)), learn(path, words)))
    got = packing.tokens_of(WORDS, texts)
    assert len(calls) == 1
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.encode(t, add_special_tokens=False).ids for t in _texts()]
    assert packing.tokens_of(WORDS, texts) == got and len(calls) == 1


def test_signs_are_looked_for_only_where_their_bytes_are():
    assert token_files._present([b"ab", b"c  d"], (b"  ", b"\xc2\xa0", b"bc", b"ab")) == [b"  ", b"ab"]
    own = Tokenizer.from_file(BYTES)
    got = token_files._tokenizer(BYTES).ids([t.encode() for t in _texts()])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.encode(t, add_special_tokens=False).ids for t in _texts()]
