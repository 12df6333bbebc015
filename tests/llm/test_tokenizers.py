"""Ids against both libraries, on texts made to part the fast ways from them."""

import random
import unicodedata

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from resonar.llm.packing import token_bytes
from resonar.llm.sentencepieces import SHORT, PieceEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _word_ids(text):
    return np.frombuffer(token_bytes(WORDS, text.encode()), "<u4").tolist()


def _texts(rng, n):
    marks = ",.;:!?*%$#&|'\"<>-_=+/\\()[]~^`@"
    pool = [*"abcdeABCxyzéÉßİıſΣςñ中日ко한 \n\t0123", *marks, "́", "̸", "​", "\xa0", "'s", "'LL", "  ", "▁", "<|endoftext|>", "<|StartOfText|>", "the", "ing"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_packing_ids_equal_the_tokenizer_with_its_own_settings():
    own = Tokenizer.from_file(WORDS)
    texts = ["İ.", "a<|endoftext|>b", "<|endoftext|> a", "<|ENDOFTEXT|>.", "A<|endoftext|>.", "don't stop!!! it's |x| 3.5%", *_texts(random.Random(5), 3000)]
    for text in texts:
        assert _word_ids(text) == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_ids_of_every_letter_before_punctuation():
    own = Tokenizer.from_file(WORDS)
    letters = [chr(k) for k in (*range(0x20, 0x3100), *range(0x3100, 0x30000, 9)) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"]
    for marks in (".", "!?", "*"):
        words = [f"a{c}{marks} {c}{marks}" for c in letters]
        for text, want in zip(words, own.encode_batch_fast(words, add_special_tokens=False), strict=True):
            assert _word_ids(text) == want.ids, ascii(text)


def test_agenda_equals_the_library():
    own, library = PieceEncoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(6)
    texts = [*_texts(rng, 3000), " " * 40, "x" * (3 * SHORT), "ab" * SHORT, "thethethe" * 9, "\n\n a\n", "▁▁a ▁b"]
    for text, data in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(data, "<i4").tolist() == library.encode(text), repr(text)
    assert own.corrected == 0


def test_matrix_and_heap_merge_alike():
    own = PieceEncoder(PIECES)
    rng = random.Random(7)
    chunks = ["▁" + "".join(rng.choice("aeinrstlothé中") for _ in range(rng.randint(1, SHORT - 1))) for _ in range(2000)]
    assert [np.frombuffer(x, "<i4").tolist() for x in own._merge_all(chunks)] == [own.merge(c) for c in chunks]
