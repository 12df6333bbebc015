"""What a worker holds while it tokenises is bounded, whatever the batch."""

import random
import tracemalloc

import pyarrow as pa
import public_tokenizers

from resonar.llm import packing

from .helpers import prose

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_words_of_all_texts_are_not_held_at_once():
    rng = random.Random(5)
    known = prose(rng, 2000).encode()
    packing.tokens_of(WORDS, [known])
    # one new word in each text, so that all of them wait for it
    texts = [b"new%d " % k + b" ".join([known] * 10) for k in range(12)]
    tracemalloc.start()
    got = packing.tokens_of(WORDS, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = packing._loaded[WORDS][0]
    assert b"".join(got[3:4]) == packing._packed(own.encode(texts[3].decode(), add_special_tokens=False).ids)
    # the texts' own ids, and the words of one text or two
    assert peak < sum(map(len, got)) + 4 * len(texts[0]) * 8


def test_batches_are_worked_off_in_slices_and_remembered_words_are_bounded(monkeypatch):
    seen, real = [], packing.binary_column
    monkeypatch.setattr(packing, "binary_column", lambda batch: (seen.append(batch.num_rows), real(batch))[1])
    packing._tokenizer(WORDS)
    own, _, last, marks = packing._loaded[WORDS]
    cache = packing.WordCache(packing.HALF)
    monkeypatch.setitem(packing._loaded, WORDS, (own, cache, last, marks))
    n = 5 * packing.ROWS + 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([f"only{k} here" for k in range(n)])], names=["doc_id", "text"])
    out = pa.Table.from_batches(list(packing._cut(WORDS, 4096, 1, False, 500)([batch])))
    assert max(seen) <= packing.ROWS and sum(seen) == n
    assert out.column("doc_id").to_pylist() == list(range(n))
    # the words of two slices, whole and without their ends
    assert len(cache) + len(cache.old) <= 4 * packing.ROWS + 1000
