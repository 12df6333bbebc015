"""Pieces of the sorted vocabulary are bounded however many words begin alike, and their counts are those of all words."""

import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from resonar.llm import bit_model, lm_scoring

from .helpers import frame, prose
from .test_lm import _seen_by_brute_force


def _cut(counts, cuts):
    """Borders whose edges were counted in parts, and the words of each piece."""
    borders = bit_model.Borders(cuts)
    words = sorted(counts)
    random.Random(3).shuffle(words)
    got = [borders.edges(words[k : k + 50], np.array([counts[w] for w in words[k : k + 50]])) for k in range(0, len(words), 50)]
    borders.set_edges(*bit_model.summed(*(np.concatenate(x) for x in zip(*got, strict=True))))
    pieces = {}
    for w, p in zip(words, borders.pieces(words).tolist(), strict=True):
        pieces.setdefault(p, []).append(w)
    return borders, pieces


def test_counts_of_pieces_equal_brute_force():
    rng = random.Random(2)
    some = lambda: "".join(rng.choice("abé!") for _ in range(rng.randint(1, 9)))
    counts = {f"{'and' if rng.random() < 0.5 else ''}{some()}".encode(): rng.randint(0, 9) for _ in range(600)}
    counts |= {b"a\x01": 4, b"a": 2, b"\n": 7, b"a\0": 1, b"x" * 500: 1, b"x" * 500 + b"y": 3, b"x" * 200: 2}
    want = _seen_by_brute_force(counts)
    keys = sorted((w + b" ")[: bit_model.CUT] for w in counts)
    for cuts in (sorted(set(keys[7::7])), sorted(set(keys)), [b"and"], [b"anda", b"andab", b"andb "], []):
        borders, pieces = _cut(counts, cuts)
        for parts in (1, 3):
            for part in range(parts):
                own = [w for p, words in pieces.items() if p % parts == part for w in words]
                got, n, seen = borders.in_order(own, np.array([counts[w] for w in own], np.int64))
                assert got == sorted(own, key=lambda w: w + b" ") and n.tolist() == [counts[w] for w in got]
                at = 0
                for w in got:
                    bits = "".join(f"{b:08b}" for b in w + b" ")
                    for k in range(len(bits)):
                        assert seen[k % 8, at + k // 8].tolist() == [want[bits[:k] + "0"], want[bits[:k] + "1"]], (w, k)
                    at += len(w) + 1


def test_words_that_begin_alike_are_dealt_over_parts(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(f"and{rng.randrange(10**9)}" for _ in range(100))) for k in range(60)]
    docs = frame(spark, rows, clash=False)
    vocabulary = docs.select(F.lit(False).alias("held_out"), "text").mapInArrow(lm_scoring._count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).cache()
    borders = lm_scoring._borders(vocabulary, vocabulary, 1000)
    size = Counter(borders.pieces([bytes(r.word) for r in vocabulary.collect()]).tolist())
    assert vocabulary.count() > 5900 and max(size.values()) < 600 and len(size) > 10


def test_scores_do_not_depend_on_the_layout_with_many_pieces(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, 60)) for k in range(100)]
    got, again = ({r.doc_id: r.score for r in lm_scoring.score_documents(frame(spark, rows).repartition(n), part_words=200).collect()} for n in (2, 7))
    assert got == again
