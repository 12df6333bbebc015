import random

import numpy as np
import pyarrow as pa

from resonar.functions import batch, optimal, scorers


def _random(rng, letters, least, most):
    return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))


def test_batches_score_as_the_twins_do():
    rng = random.Random(3)
    texts = [None, "", "İstanbul", "i̇x"] + [_random(rng, rng.choice(("abAB/_ 1.\x0b", "abéİiαΣ ñ1/")), 0, 24) for _ in range(3000)]
    own = batch.Texts(pa.array(texts, pa.string()))
    for pattern in ("a", "ab", "aB", "A1", "b/a", "aab", "é", "İ", "i", "ba_b1", "\x0b"):
        for cased in (False, True):
            for name, (_, twin) in batch.SCORERS.items():
                rows, got = batch.scores(name, pattern, own, cased)
                want = {k: x for k, t in enumerate(texts) if t is not None and (x := twin(pattern, t, cased)) is not None}
                assert dict(zip(rows.tolist(), got.tolist(), strict=True)) == want, (name, pattern, cased)
    sliced = batch.Texts(pa.array(texts, pa.string()).slice(7, 50))
    rows, got = batch.scores("greedy", "a", sliced, False)
    assert dict(zip(rows.tolist(), got.tolist(), strict=True)) == {k: x for k, t in enumerate(texts[7:57]) if (x := scorers.greedy_python("a", t)) is not None}


def test_best_alignment_equals_the_recurrence_on_long_rows():
    rng = random.Random(4)
    texts = [_random(rng, "abc/", 1, 400) for _ in range(200)]
    rows, got = batch.best_alignment("abca", batch.Texts(pa.array(texts)), False)
    assert rows.tolist() == sorted(rows.tolist()) and got.tolist() == [optimal.score_python("abca", texts[k]) for k in rows]


def test_columns(spark):
    texts = ["src/main.rs", "README.md", None, "наука read", "rd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.s for r in df.select("id", batch.score_column("greedy", "rd", df.t, False).alias("s")).collect()}
    assert got == {k: None if t is None else scorers.greedy_python("rd", t) for k, t in enumerate(texts)}
    assert np.array_equal(batch._BONUS[3], np.zeros(6))
