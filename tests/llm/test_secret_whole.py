"""The secret scan learns, and sets its threshold, from all findings of all rows."""

import random

import numpy as np

from resonar.llm import secrets

from .helpers import frame


def _rows(n):
    rng = random.Random(5)
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    return [(k, f'{some("aeioulnrst", 13)} and token = "{some("0123456789abcdef", 24)}" then {some("aeioulnrst", 5)}') for k in range(n)]


def test_a_row_gives_all_of_its_findings():
    text = " ".join(t for _, t in _rows(50))
    found = secrets.labelled(text)
    assert sum(r[3] for r in found) == 100 and sum(not r[3] for r in found) == 50  # each token is hexadecimal too


def test_a_long_plain_run_is_a_finding():
    assert [(r[3], len(r[1])) for r in secrets.labelled("x " + "xy" * 5000 + " y")] == [(0, 10 * secrets.WINDOW)]


def test_a_table_gives_all_of_its_findings_once(spark):
    rows = _rows(2000)
    docs = frame(spark, rows + rows[:300])
    found = secrets.labelled_rows(docs).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in found} == {0: 2000, 1: 2000}  # one value for both patterns


def test_training_does_not_depend_on_the_layout(spark):
    docs = frame(spark, _rows(300), clash=False)
    (one, a), (two, b) = (secrets.trained(docs.repartition(n), group=100) for n in (1, 7))
    assert np.allclose(one.flat(), two.flat(), atol=1e-9) and abs(a - b) < 0.01
    whole, _ = secrets.trained(docs)
    assert not np.allclose(one.flat(), whole.flat(), atol=1e-3)  # a mean of several groups


def test_the_threshold_counts_every_finding_kept_apart():
    model = secrets.begun(made=200, epochs=1)
    counts = np.zeros((2, 2 * secrets.FAR * secrets.STEP + 1), np.int64)
    counts[1, 9000] = 10**9
    counts[1, 11000] = 10**9
    z = np.arange(counts.shape[1]) / secrets.STEP - secrets.FAR
    low = secrets.settle(model, counts)
    assert low <= model.likely(z[9000])
