"""What the secret scan learns from is bounded by row, however long a finding is."""

import tracemalloc

import numpy as np

from resonar.llm.secrets import WINDOW, CharNetwork, Findings, labelled, scan_texts


def test_a_finding_of_ten_megabytes_is_learnt_from_in_bounded_room():
    text = "key = " + "0123456789abcdef" * 650_000 + " and token: abcdefghij0123456789"
    rows = labelled(text)
    assert sum(r[3] for r in rows) == 2 and max(len(r[1]) for r in rows) == 10 * WINDOW
    model = CharNetwork(1)
    batch = Findings.of([r[:3] for r in rows] * 32)
    tracemalloc.start()
    model.gradient(batch, np.ones(len(batch)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30


def test_long_findings_are_scored_whole():
    long = "f0" * 150_000
    model = CharNetwork(1)
    ((base, every, _),) = scan_texts([f"x {long} y"], model, 2.0)
    assert base == every == [(2, 2, 2 + len(long))]
    # one by one or beside others, the answer for a run is the same
    some = [f"x {long[:k]}zz{k} y" for k in (40, 900, 5000)]
    alone = [model.raw(Findings.of([("x ", t[2:-2], " y")]))[0] for t in some]
    both = model.raw(Findings.of([("x ", t[2:-2], " y") for t in some]))
    assert np.allclose(alone, both)
