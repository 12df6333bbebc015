import numpy as np
import pytest

from pyspark.sql import functions as F

from resonar.llm.common import Scratch
from resonar.llm.embedding_dedup import BITS, _CODED, _cells, _encode, _split, _windows, near_vectors


class Counted(Scratch):
    """Fails where the rounds do not end."""

    def save(self, df, name, codec=None):
        assert self.count < 30, "the same run is looked at again and again"
        return super().save(df, name, codec)


@pytest.mark.parametrize("shared", [1, 4, 5, 8])
def test_a_run_a_little_too_long_goes_deeper(spark, shared):
    # of 40 keys all bits differ but the first ones, so that what differs is a power of two less one
    rng = np.random.default_rng(shared)
    keys = (np.int64(1) << (BITS - shared)) + rng.integers(0, 1 << (BITS - shared), 40)
    keys[:2] = (1 << (BITS - shared)), (2 << (BITS - shared)) - 1
    df = spark.createDataFrame([(0, 1, 8, int(k), n) for n, k in enumerate(keys)], "pass int, label long, size int, key long, node long")
    got = _windows(df, 32, Counted(spark, "windows")).groupBy("depth", "start", "block", "cut").agg(F.collect_list("node").alias("nodes")).collect()
    assert sorted(n for r in got for n in r.nodes) == list(range(40))
    assert all(len(r.nodes) <= 32 and not r.cut and r.depth > shared for r in got)
    assert all(int(keys[n]) >> (BITS - r.depth) == r.start for r in got for n in r.nodes)


def test_windows_of_sorted_keys():
    rng = np.random.default_rng(6)
    for window in (1, 3, 16):
        key = np.sort(np.concatenate((rng.integers(0, 1 << BITS, 300), rng.integers(0, 64, 60), np.full(40, 5))))
        got = list(_split(key, 0, window))
        assert [x[0] for x in got] == [0, *(x[1] for x in got[:-1])] and got[-1][1] == len(key)
        for lo, hi, depth in got:
            assert hi - lo <= window
            if depth is None:
                assert key[lo] == key[hi - 1] and (key == key[lo]).sum() > window
            else:  # all keys with these bits, and one bit less would be too many
                assert ((key >> (BITS - depth)) == key[lo] >> (BITS - depth)).sum() == hi - lo
                assert depth == 0 or ((key >> (BITS - depth + 1)) == key[lo] >> (BITS - depth + 1)).sum() > window
    assert list(_split(key, 0, 400)) == [(0, 400, 0)]


def _by_brute_force(rows):
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    least = np.arange(len(rows))
    while True:
        now = np.minimum(least, np.where(near, least, len(rows)).min(axis=1))
        if (now == least).all():
            return [(k, int(near[k].sum()), int(least[k])) for k in range(len(rows))]
        least = now


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_of_a_narrow_cone(spark, kind):
    # all keys begin alike, so that cells are crowded and parted by the counts; some keys are equal
    rng = np.random.default_rng(7)
    cone = 3 * rng.normal(size=12)
    base = cone + rng.normal(size=(60, 12))
    rows = [v + 0.05 * rng.normal(size=12) for v in base for _ in range(rng.integers(1, 9))] + [base[0] + 1e-6 * rng.normal(size=12) for _ in range(90)]
    rows = [(k, v.astype(np.float32 if kind == "float" else np.float64).tolist(), k % 2) for k, v in enumerate(rows)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df, window=8, most=12, many=6, block=32).collect())
    assert got == _by_brute_force(rows)


def test_vectors_keep_their_values(spark):
    rows = [(0, [1, 2, -3], 1), (1, [2, 4, -6], 1), (2, [1, 2, 3], 1), (3, [0, 0, 0], 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<int>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True), (3, 0, 3, True)]
    # at lengths that a float does not hold, and so written at two widths within one label
    rows = [(0, [0.1, 0.2, 1e300], 1), (1, [0.0, 0.0, 1.0], 1), (2, [1e-300, 0.0, 0.0], 1), (3, [0.5, 0.0, 0.0], 1), (4, [-0.0, 0.0, 2.0], 1), (5, [0.0, float("inf"), 1.0], 1), (6, [0.0, None, 1.0], 1), (7, None, 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 2, 0), (1, 2, 0), (2, 1, 2), (3, 1, 2), (4, 2, 0), (5, 0, 5), (6, 0, 6), (7, 0, 7)]


def test_a_cell_of_equal_keys_takes_no_other_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=6)
    rows = [(1, 6, k, b"\10" + x.tobytes()) for k, x in enumerate([*rng.normal(size=(60, 6)), *(v * (k + 1) for k in range(50))])]
    coded = spark.createDataFrame(rows, "label long, size int, node long, vector binary").mapInArrow(_encode, _CODED)
    active = coded.withColumn("depth", F.lit(3)).withColumn("passes", F.lit(2))
    cells = _cells(active, 0, 2, 77, 32, Scratch(spark, "cells"))
    assert set(cells) == {(0, 1, 6), (1, 1, 6)}
    for low, depth in cells.values():
        assert (depth >= 3).all() and (np.diff(low) > 0).all()
