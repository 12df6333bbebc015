import random
from itertools import combinations

import numpy as np

from pyspark.sql import functions as F

from resonar.llm.common import shingle_sets, with_rows
from resonar.llm.embedding_dedup import near_vectors
from resonar.llm.graph import components
from resonar.llm.common import Scratch
from resonar.llm.near_dedup import near_groups

from .helpers import SCHEMA, documents, frame, prose


def _sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def _groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_shingle_sets_count_what_plain_sets_count():
    rows = documents()
    assert [len(x) for x in shingle_sets([(t or "").encode() for _, t in rows])] == [len(s) for s in _sets(rows)]


def test_near_groups_equal_brute_force(spark):
    rows = documents()
    sets = _sets(rows)
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = _groups(len(rows), links)
    least = {}
    for k, g in enumerate(group):
        if rows[k][0] is not None:
            least[g] = min(least.get(g, 10**9), rows[k][0])
    want = sorted((str(rows[k][0]), len(sets[k]), str(least.get(g))) for k, g in enumerate(group))
    got = near_groups(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_one_row_of_each_group_is_first(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (7, text), (7, text + " more"), (None, text + " again"), (3, "another text of its own here"), (None, None), (None, "")]
    got = near_groups(frame(spark, rows).withColumn("carry0", F.lit(4)), carry=("rank", "carry0")).collect()
    assert [r.doc_id for r in got if r.first and r.component_id == 7] == [7]
    assert sum(r.first for r in got) == 4 and all(r["rank"] == 1 and r.carry0 == 4 for r in got)


def test_pairs_in_a_crowd_are_linked(spark):
    own = lambda k, n: [f"w{k}x{j}" for j in range(n)]
    shared = own("all", 176)
    rows = [(k, " ".join(shared + own(k, 35))) for k in range(3000)]  # 0.71 alike
    for k in range(0, 120, 2):  # 0.77 alike
        rows[k + 1] = k + 1, " ".join(shared + own(k, 9) + own(k + 1, 26))
    for together in (10**6, 700):  # hot shingles whole, and in blocks
        got = {r.doc_id: r.component_id for r in near_groups(frame(spark, rows), together=together).collect()}
        assert got == {k: k - k % 2 if k < 120 else k for k in range(3000)}


def _by_brute_force(rows):
    sets = _sets(rows)
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return _groups(len(rows), links), len(links)


def test_hubs_chains_and_mixed_groups_lose_no_link(spark):
    rng = random.Random(11)
    rows = []
    # a hub that 500 copies link with, which hardly link with one another
    hub = prose(rng, 200).split()
    rows.append(hub)
    for k in range(500):
        own = list(hub)
        for j in rng.sample(range(200), 5):
            own[j] = f"h{k}x{j}"
        rows.append(own)
    # a chain: each text begins a little later
    line = prose(rng, 1000).split()
    rows += [line[k : k + 150] for k in range(0, 800, 8)]
    # copies of copies, of all degrees of likeness, around a shared passage
    made = [prose(rng, 120).split() for _ in range(3)]
    for k in range(700):
        own = list(rng.choice(made))
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"m{k}x{rng.randrange(9)}"
        if rng.random() < 0.2:
            own = own[: rng.randint(90, 120)]
        made.append(own)
    rows = [(k, " ".join(x)) for k, x in enumerate(rows + made)]
    want, links = _by_brute_force(rows)
    got = {r.doc_id: r.component_id for r in near_groups(frame(spark, rows)).collect()}
    assert links > 1500 and sum(g == 0 for g in want) >= 501
    assert [got[k] for k in range(len(rows))] == want


def test_empty_tables(spark):
    assert near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components_in_rounds_equal_components_at_once(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(25)]
    df = spark.createDataFrame(links, "u long, v long")
    once = {r.node: r.component for r in components(df, Scratch(spark, "t")).collect()}
    rounds = {r.node: r.component for r in components(df, Scratch(spark, "t"), task_links=0).collect()}
    assert once == rounds


def _vectors_by_brute_force(rows, threshold=0.98):
    ok = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and any(v) and np.isfinite(v).all()]
    by_label = {}
    for k in ok:
        by_label.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    count, links = [0] * len(rows), []
    for own in by_label.values():
        x = np.array([rows[k][1] for k in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        for j, k in enumerate(own):
            count[k] = int(near[j].sum())
            first = np.flatnonzero(near[j])
            links += [(k, own[i]) for i in first]
    return count, _groups(len(rows), links)


def _got(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    got = near_vectors(df, **settings).collect()
    return sorted((r.vec_id, r.n_links, r.component_id) for r in got)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = []
    for k, v in enumerate(base):
        for j in range(80 if k == 0 else k % 4):  # one region is dense
            rows.append((len(rows), (v + rng.normal(size=16) * (0.02 if j else 0)).tolist(), k % 3))
    rows += [(len(rows) + k, v, lab) for k, (v, lab) in enumerate([(None, 1), ([], 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), (rows[0][1], None), (rows[0][1], rows[0][2]), (rows[0][1], rows[0][2]), ([1.0, 2.0], 1), ([2.0, 4.0], 1)])]
    count, group = _vectors_by_brute_force(rows)
    want = [(k, count[k], group[k]) for k in range(len(rows))]
    assert _got(spark, rows) == want
    # small windows, and blocks after few passes: dense counts and the exact way must agree
    assert _got(spark, rows, window=16, most=6, many=8, block=64) == want


def test_a_hub_keeps_all_links(spark):
    rng = np.random.default_rng(4)
    hub = rng.normal(size=32)
    hub /= np.linalg.norm(hub)
    rows = [(0, hub.tolist(), 1)]
    for k in range(1, 1501):
        side = rng.normal(size=32)
        side -= (side @ hub) * hub
        side /= np.linalg.norm(side)
        rows.append((k, (0.981 * hub + np.sqrt(1 - 0.981**2) * side).tolist(), 1))
    count, group = _vectors_by_brute_force(rows)
    want = [(k, count[k], group[k]) for k in range(len(rows))]
    assert count[0] == 1500
    assert _got(spark, rows) == want
    assert _got(spark, rows, window=256, most=8) == want


def test_vectors_of_one_direction_and_ties(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=8)
    rows = [(k, (v * (k + 1)).tolist(), 2) for k in range(60)] + [(60 + k, (v + 1e-7 * rng.normal(size=8)).tolist(), 2) for k in range(200)]
    count, group = _vectors_by_brute_force(rows)
    assert _got(spark, rows, window=32, most=3, many=8, block=64) == [(k, count[k], group[k]) for k in range(len(rows))]


def test_rows_are_told_apart(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    scratch = Scratch(spark, "rows")
    for df, n, stored in ((files, 50, False), (files.where("id > 9").withColumnRenamed("id", "_file"), 40, False), (files.union(files), 100, True), (files.crossJoin(spark.range(3).toDF("k")), 150, True), (files.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x")), 100, True), (spark.range(20), 20, True)):
        before = scratch.count
        got, names = with_rows(df, scratch)
        assert got.select(*names).distinct().count() == n and (scratch.count > before) == stored and set(df.columns) <= set(got.columns)
