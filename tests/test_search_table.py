"""A table of queries against the same queries searched one by one."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from resonar.config import COMPATIBLE, SearchConfig
from resonar.functions.batch import Texts, scores
from resonar.functions.languages import BACKENDS
from resonar.functions.scorers import greedy_python
from resonar.functions.signatures import signatures
from resonar.operators.index import build_index
from resonar.operators.search import search, search_many, search_observed, search_with_stats
from resonar.operators.search_table import search_table

TEXTS = [
    "src/main.rs", "src/Main_test.rs", "README.md", "docs/readme-old.md", "café/menu.txt", "ÉCOLE.txt", "İstanbul map", "istanbul/x", "foo bar baz", "bar foo", "foo-bar", "foobar", "", "a", "A",
    "カメラ.txt", "かめら memo", "北京大学.md", "重庆.md", "한글 파일", "日本語 テスト.txt", "x" * 40, "ſtraße Straße", "tab\tsep", "naïve naive", "test 42", "Test42b",
]
QUERIES = [
    "rd", "main", "Main", "foo bar", "'foo", "'foo'", "^src md$", "!test rs", "foo | readme", "^foo bar | baz$", "é", "'é", "École", "'École", "istanbul", "'İstanbul", "kamera", "bjdx", "cq", "a", "", "  ", "x", "'strasse", "ß", "^test$",
    "t42", "'Test", "!foo", "hg", "'bar'", "txt$", "\\ a", "zzz",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    more = ["".join(rng.choice("abcAB/_ .1é") for _ in range(rng.randint(0, 14))) for _ in range(80)]
    return spark.createDataFrame(list(enumerate(TEXTS + more)), "id long, search_text string").repartition(3).cache()


def _both(spark, index, config, backend, case=None):
    asked = spark.createDataFrame([(str(k), q) for k, q in enumerate(QUERIES)], "query_id string, query string")
    got = sorted(map(tuple, search_table(index, asked, config=config, backend=backend, case=case).collect()))
    if case is None:
        want = search_many(index, {str(k): q for k, q in enumerate(QUERIES)}, config=config, backend=backend)
    else:
        groups = {}
        for k, q in enumerate(QUERIES):
            groups.setdefault(config.with_case(q, case), {})[str(k)] = q
        first, *rest = [search_many(index, qs, config=c, backend=backend) for c, qs in groups.items()]
        want = first
        for x in rest:
            want = want.union(x)
    want = sorted(map(tuple, want.select("query_id", "id", "display", "score", "key_kind", "key_index", "rank").collect()))
    assert got == want
    return got


@pytest.mark.parametrize(
    ("language", "config", "case"),
    [
        ("plain", SearchConfig(limit=7), "smart"),
        ("all", SearchConfig(limit=5, tiebreaks=("begin", "end", "chunk", "pathname", "index")), None),
        ("ja", SearchConfig(limit=None, exact=True), None),
        ("zh", SearchConfig(limit=4, normalize=False, no_sort=True), "smart"),
        ("ko", SearchConfig(limit=6, case_sensitive=True, algorithm="nucleo"), None),
    ],
)
def test_a_table_of_queries_finds_what_each_finds(spark, texts, language, config, case):
    backend = BACKENDS[language]
    index = build_index(texts, backend=backend, config=config).cache()
    assert len(_both(spark, index, config, backend, case)) > 60


def test_copies_nulls_empty_tables_and_blocks(spark, texts):
    index = build_index(texts)
    asked = spark.createDataFrame([(1, "rd"), (2, "rd"), (3, None), (2, "rd"), (None, "main"), (5, "foo"), (6, "bar"), (7, "baz")], "query_id int, query string").withColumn("rank", F.lit("x"))
    one = sorted(map(str, search_table(index, asked, config=SearchConfig(limit=2)).collect()))
    assert one == sorted(map(str, search_table(index, asked, config=SearchConfig(limit=2), block=2).collect()))
    ids = [r.split("query_id=")[1].split(",")[0] for r in one]
    assert {k: ids.count(k) for k in set(ids)} == {"1": 2, "2": 4, "None": 2, "5": 2, "6": 2, "7": 1}
    assert search_table(index, asked.limit(0)).collect() == [] and search_table(index.limit(0), asked).collect() == []
    assert search_table(index, asked, config=SearchConfig(limit=0)).collect() == []


def test_the_plan_does_not_grow_with_the_queries(spark, texts):
    index = build_index(texts)
    plans = []
    for n in (3, 900):
        asked = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"))
        plans.append(search_table(index, asked)._jdf.queryExecution().optimizedPlan().toString())
    assert plans[0].count("\n") == plans[1].count("\n") and plans[1].count("MapInArrow") == 1


def test_signatures_rule_out_no_match():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcABéİ i̇中日_1") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    held = Texts(pa.array(texts))
    chars, pairs = signatures(held)
    kept = 0
    for pattern in ["ab", "aa", "é1", "中日", "c_b", "Ab", "i", "bab"]:
        own, near = signatures(Texts(pa.array([pattern])))
        for name, asked, has in (("greedy", own, chars), ("exact", near, pairs)):
            rows, _ = scores(name, pattern, held, False)
            on = np.flatnonzero((asked[0] & ~has) == 0)
            assert set(rows.tolist()) <= set(on.tolist())
            kept += len(on)
    assert kept < 0.8 * 16 * len(texts)


def _pairs_by_hand(row, text, config, backend):
    """Pairs of a variant and a key that it meets, and whether some pair matches."""
    calls, hit = 0, False
    keys = [(row["display"], "Original")] + [(row["norm"], "Normalized")] * (config.normalize and not config.case_sensitive and not row["case_fold_only"]) + [(k["text"], k["kind"]) for k in row["keys"]]
    for pattern, kind, _ in backend.variants(text, config):
        if kind == "Normalized" and config.case_sensitive:
            continue
        for key, own in keys:
            if own in COMPATIBLE[kind]:
                calls += 1
                hit |= greedy_python(pattern, key, config.case_sensitive) is not None
    return calls, hit


@pytest.mark.parametrize("language", ["plain", "all"])
def test_counts_equal_a_count_of_the_pairs_tried(spark, texts, language):
    backend, config = BACKENDS[language], SearchConfig(limit=3)
    index = build_index(texts, backend=backend, config=config).cache()
    rows = index.collect()
    for query, groups in (("rd", [["rd"]]), ("foo rd | kamera a", [["foo", "rd"], ["kamera", "a"]])):
        want = 0
        for row in rows:
            for group in groups:
                for term in group:
                    calls, hit = _pairs_by_hand(row, term, config, backend)
                    want += calls
                    if not hit:
                        break
        found, seen = search_observed(index, query, config=config, backend=backend)
        assert [r.id for r in found.collect()] == [r.id for r in search(index, query, config=config, backend=backend).collect()]
        counted = search_with_stats(index, query, config=config, backend=backend)[1].first().asDict()
        assert seen.get == counted and counted["fuzzy_calls"] == counted["keys_seen"] == want and counted["candidates_seen"] == len(rows)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CollectMetrics") == 1 and not re.search(r"^\W*(Join|Union)", plan, re.M)
    # a negated term and terms of the exact family: no pairs behind a prefix that fails
    _, seen = search_observed(index, "^src rd", config=config, backend=BACKENDS["plain"])
    _.collect()
    on = [r for r in rows if (r["norm"] or "").startswith("src")]
    assert seen.get["fuzzy_calls"] == sum(_pairs_by_hand(r, "rd", config, BACKENDS["plain"])[0] for r in on)
    assert search_with_stats(index.limit(0), "rd")[1].first().asDict() == {"candidates_seen": 0, "keys_seen": 0, "variants_seen": 1, "fuzzy_calls": 0, "quality_score_calls": 0, "reading_generation_calls": 0}


def _batch(texts: list[str]):
    import pyarrow as pa

    display, keys = pa.array(texts), pa.nulls(len(texts), pa.list_(pa.struct([("text", pa.string())])))
    low = pa.array([t.lower() for t in texts])
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), display, low, pa.array([True] * len(texts)), low, keys], names=["id", "display", "norm", "case_fold_only", "hay", "keys"])


def _met(texts: list[str], queries: list[str], limit: int | None):
    from types import SimpleNamespace

    from resonar.functions.languages import BACKENDS
    from resonar.operators import search_table as table

    sent = SimpleNamespace(value=table.Compiled(queries, SearchConfig(limit=limit), BACKENDS["plain"], None))
    return [(r["query"], r["id"]) for b in table._meet(sent)(iter([_batch(texts)])) for r in b.to_pylist()]


def test_rows_of_equal_scores_do_not_all_leave_their_batch():
    texts = [f"red bolt_{k:04d}" for k in range(500)]
    for query in ("rdbt", "^red 'bolt !x"):
        assert sorted(_met(texts, [query], 3)) == [(query, k) for k in range(3)]


def test_a_term_of_many_queries_is_looked_at_once_a_batch(monkeypatch):
    from resonar.operators import search_table as table

    seen = []
    hits = table._hits
    monkeypatch.setattr(table, "_hits", lambda mode, needle, hay: seen.append((mode, needle)) or hits(mode, needle, hay))
    queries = [f"^{a} '{b} !{c}" for a in ("red", "hot") for b in ("bolt", "gear") for c in ("x1", "x2", "x3")]
    texts = [f"{a} {b}/{c}" for a in ("red", "hot") for b in ("bolt", "gear") for c in ("x1", "x2")]
    assert len(_met(texts, queries, None)) == 16
    assert len(seen) == len(set(seen)) == 7
