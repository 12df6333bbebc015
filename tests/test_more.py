import os
import random

import pytest

from resonar.config import SearchConfig
from resonar.functions.languages import BACKENDS, backend_for, chinese, detect_language_of
from resonar.operators.explain import explain, match_positions
from resonar.operators.fields import Delimiter
from resonar.operators.index import apply_aliases, build_index, newest_first, with_ids
from resonar.operators.outcome import decide
from resonar.operators.search import matches, search
from resonar.sources.text import write_records
from resonar.sources.walker import walk
from resonar.streaming.live import LiveSearch


def _items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, search_text string")


def test_digits_are_read_and_kept(spark):
    ja = backend_for("ja", readings=True)
    index = build_index(_items(spark, ["2025年8月", "2025年9月", "notes"]), backend=ja)
    for query in ("8gatsu", "hachigatsu"):
        got = search(index, query, config=SearchConfig(limit=1), backend=ja)
        (row,) = explain(got, index, query, config=SearchConfig(), backend=ja).collect()
        assert (row.id, row.source_start, row.source_end, row.source_text) == (0, 5, 7, "8月"), query


def test_chinese_characters_outside_the_table(spark):
    assert "银" not in chinese.READINGS_TABLE
    zh = BACKENDS["zh"]
    index = build_index(_items(spark, ["银行软件", "北京大学", "notes"]), backend=zh)
    assert search(index, "yinhang", config=SearchConfig(limit=1), backend=zh).first().id == 0
    assert search(index, "ruanjian", config=SearchConfig(limit=1), backend=zh).first().id == 0
    assert search(index, "bjdx", config=SearchConfig(limit=1), backend=zh).first().id == 1


def test_language_of_a_table(spark):
    texts = _items(spark, ["plain", None, "北京"])
    assert detect_language_of(texts, "abc", locale="zh_CN.UTF-8") == "zh" == detect_language_of(texts, "abc", locale="zh")
    assert detect_language_of(texts, "abc", locale="ko") == "plain" and detect_language_of(texts, "かな") == "ja"
    assert detect_language_of(texts.limit(0), "abc", locale="zh") == "plain"


def test_aliases_have_a_normal_form(spark):
    items = spark.createDataFrame([(0, "x.txt", "x.txt", "x.txt")], "id long, original string, display string, search_text string")
    aliases = spark.createDataFrame([("Ｆｏｏ", "x.txt")], "query string, display string")
    (key,) = apply_aliases(build_index(items), items, aliases).first()["keys"]
    assert (key.text, key.norm) == ("Ｆｏｏ", "foo")


def test_ids_follow_the_input_and_history_keeps_the_newest(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id * 3 AS x")
    assert [(r.x, r.id) for r in with_ids(df).orderBy("id").collect()] == [(3 * k, k) for k in range(1000)]
    lines = spark.createDataFrame([("ls", 0, "a"), ("cd", 1, "b"), ("ls", 2, "c"), (None, 3, "d")], "line string, pos long, more string")
    assert [tuple(r) for r in newest_first(lines).collect()] == [(None, 3, "d"), ("ls", 2, "c"), ("cd", 1, "b")]


def _positions_by_brute_force(pattern, text):
    edges = set("/\\_- .")
    own = [100 + 90 * (i == 0 or text[i - 1] in edges) for i in range(len(text))]
    best = None

    def go(j, places, score):
        nonlocal best
        if j == len(pattern):
            key = (score, places[0] - places[-1], [-x for x in places])
            best = max(best, (key, places)) if best else (key, places)
            return
        for i in range(places[-1] + 1 if places else 0, len(text)):
            if text[i] == pattern[j]:
                gap = i - places[-1] - 1 if places else None
                go(j + 1, [*places, i], score + own[i] + (-2 * i if gap is None else 160 if gap == 0 else -4 * gap))

    at = text.find(pattern)
    if at >= 0:
        return list(range(at, at + len(pattern)))
    go(0, [], 0)
    return best and best[1]


def test_places_equal_brute_force_and_long_texts_end():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("ab_c") for _ in range(rng.randint(1, 11)))
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        assert match_positions(pattern, text) == _positions_by_brute_force(pattern, text), (pattern, text)
    assert match_positions("xyz", "x y " * 50_000 + "z") is not None


def test_results_are_explained_in_their_order(spark):
    index = build_index(_items(spark, [f"{'x' * k}read{k}.md" for k in range(30)]))
    got = search(index, "read", config=SearchConfig(limit=20))
    assert [r.id for r in explain(got, index, "read").collect()] == [r.id for r in got.collect()]


def test_decide(spark):
    index = build_index(_items(spark, ["one", "two", "onetwo"]))
    found = lambda q: matches(index, q)
    assert decide(found("wo"), select_1=True) == ("ask", None)
    assert decide(found("netw"), select_1=True) == ("select", 2) and decide(found("zz"), exit_0=True) == ("exit", None) and decide(found("zz")) == ("ask", None)


def test_records_are_written_as_they_were(spark, tmp_path):
    rows = [bytearray(b"bad\xff"), bytearray(b""), bytearray("ünï".encode())]
    write_records(spark.createDataFrame([(r,) for r in rows], "output binary").coalesce(1), f"{tmp_path}/out", nul=True)
    (file,) = [f for f in os.listdir(f"{tmp_path}/out") if f.startswith("part-")]
    with open(f"{tmp_path}/out/{file}", "rb") as f:
        assert f.read() == b"".join(bytes(r) + b"\0" for r in rows)


def test_ignore_rules(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    files = {
        "home/.config/git/ignore": "*.global\n", "r/.git/info/exclude": "secret.txt\n/top.txt\n", "r/.gitignore": "foo/*.c\n*.log\n!keep.log\nbuild/\ndeep/**/x.md\n\\#odd\nb[ae]d\n",
        "r/foo/a.c": "", "r/foo/sub/b.c": "", "r/a.log": "", "r/keep.log": "", "r/build/x": "", "r/deep/1/2/x.md": "", "r/deep/x.md": "", "r/#odd": "", "r/bad": "", "r/bed": "", "r/bid": "",
        "r/secret.txt": "", "r/top.txt": "", "r/in/top.txt": "", "r/in/.gitignore": "!secret.txt\n", "r/in/secret.txt": "", "r/x.global": "",
    }
    for name, text in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    monkeypatch.chdir(tmp_path / "r")
    assert sorted(walk(".")) == [".gitignore", "bid", "foo/sub/b.c", "in/.gitignore", "in/secret.txt", "in/top.txt", "keep.log"]


def test_live_case_and_rows_that_come_again(spark, tmp_path):
    live = LiveSearch(f"{tmp_path}/live", "read", case="smart")
    live.add(_items(spark, ["READ", "read"]), 0)
    assert {r.id for r in live.results(spark).collect()} == {0, 1}
    live.set_query("READ")
    assert {r.id for r in live.results(spark).collect()} == {0}
    live.add(spark.createDataFrame([(0, "READ more")], "id long, search_text string"), 1)
    assert [r.display for r in live.results(spark).collect() if r.id == 0] == ["READ more"]
    live.compact(spark, f"{tmp_path}/few")
    live.set_query("more")
    assert [r.id for r in live.results(spark).collect()] == [0]


def test_delimiters_are_checked_by_what_runs_them(spark):
    Delimiter(r"\p{IsAlphabetic}+")  # Java knows it, Python does not
    for bad in ("[", "(?P<x>a)"):
        with pytest.raises(ValueError, match="bad delimiter"):
            Delimiter(bad)
