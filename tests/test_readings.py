"""Readings: the lattice against all segmentations, phrases, and runs that are read once."""

import random
from dataclasses import replace

import pytest

from resonar.functions.languages import BACKENDS, backend_for, chinese, japanese
from resonar.functions.languages.lattice import END, UNKNOWN_COST, Dictionary, LatticeTokenizer, read_connections, read_dictionary
from resonar.operators.index import build_index, build_index_by_runs
from resonar.operators.search import search


def _cheapest(entries, costs, text):
    """The least cost of all segmentations."""
    best = []

    def go(at, right, total):
        if at == len(text):
            best.append(total + costs.get((right, END), 0))
            return
        found = [e for e in entries if text.startswith(e[0], at)]
        if not any(len(e[0]) == 1 for e in found):
            found.append((text[at], END, END, UNKNOWN_COST, None))
        for s, left, r, cost, _ in found:
            go(at + len(s), r, total + costs.get((right, left), 0) + cost)

    go(0, END, 0)
    return min(best)


def test_the_lattice_finds_the_cheapest_of_all_segmentations():
    rng = random.Random(3)
    for _ in range(60):
        entries = [("".join(rng.choice("東京都大学") for _ in range(rng.randint(1, 4))), rng.randint(0, 3), rng.randint(0, 3), rng.randint(-50, 300), "ア") for _ in range(rng.randint(1, 25))]
        costs = {(a, b): rng.randint(-60, 60) for a in range(4) for b in range(4)}
        own = Dictionary(costs=costs)
        for e in entries:
            own.add(*e)
        for _ in range(10):
            text = "".join(rng.choice("東京都大学x") for _ in range(rng.randint(0, 8)))
            path = own.path(text)
            assert "".join(text[a:b] for a, b, _ in path) == text
            if text:
                assert _cost(own, text, path) == _cheapest(entries, costs, text)


def _cost(own, text, path):
    """The least cost of the words that a path names."""
    ways = {END: 0}
    for a, b, reading in path:
        now = {}
        words = [w for w in own.words(text, a) if w[0] == b and w[4] == reading] or [(b, END, END, UNKNOWN_COST, reading)]
        for _, left, right, cost, _ in words:
            for before, total in ways.items():
                now[right] = min(now.get(right, 1 << 60), total + own.costs.get((before, left), 0) + cost)
        ways = now
    return min(total + own.costs.get((right, END), 0) for right, total in ways.items())


ENTRIES = """東京都,1,1,900,名詞,固有,*,*,*,*,東京都,トウキョウト,トーキョート
東京,1,1,300,名詞,固有,*,*,*,*,東京,トウキョウ,トーキョー
東,1,1,900,名詞,一般,*,*,*,*,東,ヒガシ,ヒガシ
京都,1,1,300,名詞,固有,*,*,*,*,京都,キョウト,キョート
都,2,2,200,名詞,接尾,*,*,*,*,都,ト,ト
都大,1,1,2000,名詞,一般,*,*,*,*,都大,*,*
大学,1,1,300,名詞,一般,*,*,*,*,大学,ダイガク,ダイガク
not an entry
"""


@pytest.fixture
def dictionary(spark, tmp_path):
    (tmp_path / "words.csv").write_text(ENTRIES, encoding="utf-8")
    (tmp_path / "matrix.def").write_text("3 3\n1 2 -100\n0 1 0\n2 1 50\n", encoding="utf-8")
    entries, costs = read_dictionary(spark, str(tmp_path / "words.csv")), read_connections(spark, str(tmp_path / "matrix.def"))
    assert entries.count() == 7 and costs.count() == 3 and entries.where("surface = '都大' AND reading IS NULL").count() == 1
    with pytest.raises(ValueError):
        Dictionary.of_tables(entries, costs, most=3)
    return Dictionary.of_tables(entries, costs)


def test_published_layouts_and_readings(spark, dictionary):
    assert [r for _, _, r in dictionary.path("東京都大学")] == ["トウキョウ", "ト", "ダイガク"]  # longest match reads 東京都 大学
    assert [r for _, _, r in dictionary.path("東京都")] == ["トウキョウ", "ト"]
    assert dictionary.path("かx猫") == [(0, 1, "か"), (1, 2, "x"), (2, 3, None)]
    tokenizer = LatticeTokenizer(dictionary, spark)
    backend = backend_for("ja", readings=True, tokenizer=tokenizer)
    items = spark.createDataFrame([(0, "東京都大学.txt"), (1, "東北 大学"), (2, "京都大学"), (3, "plain")], "id long, search_text string")
    found = search(build_index(items, backend=backend), "kyoutodaigaku", backend=backend).collect()
    assert {r.id for r in found} == {0, 2}


def test_each_run_is_read_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def counting(text):
        import os
        import uuid

        (calls / f"{os.getpid()}-{uuid.uuid4().hex}").write_text(text)
        return japanese.default_tokenizer()(text)

    texts = ["東京大学.txt", "東京大学 資料", "資料 8月", "令和8年度資料", "カメラ", "plain", None, "東京大学", "猫 資料", "東京大学.txt"]
    items = spark.createDataFrame([(k % 8, t) for k, t in enumerate(texts)], "id long, search_text string").repartition(3)
    backend = replace(BACKENDS["ja"], readings=True)
    want = sorted(map(str, build_index(items, backend=backend).collect()))
    index = build_index_by_runs(items, backend=replace(backend, tokenizer=counting))
    assert sorted(map(str, index.collect())) == want
    read = sorted(f.read_text() for f in calls.iterdir())
    assert read == sorted(set().union(*[japanese.runs_to_read(t) for t in texts if t]))


def test_phrases_come_before_characters():
    full = lambda text, **how: chinese.keys(text, polyphone="phrase", **how)[0].text
    assert full("银行行长") == "yin hang hang zhang" and full("银行长江") == "yin hang chang jiang"
    assert full("重庆重要") == "chong qing zhong yao" and full("还书") == "huan shu" and full("还有") == "hai you"
    own = chinese.Phrases({"大学": ["tai", "xue"]})
    assert full("北京大学", phrases=own) == "bei jing tai xue"
    assert chinese.keys("大学生", polyphone="common")[0].text == "da xue sheng"
    with pytest.raises(ValueError):
        chinese.Phrases({"大学": ["da"]})
    assert chinese.Phrases({}).find("大学") == {}
