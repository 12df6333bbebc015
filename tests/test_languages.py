from resonar.config import SearchConfig
from resonar.functions.languages import BACKENDS, backend_for, chinese, detect_language, japanese, korean
from resonar.functions.languages.backends import cap_keys
from resonar.functions.languages.mapped import Key


def test_korean_keys():
    assert [k.text for k in korean.keys("한글.txt")] == ["han geul", "hangeul", "ㅎㄱ", "gksrmf"]
    assert korean.keys("a한")[0].spans == [(1, 2)] * 3
    assert [k.text for k in korean.keys("한글", budget=9)] == ["han geul"]


def test_chinese_keys():
    assert [(k.text, k.kind) for k in chinese.keys("北京大学", polyphone="none")] == [("bei jing da xue", "PinyinFull"), ("beijingdaxue", "PinyinJoined"), ("bjdx", "PinyinInitials")]
    assert "huanmei" in [k.text for k in chinese.keys("还没")] and "huanmei" not in [k.text for k in chinese.keys("还没", polyphone="none")]
    assert all(k.kind != "PinyinInitials" for k in chinese.keys("北京", initials=False))


def test_japanese():
    romaji = lambda t: japanese.kana_to_romaji(t, [None] * len(t))[0]
    assert (romaji("かめら.txt"), romaji("こーど"), romaji("きっぷ"), romaji("しゃ")) == ("kamera.txt", "ko-do", "kippu", "sha")
    assert japanese.romaji_to_kana("shinjuku", 16) == ["しんじゅく"]
    assert "とうきょう" in japanese.romaji_to_kana("tokyo", 16)
    assert japanese.kanji_numerals("2025年8月")[0] == "二千二十五年八月"
    assert japanese.numeric_romaji("8gatsu") == "hachigatsu" and japanese.numeric_romaji("88") is None
    assert [k.text for k in japanese.keys("日本語", readings=True)] == ["にほんご", "nihongo"]


def test_caps_and_variants():
    keys = [Key("a" * 1020, "Original"), Key("b" * 10, "KanaReading"), Key("c", "KanaReading"), Key("c", "KanaReading")]
    assert [k.text[0] for k in cap_keys(keys, SearchConfig())] == ["a", "c"]
    assert [v[1] for v in BACKENDS["ja"].variants("Tokyo", SearchConfig())] == ["Original", "Normalized", "RomajiToKana", "RomajiToKana"]
    assert len(BACKENDS["ja"].variants("nnnnnnnn", SearchConfig(max_query_variants=3))) == 3


def test_detection():
    assert detect_language("한") == "ko" and detect_language("か") == "ja" and detect_language("é") == "plain"
    assert detect_language("a", ["北京"], "zh_CN") == "zh" and backend_for("auto", "a").name == "plain"


def test_length_of_other_characters_leaves_the_kind_of_a_pinyin_key():
    made = chinese.keys("重庆1000000", polyphone="none")
    assert [(k.text, k.kind) for k in made] == [("chong qing", "PinyinFull"), ("chongqing", "PinyinJoined"), ("cq", "PinyinInitials")]


def test_keys_of_a_small_file_are_made_in_more_than_one_task(spark):
    from resonar.functions.languages import BACKENDS
    from resonar.operators.index import build_index

    one = spark.createDataFrame([(k, f"한글{k}") for k in range(40)], "id long, search_text string").coalesce(1)
    own = build_index(one, backend=BACKENDS["ko"])
    assert own.rdd.getNumPartitions() >= 4
    assert {r["id"]: [k["text"] for k in r["keys"]] for r in own.collect()} == {k: ["han geul", "hangeul", "ㅎㄱ", "gksrmf"] for k in range(40)}


def _python_steps(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_keys_and_bonuses_are_made_once_though_filters_ask_for_them(spark):
    from pyspark.sql import functions as F
    from resonar.functions.languages import BACKENDS
    from resonar.operators.index import build_index
    from resonar.operators.search import search

    texts = spark.createDataFrame([(k, f"한글{k}") for k in range(4)], "id long, search_text string")
    exploded = build_index(texts, backend=BACKENDS["ko"]).select("id", F.explode("keys").alias("key"))
    assert _python_steps(exploded) == 1
    found = search(build_index(texts), "'글", config=SearchConfig(limit=None))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[call(") == 1
    assert [r["id"] for r in found.collect()] == [0, 1, 2, 3]
