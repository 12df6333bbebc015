"""Chinese keys: pinyin in full, joined, and initials, with a few common second readings."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick

from ..normalize import normalize
from .mapped import Key, KeyList, join

#: At most so many readings of one character are used.
READINGS = 3
# Frequent characters and their readings, the usual one first. A table of readings may be added.
READINGS_TABLE = {
    **{c: r.split("/") for c, r in zip(
        "北京大学地铁厦重庆还没中国人上海天津广州深圳南西安成都文件报告资料项目会议测试日本语言电脑机东方水山口长江黄河家新好我你他是不了在有这个们来到时说为子能下过出就年生行和",
        "bei jing/jin da/dai xue di/de tie sha/xia chong/zhong qing hai/huan mei/mo zhong guo ren shang hai tian jin guang zhou shen zhen nan xi an cheng du/dou wen jian bao gao zi liao xiang mu hui/kuai yi ce shi ri ben yu yan dian nao ji dong fang shui shan kou chang/zhang jiang huang he jia xin hao wo ni ta shi bu le/liao zai you zhe/zhei ge men lai dao shi shuo/shui wei zi neng xia guo chu jiu nian sheng xing/hang he/huo".split(),
        strict=True,
    )},
    "重": ["zhong", "chong"],
}


# Phrases in which a character of several readings has one, for polyphone "phrase".
PHRASES = {
    "重庆": ["chong", "qing"], "重要": ["zhong", "yao"], "重复": ["chong", "fu"], "银行": ["yin", "hang"], "行走": ["xing", "zou"], "行业": ["hang", "ye"], "长大": ["zhang", "da"], "长江": ["chang", "jiang"], "校长": ["xiao", "zhang"],
    "音乐": ["yin", "yue"], "快乐": ["kuai", "le"], "会计": ["kuai", "ji"], "会议": ["hui", "yi"], "都市": ["du", "shi"], "首都": ["shou", "du"], "了解": ["liao", "jie"], "还书": ["huan", "shu"], "还有": ["hai", "you"],
    "厦门": ["xia", "men"], "大厦": ["da", "sha"], "目的": ["mu", "di"], "和平": ["he", "ping"], "西藏": ["xi", "zang"], "收藏": ["shou", "cang"], "银行行长": ["yin", "hang", "hang", "zhang"], "调查": ["diao", "cha"], "调整": ["tiao", "zheng"],
}


class Phrases:
    """Readings of phrases, one for each character, found by an Aho-Corasick automaton: from the left, the longest first."""

    def __init__(self, readings: dict[str, list[str]]):
        self.readings = {k: list(v) for k, v in readings.items() if k}
        for phrase, own in self.readings.items():
            if len(own) != len(phrase):
                raise ValueError(f"{phrase!r} has {len(phrase)} characters and {len(own)} readings")
        self.automaton = ahocorasick.Automaton()
        for phrase in self.readings:
            self.automaton.add_word(phrase, phrase)
        if self.readings:
            self.automaton.make_automaton()

    def __reduce__(self):
        return Phrases, (self.readings,)

    def find(self, text: str) -> dict[int, list[str]]:
        """Where phrases start, and their readings."""
        if not self.readings:
            return {}
        return {end + 1 - len(phrase): self.readings[phrase] for end, phrase in self.automaton.iter_long(text)}


@lru_cache(maxsize=1)
def default_phrases() -> Phrases:
    return Phrases(PHRASES)


#: The phrase that is known in every mode.
ALWAYS = {"重庆": PHRASES["重庆"]}


@lru_cache(maxsize=1)
def _always() -> Phrases:
    return Phrases(ALWAYS)


@lru_cache(maxsize=4)
def readings_from_jvm(spark, chars: str) -> dict[str, list[str]]:
    """First readings of characters by the transliterator that ships with Spark; one call on the driver."""
    out = {}
    make = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance
    got = make("Han-Latin; Latin-ASCII; Lower").transliterate("\n".join(chars)).split("\n")
    for c, read in zip(chars, map(str.strip, got), strict=True):
        if read != c and read.isascii() and read.isalpha():
            out[c] = [read]
    return out


#: The blocks whose characters get a reading.
HAN = (range(0x3400, 0x4DC0), range(0x4E00, 0xA000))


def full_table(spark) -> dict[str, list[str]]:
    """Readings of all characters of HAN: those of READINGS_TABLE, first readings of the transliterator for all others.

    Some 27,000 rows at most. Where Spark has no transliterator the small table stands alone.
    """
    try:
        found = readings_from_jvm(spark, "".join(chr(k) for block in HAN for k in block))
    except (TypeError, AttributeError):  # py4j gives a package, not a class, where there is none
        found = {}
    return found | READINGS_TABLE


class SharedTable:
    """full_table, sent to the workers once for a session and not with each plan."""

    def __init__(self, spark):
        self.sent = spark.sparkContext.broadcast(full_table(spark))  # some 27,000 rows at most

    def get(self, c: str) -> list[str] | None:
        return self.sent.value.get(c)


_shared: dict[str, SharedTable] = {}


def shared_table(spark) -> SharedTable:
    name = spark.sparkContext.applicationId
    if name not in _shared:
        _shared[name] = SharedTable(spark)
    return _shared[name]


def keys(text: str, most: int = 8, budget: int = 1024, polyphone: str = "common", initials: bool = True, table: dict[str, list[str]] | SharedTable | None = None, phrases: Phrases | None = None) -> list[Key]:
    """Keys of the characters that have a reading; others leave no trace.

    polyphone `none` uses first readings only; otherwise each further reading replaces one character's at a time. With
    `phrase`, characters of a known phrase have the phrase's readings alone. A key
    with a space is PinyinFull; one of a letter for each character read is PinyinInitials, others are PinyinJoined, whatever else
    the text holds.
    """
    if not text or most <= 0 or budget <= 0:
        return []
    table = READINGS_TABLE if table is None else table
    found: list[tuple[list[str], tuple[int, int]]] = []
    held = ((phrases or default_phrases()) if polyphone == "phrase" else _always()).find(text)
    k = 0
    while k < len(text):
        if k in held:
            found += [([r], (k + j, k + j + 1)) for j, r in enumerate(held[k])]
            k += len(held[k])
            continue
        if own := table.get(text[k]):
            found.append((list(dict.fromkeys(own))[: 1 if polyphone == "none" else READINGS], (k, k + 1)))
        k += 1
    if not found or len(found) > budget:
        return []
    out = KeyList(most, budget, by_kind=False)

    def push(own: list[tuple[str, tuple[int, int]]]) -> None:
        for separator in (" ", ""):
            out.push(join(own, separator, "", out.left))
        out.push(join([(r[0], s) for r, s in own], "", "", out.left))

    first = [(r[0], s) for r, s in found]
    push(first)
    for n in range(1, max(len(r) for r, _ in found)):
        for k, (r, s) in enumerate(found):
            if n < len(r) and len(out.keys) < most:
                push([*first[:k], (r[n], s), *first[k + 1 :]])
    kept = []
    for key in out.keys:
        key.kind = "PinyinFull" if " " in key.text else "PinyinInitials" if len(key.text) <= len(found) else "PinyinJoined"
        if initials or key.kind != "PinyinInitials":
            kept.append(key)
    return kept


def variants(query: str, initials: bool = True) -> list[tuple[str, str]]:
    plain = normalize(query)
    if len(plain) < 2 or not (plain.isascii() and plain.isalpha()):
        return []
    return [(plain, "Initials")] * initials + [(plain, "Pinyin")]
