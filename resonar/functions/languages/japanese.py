"""Japanese keys and variants: kana, romaji, numbers, and kanji readings from a tokenizer that a caller supplies."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import islice, product

from ..normalize import DASHES, has_kana, normalize, to_hiragana
from .mapped import Key, Span

FANOUT = 16
_VOWELS = "aiueo"
# Rows of the syllabary by consonant, for the vowels a i u e o.
ROWS = {
    "": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも",
    "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "y": "や ゆ よ", "w": "わ   を",
}
SPECIAL = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu"}
GLIDES = {"ゃ": "a", "ゅ": "u", "ょ": "o"}
# Cities that are written short in romaji, and ways to write a long o.
LONG_O = ("おう", "おー", "おおう")
CITIES = {"tokyo": "とうきょう", "kyoto": "きょうと", "osaka": "おおさか", "kobe": "こうべ"}


def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    tokens, romaji, combos = {}, {}, {}
    for c, row in ROWS.items():
        for v, kana in zip(_VOWELS, row.ljust(5), strict=True):
            if kana != " ":
                tokens[c + v] = kana
                romaji[kana] = SPECIAL.get(kana, c + v)
    tokens |= {r: k for k, r in SPECIAL.items() if k not in "ぢづ"}
    # Spellings that input methods take besides.
    tokens |= {"ca": "か", "ci": "し", "cu": "く", "ce": "せ", "co": "こ", "hu": "ふ", "si": "し", "ti": "ち", "tu": "つ", "zi": "じ", "di": "ぢ", "du": "づ"}
    for c, row in ROWS.items():
        if c in ("", "y", "w"):
            continue
        kana = row[1]
        for glide, v in GLIDES.items():
            tokens[f"{c}y{v}"] = kana + glide
            if c != "d":
                short = {"し": "sh", "ち": "ch", "じ": "j"}.get(kana)
                combos[kana + glide] = short + v if short else f"{c}y{v}"
                if short:
                    tokens[short + v] = kana + glide
                if short in ("ch", "j"):
                    tokens[("cy" if short == "ch" else "jy") + v] = kana + glide
    # Small letters as input methods take them.
    for mark in "lx":
        tokens |= {mark + v: k for v, k in zip(_VOWELS, "ぁぃぅぇぉ", strict=True)}
        tokens |= {f"{mark}ye": "ぇ", f"{mark}ka": "ゕ", f"{mark}ke": "ゖ", f"{mark}tsu": "っ", f"{mark}tu": "っ", f"{mark}wa": "ゎ"}
        tokens |= {f"{mark}y{v}": k for k, v in GLIDES.items()}
    tokens["xn"] = "ん"
    return tokens, romaji, combos


TOKENS, ROMAJI, COMBOS = _tables()


_TOKEN = re.compile("|".join(sorted(TOKENS, key=len, reverse=True)))
#: What a place may be read as, by how the text goes on: (characters used, kana) of each way. An n before a letter other than
#: a vowel stands alone, before y it may; a consonant before itself is a small tsu where a syllable follows.
GRAMMAR = (
    (re.compile("n'"), ((2, "ん"),), False),
    (re.compile("nn"), ((1, "ん"), (2, "ん")), False),
    (re.compile("n(?![aiueoy])", re.S), ((1, "ん"),), False),
    (re.compile("n(?=y)"), ((1, "ん"),), True),
    (re.compile(rf"([b-df-hj-mp-tv-z])(?=\1)(?={_TOKEN.pattern})"), ((1, "っ"),), False),
)


def _ways(text: str, k: int) -> list[tuple[int, str]]:
    """Ways to go on from place k: (next place, kana). A syllable, or the character itself, is the last of them."""
    out: list[tuple[int, str]] = []
    for pattern, ways, goes_on in GRAMMAR:
        if pattern.match(text, k):
            out += [(k + n, kana) for n, kana in ways]
            if not goes_on:
                return out
    own = _TOKEN.match(text, k)
    return [*out, (own.end(), TOKENS[own.group()]) if own else (k + 1, text[k])]


def _spellings(text: str):
    """(place, kana so far) of all readings, those of fewer steps first."""
    level = [(0, "")]
    while level:
        yield from level
        level = [(n, built + kana) for k, built in level if k < len(text) for n, kana in _ways(text, k)]


def romaji_to_kana(query: str, most: int) -> list[str]:
    """Kana spellings of a romaji query, those of fewest steps first, within a budget of steps."""
    text = query.strip().lower()
    if most <= 0 or not text or not query.strip().isascii():
        return []
    whole = (kana for k, kana in islice(_spellings(text), max(most * 16, 16)) if k == len(text) and has_kana(kana))
    found = dict.fromkeys(whole)
    further = [x * len(text) for x in LONG_O] if len(text) > 1 and not text.strip("o") else [CITIES[text]] if text in CITIES else []
    return list(islice(dict.fromkeys((*islice(found, most), *further)), most))


def _merge(a: Span | None, b: Span | None) -> Span | None:
    return (min(a[0], b[0]), max(a[1], b[1])) if a and b else a or b


def kana_to_romaji(text: str, spans: list[Span | None]) -> tuple[str, list[Span | None]]:
    """Romaji of hiragana; other characters stay, dashes become hyphens."""
    out, where, k = [], [], 0

    def put(piece: str, span: Span | None) -> None:
        out.append(piece)
        where.extend([span] * len(piece))

    while k < len(text):
        c, two = text[k], text[k : k + 2]
        if c == "っ":
            put(ROMAJI.get(text[k + 1 : k + 2], "")[:1], spans[k])
        elif two in COMBOS:
            put(COMBOS[two], _merge(spans[k], spans[k + 1]))
            k += 1
        else:
            put("n" if c == "ん" else "-" if c in DASHES else ROMAJI.get(c, c), spans[k])
        k += 1
    return "".join(out), where


def hiragana_with_spans(text: str, spans: list[Span | None] | None = None) -> tuple[str, list[Span | None]]:
    """Each character normalised by itself and turned to hiragana, so that half-width marks stay apart."""
    out, where = [], []
    for k, c in enumerate(text):
        own = to_hiragana(normalize(c))
        out.append(own)
        where += [(spans[k] if spans else (k, k + 1))] * len(own)
    return "".join(out), where


def _reading_keys(kana: str, spans: list[Span | None]) -> list[Key]:
    romaji, where = kana_to_romaji(kana, spans)
    return [Key(kana, "KanaReading", spans)] + [Key(romaji, "RomajiReading", where)] * (romaji != kana)


# Numerals of one digit and of tens, and how they are read.
_ONES = dict(zip("123456789", "一二三四五六七八九", strict=True))
_READ = dict(zip("123456789", "ichi ni san yon go roku nana hachi kyuu".split(), strict=True))
_PLACES = (("千", "sen"), ("百", "hyaku"), ("十", "juu"), ("", ""))
_CHANGED = {("3", "sen"): "sanzen", ("8", "sen"): "hassen", ("3", "hyaku"): "sanbyaku", ("6", "hyaku"): "roppyaku", ("8", "hyaku"): "happyaku"}


def _number(digits: str, reading: bool) -> str | None:
    """A number of 1 to 9999 in Japanese numerals or in romaji; None for others and for a zero in front."""
    if not 1 <= len(digits) <= 4 or digits[0] == "0":
        return None
    out = []
    for d, (sign, read) in zip(digits.zfill(4), _PLACES, strict=True):
        if d != "0":
            bare = d == "1" and sign
            out.append(_CHANGED.get((d, read), ("" if bare else _READ[d]) + read) if reading else ("" if bare else _ONES[d]) + sign)
    return "".join(out)


def _digit_runs(text: str):
    """(start, end, digits) of runs of digits; , ， and _ between them are skipped."""
    k = 0
    while k < len(text):
        if not (text[k] in "0123456789" or "０" <= text[k] <= "９"):
            k += 1
            continue
        start, digits = k, ""
        while k < len(text) and (text[k] in ",，_" or text[k] in "0123456789" or "０" <= text[k] <= "９"):
            if text[k] not in ",，_":
                digits += str(int(text[k]))
            k += 1
        yield start, k, digits


def _replaced(text: str, reading: bool) -> tuple[str, list[Span]] | None:
    out, spans, at, changed = "", [], 0, False
    for start, end, digits in _digit_runs(text):
        if (number := _number(digits, reading)) is None:
            continue
        out += text[at:start] + number
        spans += [(k, k + 1) for k in range(at, start)] + [(start, end)] * len(number)
        at, changed = end, True
    return (out + text[at:], spans + [(k, k + 1) for k in range(at, len(text))]) if changed else None


def kanji_numerals(text: str) -> tuple[str, list[Span]] | None:
    """Digits written as numerals, with spans; None where nothing changes."""
    return _replaced(text, False)


def numeric_romaji(query: str) -> str | None:
    """A query like 8gatsu with its digits as read; None where it has no letter or no such number."""
    plain = normalize(query)
    got = _replaced(plain, True) if any(c.isascii() and c.isalpha() for c in plain) else None
    return got[0] if got else None


Tokenizer = Callable[[str], list[tuple[str, list[str], int, int]]]
#: Runs whose readings a worker keeps.
RUNS_KEPT = 4096
# A lexicon of frequent words for texts without a tokenizer of one's own, first readings first.
LEXICON = {
    "日本語": ["ニホンゴ"], "日本": ["ニホン"], "東京": ["トウキョウ"], "大学": ["ダイガク"], "東北": ["トウホク"], "電機": ["デンキ"], "京都": ["キョウト"], "大阪": ["オオサカ"],
    "駅": ["エキ"], "新宿": ["シンジュク"], "月": ["ガツ", "ゲツ"], "年": ["ネン"], "日": ["ニチ", "ヒ"], "資料": ["シリョウ"], "令和": ["レイワ"], "年度": ["ネンド"], "第": ["ダイ"], "号": ["ゴウ"],
    "一": ["イチ"], "二": ["ニ"], "三": ["サン"], "四": ["ヨン", "シ"], "五": ["ゴ"], "六": ["ロク"], "七": ["ナナ", "シチ"], "八": ["ハチ"], "九": ["キュウ", "ク"], "十": ["ジュウ"], "百": ["ヒャク"], "千": ["セン"], "万": ["マン"],
    "四月": ["シガツ"], "七月": ["シチガツ"], "九月": ["クガツ"], "三百": ["サンビャク"], "六百": ["ロッピャク"], "八百": ["ハッピャク"], "三千": ["サンゼン"], "八千": ["ハッセン"],
    "会議": ["カイギ"], "議事録": ["ギジロク"], "報告": ["ホウコク"], "報告書": ["ホウコクショ"], "請求書": ["セイキュウショ"], "見積書": ["ミツモリショ"], "契約書": ["ケイヤクショ"], "写真": ["シャシン"], "動画": ["ドウガ"], "音楽": ["オンガク"],
    "設計": ["セッケイ"], "設定": ["セッテイ"], "検索": ["ケンサク"], "文書": ["ブンショ"], "予定": ["ヨテイ"], "計画": ["ケイカク"], "研究": ["ケンキュウ"], "開発": ["カイハツ"], "試験": ["シケン"], "結果": ["ケッカ"], "会社": ["カイシャ"], "電話": ["デンワ"],
    "名古屋": ["ナゴヤ"], "横浜": ["ヨコハマ"], "神戸": ["コウベ"], "札幌": ["サッポロ"], "福岡": ["フクオカ"], "北海道": ["ホッカイドウ"], "沖縄": ["オキナワ"], "渋谷": ["シブヤ"], "銀座": ["ギンザ"], "空港": ["クウコウ"],
    "今日": ["キョウ"], "明日": ["アシタ"], "昨日": ["キノウ"], "時間": ["ジカン"], "午前": ["ゴゼン"], "午後": ["ゴゴ"], "学校": ["ガッコウ"], "先生": ["センセイ"], "学生": ["ガクセイ"], "図書館": ["トショカン"], "病院": ["ビョウイン"], "銀行": ["ギンコウ"],
}


def lexicon_tokenizer(lexicon: dict[str, list[str]]) -> Tokenizer:
    """Longest match over a lexicon; a character that is not in it reads as itself where it is kana, else not at all.

    Readings of runs are kept, up to a number, as the same runs come again in a table's rows.
    """
    longest = max(map(len, lexicon), default=1)

    @lru_cache(maxsize=RUNS_KEPT)
    def run(text: str):
        out, k = [], 0
        while k < len(text):
            n = next((n for n in range(min(longest, len(text) - k), 0, -1) if text[k : k + n] in lexicon), 0)
            if n:
                out.append((text[k : k + n], lexicon[text[k : k + n]], k, k + n))
            else:
                n = 1
                out.append((text[k], [text[k]] if has_kana(text[k]) or text[k].isascii() else [], k, k + 1))
            k += n
        return out

    return run


@lru_cache(maxsize=1)
def default_tokenizer() -> Tokenizer:
    return lexicon_tokenizer(LEXICON)


def _is_japanese(c: str) -> bool:
    return has_kana(c) or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "ー々〆〇" or c.isdigit()


def runs_of(source: str) -> list[tuple[int, int]]:
    """Where runs of Japanese characters start and end."""
    out, k = [], 0
    while k < len(source):
        end = k
        while end < len(source) and _is_japanese(source[end]):
            end += 1
        if end > k:
            out.append((k, end))
        k = max(end, k + 1)
    return out


def _sources(text: str) -> list[tuple[str, list[Span]]]:
    """The text with its digits read as numerals, where it has such, and as it is."""
    own: list[Span] = [(k, k + 1) for k in range(len(text))]
    got = kanji_numerals(text)
    return [got, (text, own)] if got else [(text, own)]


def has_kanji(text: str) -> bool:
    return any("㐀" <= c <= "鿿" for c in text)


def runs_to_read(text: str) -> set[str]:
    """The runs that kanji_keys will ask a tokenizer for."""
    return {source[a:b] for source, _ in _sources(text) for a, b in runs_of(source)} if has_kanji(text) else set()


def _read(source: str, spans: list[Span], tokenizer: Tokenizer) -> list[list[list[tuple[str, Span]]]] | None:
    """The choices of each piece of source, as lists of (kana, span); None where a run of Japanese cannot be read."""
    options: list[list[list[tuple[str, Span]]]] = []
    ends = dict(runs_of(source))
    k = 0
    while k < len(source):
        if k not in ends:
            options.append([[(source[k], spans[k])]])
            k += 1
            continue
        end = ends[k]
        for _, readings, a, b in tokenizer(source[k:end]):
            if not readings:
                return None
            where = (spans[k + a][0], spans[k + b - 1][1])
            options.append([[(r, where)] for r in readings])
        k = end
    return options


def kanji_keys(text: str, tokenizer: Tokenizer, most: int = 8, budget: int = 1024) -> list[Key]:
    """Readings of runs of Japanese characters, other characters kept; no key where a run cannot be read.

    Digits are read as numerals; a further reading keeps them as they are, so that 8月 is found by both hachigatsu and
    8gatsu.
    """
    if not has_kanji(text):
        return []
    sources = _sources(text)
    out: list[Key] = []
    for source, spans in sources:
        options = _read(source, spans, tokenizer)
        if options is None:
            continue
        for choice in product(*options):
            flat = [piece for part in choice for piece in part]
            kana, where = "", []
            for piece, span in flat:
                read = to_hiragana(normalize(piece))
                kana += read
                where += [span] * len(read)
            # each source may fill half of what there is, so that many readings of one do not hide the other
            if len(kana.encode()) > budget or len(out) >= most * (1 + (source is text)) // len(sources):
                break
            out += _reading_keys(kana, where)
    return out


def keys(text: str, most: int = 8, budget: int = 1024, readings: bool = False, tokenizer: Tokenizer | None = None) -> list[Key]:
    out: list[Key] = []
    if has_kana(text) and len(text.encode()) <= budget:
        out += _reading_keys(*hiragana_with_spans(text))
    if readings:
        out += kanji_keys(text, tokenizer or default_tokenizer(), most, budget)
    return out


def variants(query: str, max_variants: int) -> list[tuple[str, str]]:
    plain, out = normalize(query), []
    most = max(max_variants, FANOUT)
    if has_kana(plain):
        out.append((to_hiragana(plain), "Kana"))
    if number := numeric_romaji(query):
        out += [(k, "RomajiToKana") for k in romaji_to_kana(number, most)]
    return out + [(k, "RomajiToKana") for k in romaji_to_kana(query, most)]
