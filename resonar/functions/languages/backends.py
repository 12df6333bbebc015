"""Language backends: which keys a text gets and which variants a query gets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...config import BASE_KINDS, COMPATIBLE, VARIANT_WEIGHTS, SearchConfig
from ..normalize import has_han, has_hangul, has_kana, normalize
from . import chinese, japanese, korean
from .mapped import Key


@dataclass(frozen=True)
class Backend:
    """plain, ja, ko, zh or all. Subclass it and override keys() or extra_variants() for another language."""

    name: str = "plain"
    readings: bool = False
    polyphone: str = "common"
    zh_initials: bool = True
    #: Readings of Chinese characters; build_index() puts in chinese.shared_table() where there are none.
    zh_table: dict[str, list[str]] | chinese.SharedTable | None = field(default=None, hash=False, compare=False, repr=False)
    #: Reads runs of kanji, with readings; the small lexicon where there is none.
    tokenizer: japanese.Tokenizer | None = field(default=None, hash=False, compare=False, repr=False)
    #: Readings of Chinese phrases, for polyphone "phrase".
    zh_phrases: chinese.Phrases | None = field(default=None, hash=False, compare=False, repr=False)
    ko_families: frozenset[str] = frozenset({"romanized", "initials", "keyboard"})

    def keys(self, text: str, config: SearchConfig) -> list[Key]:
        most, budget = config.max_search_keys_per_candidate, config.max_total_key_bytes_per_candidate
        ja = japanese.keys(text, most, budget, self.readings, self.tokenizer) if self.name in ("ja", "all") else []
        ko = korean.keys(text, most, budget, self.ko_families) if self.name in ("ko", "all") and len(text.encode()) <= budget else []
        zh = chinese.keys(text, most, budget, self.polyphone, self.zh_initials, self.zh_table, self.zh_phrases) if self.name in ("zh", "all") else []
        if self.name != "all":
            return ja + ko + zh
        zh.sort(key=lambda k: k.kind != "PinyinInitials")
        out = []
        for k in range(max(map(len, (ja, ko, zh)), default=0)):
            out += [group[k] for group in (ja, ko, zh) if k < len(group)]
        return out[:most]

    def extra_variants(self, query: str, config: SearchConfig) -> list[tuple[str, str]]:
        zh = chinese.variants(query, self.zh_initials) if self.name in ("zh", "all") else []
        ja = japanese.variants(query, config.max_query_variants) if self.name in ("ja", "all") else []
        return zh + ja

    @property
    def has_keys(self) -> bool:
        return self.name != "plain" or type(self) is not Backend

    def variants(self, query: str, config: SearchConfig) -> list[tuple[str, str, int]]:
        """(text, kind, weight) of a query. A text comes again only where it reaches further kinds of keys."""
        plain = normalize(query)
        found = [(query, "Original")] + [(plain, "Normalized")] * (plain != query) + self.extra_variants(query, config)
        out, reach = [], {}
        for text, kind in found:
            if len(out) >= config.max_query_variants:
                break
            if COMPATIBLE[kind] <= reach.get(text, frozenset()):
                continue
            reach[text] = reach.get(text, frozenset()) | COMPATIBLE[kind]
            out.append((text, kind, VARIANT_WEIGHTS[kind]))
        return out


# the characters of has_han, has_kana and has_hangul, for built-in functions
HAN_CHAR = "[\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff]"
KANA_CHAR = "[ぁ-ゖァ-ヶ]"
HANGUL_CHAR = "[가-힣ᄀ-ᇿ\u3130-\u318f\ua960-\ua97f\ud7b0-\ud7ff]"

BACKENDS = {name: Backend(name) for name in ("plain", "ja", "ko", "zh", "all")}


def cap_keys(keys: list[Key], config: SearchConfig) -> list[Key]:
    """Keys without repeats of kind and text. Others than base keys are skipped where they would exceed a cap; base keys stay, and count."""
    out: list[Key] = []
    seen, size = set(), 0
    for key in keys:
        if (key.kind, key.text) in seen:
            continue
        seen.add((key.kind, key.text))
        n = len(key.text.encode())
        if key.kind not in BASE_KINDS and (len(out) >= config.max_search_keys_per_candidate or size + n > config.max_total_key_bytes_per_candidate):
            continue
        out.append(key)
        size += n
    return out


def detect_language(query: str, sample: Iterable[str] = (), locale: str = "") -> str:
    """The language of a query: by its script, else by the locale where the sample holds that language's script."""
    if has_hangul(query):
        return "ko"
    if has_kana(query):
        return "ja"
    if any(not c.isascii() and c.isalpha() for c in query):
        return "plain"
    sample = list(sample)[:256]
    holds = {"ja": any(has_kana(t) or has_han(t) for t in sample), "ko": any(map(has_hangul, sample)), "zh": any(map(has_han, sample))}
    own = locale[:2].lower()
    return own if holds.get(own) else "plain"


def detect_language_of(table: DataFrame, query: str, text: str = "search_text", locale: str = "", sample: int = 256) -> str:
    """detect_language with the scripts of a table's first rows, found by built-in functions; one row comes back."""
    some = table.select(F.col(text).alias("t")).where("t IS NOT NULL").limit(sample)
    holds = lambda pattern: F.coalesce(F.bool_or(F.col("t").rlike(pattern)), F.lit(False))
    han, kana, hangul = some.agg(holds(HAN_CHAR), holds(KANA_CHAR), holds(HANGUL_CHAR)).first()
    return detect_language(query, ["漢"] * han + ["か"] * kana + ["한"] * hangul, locale)


def backend_for(name: str, query: str = "", sample: Iterable[str] = (), locale: str = "", **options) -> Backend:
    if name == "auto":
        name = detect_language(query, sample, locale)
    if name not in BACKENDS:
        raise ValueError(f"unknown language {name!r}")
    return replace(BACKENDS[name], **options)
