"""Text normalisation: built-in expressions where Spark has them, one Arrow UDF for NFKC."""

from __future__ import annotations

import unicodedata

import pyarrow as pa

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Dashes and prolonged-sound marks that count as a hyphen.
DASHES = "‐‑‒–—―−゠ー﹘﹣－ｰ"
_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
_TO_HIRAGANA = str.maketrans(_KATAKANA, _HIRAGANA)
_TO_KATAKANA = str.maketrans(_HIRAGANA, _KATAKANA)
_DASH = str.maketrans(DASHES, "-" * len(DASHES))
ASCII = r"^[\x00-\x7F]*$"
#: Nine blocks of Han characters.
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}\x{3005}\x{3007}]"


def lower_each(text: str) -> str:
    """Lower case character by character, so that a closing sigma stays an ordinary one."""
    return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()


def normalize(text: str) -> str:
    """NFKC, lower case of each character, dashes to hyphens."""
    if text.isascii():
        return text.lower()
    return lower_each(unicodedata.normalize("NFKC", text)).translate(_DASH)


def fold(text: str) -> str:
    """Lower case where it is one character for one; only İ is not."""
    return text.lower() if text.isascii() else lower_each(text.replace("İ", "\ue000")).replace("\ue000", "İ")


def to_hiragana(text: str) -> str:
    return text.translate(_TO_HIRAGANA)


def to_katakana(text: str) -> str:
    return text.translate(_TO_KATAKANA)


def fold_dashes(text: str) -> str:
    return text.translate(_DASH)


def has_kana(text: str) -> bool:
    return any("ぁ" <= c <= "ゖ" or "ァ" <= c <= "ヶ" for c in text)


def has_han(text: str) -> bool:
    return any("㐀" <= c <= "鿿" or "豈" <= c <= "﫿" for c in text)


def has_hangul(text: str) -> bool:
    return any("가" <= c <= "힣" or "ᄀ" <= c <= "ᇿ" or "㄰" <= c <= "㆏" or "ꥠ" <= c <= "꥿" or "ힰ" <= c <= "퟿" for c in text)


def _normalized(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normalize(t) for t in text.to_pylist()], pa.string())


_normalize_udf = F.arrow_udf(_normalized, StringType())


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def normalize_col(text: Column) -> Column:
    """normalize as a Column. ASCII rows stay in the JVM: Python workers get null for them."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(_normalize_udf(F.when(~is_ascii(text), text)))


def fold_col(text: Column) -> Column:
    """fold as a Column of built-in functions."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.translate(F.lower(F.translate(text, "Σİ", "σ\ue000")), "\ue000", "İ"))


def lower_col(text: Column) -> Column:
    """Whole-text lower case, which knows a closing sigma."""
    return F.lower(text)


def fold_dashes_col(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def to_hiragana_col(text: Column) -> Column:
    return F.translate(text, _KATAKANA, _HIRAGANA)


def to_katakana_col(text: Column) -> Column:
    return F.translate(text, _HIRAGANA, _KATAKANA)


def has_kana_col(text: Column) -> Column:
    return text.rlike("[ぁ-ゖァ-ヶ]")


def has_han_col(text: Column) -> Column:
    return text.rlike(HAN)


def has_hangul_col(text: Column) -> Column:
    return text.rlike(r"[가-힣\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}]")


def visible_controls_col(text: Column) -> Column:
    """Control characters as visible ones, one for one."""
    plain = "".join(map(chr, [*range(1, 32), 127, *range(128, 160)]))
    shown = "".join(map(chr, [*range(0x2401, 0x2420), 0x2421])) + "�" * 32
    return F.translate(F.replace(text, F.lit("\x00"), F.lit("␀")), plain, shown)


def strip_ansi_col(text: Column) -> Column:
    """Without terminal escapes: ESC goes, and after ESC [ all up to the first character of @ to ~."""
    return F.regexp_replace(text, r"\x1b(\[[^\x40-\x7e]*[\x40-\x7e]?)?", "")


def char_slice_col(text: Column, start: int, end: int) -> Column:
    return F.substring(text, start + 1, end - start)
