"""Korean keys: romanised, initials, and what the two-set keyboard types, all from Hangul arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mapped import Key, KeyList, join

# Letters of initial, vowel and final in Unicode's order.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
ROMAN_INITIAL = "g kk n d tt r m b pp s ss _ j jj ch k t p h".replace("_", "").split(" ")
ROMAN_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
ROMAN_FINAL = ["", *"k k k n n n t l k m p l l p l m p p t t ng t t k t p t".split()]
KEY_INITIAL = "r r s e e f a q q t t d w w c z x v g".split()
KEY_VOWEL = "k o i o j p u p h hk ho hl y n nj np nl b m ml l".split()
KEY_FINAL = ["", *"r r rt s sw sg e f fr fa fq ft fx fv fg a q qt t t d w c z x v g".split()]


def decompose(c: str) -> tuple[int, int, int] | None:
    """Numbers of a syllable's initial, vowel and final."""
    k = ord(c) - 0xAC00
    return (k // 588, k % 588 // 28, k % 28) if 0 <= k < 11172 else None


def keys(text: str, most: int = 8, budget: int = 1024, families: frozenset[str] = frozenset({"romanized", "initials", "keyboard"})) -> list[Key]:
    """Keys of the syllables of text; other characters leave no trace. A key over what is left of budget is left out."""
    if not text or most <= 0 or budget <= 0:
        return []
    found = [(parts, (k, k + 1)) for k, c in enumerate(text) if (parts := decompose(c))]
    if not found or len(found) > budget:
        return []
    roman = [(ROMAN_INITIAL[i] + ROMAN_VOWEL[v] + ROMAN_FINAL[f], s) for (i, v, f), s in found]
    typed = [(KEY_INITIAL[i] + KEY_VOWEL[v] + KEY_FINAL[f], s) for (i, v, f), s in found]
    out = KeyList(most, budget, by_kind=True)
    out.push(join(roman, " ", "KoreanRomanized", out.left))
    out.push(join(roman, "", "KoreanRomanized", out.left))
    out.push(join([(INITIALS[i], s) for (i, _, _), s in found], "", "KoreanInitials", out.left))
    out.push(join(typed, "", "KoreanKeyboard", out.left))
    wanted = {"KoreanRomanized": "romanized", "KoreanInitials": "initials", "KoreanKeyboard": "keyboard"}
    return [k for k in out.keys if wanted[k.kind] in families]


def _per_syllable(text: Column, tables: tuple[list[str], list[str], list[str]], separator: str) -> Column:
    lists = [F.array(*map(F.lit, t)) for t in tables]
    syllables = F.filter(F.transform(F.split(text, ""), lambda c: F.ascii(c) - 0xAC00), lambda k: (k >= 0) & (k < 11172))
    at = lambda table, k: F.get(table, k.cast("int"))
    spelt = F.transform(syllables, lambda k: F.concat(at(lists[0], F.floor(k / 588)), at(lists[1], F.floor(k % 588 / 28)), at(lists[2], k % 28)))
    return F.array_join(spelt, separator)


def romanized_col(text: Column, separator: str = "") -> Column:
    """The romanised key as built-in functions."""
    return _per_syllable(text, (ROMAN_INITIAL, ROMAN_VOWEL, ROMAN_FINAL), separator)


def initials_col(text: Column) -> Column:
    return _per_syllable(text, (list(INITIALS), [""] * 21, [""] * 28), "")


def keyboard_col(text: Column) -> Column:
    return _per_syllable(text, (KEY_INITIAL, KEY_VOWEL, KEY_FINAL), "")
