"""Scorers as expressions of built-in functions, and their plain Python twins.

A pattern is known when the plan is made, so the walk to the earliest end of a subsequence is a chain of position().
The walk back goes over the reversed text, and what follows uses all places of a match; both are lambdas over a short
array, which keeps generated code small for any pattern.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import fold, fold_col, is_ascii

# Parts of a fuzzy score.
START, MATCH, GAP, GAP_MORE, ADJACENT, CASE = 1000, 160, -30, -10, 40, 75
WHOLE, PREFIX, INSIDE = 10_000, 8_000, 6_000
DELIMITERS = "/\\,:;|"
DOTTED, DOTTED_TWO = "İ", "i̇"


def _at(sub: Column, text: Column, start: Column | None = None) -> Column:
    """1-based position of sub from start on; null where there is none."""
    return F.nullif(F.position(sub, text, start) if start is not None else F.position(sub, text), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Classes of characters: s white space, d delimiter, n number, l lower, u upper, a other letter, o all else.
_ASCII = "".join(map(chr, range(128)))


def _ascii_class(c: str) -> str:
    if c in " \t\n\r\f":
        return "s"
    return "d" if c in DELIMITERS else "n" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o"


_CLASSES = "".join(map(_ascii_class, _ASCII))


def classes(text: Column) -> Column:
    """One letter for each character's class, after an s for the text's start."""
    other = text
    steps = ((r"\x0b", " "), (r"[\p{N}&&[^\x00-\x7f]]", "0"), (r"[\p{IsLowercase}&&[^\x00-\x7f]]", "a"), (r"[\p{IsUppercase}&&[^\x00-\x7f]]", "A"))
    for pattern, stands in (*steps, (r"[\p{IsWhite_Space}&&[^\x00-\x7f]]", " "), (r"[\p{IsAlphabetic}&&[^\x00-\x7f]]", "\u00aa"), (r"[^\x00-\x7f\u00aa]", "#")):
        other = F.regexp_replace(other, pattern, stands)
    plain = F.translate(text, _ASCII[1:], _CLASSES[1:])
    return F.concat(F.lit("s"), F.when(is_ascii(text), plain).otherwise(F.translate(other, _ASCII[1:] + "\u00aa", _CLASSES[1:] + "a")))


def _bonus(kinds: Column, q: Column) -> Column:
    """What a match at 1-based place q earns: by the class before it, else by a turn from one class to another."""
    pair = F.substring(kinds, q, F.lit(2))
    first = F.substring(kinds, q, F.lit(1))
    return F.when(first == "s", 100).when(first == "d", 90).when(first == "o", 80).when((pair == "lu") | (pair == "ln") | (pair == "un") | (pair == "an"), 70).otherwise(0)


def subsequence_end(pattern: str, text: Column) -> Column:
    """1-based place where the earliest subsequence match ends; null where there is none. Compiles to plain code."""
    return reduce(lambda e, c: _at(F.lit(c), text, e + 1), pattern, F.lit(0))


def _whole(needle: str, f: Column) -> Column:
    return F.when(f == needle, WHOLE).when(f.startswith(needle), PREFIX).when(F.position(F.lit(needle), f) > 0, INSIDE).otherwise(0)


def _gap(d: Column) -> Column:
    return F.when(d == 1, ADJACENT).otherwise(GAP + GAP_MORE * (d - 2))


def _score_places(pattern: str, needle: str, text: Column, f: Column, end: Column, typed: bool) -> Column:
    size = F.length(text)
    before = F.array(*[F.lit(c) for c in reversed(needle[:-1])]) if len(needle) > 1 else F.array().cast("array<string>")

    def places(back: Column) -> Column:
        step = lambda q, c: F.array_prepend(q, size + 1 - F.position(c, back, size + 2 - F.get(q, F.lit(0))))
        return F.aggregate(before, F.array(end), step)

    def total(q: Column, kinds: Column) -> Column:
        # the first character's bonus counts twice; others bring the gap before them
        each = F.transform(q, lambda x, i: F.when(i == 0, 2).otherwise(1) * _bonus(kinds, x) + F.when(i == 0, 0).otherwise(_gap(x - F.get(q, i - 1))))
        out = START + MATCH * len(needle) + F.aggregate(each, F.lit(0), lambda a, x: a + x) - 2 * (F.get(q, F.lit(0)) - 1) - F.floor(size / 8)
        if typed:
            out = out + F.when(F.array_join(F.transform(q, lambda x: F.substring(text, x, F.lit(1))), "") == pattern, CASE).otherwise(0)
        return out

    found = let(F.reverse(f), places)
    return (let(classes(text), lambda kinds: let(found, lambda q: total(q, kinds))) + _whole(needle, f)).cast("long")


def _greedy_once(pattern: str, text: Column, case_sensitive: bool, case_bonus: bool = True) -> Column:
    needle = pattern if case_sensitive else fold(pattern)
    score = lambda f: lambda end: F.when(end.isNotNull(), _score_places(pattern, needle, text, f, end, case_bonus and not case_sensitive))
    return let(text if case_sensitive else fold_col(text), lambda f: let(subsequence_end(needle, f), score(f)))


def _exact_once(pattern: str, text: Column, case_sensitive: bool, case_bonus: bool = True) -> Column:
    needle = pattern if case_sensitive else fold(pattern)

    def score(f: Column, k: Column) -> Column:
        reach = F.when(f == needle, WHOLE).when(k == 1, PREFIX).otherwise(INSIDE)
        typed = not case_sensitive and case_bonus
        case = F.when(F.substring(text, k, F.lit(len(pattern))) == pattern, CASE).otherwise(0) if typed else F.lit(0)
        start = F.octet_length(F.substring(text, F.lit(1), k - 1))
        return F.when(k.isNotNull(), (START + reach + case - 5 * start - F.length(text)).cast("long"))

    return let(text if case_sensitive else fold_col(text), lambda f: let(_at(F.lit(needle), f), lambda k: score(f, k)))


def _with_rewrites(once, pattern: str, text: Column, case_sensitive: bool) -> Column:
    """A failed comparison that involves İ is tried again with the letter composed, and then written out.

    The rewrites add or take away only i, İ and the dot, so a pattern without them cannot gain from either.
    """
    first = once(pattern, text, case_sensitive)
    if case_sensitive or not set(pattern.lower()) & set(DOTTED_TWO):
        return first
    held = F.lit(True) if DOTTED in pattern else F.contains(text, F.lit(DOTTED))
    composed_p = pattern.replace(DOTTED_TWO, DOTTED)
    composed_t = F.replace(text, F.lit(DOTTED_TWO), F.lit(DOTTED))
    spelt_p, spelt_t = pattern.replace(DOTTED, DOTTED_TWO), F.replace(text, F.lit(DOTTED), F.lit(DOTTED_TWO))
    again = F.coalesce(once(composed_p, composed_t, False, False), once(spelt_p, spelt_t, False, False))
    return F.coalesce(first, F.when(held, again))


def greedy(pattern: str, text: Column, case_sensitive: bool = False) -> Column:
    """Greedy fuzzy score (long); null where the pattern is no subsequence of text."""
    return F.lit(0).cast("long") if not pattern else _with_rewrites(_greedy_once, pattern, text, case_sensitive)


def exact(pattern: str, text: Column, case_sensitive: bool = False) -> Column:
    """Substring score (long); null where text does not hold the pattern."""
    return F.lit(0).cast("long") if not pattern else _with_rewrites(_exact_once, pattern, text, case_sensitive)


def subsequence_filter(pattern: str, text: Column) -> Column:
    """A LIKE that any case-sensitive subsequence match meets."""
    escaped = [f"\\{c}" if c in "%_\\" else c for c in pattern]
    return text.like("%" + "%".join(escaped) + "%")


# ---- plain Python twins, for tests and for rows that Python handles anyway


def _class_of(c: str) -> str:
    if c.isspace():
        return "s"
    return "n" if c.isnumeric() else "u" if c.isupper() else "l" if c.islower() else "a" if c.isalpha() else "o"


def bonus_at(text: str, q: int) -> int:
    """q counts from 0."""
    if q == 0:
        return 100
    before, own = text[q - 1], text[q]
    if before == "\x0b" and text.isascii():
        return 80
    b, o = _class_of(before), _class_of(own)
    if b == "s":
        return 100
    if before in DELIMITERS:
        return 90
    if b == "o":
        return 80
    return 70 if b == "l" and o == "u" or b != "n" and o == "n" else 0


def _greedy_python(pattern: str, text: str, case_sensitive: bool, case_bonus: bool) -> int | None:
    wanted, f = (pattern, text) if case_sensitive else (fold(pattern), fold(text))
    end = -1
    for c in wanted:
        end = f.find(c, end + 1)
        if end < 0:
            return None
    places = [end]
    for c in reversed(wanted[:-1]):
        places.append(f.rfind(c, 0, places[-1]))
    q = places[::-1]
    gaps = sum(ADJACENT if b - a == 1 else GAP + GAP_MORE * (b - a - 2) for a, b in zip(q, q[1:], strict=False))
    case = CASE if not case_sensitive and case_bonus and "".join(text[k] for k in q) == pattern else 0
    whole = WHOLE if f == wanted else PREFIX if f.startswith(wanted) else INSIDE if wanted in f else 0
    return START + MATCH * len(q) + sum(bonus_at(text, k) for k in q) + bonus_at(text, q[0]) + gaps + case - 2 * q[0] - len(text) // 8 + whole


def _exact_python(pattern: str, text: str, case_sensitive: bool, case_bonus: bool) -> int | None:
    needle, f = (pattern, text) if case_sensitive else (fold(pattern), fold(text))
    k = f.find(needle)
    if k < 0:
        return None
    case = CASE if not case_sensitive and case_bonus and text.startswith(pattern, k) else 0
    return START + (WHOLE if f == needle else PREFIX if k == 0 else INSIDE) + case - 5 * len(text[:k].encode()) - len(text)


def _retried(once, pattern: str, text: str, case_sensitive: bool) -> int | None:
    if not pattern:
        return 0
    got = once(pattern, text, case_sensitive, True)
    if got is None and not case_sensitive and (DOTTED in pattern or DOTTED in text):
        got = once(pattern.replace(DOTTED_TWO, DOTTED), text.replace(DOTTED_TWO, DOTTED), False, False)
        if got is None:
            got = once(pattern.replace(DOTTED, DOTTED_TWO), text.replace(DOTTED, DOTTED_TWO), False, False)
    return got


def greedy_python(pattern: str, text: str, case_sensitive: bool = False) -> int | None:
    return _retried(_greedy_python, pattern, text, case_sensitive)


def exact_python(pattern: str, text: str, case_sensitive: bool = False) -> int | None:
    return _retried(_exact_python, pattern, text, case_sensitive)
