"""The extended query language: fuzzy, exact, prefix, suffix, equal, boundary and negated terms, AND and OR."""

from __future__ import annotations

from dataclasses import dataclass

SPECIAL = frozenset(" \t|!'^$")


@dataclass(frozen=True)
class Term:
    text: str
    negated: bool = False
    mode: str = "fuzzy"  # fuzzy, exact, prefix, suffix, equal, boundary


def is_extended(query: str) -> bool:
    """Whether a special character stands anywhere without a backslash before it."""
    k = 0
    while k < len(query):
        if query[k] == "\\":
            k += 2
        elif query[k] in SPECIAL:
            return True
        else:
            k += 1
    return False


def tokens(query: str) -> list[str]:
    """Pieces between spaces and tabs, | a piece of its own. A backslash goes and saves what follows; a last one stays."""
    out, own, k = [], "", 0
    while k < len(query):
        c = query[k]
        if c == "\\" and k + 1 < len(query):
            own += query[k + 1]
            k += 2
            continue
        if c in " \t|":
            out += [own] * bool(own) + ["|"] * (c == "|")
            own = ""
        else:
            own += c
        k += 1
    return out + [own] * bool(own)


def parse_term(raw: str, exact: bool = False) -> Term | None:
    negated = raw.startswith("!")
    text = raw[1:] if negated else raw
    mode = "exact" if exact or negated else "fuzzy"
    if text.startswith("'"):
        text = text[1:]
        if text.endswith("'") and len(text) > 1:
            text, mode = text[:-1], "boundary"
        else:
            mode = "fuzzy" if exact and not negated else "exact"
    front, back = text.startswith("^"), text.endswith("$") and text != "^"
    if front:
        text = text[1:]
    if back and text:
        text = text[:-1]
    if front or back:
        mode = "equal" if front and back else "prefix" if front else "suffix"
    return Term(text, negated, mode) if text else None


def parse(query: str, exact: bool = False) -> list[list[Term]]:
    """Groups of terms: any group may hold, and all terms of one must. a b | c is (a and b) or c."""
    groups: list[list[Term]] = [[]]
    for piece in tokens(query):
        if piece == "|":
            groups.append([])
        elif term := parse_term(piece, exact):
            groups[-1].append(term)
    return [g for g in groups if g]


def highlight_patterns(query: str, exact: bool = False) -> list[str]:
    """Texts of the terms that a match shows."""
    return [t.text for g in parse(query, exact) for t in g if not t.negated] if is_extended(query) else [query] * bool(query)
