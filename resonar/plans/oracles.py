"""SQL of what searches over ASCII tables must return, written out for a given query."""

from __future__ import annotations


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ALNUM = "regexp_matches({0}, '[A-Za-z0-9]')"


def _bonus(q: str) -> str:
    a, b = f"substr(t, {q} - 1, 1)", f"substr(t, {q}, 1)"
    return (
        f"CASE WHEN {q} = 1 OR {a} = ' ' THEN 100 WHEN {a} IN ('/', '\\', ',', ':', ';', '|') THEN 90 WHEN NOT {_ALNUM.format(a)} THEN 80 "
        f"WHEN (regexp_matches({a}, '[a-z]') AND regexp_matches({b}, '[A-Z]')) OR (NOT regexp_matches({a}, '[0-9]') AND regexp_matches({b}, '[0-9]')) THEN 70 ELSE 0 END"
    )


def greedy(source: str, pattern: str, case_sensitive: bool = False, add: int = 3500) -> str:
    """SELECT id, display, score of source (id, display)."""
    chars = [quoted(c) for c in (pattern if case_sensitive else pattern.lower())]
    return _greedy(source, chars, quoted("".join(pattern if case_sensitive else pattern.lower())), quoted(pattern), case_sensitive, add, "")


def greedy_pairs(source: str, size: int, carry: str) -> str:
    """SELECT id, display, score and carry of source (id, display, p and carry), where each row has a pattern p of one size."""
    return _greedy(source, [f"substr(lower(p), {k}, 1)" for k in range(1, size + 1)], "lower(p)", "p", False, 3500, f"{carry}, ")


def _greedy(source: str, chars: list[str], needle: str, pattern: str, case_sensitive: bool, add: int, carry: str) -> str:
    f = "t" if case_sensitive else "lower(t)"
    kept = f"{carry}p, " if carry else ""
    steps = ["0 AS e0"]
    for k, c in enumerate(chars, 1):
        find = f"instr(substr(f, e{k - 1} + 1), {c})"
        steps.append(f"CASE WHEN e{k - 1} IS NULL OR {find} = 0 THEN NULL ELSE e{k - 1} + {find} END AS e{k}")
    m = len(chars)
    back = [f"e{m} AS q{m}"]
    for k in range(m - 1, 0, -1):
        back.append(f"q{k + 1} - instr(reverse(substr(f, 1, q{k + 1} - 1)), {chars[k - 1]}) AS q{k}")
    parts = [_bonus(f"q{k}") for k in range(1, m + 1)] + [_bonus("q1")]
    parts += [f"CASE WHEN q{k + 1} - q{k} = 1 THEN 40 ELSE -30 - 10 * (q{k + 1} - q{k} - 2) END" for k in range(1, m)]
    if not case_sensitive:
        typed = " || ".join(f"substr(t, q{k}, 1)" for k in range(1, m + 1))
        parts.append(f"CASE WHEN {typed} = {pattern} THEN 75 ELSE 0 END")
    parts.append(f"CASE WHEN f = {needle} THEN 10000 WHEN starts_with(f, {needle}) THEN 8000 WHEN instr(f, {needle}) > 0 THEN 6000 ELSE 0 END")
    total = " + ".join(f"({p})" for p in parts)
    return (
        f"SELECT {carry}id, t AS display, CAST({1000 + 160 * m + add} + {total} - 2 * (q1 - 1) - length(t) // 8 AS BIGINT) AS score FROM "
        f"(SELECT *, {', '.join(back)} FROM (SELECT *, {', '.join(steps)} FROM (SELECT {kept}id, display AS t, {f} AS f FROM ({source}))) WHERE e{m} IS NOT NULL)"
    )


def exact(source: str, pattern: str, add: int = 3500) -> str:
    low = quoted(pattern.lower())
    return (
        f"SELECT id, t AS display, CAST({1000 + add} + CASE WHEN f = {low} THEN 10000 WHEN k = 1 THEN 8000 ELSE 6000 END + CASE WHEN substr(t, k, {len(pattern)}) = {quoted(pattern)} THEN 75 ELSE 0 END - 5 * (k - 1) - length(t) AS BIGINT) AS score "
        f"FROM (SELECT id, display AS t, lower(display) AS f, instr(lower(display), {low}) AS k FROM ({source})) WHERE k > 0"
    )


def term(mode: str, text: str) -> str:
    """Score of a term of the exact family over column t, null where it does not match."""
    n, size = quoted(text.lower()), len(text)
    typed = lambda k: f"CASE WHEN substr(t, {k}, {size}) = {quoted(text)} THEN 75 ELSE 0 END"
    if mode == "equal":
        return f"CASE WHEN lower(t) = {n} THEN 13000 + {typed('1')} END"
    if mode == "prefix":
        return f"CASE WHEN starts_with(lower(t), {n}) THEN 11500 - length(t) + {typed('1')} END"
    if mode == "suffix":
        return f"CASE WHEN ends_with(lower(t), {n}) THEN 11500 - length(t) + {typed(f'length(t) - {size} + 1')} END"
    if mode == "boundary":
        k = f"(length(regexp_extract(t, '(?i)^(.*?)\\b{text}\\b', 1)) + 1)"
        return f"CASE WHEN regexp_matches(t, '(?i)\\b{text}\\b') THEN 11000 - 5 * ({k} - 1) - length(t) + {typed(k)} END"
    k = f"instr(lower(t), {n})"
    return f"CASE WHEN {k} > 0 THEN 10000 - 5 * ({k} - 1) - length(t) + {typed(k)} END"


def ordered(body: str, order: str, limit: int | None, kind: str = "Original") -> str:
    cut = f" LIMIT {limit}" if limit is not None else ""
    return f"SELECT id, display, score, {quoted(kind)} AS key_kind, CAST(0 AS INTEGER) AS key_index FROM ({body}) ORDER BY {order}{cut}"
