"""Optimal-alignment fuzzy scorer: affine gaps, the best of all subsequence matches. Runs in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import fold
from .scorers import bonus_at

MATCH, GAP, GAP_MORE, ADJACENT = 16, -3, -1, 4


def score_python(pattern: str, text: str, case_sensitive: bool = False) -> int | None:
    """Best total of 16 a character, a tenth of its surroundings' bonus, 4 for each neighbour, and gap costs; the first character's bonus counts twice."""
    if not pattern:
        return 0
    p, t = (pattern, text) if case_sensitive else (fold(pattern), fold(text))
    at = -1
    for c in p:
        at = t.find(c, at + 1)
        if at < 0:
            return None
    low = -(10**9)
    ends = [low] * len(t)
    for i, c in enumerate(p):
        now, best, adjacent = [low] * len(t), low, low
        for j, d in enumerate(t):
            if j >= 2:  # a gap opens behind ends[j - 2] or grows by one
                best = max(best + GAP_MORE, ends[j - 2] + GAP)
            adjacent = ends[j - 1] if j else low
            if c == d:
                own = MATCH + bonus_at(text, j) // 10 * (2 if i == 0 else 1)
                before = 0 if i == 0 else max(best, adjacent + ADJACENT)
                if before > low // 2:
                    now[j] = before + own
        ends = now
    return max(ends)


def score(pattern: str, text: Column, case_sensitive: bool = False) -> Column:
    from .batch import score_column

    return F.lit(0).cast("long") if not pattern else score_column("optimal", pattern, text, case_sensitive)
