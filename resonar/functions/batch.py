"""Scorers over Arrow batches in numpy: all rows of a batch at once.

A batch's texts are one run of characters: of bytes where all are ASCII, else of code points. Where a character stands is
looked up for all rows at once, so a walk along a pattern costs one binary search for each row that still matches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import optimal
from .normalize import fold
from .scorers import ADJACENT, CASE, DELIMITERS, DOTTED, GAP, GAP_MORE, INSIDE, MATCH, PREFIX, START, WHOLE, _class_of, exact_python, greedy_python

# classes of characters as in scorers: 0 other, 1 white space, 2 delimiter, 3 number, 4 lower, 5 upper, 6 other letter
_LETTER = 6
#: Bonus by the class before and the class of a place.
_BONUS = np.zeros((6, 6), np.int64)
_BONUS[0], _BONUS[1], _BONUS[2] = 80, 100, 90
_BONUS[4, 3] = _BONUS[5, 3] = _BONUS[4, 5] = 70
#: A letter without case counts as an upper one before a place, and as a lower one at it.
_BEFORE, _OWN = np.array([0, 1, 2, 3, 4, 5, 5], np.uint8), np.array([0, 1, 2, 3, 4, 5, 4], np.uint8)
#: Control characters that are white space in texts with characters outside ASCII only.
_CONTROLS = (0x0B, 0x1C, 0x1D, 0x1E, 0x1F)


class _Characters:
    """Fold and class of characters, looked up once in each process."""

    def __init__(self):
        self.known = np.zeros(0x110000, bool)
        self.fold = np.arange(0x110000, dtype=np.uint32)
        self.kind = np.zeros(0x110000, np.uint8)
        self.size = np.full(0x110000, 4, np.uint8)
        self.size[:0x80], self.size[0x80:0x800], self.size[0x800:0x10000] = 1, 2, 3
        self.learn(np.arange(128))

    def learn(self, points: np.ndarray) -> None:
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        for k in np.flatnonzero(seen & ~self.known).tolist():
            c = chr(k)
            self.fold[k] = ord(fold(c))
            self.kind[k] = 2 if c in DELIMITERS else "osdnlua".index(_class_of(c))
        self.known |= seen


_CHARACTERS = _Characters()


class Texts:
    """The texts of an Arrow string array: characters, and where each row starts and ends among them."""

    def __init__(self, texts: pa.Array):
        self.texts = texts = texts.cast(pa.large_string())
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        at = at - at[0]
        self.null = texts.is_null().to_numpy(zero_copy_only=False)
        self.rows = np.flatnonzero(~self.null)
        strange = np.flatnonzero(raw >= 128)
        self.ascii = np.searchsorted(strange, at[:-1]) == np.searchsorted(strange, at[1:])
        if len(strange):
            heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            at = heads[at]
            raw = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            _CHARACTERS.learn(raw)
        self.data = raw if len(raw) else np.zeros(1, np.uint8)
        self.start, self.end = at[:-1], at[1:]
        self.lower = _CHARACTERS.fold[self.data].astype(self.data.dtype)
        self._places: dict[tuple[bool, int], np.ndarray] = {}
        self._kind = self._bytes = None

    @property
    def kind(self) -> np.ndarray:
        """Classes of all characters."""
        if self._kind is None:
            self._kind = _CHARACTERS.kind[self.data]
            odd = np.flatnonzero(np.isin(self.data, _CONTROLS))
            row = np.searchsorted(self.end, odd, side="right")
            self._kind[odd[self.ascii[np.minimum(row, len(self.ascii) - 1)]]] = 0
        return self._kind

    def octets(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """UTF-8 bytes between places."""
        if self.data.dtype == np.uint8:
            return end - start
        if self._bytes is None:
            self._bytes = np.concatenate(([0], np.cumsum(_CHARACTERS.size[self.data], dtype=np.int64)))
        return self._bytes[end] - self._bytes[start]

    def places(self, cased: bool, c: int) -> np.ndarray:
        """Where a character stands; a place behind all texts comes last."""
        if (cased, c) not in self._places:
            self._places[cased, c] = np.append(np.flatnonzero((self.data if cased else self.lower) == c), len(self.data))
        return self._places[cased, c]

    def bonus(self, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        before = np.where(at > start, _BEFORE[self.kind[np.maximum(at - 1, 0)]], 1)
        return _BONUS[before, _OWN[self.kind[at]]]

    def holding(self, cased: bool, needle: list[int], rows: np.ndarray) -> np.ndarray:
        """Of each row, the first place of needle; -1 where there is none."""
        f = self.data if cased else self.lower
        at = self.places(cased, needle[0])[:-1]
        for j, c in enumerate(needle[1:], 1):
            at = at[at + j < len(f)]
            at = at[f[at + j] == c]
        at = np.append(at, len(f))
        first = at[np.searchsorted(at, self.start[rows])]
        return np.where(first + len(needle) <= self.end[rows], first, -1)


Scores = tuple[np.ndarray, np.ndarray]  # rows that match, and their scores


def _typed(texts: Texts, places: list[np.ndarray], pattern: str) -> np.ndarray:
    same = np.ones(len(places[0]), bool)
    for at, c in zip(places, pattern, strict=True):
        same &= texts.data[at] == ord(c)
    return same


def _walk(texts: Texts, needle: list[int], cased: bool, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Those of rows that hold needle as a subsequence, and the places of the match that ends first, latest places first
    found backwards from its end."""
    at = texts.start[rows] - 1
    for c in needle:
        found = texts.places(cased, c)
        at = found[np.searchsorted(found, at + 1)]
        on = at < texts.end[rows]
        if not on.all():
            rows, at = rows[on], at[on]
    places = [at]
    for c in reversed(needle[:-1]):
        found = texts.places(cased, c)
        at = found[np.searchsorted(found, at) - 1]
        places.append(at)
    return rows, places[::-1]


def _needle(pattern: str, cased: bool) -> list[int]:
    """The pattern's characters as they are compared."""
    return [ord(c) for c in (pattern if cased else fold(pattern))]


def greedy(pattern: str, texts: Texts, cased: bool, among: np.ndarray | None = None) -> Scores:
    needle = _needle(pattern, cased)
    rows, q = _walk(texts, needle, cased, texts.rows if among is None else among)
    start, end = texts.start[rows], texts.end[rows]
    out = START + MATCH * len(needle) - 2 * (q[0] - start) - (end - start) // 8 + texts.bonus(q[0], start)
    for k, at in enumerate(q):
        out = out + texts.bonus(at, start)
        if k:
            d = at - q[k - 1]
            out += np.where(d == 1, ADJACENT, GAP + GAP_MORE * (d - 2))
    if not cased:
        out += np.where(_typed(texts, q, pattern), CASE, 0)
    first = texts.holding(cased, needle, rows)
    out += np.where(first < 0, 0, np.where(first > start, INSIDE, np.where(end - start == len(needle), WHOLE, PREFIX)))
    return rows, out


def exact(pattern: str, texts: Texts, cased: bool, among: np.ndarray | None = None) -> Scores:
    needle = _needle(pattern, cased)
    rows = texts.rows if among is None else among
    first = texts.holding(cased, needle, rows)
    rows, first = rows[first >= 0], first[first >= 0]
    start, size = texts.start[rows], texts.end[rows] - texts.start[rows]
    out = START + np.where(size == len(needle), WHOLE, np.where(first == start, PREFIX, INSIDE)) - 5 * texts.octets(start, first) - size
    if not cased:
        out += np.where(_typed(texts, [first + k for k in range(len(needle))], pattern), CASE, 0)
    return rows, out


def best_alignment(pattern: str, texts: Texts, cased: bool, among: np.ndarray | None = None) -> Scores:
    """Rows of similar length as one matrix: for each character of the pattern, the best total that ends at each place."""
    needle = _needle(pattern, cased)
    rows, _ = _walk(texts, needle, cased, texts.rows if among is None else among)
    out = np.zeros(len(rows), np.int64)
    size = texts.end[rows] - texts.start[rows]
    order = np.argsort(size, kind="stable")
    f = texts.data if cased else texts.lower
    low = -(1 << 40)
    k = 0
    while k < len(order):
        many = max(1, min(len(order) - k, (1 << 20) // int(size[order[min(len(order), k + 4096) - 1]])))
        some = order[k : k + min(many, 4096)]
        k += len(some)
        width = int(size[some].max())
        j = np.arange(width)
        inside = j < size[some][:, None]
        at = np.where(inside, texts.start[rows[some]][:, None] + j, 0)
        own = optimal.MATCH + texts.bonus(at, texts.start[rows[some]][:, None]) // 10
        first = own + texts.bonus(at, texts.start[rows[some]][:, None]) // 10
        char = np.where(inside, f[at], 0)
        ends = None
        for i, c in enumerate(needle):
            if i == 0:
                now = first
            else:
                # a gap behind place j' costs GAP, and GAP_MORE for each place beyond the first
                run = np.maximum.accumulate(ends - optimal.GAP_MORE * j, axis=1)
                before = np.full_like(ends, low)
                before[:, 2:] = run[:, :-2] + optimal.GAP + optimal.GAP_MORE * (j[2:] - 2)
                before[:, 1:] = np.maximum(before[:, 1:], ends[:, :-1] + optimal.ADJACENT)
                now = before + own
            ends = np.where((char == c) & inside & (now > low // 2), now, low)
        out[some] = ends.max(axis=1)
    return rows, out


#: By name: the scorer of a batch's rows, and the twin for one text.
SCORERS: dict[str, tuple[Callable[[str, Texts, bool, np.ndarray | None], Scores], Callable[[str, str, bool], int | None]]] = {
    "greedy": (greedy, greedy_python),
    "exact": (exact, exact_python),
    "optimal": (best_alignment, optimal.score_python),
}
_RESULT = pa.struct([("score", pa.int64()), ("v", pa.int32()), ("k", pa.int32())])


def scores(name: str, pattern: str, texts: Texts, cased: bool, among: np.ndarray | None = None) -> Scores:
    """Rows (of `among`, all by default) that match pattern, and their scores. An empty pattern matches all with 0."""
    on = texts.rows if among is None else texts.rows[among[texts.rows]]
    if not pattern:
        return on, np.zeros(len(on), np.int64)
    whole, one = SCORERS[name]
    rows, got = whole(pattern, texts, cased, on)
    if cased or texts.data.dtype == np.uint8 or one is optimal.score_python:
        return rows, got
    # a dotted letter may be compared in two spellings where the first comparison fails: those few texts one by one
    missed = np.zeros(len(texts.start), bool)
    missed[on] = True
    missed[rows] = False
    if DOTTED not in pattern:
        dotted = texts.places(True, ord(DOTTED))[:-1]
        held = np.zeros_like(missed)
        held[np.searchsorted(texts.end, dotted, side="right")] = True
        missed &= held
    else:
        missed &= ~texts.ascii
    other = np.flatnonzero(missed)
    if not len(other):
        return rows, got
    more = [one(pattern, t, cased) for t in texts.texts.take(pa.array(other)).to_pylist()]
    hits = [k for k, x in enumerate(more) if x is not None]
    return np.concatenate((rows, other[hits])), np.concatenate((got, np.array([more[k] for k in hits], np.int64)))


def best_column(name: str, variants: list[tuple[str, frozenset[str], int]], base: list[tuple[Column, str, int]], keys: Column | None, cased: bool) -> Column:
    """struct<score, v, k> of the best compatible variant and key of a row: the highest score; of equals the first variant,
    then the first key. v and k are negated, so that the greatest struct is the best.

    variants: pattern, kinds of keys it meets, weight. base: text, kind and weight of the keys that every row has; keys:
    a column of further ones (text, kind, weight).
    """
    kinds = [k for _, k, _ in base]

    def run(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        parts, row, order, kind, weight = [], [], [], [], []
        for k, (text, (_, own, w)) in enumerate(zip(columns, base_plain, strict=False)):
            parts.append(text.cast(pa.large_string()))
            row.append(np.arange(n))
            order.append(np.full(n, k))
            kind.append(np.full(n, kinds.index(own)))
            weight.append(np.full(n, w))
        names = list(kinds)
        if len(columns) > len(base_plain):
            more = columns[-1]
            flat = more.flatten()
            size = np.nan_to_num(more.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            own = flat.field("kind").dictionary_encode()
            named = own.dictionary.to_pylist()
            parts.append(flat.field("text").cast(pa.large_string()))
            row.append(np.repeat(np.arange(n), size))
            order.append(len(base_plain) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            kind.append(len(names) + own.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            weight.append(flat.field("weight").to_numpy(zero_copy_only=False).astype(np.int64))
            names += named
        row, order, kind, weight = (np.concatenate(x) for x in (row, order, kind, weight))
        texts = Texts(pa.concat_arrays(parts))
        best, found_v, found_k = np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for v, (pattern, meets, own_weight) in enumerate(variants):
            allowed = np.array([x in meets for x in names], bool)[kind]
            at, got = scores(name, pattern, texts, cased, allowed)
            got = got + weight[at] + own_weight
            first = np.lexsort((order[at], -got, row[at]))
            first = first[np.flatnonzero(np.diff(row[at][first], prepend=-1))]
            r, s, k = row[at][first], got[first], order[at][first]
            better = s > best[r]
            best[r[better]], found_v[r[better]], found_k[r[better]] = s[better], -v, -k[better]
        none = best == np.iinfo(np.int64).min
        return pa.StructArray.from_arrays([pa.array(best), pa.array(found_v), pa.array(found_k)], fields=list(_RESULT), mask=pa.array(none))

    base_plain = [(None, own, w) for _, own, w in base]
    given = [c for c, _, _ in base] + ([] if keys is None else [keys])
    # not deterministic, says the plan: else a filter on the result would be pushed below and score every row twice
    return _arrow_udf(run, len(given))(*given)


def _arrow_udf(run, n: int):
    if n == 1:

        def call(a: pa.Array) -> pa.Array:
            return run(a)
    elif n == 2:

        def call(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)
    else:

        def call(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run(a, b, c)

    return F.arrow_udf(call, "struct<score:bigint,v:int,k:int>").asNondeterministic()


def score_column(name: str, pattern: str, text: Column, cased: bool) -> Column:
    """Scores of one text as a long column; null where it does not match."""

    def run(a: pa.Array) -> pa.Array:
        rows, got = scores(name, pattern, Texts(a), cased)
        out, none = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        out[rows], none[rows] = got, False
        return pa.array(out, mask=none)

    def call(a: pa.Array) -> pa.Array:
        return run(a)

    return F.arrow_udf(call, "long")(text)
