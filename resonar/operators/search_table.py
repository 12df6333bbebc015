"""Search for a table of queries in one scan of the index.

The plan is the same for one query and for ten thousand: queries are compiled to patterns and terms, sent to the tasks
once, and met with each Arrow batch of keys there. Signatures of characters and neighbours rule out most pairs of pattern
and key; what is left is scored by the same batch scorers as a single search, and each query's best rows of the batch go on
to one window, which cuts per partition before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COMPATIBLE, KEY_WEIGHTS, SearchConfig, total_order
from ..functions import scorers
from ..functions.batch import Texts, scores
from ..functions.languages import BACKENDS, Backend
from ..functions.normalize import fold
from ..functions.signatures import signatures
from ..shared import spread
from . import query as language
from .rank import RESULT, exact_ranks, tie_columns, tiebreak_query
from .search import _base_keys, _matcher, _spelt_at, _variants, comparable

#: Distinct queries that are sent to the tasks at once; a larger table is searched in so many scans more.
BLOCK = 20_000
#: Pairs of signatures compared at once, and rows given on at once.
PAIRS, ROWS = 1 << 22, 1 << 16
#: Hits of terms kept for a batch, of 24 bytes each.
HELD = 1 << 21


@dataclass
class _Fuzzy:
    """Variants of one text: pattern, kinds it meets, weight, and their places in the list of all patterns."""

    scorer: str
    folds: bool
    cased: bool
    variants: list[tuple[str, frozenset[str], int, int]]


@dataclass
class _Query:
    text: str
    cased: bool
    tie: str
    whole: _Fuzzy | None  # a plain query; None with no groups: every row
    groups: list[list[tuple[language.Term, _Fuzzy | None]]]


class Compiled:
    """Queries as tasks need them. Patterns that occur again are looked at once for each batch."""

    def __init__(self, queries: list[str], config: SearchConfig, backend: Backend, case: str | None):
        self.patterns: dict[tuple[str, str, bool, bool], int] = {}
        self.config, self.backend = config, backend
        self.queries = [self._query(q, config if case is None else config.with_case(q, case)) for q in queries]
        texts = Texts(pa.array([k[0] for k in self.patterns], pa.string()))
        self.chars, self.pairs = signatures(texts)
        for (pattern, scorer, _, _), k in self.patterns.items():
            if scorer != "exact":
                self.pairs[k] = 0
            if scorers.DOTTED in pattern or scorers.DOTTED_TWO in pattern:
                self.chars[k] = self.pairs[k] = 0

    def _fuzzy(self, text: str, config: SearchConfig) -> _Fuzzy:
        matcher = _matcher(config)
        if matcher.batch is None:
            raise ValueError("a table of queries wants a matcher that scores batches")
        out = []
        for pattern, kind, weight in _variants(text, self.backend, config):
            key = (pattern, matcher.batch, matcher.folds_case, config.case_sensitive)
            out.append((pattern, frozenset(COMPATIBLE[kind]), weight, self.patterns.setdefault(key, len(self.patterns))))
        return _Fuzzy(matcher.batch, matcher.folds_case, config.case_sensitive, out)

    def _query(self, text: str, config: SearchConfig) -> _Query:
        made = _Query(text, config.case_sensitive, tiebreak_query(text), None, [])
        if config.disabled:
            return made
        if not (config.extended and language.is_extended(text)):
            made.whole = self._fuzzy(text, config)
            return made
        loose = replace(config, exact=False)
        made.groups = [[(t, self._fuzzy(t.text, loose) if t.mode == "fuzzy" else None) for t in g] for g in language.parse(text, config.exact)]
        return made


Hits = tuple[np.ndarray, np.ndarray, np.ndarray]  # rows in ascending order, score, index of the key
_NONE: Hits = (np.zeros(0, np.int64),) * 3


def _best_of(row: np.ndarray, score: np.ndarray, variant: np.ndarray, key: np.ndarray) -> Hits:
    """Of each row the highest score; of equals the first variant, then the first key."""
    first = np.lexsort((key, variant, -score, row))
    first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
    return row[first], score[first], key[first]


class _Keys:
    """All keys of a batch's rows: texts, their rows, places in the row's list, kinds and weights."""

    def __init__(self, n: int, base: list[tuple[pa.Array, str]], more: pa.Array | None):
        kinds = [kind for _, kind in base]
        parts = [text.cast(pa.large_string()) for text, _ in base]
        row, order = [np.arange(n)] * len(base), [np.full(n, k) for k in range(len(base))]
        kind, weight = [np.full(n, k) for k in range(len(base))], [np.full(n, KEY_WEIGHTS[k]) for k in kinds]
        if more is not None:
            flat, size = more.flatten(), np.nan_to_num(more.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            named = flat.field("kind").dictionary_encode()
            parts.append(flat.field("text").cast(pa.large_string()))
            row.append(np.repeat(np.arange(n), size))
            order.append(len(base) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            kind.append(len(kinds) + named.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            weight.append(flat.field("weight").to_numpy(zero_copy_only=False).astype(np.int64))
            kinds += named.dictionary.to_pylist()
        self.row, self.order, self.kind, self.weight = (np.concatenate(x) for x in (row, order, kind, weight))
        self.kinds = kinds
        self.texts = Texts(pa.concat_arrays(parts))
        self.chars, self.pairs = signatures(self.texts)
        self._met: dict[frozenset[str], np.ndarray] = {}

    def met_by(self, kinds: frozenset[str]) -> np.ndarray:
        if kinds not in self._met:
            self._met[kinds] = np.array([x in kinds for x in self.kinds], bool)[self.kind]
        return self._met[kinds]


class _Batch:
    def __init__(self, batch: pa.RecordBatch, compiled: Compiled):
        self.batch, self.all = batch, compiled
        self.n = batch.num_rows
        self.config, self.backend = compiled.config, compiled.backend
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        self.display, self.norm, self.fold_only, self.hay, self.more = (col(c) for c in ("display", "norm", "case_fold_only", "hay", "keys"))
        self._keys: dict[tuple[bool, bool], _Keys] = {}
        self._allowed: dict[int, np.ndarray] = {}
        self._lists: dict[str, list] = {}
        self._terms: dict[tuple, Hits] = {}
        self._held = 0
        self._ties: dict[str, np.ndarray] = {}

    def keys(self, cased: bool, folds: bool) -> _Keys:
        if (cased, folds) not in self._keys:
            base = [(self.display, "Original")]
            if self.config.normalize and (not cased or self.backend.has_keys):
                seen = pa.nulls(self.n, self.norm.type) if cased else self.norm
                if folds and not cased:
                    seen = pc.if_else(self.fold_only, pa.scalar(None, self.norm.type), self.norm)
                base.append((seen, "Normalized"))
            self._keys[cased, folds] = _Keys(self.n, base, self.more if self.backend.has_keys else None)
            self._prune(cased, folds)
        return self._keys[cased, folds]

    def _prune(self, cased: bool, folds: bool) -> None:
        """For each pattern over these keys, the keys that its signature does not rule out."""
        keys = self._keys[cased, folds]
        own = [k for (_, _, f, c), k in self.all.patterns.items() if (c, f) == (cased, folds)]
        step = max(1, PAIRS // max(1, len(keys.chars)))
        for k in range(0, len(own), step):
            some = np.array(own[k : k + step])
            lacks = (self.all.chars[some, None] & ~keys.chars) | (self.all.pairs[some, None] & ~keys.pairs)
            for j, at in zip(some.tolist(), lacks == 0, strict=True):
                self._allowed[j] = np.flatnonzero(at)

    def _once(self, name: tuple, look: Callable[[], Hits]) -> Hits:
        """A term's hits, kept for later queries of the batch; those not asked for longest go first."""
        if (got := self._terms.pop(name, None)) is None:
            got = look()
            self._held += len(got[0]) + 1
            while self._held > HELD and self._terms:
                self._held -= len(self._terms.pop(next(iter(self._terms)))[0]) + 1
        self._terms[name] = got
        return got

    def fuzzy(self, asked: _Fuzzy, again: bool = True) -> Hits:
        """Hits of a text; those of a term, which may come again in other queries, are kept for the batch."""
        name = (asked.scorer, asked.folds, asked.cased, *(v[3] for v in asked.variants))
        if not again:
            return self._fuzzy(asked)
        return self._once(name, lambda: self._fuzzy(asked))

    def _fuzzy(self, asked: _Fuzzy) -> Hits:
        keys = self.keys(asked.cased, asked.folds)
        found = []
        for v, (pattern, kinds, weight, nth) in enumerate(asked.variants):
            at = self._allowed[nth]
            at = at[keys.met_by(kinds)[at]]
            if len(at):
                on = np.zeros(len(keys.row), bool)
                on[at] = True
                at, got = scores(asked.scorer, pattern, keys.texts, asked.cased, on)
                found.append((keys.row[at], got + keys.weight[at] + weight, np.full(len(at), v), keys.order[at]))
        if not found:
            return _NONE
        return _best_of(*(np.concatenate(x) for x in zip(*found, strict=True)))

    #: Tiebreaks that are known without the query.
    known = ("length", "index")

    def tie(self, name: str) -> np.ndarray:
        """A tiebreak of all rows, ascending."""
        if name not in self._ties:
            own = self.batch.column(0) if name == "index" else pc.utf8_length(self.display)
            self._ties[name] = own.to_numpy(zero_copy_only=False).astype(np.int64)
        return self._ties[name]

    def values(self, name: str, column: pa.Array) -> list:
        if name not in self._lists:
            self._lists[name] = column.to_pylist()
        return self._lists[name]

    def exact(self, term: language.Term, cased: bool) -> Hits:
        """Best key of each row for a term of the exact family, over keys of all kinds; a term that other queries have too is
        looked at once."""
        return self._once((term.mode, term.text, cased), lambda: self._exact(term, cased))

    def _exact(self, term: language.Term, cased: bool) -> Hits:
        config = replace(self.config, case_sensitive=cased)
        needle = comparable(term.text, config)
        counts = not cased and fold(term.text) == needle
        hay = self.display if cased else self.hay
        at, start, score = _hits(term.mode, needle, hay)
        found = []
        if len(at):
            shown, heard = self.values("display", self.display), self.values("display" if cased else "hay", hay)
            bonus = np.zeros(len(at), np.int64)
            if counts:
                for j, (r, k) in enumerate(zip(at.tolist(), start.tolist(), strict=True)):
                    text = shown[r]
                    if text is not None and (text.startswith(term.text, k) if len(text) == len(heard[r]) else _spelt_at(text, k + 1, term.text)):
                        bonus[j] = scorers.CASE
            found.append((at, score + KEY_WEIGHTS["Original"] + bonus, np.zeros(len(at), np.int64)))
            if config.normalize and not cased:
                own = ~self.fold_only.to_numpy(zero_copy_only=False)[at].astype(bool)
                if own.any():
                    normal = self.values("norm", self.norm)
                    same = np.array([scorers.CASE * (counts and normal[r].startswith(term.text, k)) for r, k in zip(at[own].tolist(), start[own].tolist(), strict=True)], np.int64)
                    found.append((at[own], score[own] + KEY_WEIGHTS["Normalized"] + same, np.ones(int(own.sum()), np.int64)))
        if self.backend.has_keys:
            flat, size = self.more.flatten(), np.nan_to_num(self.more.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            if len(flat):
                at, start, score = _hits(term.mode, needle, flat.field("text" if cased else "hay"))
                row = np.repeat(np.arange(self.n), size)
                order = _base_keys(self.config) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                texts = self.values("keys", flat.field("text"))
                typed = np.array([scorers.CASE * (counts and texts[r].startswith(term.text, k)) for r, k in zip(at.tolist(), start.tolist(), strict=True)], np.int64)
                found.append((row[at], score + flat.field("weight").to_numpy(zero_copy_only=False)[at] + typed, order[at]))
        if not found:
            return _NONE
        row, score, key = (np.concatenate(x) for x in zip(*found, strict=True))
        return _best_of(row, score, np.zeros(len(row), np.int64), key)

    def query(self, asked: _Query) -> Hits:
        if asked.whole is not None:
            return self.fuzzy(asked.whole, again=False)
        everything = np.arange(self.n)
        if not asked.groups:
            return everything, np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        found = []
        for g, group in enumerate(asked.groups):
            rows, total, last = everything, np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            for term, fuzzy in sorted(group, key=lambda t: t[0].negated):
                got, score, key = self.fuzzy(fuzzy) if fuzzy else self.exact(term, asked.cased)
                if rows is everything and not term.negated:
                    rows, total, last = got, score, key
                    continue
                place = np.full(self.n, -1)
                place[got] = np.arange(len(got))
                place = place[rows]
                if term.negated:
                    on = place < 0
                    rows, total, last = rows[on], total[on], last[on]
                else:
                    on = place >= 0
                    rows, total, last = rows[on], total[on] + score[place[on]], key[place[on]]
                if not len(rows):
                    break
            found.append((rows, total, np.full(len(rows), g), last))
        if len(found) == 1:
            return rows, total, last
        return _best_of(*(np.concatenate(x) for x in zip(*found, strict=True)))


_EDGE = r"(?:(?<![\p{Alphabetic}\p{N}])|(?![\p{Alphabetic}\p{N}]))"


def _hits(mode: str, needle: str, hay: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that meet a term, where it begins in characters from 0, and scores."""
    size = pc.utf8_length(hay)
    if mode == "equal":
        on = pc.equal(hay, pa.scalar(needle, hay.type))
    elif mode in ("prefix", "suffix"):
        on = (pc.starts_with if mode == "prefix" else pc.ends_with)(hay, needle)
    else:
        octet = pc.find_substring(hay, needle)
        on = pc.greater_equal(octet, 0)
    at = np.flatnonzero(pc.fill_null(on, False).to_numpy(zero_copy_only=False))
    length = size.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
    zero = np.zeros(len(at), np.int64)
    if mode == "equal":
        return at, zero, zero + 10_000
    if mode == "prefix":
        return at, zero, 8500 - length
    if mode == "suffix":
        return at, length - len(needle), 8500 - length
    octet = octet.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = hay.take(pa.array(at)).to_pylist()
    if mode == "exact":
        start = np.array([len(t.encode()[:k].decode()) for t, k in zip(texts, octet.tolist(), strict=True)], np.int64)
        return at, start, 7000 - 5 * octet - length
    found = [regex.search(_EDGE + regex.escape(needle) + _EDGE, t) for t in texts]
    on = np.array([f is not None for f in found], bool)
    start = np.array([f.start() for f in found if f], np.int64)
    octet = np.array([len(t[: f.start()].encode()) for t, f in zip(texts, found, strict=True) if f], np.int64)
    return at[on], start, 8000 - 5 * octet - length[on]


_FORM = "query string, tie string, id long, display string, norm string, score long, key_kind string, key_index int"


def _cut(hits: Hits, own: _Batch) -> Hits:
    """What can be among a query's best `limit` rows, by this batch alone: rows that are equal in all that is known here stay."""
    rows, score, key = hits
    config = own.config
    if config.limit is None or len(rows) <= config.limit:
        return hits
    if not config.limit:
        return _NONE
    by = own.tie("index")[rows] if config.no_sort else -score
    on = np.flatnonzero(by <= np.partition(by, config.limit - 1)[config.limit - 1])
    if not config.no_sort and len(on) > config.limit:
        known = [by[on], *(own.tie(name)[rows[on]] for name in takewhile(own.known.__contains__, total_order(config.tiebreaks)))]
        order = np.lexsort(known[::-1])
        last = order[config.limit - 1]
        same = np.logical_and.reduce([k[order[config.limit :]] == k[last] for k in known])
        on = on[np.concatenate((order[: config.limit], order[config.limit :][same]))]
    return rows[on], score[on], key[on]


def _meet(compiled):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Compiled = compiled.value
        config = asked.config
        names = ["Original", "Normalized"][: _base_keys(config)]
        for batch in batches:
            own = _Batch(batch, asked)
            waiting, held = [], 0
            for q in asked.queries:
                rows, score, key = _cut(own.query(q), own)
                if len(rows):
                    waiting.append((q, rows, score, key))
                    held += len(rows)
                if held > ROWS:
                    yield _rows(own, waiting, names)
                    waiting, held = [], 0
            if waiting:
                yield _rows(own, waiting, names)

    return run


def _rows(own: _Batch, waiting: list, names: list[str]) -> pa.RecordBatch:
    size = [len(w[1]) for w in waiting]
    nth = pa.array(np.repeat(np.arange(len(waiting)), size))
    rows, score, key = (np.concatenate([w[k] for w in waiting]) for k in (1, 2, 3))
    take = pa.array(rows)
    further = key >= len(names)
    kind = pa.array(names, pa.string()).take(pa.array(np.where(further, 0, key)))
    if further.any():
        whole = np.array(kind.to_pylist(), object)
        for j in np.flatnonzero(further).tolist():
            whole[j] = own.more[int(rows[j])][int(key[j]) - len(names)]["kind"].as_py()
        kind = pa.array(whole.tolist(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([w[0].text for w in waiting], pa.string()).take(nth), pa.array([w[0].tie for w in waiting], pa.string()).take(nth), own.batch.column(0).take(take), own.display.take(take), own.norm.take(take), pa.array(score), kind, pa.array(key.astype(np.int32))],
        names=[x.split()[0] for x in _FORM.split(", ")],
    )


def _ready(index: DataFrame, config: SearchConfig, backend: Backend) -> DataFrame:
    heard = lambda text, norm: norm if config.normalize else F.lower(text)
    keys = F.lit(None).cast("array<struct<text:string,kind:string,weight:int,hay:string>>")
    if backend.has_keys:
        keys = F.transform("keys", lambda k: F.struct(k["text"].alias("text"), k["kind"].alias("kind"), k["weight"].alias("weight"), heard(k["text"], k["norm"]).alias("hay")))
    return index.select("id", "display", "norm", "case_fold_only", heard(F.col("display"), F.col("norm")).alias("hay"), keys.alias("keys"))


def order_of(config: SearchConfig, tie: Column) -> list[Column]:
    """Ascending sort keys of found rows, whose tiebreaks look for a column's text."""
    return [F.col("id")] if config.no_sort else [-F.col("score"), *tie_columns(tie, config.tiebreaks)]


def search_table(index: DataFrame, queries: DataFrame, *, id: str = "query_id", query: str = "query", config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"], case: str | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, the columns of search, and rank from 1: each query's best `limit` rows, or all without a limit.

    queries has an id of any type and a text, plain or extended; `case` (ignore, respect, smart) is decided for each text.
    Equal texts are searched once. A null text finds nothing, and an empty one every row. Up to `block` distinct texts
    take one scan of the index, whose plan does not depend on their number; each further block of a larger table takes
    one more. Empty tables give an empty table.
    """
    spark = index.sparkSession
    asked = queries.select(F.col(id).alias("query_id"), F.col(query).alias("query")).where("query IS NOT NULL")
    texts = asked.select("query").distinct()
    blocks = -(-texts.count() // block)
    ready, parts = spread(_ready(index, config, backend)), []
    for k in range(blocks):
        own = sorted(r[0] for r in texts.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).collect())  # about `block` texts
        compiled = spark.sparkContext.broadcast(Compiled(own, config, backend, case))
        parts.append(ready.mapInArrow(_meet(compiled), _FORM))
    if not parts:
        found = spark.createDataFrame([], f"{_FORM}, rank int")
    else:
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        order = order_of(config, F.col("tie"))
        if config.limit is None:
            held = [f"_by{k}" for k in range(len(order))]
            found = found.withColumns(dict(zip(held, order, strict=True))).drop("tie", "norm")
            found = exact_ranks(found, ["query"], [F.col(c) for c in held], "rank")
        else:
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= config.limit)
    return asked.join(found, "query").select("query_id", *RESULT, "rank")
