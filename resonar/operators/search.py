"""Search: a query becomes one filter and one score expression over the index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import ALGORITHMS, COMPATIBLE, KEY_WEIGHTS, SearchConfig
from ..functions import optimal, scorers
from ..functions.batch import best_column
from ..functions.languages import BACKENDS, Backend
from ..functions.normalize import fold, fold_col, normalize
from ..shared import spread
from . import query as language
from .rank import RESULT, exact_ranks, ranked, sort_columns

_BEST = "struct<score:bigint,v:int,k:int>"


@dataclass(frozen=True)
class Matcher:
    """A scorer: score(pattern, text, case_sensitive) -> Column. folds_case promises that a hit on folded text is one on the text as written."""

    score: Callable[[str, Column, bool], Column]
    folds_case: bool = False
    in_lambda: bool = True
    possible: Callable[[str, Column, bool], Column] | None = None
    batch: str | None = None  # name of a scorer of Arrow batches that stands for it


def _holds_subsequence(pattern: str, text: Column, case_sensitive: bool) -> Column:
    if case_sensitive:
        return scorers.subsequence_filter(pattern, text)
    return scorers.subsequence_filter(fold(pattern), fold_col(text)) | F.contains(text, F.lit(scorers.DOTTED))


def _holds_text(pattern: str, text: Column, case_sensitive: bool) -> Column:
    if case_sensitive:
        return F.contains(text, F.lit(pattern))
    return F.contains(fold_col(text), F.lit(fold(pattern))) | F.contains(text, F.lit(scorers.DOTTED))


MATCHERS: dict[str, Matcher] = {
    "greedy": Matcher(scorers.greedy, True, possible=_holds_subsequence, batch="greedy"),
    "exact": Matcher(scorers.exact, True, possible=_holds_text, batch="exact"),
    "optimal": Matcher(optimal.score, True, in_lambda=False, possible=_holds_subsequence, batch="optimal"),
}


def register_matcher(name: str, score, folds_case: bool = False, in_lambda: bool = True) -> None:
    """A matcher of one's own, chosen by SearchConfig.algorithm. Without folds_case it also sees keys that only fold case."""
    MATCHERS[name] = Matcher(score, folds_case, in_lambda)


def _matcher(config: SearchConfig) -> Matcher:
    if config.exact:
        return MATCHERS["exact"]
    name = ALGORITHMS.get(config.algorithm, config.algorithm)
    if name not in MATCHERS:
        raise ValueError(f"unknown algorithm {config.algorithm!r}")
    return MATCHERS[name]


def _base_keys(config: SearchConfig) -> int:
    return 2 if config.normalize else 1


def _normalized_blocked(config: SearchConfig, folds: bool) -> Column | None:
    """None: never looked at. Else the rows where the normal form is looked at."""
    if config.case_sensitive or not config.normalize:
        return None
    return ~F.col("case_fold_only") if folds else F.lit(True)


def _best(score: Column, v: int, k: Column) -> Column:
    return F.struct(score.cast("long").alias("score"), F.lit(-v).alias("v"), (-k).cast("int").alias("k"))


def _top(parts: list[Column]) -> Column:
    """The best of arrays of (score, -v, -k); null where none has a score."""
    best = F.array_max(F.filter(F.concat(*parts), lambda x: x["score"].isNotNull()))
    return best.cast(_BEST)


def _variants(text: str, backend: Backend, config: SearchConfig) -> list[tuple[str, str, int]]:
    found = backend.variants(text, config)
    return [v for v in found if v[1] != "Normalized" or (config.normalize and not config.case_sensitive)]


def _base_key_list(config: SearchConfig, backend: Backend, folds: bool) -> list[tuple[Column, str, int]]:
    """Text, kind and weight of the keys that every row has; one that is not looked at has a null text."""
    shown = _normalized_blocked(config, folds)
    base = [(F.col("display"), "Original")]
    if config.normalize and (shown is not None or backend.has_keys):
        base.append((F.lit(None).cast("string") if shown is None else F.when(shown, F.col("norm")), "Normalized"))
    return [(text, kind, KEY_WEIGHTS[kind]) for text, kind in base]


def _more_keys() -> Column:
    return F.transform("keys", lambda k: F.struct(k["text"].alias("text"), k["kind"].alias("kind"), k["weight"].alias("weight")))


def _key_list(config: SearchConfig, backend: Backend, folds: bool) -> Column:
    """All keys of a row as (text, kind, weight), base keys first."""
    base = [F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight")) for text, kind, weight in _base_key_list(config, backend, folds)]
    return F.concat(F.array(*base), _more_keys()) if backend.has_keys else F.array(*base)


def _key_scorer(pattern: str, v: int, kind: str, weight: int, config: SearchConfig, matcher: Matcher):
    def run(key: Column, i: Column) -> Column:
        score = matcher.score(pattern, key["text"], config.case_sensitive) + key["weight"] + weight
        return _best(F.when(key["kind"].isin(*sorted(COMPATIBLE[kind])) & key["text"].isNotNull(), score), v, i)

    return run


def _fuzzy(text: str, backend: Backend, config: SearchConfig, matcher: Matcher) -> Column:
    """(score, -v, -k) of the best compatible variant and key: the first of equals, variants before keys."""
    if matcher.batch:
        variants = [(pattern, frozenset(COMPATIBLE[kind]), weight) for pattern, kind, weight in _variants(text, backend, config)]
        return best_column(matcher.batch, variants, _base_key_list(config, backend, matcher.folds_case), _more_keys() if backend.has_keys else None, config.case_sensitive)
    keys, parts = _key_list(config, backend, matcher.folds_case), []
    most = 2 + config.max_search_keys_per_candidate * backend.has_keys
    for v, (pattern, kind, weight) in enumerate(_variants(text, backend, config)):
        run = _key_scorer(pattern, v, kind, weight, config, matcher)
        if matcher.in_lambda:
            parts.append(F.transform(keys, run))
        else:
            parts.append(F.array(*[run(F.get(keys, F.lit(i)), F.lit(i)) for i in range(most)]))
    return _top(parts)


def _possible(text: str, backend: Backend, config: SearchConfig, matcher: Matcher) -> Column | None:
    """A cheap condition that every match of a fuzzy term meets; it compiles to plain code."""
    if matcher.possible is None or not text:
        return None
    out = [F.size("keys") > 0] if backend.has_keys else []
    for pattern, kind, _ in _variants(text, backend, config):
        if "Original" in COMPATIBLE[kind]:
            out += [matcher.possible(pattern, F.col("display"), config.case_sensitive)]
            if _normalized_blocked(config, matcher.folds_case) is not None:
                out += [matcher.possible(pattern, F.col("norm"), False)]
    return reduce(lambda a, b: a | b, out)


def comparable(text: str, config: SearchConfig) -> str:
    return text if config.case_sensitive else normalize(text) if config.normalize else text.lower()


def _spelt_at(text: str, k: int, typed: str) -> bool:
    """Whether text spells typed where the k-th character (from 1) of its normal form comes from."""
    at = 0
    for i, c in enumerate(text):
        if at == k - 1:
            return text.startswith(typed, i)
        at += len(normalize(c))
    return False


def _typed_at(display: Column, start: Column, literal: str) -> Column:
    """_spelt_at as a Column. Most rows are null, as only those whose normal form has another length are asked about."""

    def run(text: pa.Array, k: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for i in np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False)):
            if (place := k[i].as_py()) is not None:
                out[i] = _spelt_at(text[i].as_py(), place, literal)
        return pa.array(out)

    def call(text: pa.Array, k: pa.Array) -> pa.Array:
        return run(text, k)

    # not deterministic, says the plan: else the filter on the score would call it a second time for every row
    return F.arrow_udf(call, "boolean").asNondeterministic()(display, F.when(display.isNotNull(), start))


_EDGE = r"(?:(?<![\p{IsAlphabetic}\p{N}])|(?![\p{IsAlphabetic}\p{N}]))"


def _hit(mode: str, needle: str, hay: Column) -> tuple[Column, Column]:
    """(score, 1-based start); the score is null where the term does not match."""
    n = F.lit(needle)
    if mode in ("exact", "boundary"):
        if mode == "exact":
            k = F.position(n, hay)
        else:
            quoted = r"\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + r"\E"
            k = F.regexp_instr(hay, F.lit(_EDGE + quoted + _EDGE))
        start = F.octet_length(F.substring(hay, F.lit(1), k - 1))
        return F.when(k > 0, (7000 if mode == "exact" else 8000) - 5 * start - F.length(hay)), k
    if mode == "equal":
        return F.when(hay == n, F.lit(10_000)), F.lit(1)
    near = F.startswith(hay, n) if mode == "prefix" else F.endswith(hay, n)
    return F.when(near, 8500 - F.length(hay)), F.lit(1) if mode == "prefix" else F.length(hay) - len(needle) + 1


def _exact(term: language.Term, config: SearchConfig, backend: Backend) -> Column:
    """(score, 0, -k) of the best key for a term of the exact family, over keys of all kinds."""
    cs, needle = config.case_sensitive, comparable(term.text, config)
    counts = not cs and fold(term.text) == needle
    hay = F.col("display") if cs else F.col("norm") if config.normalize else F.lower("display")
    score, k = _hit(term.mode, needle, hay)
    bonus = F.lit(0)
    if counts:
        aligned = F.length("display") == F.length(hay)
        straight = F.substring("display", k, F.lit(len(term.text))) == term.text
        other = _typed_at(F.when(~aligned, F.col("display")), k, term.text)
        bonus = F.when(F.when(aligned, straight).otherwise(other), scorers.CASE).otherwise(0)
    own = [_best(score + KEY_WEIGHTS["Original"] + bonus, 0, F.lit(0))]
    if (shown := _normalized_blocked(config, not cs)) is not None:
        same = F.when(F.substring("norm", k, F.lit(len(term.text))) == term.text, scorers.CASE).otherwise(0) if counts else F.lit(0)
        own.append(_best(F.when(shown, score + KEY_WEIGHTS["Normalized"] + same), 0, F.lit(1)))
    parts = [F.array(*own)]
    if backend.has_keys:

        def one(key: Column, i: Column) -> Column:
            text = key["text"] if cs else key["norm"] if config.normalize else F.lower(key["text"])
            got, at = _hit(term.mode, needle, text)
            typed = F.when(F.substring(key["text"], at, F.lit(len(term.text))) == term.text, scorers.CASE).otherwise(0) if counts else F.lit(0)
            return _best(got + key["weight"] + typed, 0, i + _base_keys(config))

        parts.append(F.transform("keys", one))
    return _top(parts)


def _literal_filter(term: language.Term, config: SearchConfig, backend: Backend) -> Column | None:
    """The plain predicate of an exact-family term, where only the text and its normal form are keys."""
    if backend.has_keys:
        return None
    hay = F.col("display") if config.case_sensitive else F.col("norm") if config.normalize else F.lower("display")
    return _hit(term.mode, comparable(term.text, config), hay)[0].isNotNull()


def _scored(index: DataFrame, query: str, config: SearchConfig, backend: Backend, name: str = "best") -> DataFrame:
    """index rows that match, with column `name` (score, -v, -k)."""
    best = lambda score: F.struct(F.lit(score).cast("long").alias("score"), F.lit(0).alias("v"), F.lit(0).alias("k"))
    if config.disabled:
        return index.withColumn(name, best(0))
    matcher = _matcher(config)
    if not (config.extended and language.is_extended(query)):
        near = _possible(query, backend, config, matcher)
        some = index if near is None else index.where(near)
        return some.withColumn(name, _fuzzy(query, backend, config, matcher)).where(F.col(name).isNotNull())
    groups = language.parse(query, config.exact)
    if not groups:
        return index.withColumn(name, best(0))
    fuzzy = _matcher(replace(config, exact=False))
    cheap = lambda t: _possible(t.text, backend, config, fuzzy) if t.mode == "fuzzy" else _literal_filter(t, config, backend)
    needed = []
    for group in groups:
        own = [c for t in group if not t.negated and (c := cheap(t)) is not None]
        own += [~c for t in group if t.negated and t.mode != "fuzzy" and (c := cheap(t)) is not None]
        needed.append(reduce(lambda a, b: a & b, own) if own else F.lit(True))
    out = index.where(reduce(lambda a, b: a | b, needed))
    columns, ways = [], []
    for g, group in enumerate(groups):
        last = None
        total, holds = F.lit(0).cast("long"), F.lit(True)
        for t, term in enumerate(group):
            c = f"_{name}_{g}_{t}"
            out = out.withColumn(c, _fuzzy(term.text, backend, config, fuzzy) if term.mode == "fuzzy" else _exact(term, config, backend))
            columns.append(c)
            if term.negated:
                holds = holds & F.col(c).isNull()
            else:
                holds, total, last = holds & F.col(c).isNotNull(), total + F.col(c)["score"], F.col(c)["k"]
        k = F.lit(0) if last is None else last
        ways.append(F.when(holds, F.struct(total.alias("score"), F.lit(-g).alias("v"), k.alias("k"))))
    out = out.withColumn(name, F.array_max(F.array(*ways)).cast(_BEST)).drop(*columns)
    return out.where(F.col(name).isNotNull())


def _kind(k: Column, config: SearchConfig) -> Column:
    base = _base_keys(config)
    return F.when(k == 0, "Original").when((k == 1) & F.lit(base == 2), "Normalized").otherwise(F.get("keys", k - base)["kind"])


def matches(index: DataFrame, query: str, *, config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"]) -> DataFrame:
    """All rows that match, unordered: the index's columns, score, key_kind, key_index."""
    found = _scored(index, query, config, backend)
    k = -F.col("best.k")
    return found.select(*index.columns, F.col("best.score").alias("score"), _kind(k, config).alias("key_kind"), k.alias("key_index"))


def search(index: DataFrame, query: str, *, config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"]) -> DataFrame:
    """id, display, score, key_kind, key_index of the best rows, in order. Where all are wanted, and so are sorted by all tasks,
    they are also scored by all."""
    if config.limit is None:
        index = spread(index)
    return ranked(matches(index, query, config=config, backend=backend), query, config)


#: Queries scored in one scan of the index.
TOGETHER = 16


def _order(query: str, config: SearchConfig) -> Column:
    keys = [F.col("id")] if config.no_sort else [-F.col("score"), *sort_columns(query, config.tiebreaks)]
    return F.struct(*[c.cast("long").alias(f"o{k}") for k, c in enumerate(keys)])


def _together(index: DataFrame, queries: dict[str, str], config: SearchConfig, backend: Backend) -> DataFrame:
    """All matches of several plain queries from one scan: a row for each query that a text matches."""
    matcher = _matcher(config)
    near = [F.lit(True) if config.disabled else _possible(q, backend, config, matcher) for q in queries.values()]
    some = index if any(n is None for n in near) else index.where(reduce(lambda a, b: a | b, near))
    nothing = F.struct(F.lit(0).cast("long").alias("score"), F.lit(0).alias("v"), F.lit(0).alias("k"))
    best = [nothing if config.disabled else _fuzzy(q, backend, config, matcher) for q in queries.values()]
    hits = F.array(*[F.struct(F.lit(n).alias("query_id"), F.lit(i).alias("nth"), b.alias("best")) for i, (n, b) in enumerate(zip(queries, best, strict=True))])
    out = some.withColumn("_hit", F.explode(F.filter(hits, lambda h: h["best"].isNotNull())))
    k = -F.col("_hit.best.k")
    out = out.select("norm", "id", "display", F.col("_hit.best.score").alias("score"), _kind(k, config).alias("key_kind"), k.alias("key_index"), F.col("_hit.query_id").alias("query_id"), F.col("_hit.nth").alias("nth"))
    order = reduce(lambda a, i: F.when(F.col("nth") == i[0], _order(i[1], config)).otherwise(a), enumerate(queries.values()), F.lit(None))
    return out.select("query_id", *RESULT, order.alias("_order"))


def search_many(index: DataFrame, queries: dict[str, str], *, config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"], together: int = TOGETHER) -> DataFrame:
    """query_id and the columns of search, for several queries; each query's best `limit` rows with their rank from 1.

    Plain queries share scans of the index, `together` in each; an extended query scans by itself, with its own filter
    pushed down. Ranks are cut within each partition before they are shuffled.
    """
    alone = {n: q for n, q in queries.items() if config.extended and language.is_extended(q) and not config.disabled}
    plain = [(n, q) for n, q in queries.items() if n not in alone]
    parts = [_together(index, dict(plain[k : k + together]), config, backend) for k in range(0, len(plain), together)]
    for name, query in alone.items():
        found = matches(index, query, config=config, backend=backend)
        parts.append(found.select(F.lit(name).alias("query_id"), *RESULT, _order(query, config).alias("_order")))
    whole = reduce(lambda a, b: a.union(b), parts)
    if config.limit is None:
        return exact_ranks(whole, ["query_id"], [F.col("_order")], "rank").drop("_order")
    return whole.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_order"))).where(F.col("rank") <= config.limit).drop("_order")


def _pairs(text: str, config: SearchConfig, backend: Backend) -> Column:
    """How many pairs of a variant and a key that it meets a row has."""
    found = _variants(text, backend, config)
    shown = _normalized_blocked(config, _matcher(config).folds_case)
    visible = 1 + (shown.cast("int") if shown is not None else F.lit(0))
    base = sum("Original" in COMPATIBLE[k] for _, k, _ in found)
    reached = [sorted(COMPATIBLE[k]) for _, k, _ in found]
    more = F.aggregate("keys", F.lit(0), lambda a, x: a + sum((x["kind"].isin(*kinds).cast("int") for kinds in reached), F.lit(0)))
    return (base * visible + more).cast("long")


def _tried(index: DataFrame, query: str, config: SearchConfig, backend: Backend) -> tuple[DataFrame, int]:
    """index with the number of pairs that are scored for each row, and the number of variants.

    A plain query scores all pairs. In an extended one a group's terms are tried in turn until one fails, so that rows carry
    each term's outcome; terms of the exact family score no pairs.
    """
    if config.disabled:
        return index.withColumn("_calls", F.lit(0).cast("long")), len(_variants(query, backend, config))
    if not (config.extended and language.is_extended(query)):
        return index.withColumn("_calls", _pairs(query, config, backend)), len(_variants(query, backend, config))
    loose = replace(config, exact=False)
    fuzzy = _matcher(loose)
    out, calls, variants, names = index, F.lit(0).cast("long"), 0, []
    for g, group in enumerate(language.parse(query, config.exact)):
        open_ = F.lit(True)
        for t, term in enumerate(group):
            last = t == len(group) - 1
            if term.mode == "fuzzy":
                variants += len(_variants(term.text, backend, loose))
                calls = calls + F.when(open_, _pairs(term.text, loose, backend)).otherwise(0)
            if last and term.mode != "fuzzy" or not any(x.mode == "fuzzy" for x in group[t + 1 :]):
                break  # no later term of the group scores pairs
            names.append(f"_tried_{g}_{t}")
            out = out.withColumn(names[-1], (_fuzzy(term.text, backend, loose, fuzzy) if term.mode == "fuzzy" else _exact(term, config, backend)).isNotNull())
            open_ = open_ & (~F.col(names[-1]) if term.negated else F.col(names[-1]))
    return out.withColumn("_calls", calls).drop(*names), variants


def _counts(variants: int) -> list[Column]:
    calls = F.coalesce(F.sum("_calls"), F.lit(0))
    nothing = F.lit(0).cast("long")
    return [F.count("*").alias("candidates_seen"), calls.alias("keys_seen"), F.max(F.lit(variants).cast("long")).alias("variants_seen"), calls.alias("fuzzy_calls"), F.max(nothing).alias("quality_score_calls"), F.max(nothing).alias("reading_generation_calls")]


def search_observed(index: DataFrame, query: str, *, config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"]) -> tuple[DataFrame, Observation]:
    """Results, and the counts of search_with_stats taken in the results' own scan: read them with .get after an action.

    Over an empty index variants_seen and the two counters that stay 0 are null.
    """
    seen = Observation()
    counted, variants = _tried(index, query, config, backend)
    counted = counted.observe(seen, *_counts(variants)).drop("_calls")
    return search(counted, query, config=config, backend=backend), seen


def search_with_stats(index: DataFrame, query: str, *, config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"]) -> tuple[DataFrame, DataFrame]:
    """Results, and one row of counts: rows seen, variants, and pairs of variant and key that are scored."""
    counted, variants = _tried(index, query, config, backend)
    stats = counted.agg(*_counts(variants)).fillna({"variants_seen": variants, "quality_score_calls": 0, "reading_generation_calls": 0})
    return search(index, query, config=config, backend=backend), stats


def query_variants(spark, query: str, *, config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"]) -> DataFrame:
    """The variants of a query as a table."""
    rows = [(k, *v) for k, v in enumerate(backend.variants(query, config))]
    return spark.createDataFrame(rows, "v_idx int, text string, kind string, weight int")
