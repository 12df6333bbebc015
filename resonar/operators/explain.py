"""Why a row matched: places of a pattern in a key and in the text it came from. For the few rows of a result only."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMPATIBLE, SearchConfig
from ..functions.languages import BACKENDS, Backend
from ..functions.normalize import fold_dashes, has_han, has_kana, to_hiragana
from .query import highlight_patterns

EDGES = frozenset("/\\_- .")


def _comparable(text: str, case_sensitive: bool) -> list[tuple[int, str]]:
    """(place in text, character) after NFKC, lower case, dashes and kana; also where case counts."""
    out = []
    for k, c in enumerate(text):
        for d in unicodedata.normalize("NFKC", c):
            out += [(k, to_hiragana(fold_dashes(x))) for x in (d if case_sensitive else d.lower())]
    return out


def match_positions(pattern: str, text: str, case_sensitive: bool = False) -> list[int] | None:
    """Places of a contiguous match, else of the best subsequence; None without one.

    A subsequence earns 100 a character, 90 behind an edge, 160 next to its predecessor, loses 4 for each character
    skipped and 2 for each before the first; of equals the shorter span, then the earlier places.
    """
    if not pattern:
        return []
    p = [c for _, c in _comparable(pattern, case_sensitive)]
    t = _comparable(text, case_sensitive)
    letters = [c for _, c in t]
    for k in range(len(t) - len(p) + 1):
        if letters[k : k + len(p)] == p:
            return [i for i, _ in t[k : k + len(p)]]
    if len(p) > len(t):
        return None
    own = [100 + 90 * (i == 0 or text[i - 1] in EDGES) for i, _ in t]
    # a state is (score, places); for each place of the next character the best state before it, and the best right before it
    order = lambda s: (s[0], s[1][0] - s[1][-1], [-x for x in s[1]])
    apart = lambda s: (s[0] + 4 * s[1][-1], s[1][0], [-x for x in s[1]])
    states = [(own[j] - 2 * t[j][0], (t[j][0],)) if letters[j] == p[0] else None for j in range(len(t))]
    for c in p[1:]:
        now: list = [None] * len(t)
        far = near = None
        added = 0
        for j, (here, d) in enumerate(t):
            while added < j and t[added][0] < here:
                s = states[added]
                added += 1
                if s is None:
                    continue
                if far is None or apart(s) > apart(far):
                    far = s
                if near is None or near[1][-1] != s[1][-1] or order(s) > order(near):
                    near = s
            if d != c:
                continue
            ways = [] if far is None else [(far[0] + own[j] - 4 * (here - far[1][-1] - 1), (*far[1], here))]
            if near is not None and near[1][-1] == here - 1:
                ways.append((near[0] + own[j] + 160, (*near[1], here)))
            if ways:
                now[j] = max(ways, key=order)
        states = now
    ways = [s for s in states if s is not None]
    return list(max(ways, key=order)[1]) if ways else None


def _span(places: list[int]) -> tuple[int, int]:
    return min(places), max(places) + 1


def _source(places: list[int], spans, plain: bool) -> tuple[int, int] | None:
    if spans is None:
        return _span(places) if plain else None
    own = [spans[k] for k in places if k < len(spans) and spans[k] is not None]
    return (min(s[0] for s in own), max(s[1] for s in own)) if own else None


def _with_keys(results: DataFrame, index: DataFrame) -> DataFrame:
    """Results, in their order, with what the index has for them."""
    few = results.select("id", "display", "score", "key_kind", "key_index").withColumn("_place", F.monotonically_increasing_id())
    return few.join(index.select("id", "norm", "keys"), "id").orderBy("_place")


EXPLAIN = "id long, score long, key_kind string, query string, matched_text string, key_start int, key_end int, key_text string, source_start int, source_end int, source_text string"


def explain(results: DataFrame, index: DataFrame, query: str, *, config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"]) -> DataFrame:
    """results with what matched and where: the first pattern and variant that fits the winning key and has places in it.

    results must be few rows, as search() gives them; their order, by score and then as search() has it, is kept.
    """
    patterns = highlight_patterns(query, config.exact) if config.extended else [query]
    ways = [(v, kind) for p in patterns for v, kind, _ in backend.variants(p, config)]
    base = 2 if config.normalize else 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                k = row.key_index
                extra = None if k < base else row.keys[k - base]
                text = row.display if k == 0 else row.norm if extra is None else extra["text"]
                spans = None
                if extra is not None and extra["source_map"] is not None:
                    spans = [None if s is None else (int(s["start_char"]), int(s["end_char"])) for s in extra["source_map"]]
                found = next(((v, places) for v, kind in ways if row.key_kind in COMPATIBLE[kind] and (places := match_positions(v, text, config.case_sensitive))), None)
                if found is None:
                    out.append((row.id, row.score, row.key_kind, query, None, None, None, text, None, None, None))
                    continue
                v, places = found
                a, b = _span(places)
                source = _source(places, spans, row.key_kind in ("Original", "Normalized") and len(text) == len(row.display))
                snippet = row.display[source[0] : source[1]] if source else None
                out.append((row.id, row.score, row.key_kind, v, text[a:b], a, b, text, *(source or (None, None)), snippet))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in EXPLAIN.split(", ")])
            yield frame.astype({c: "Int32" for c in ("key_start", "key_end", "source_start", "source_end")})

    both = _with_keys(results, index).select("id", "display", "score", "key_kind", "key_index", "norm", "keys")
    return both.mapInPandas(run, EXPLAIN)


#: Bounds of highlighting: longer texts and patterns, and further terms, show nothing.
LONGEST, LONGEST_PATTERN, MOST_TERMS = 512, 64, 32


def highlight_places(display: str, key_text: str, key_kind: str, spans, ways: list[tuple[str, str]], case_sensitive: bool = False) -> list[int]:
    """Places in display to show as matched, by (variant, kind): through the key's spans, else the text's own kana and Han characters."""
    if len(display) > LONGEST or len(key_text) > LONGEST:
        return []
    out: set[int] = set()
    for variant, kind in ways[:MOST_TERMS]:
        if key_kind not in COMPATIBLE[kind] or len(variant) > LONGEST_PATTERN:
            continue
        places = match_positions(variant, key_text, case_sensitive)
        if places is None:
            continue
        if key_kind in ("Original", "Normalized"):
            out |= {k for k in places if k < len(display)}
        elif spans is not None:
            out |= {x for k in places if k < len(spans) and spans[k] for x in range(*spans[k])}
        else:
            own = {k for k, c in enumerate(display) if has_kana(c) or has_han(c)}
            out |= own or set(range(len(display)))
    return sorted(out)


def highlight(results: DataFrame, index: DataFrame, query: str, *, config: SearchConfig = SearchConfig(), backend: Backend = BACKENDS["plain"]) -> DataFrame:
    """id, display and places (array<int>) for the few rows of a result."""
    patterns = highlight_patterns(query, config.exact) if config.extended else [query]
    ways = [(v, kind) for p in patterns for v, kind, _ in backend.variants(p, config)]
    base = 2 if config.normalize else 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            places = []
            for row in frame.itertuples(index=False):
                extra = None if row.key_index < base else row.keys[row.key_index - base]
                text = row.display if row.key_index == 0 else row.norm if extra is None else extra["text"]
                held = None if extra is None else extra["source_map"]
                spans = None if held is None else [None if s is None else (int(s["start_char"]), int(s["end_char"])) for s in held]
                places.append(highlight_places(row.display, text, row.key_kind, spans, ways, config.case_sensitive))
            yield pd.DataFrame({"id": frame["id"], "display": frame["display"], "places": places})

    both = _with_keys(results, index).select("id", "display", "key_kind", "key_index", "norm", "keys")
    return both.mapInPandas(run, "id long, display string, places array<int>")


def explain_text(row) -> str:
    """One explained row as lines of text."""
    span = lambda a, b: "n/a" if a is None or pd.isna(a) else f"{int(a)}..{int(b)}"
    show = lambda x: "n/a" if x is None else x
    return "\n".join([
        f"score: {row['score']}", f"matched key: {row['key_kind']}", f"query: {row['query']}", f"matched text: {show(row['matched_text'])}",
        f"key span: {span(row['key_start'], row['key_end'])}", f"key text: {row['key_text']}", f"source span: {span(row['source_start'], row['source_end'])} {show(row['source_text'])}",
    ])
