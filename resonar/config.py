"""Kinds of keys and query variants, their weights, and the knobs of a search."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Weight of each kind of key and of each kind of query variant.
KEY_WEIGHTS = {
    "Original": 3000,
    "Normalized": 2800,
    "KanaReading": 1700,
    "RomajiReading": 1800,
    "PinyinFull": 1750,
    "PinyinJoined": 1800,
    "PinyinInitials": 1850,
    "KoreanRomanized": 1800,
    "KoreanInitials": 1850,
    "KoreanKeyboard": 1750,
    "LearnedAlias": 2500,
}
VARIANT_WEIGHTS = {"Original": 500, "Normalized": 450, "Kana": 350, "RomajiToKana": 200, "Pinyin": 250, "Initials": 250}
_LATIN = frozenset(KEY_WEIGHTS) - {"KanaReading", "PinyinInitials"}
#: Kinds of key that a kind of variant may be compared with.
COMPATIBLE = {
    "Original": _LATIN,
    "Normalized": _LATIN,
    "Kana": frozenset({"KanaReading"}),
    "RomajiToKana": frozenset({"KanaReading"}),
    "Pinyin": frozenset({"PinyinFull", "PinyinJoined"}),
    "Initials": frozenset({"PinyinInitials", "KoreanInitials", "LearnedAlias"}),
}
BASE_KINDS = frozenset({"Original", "Normalized"})
TIEBREAKS = ("length", "begin", "end", "chunk", "pathname", "index")
ALGORITHMS = {"greedy": "greedy", "fzf-v1": "greedy", "fzf-v2": "optimal", "nucleo": "optimal"}

KEY_TYPE = "struct<text:string,kind:string,weight:int,case_fold_only:boolean,source_map:array<struct<start_char:int,end_char:int>>>"


@dataclass(frozen=True)
class SearchConfig:
    limit: int | None = 10
    max_query_variants: int = 8
    max_search_keys_per_candidate: int = 8
    max_total_key_bytes_per_candidate: int = 1024
    top_b_for_quality_score: int = 1000  # accepted; nothing is scored twice
    exact: bool = False
    extended: bool = True
    case_sensitive: bool = False
    disabled: bool = False
    no_sort: bool = False
    normalize: bool = True
    algorithm: str = "greedy"
    tiebreaks: tuple[str, ...] = field(default=("length", "index"))

    def with_case(self, query: str, mode: str) -> SearchConfig:
        return replace(self, case_sensitive=case_sensitive(query, mode))


def case_sensitive(query: str, mode: str) -> bool:
    """mode: ignore, respect, or smart (sensitive when the query holds an upper-case character)."""
    if mode not in ("ignore", "respect", "smart"):
        raise ValueError(f"unknown case mode {mode!r}")
    return mode == "respect" or mode == "smart" and any(c.isupper() for c in query)


def parse_tiebreaks(text: str = "length", scheme: str = "default") -> tuple[str, ...]:
    """A comma list of tiebreaks. A scheme replaces it only where it is the default; index ends a list."""
    if text == "length" and scheme in ("path", "history"):
        text = "pathname,length" if scheme == "path" else "index"
    elif scheme not in ("default", "path", "history"):
        raise ValueError(f"unknown scheme {scheme!r}")
    out: list[str] = []
    for name in (x.strip() for x in text.split(",")):
        if name not in TIEBREAKS:
            raise ValueError(f"unknown tiebreak {name!r}")
        if name in out:
            raise ValueError(f"{name} is given twice")
        if "index" in out:
            raise ValueError("index must be the last tiebreak")
        out.append(name)
    return total_order(tuple(out))


def total_order(tiebreaks: tuple[str, ...]) -> tuple[str, ...]:
    """Each tiebreak once, and index at the end."""
    return (*dict.fromkeys(t for t in tiebreaks if t != "index"), "index")


def read_config(path: str, **over) -> SearchConfig:
    """A SearchConfig from the [search] table of a TOML file; keyword arguments win."""
    import tomllib

    with open(path, "rb") as f:
        found = tomllib.load(f).get("search", {})
    names = SearchConfig.__dataclass_fields__
    if unknown := set(found) - set(names):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    if "tiebreaks" in found:
        found["tiebreaks"] = parse_tiebreaks(found["tiebreaks"]) if isinstance(found["tiebreaks"], str) else total_order(tuple(found["tiebreaks"]))
    return SearchConfig(**(found | over))
