import pytest

from resonar.config import SearchConfig, case_sensitive, parse_tiebreaks, total_order
from resonar.operators.query import Term, highlight_patterns, is_extended, parse, parse_term, tokens


def test_detects_special_characters():
    assert is_extended("a b") and is_extended("!a") and is_extended("a$")
    assert not is_extended("abc") and not is_extended("foo\\ bar")


def test_tokens():
    assert tokens("a b|c") == ["a", "b", "|", "c"]
    assert tokens("a\\ b c\\") == ["a b", "c\\"]


@pytest.mark.parametrize("raw,exact,term", [
    ("a", False, Term("a")), ("a", True, Term("a", mode="exact")), ("!a", False, Term("a", True, "exact")), ("'a", False, Term("a", mode="exact")), ("'a", True, Term("a")),
    ("'a'", False, Term("a", mode="boundary")), ("^a", False, Term("a", mode="prefix")), ("a$", False, Term("a", mode="suffix")), ("^a$", False, Term("a", mode="equal")), ("!^a", False, Term("a", True, "prefix")), ("!", False, None), ("'", False, None),
])
def test_terms(raw, exact, term):
    assert parse_term(raw, exact) == term


def test_or_binds_weaker_than_and():
    assert [[t.text for t in g] for g in parse("a b | c | | d")] == [["a", "b"], ["c"], ["d"]]
    assert highlight_patterns("'a !b ^c") == ["a", "c"]


def test_config():
    assert case_sensitive("aB", "smart") and not case_sensitive("ab", "smart")
    assert parse_tiebreaks(scheme="path") == ("pathname", "length", "index")
    assert parse_tiebreaks("begin", "path") == ("begin", "index")
    assert total_order(("index", "length", "length")) == ("length", "index")
    for bad in ("length,length", "index,length", "x"):
        with pytest.raises(ValueError):
            parse_tiebreaks(bad)
    assert SearchConfig().limit == 10
