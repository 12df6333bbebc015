"""Functions of this package for SQL text: table functions for keys, variants and terms, and scorers of two columns.

    register(spark)
    spark.sql("SELECT t.id, k.* FROM texts t, LATERAL search_keys(t.text, 'zh') k")
    spark.sql("SELECT q.id, t.id, fuzzy_score(q.query, t.text) FROM ...")
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import KEY_WEIGHTS, SearchConfig, case_sensitive
from ..operators import query as language
from .batch import Texts, scores
from .languages import backend_for, detect_language
from .languages.backends import cap_keys
from .languages.mapped import Key
from .normalize import normalize

#: Keys and variants are not capped by number here beyond what a search takes.
CONFIG = SearchConfig()


class _Keys:
    def eval(self, text: str, lang: str):
        if text is None or lang is None:
            return
        plain = normalize(text)
        for k, key in enumerate(cap_keys([Key(text, "Original"), Key(plain, "Normalized"), *backend_for(lang).keys(text, CONFIG)], CONFIG)):
            yield k, key.text, key.kind, KEY_WEIGHTS[key.kind]


class _Variants:
    def eval(self, query: str, lang: str):
        if query is None or lang is None:
            return
        for k, (text, kind, weight) in enumerate(backend_for(lang).variants(query, CONFIG)):
            yield k, text, kind, weight


class _Terms:
    def eval(self, query: str):
        for g, group in enumerate(language.parse(query or "")):
            for k, term in enumerate(group):
                yield g, k, term.text, term.negated, term.mode


def _scorer(name: str):
    def run(pattern: pa.Array, text: pa.Array) -> pa.Array:
        """Rows of one pattern are scored together."""
        out, none = np.zeros(len(text), np.int64), np.ones(len(text), bool)
        held, texts = pattern.dictionary_encode(), Texts(text)
        which = held.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        for k, own in enumerate(held.dictionary.to_pylist()):
            rows, got = scores(name, own, texts, False, which == k)
            out[rows], none[rows] = got, False
        return pa.array(out, mask=none)

    def call(pattern: pa.Array, text: pa.Array) -> pa.Array:
        return run(pattern, text)

    return F.arrow_udf(call, "long")


def _language(text: pa.Array, locale: pa.Array) -> pa.Array:
    return pa.array([None if t is None else detect_language(t, (t,), own or "") for t, own in zip(text.to_pylist(), locale.to_pylist(), strict=True)], pa.string())


def _query_language(query: pa.Array, sample: pa.Array, locale: pa.Array) -> pa.Array:
    rows = zip(query.to_pylist(), sample.to_pylist(), locale.to_pylist(), strict=True)
    return pa.array([None if q is None else detect_language(q, [t] if t else [], own or "") for q, t, own in rows], pa.string())


def _cased(query: pa.Array, mode: pa.Array) -> pa.Array:
    return pa.array([None if q is None or m is None else case_sensitive(q, m) for q, m in zip(query.to_pylist(), mode.to_pylist(), strict=True)], pa.bool_())


def register(spark: SparkSession) -> None:
    """Names the functions in a session; doing so again does no harm.

    search_keys(text, language): pos, text, kind, weight. query_variants(query, language): v_idx, text, kind, weight.
    query_terms(query): grp, pos, text, negated, mode. fuzzy_score, exact_score, optimal_score(pattern, text): a long, null
    where text does not match. text_language(text, locale), query_language(query, sample, locale), is_case_sensitive(query, mode). Null arguments give no rows, or
    null.
    """
    tables = {"search_keys": (_Keys, "pos int, text string, kind string, weight int"), "query_variants": (_Variants, "v_idx int, text string, kind string, weight int"), "query_terms": (_Terms, "grp int, pos int, text string, negated boolean, mode string")}
    for name, (cls, kind) in tables.items():
        spark.udtf.register(name, F.udtf(cls, returnType=kind))
    for name, scorer in (("fuzzy_score", "greedy"), ("exact_score", "exact"), ("optimal_score", "optimal")):
        spark.udf.register(name, _scorer(scorer))
    spark.udf.register("text_language", F.arrow_udf(_language, "string"))
    spark.udf.register("query_language", F.arrow_udf(_query_language, "string"))
    spark.udf.register("is_case_sensitive", F.arrow_udf(_cased, "boolean"))
