"""Every query by name, over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig, case_sensitive, parse_tiebreaks
from ..functions import normalize as norm
from ..functions import optimal, scorers
from ..functions import sql as sql_functions
from ..functions.languages import BACKENDS, Backend, backend_for, chinese, detect_language_of, japanese, korean, lattice
from ..functions.languages.mapped import Key
from ..functions.width import width_col
from ..operators import fields, index
from ..operators.explain import explain, highlight
from ..operators.search import matches, query_variants, register_matcher, search, search_many, search_with_stats
from ..operators.search_table import search_table
from ..shared import shared_folder, spread, stored
from ..sources import text
from ..streaming.live import LiveSearch
from . import oracles as sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TEXTS = {"part": ("p_partkey", "p_name"), "customer": ("c_custkey", "c_name"), "pages": ("page_id", "url"), "nation": ("n_nationkey", "n_name")}


def _items(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    key, text = _TEXTS[table]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("id"), F.col(text).alias("search_text"))


def _index(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return index.build_index(_items(spark, sf_dir, table))


def _source(table: str) -> str:
    key, text = _TEXTS[table]
    return f"SELECT {key} AS id, {text} AS display FROM {table}"


def _query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _sql(spark: SparkSession, sf_dir: str, query: str, *tables: str, **frames: DataFrame) -> DataFrame:
    """SQL text over tables of the folder and frames, named in braces, with the functions of this package, whose rows are
    spread over all tasks first."""
    sql_functions.register(spark)
    given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables} | frames
    return spark.sql(query, **{name: spread(df) for name, df in given.items()})


def _search(name: str, table: str, query: str, config: SearchConfig, oracle: str | None) -> None:
    _query(name, oracle)(lambda spark, d: search(_index(spark, d, table), query, config=config))


_BY_LENGTH = "score DESC, length(display), id"
TOP = SearchConfig()
ALL = SearchConfig(limit=None)

# ---- scorers
_search("greedy_topk", "part", "rd", TOP, sql.ordered(sql.greedy(_source("part"), "rd"), _BY_LENGTH, 10))
_search("greedy_unlimited", "customer", "c01", ALL, sql.ordered(sql.greedy(_source("customer"), "c01"), _BY_LENGTH, None))
_search("greedy_urls", "pages", "exam", replace(TOP, limit=50), sql.ordered(sql.greedy(_source("pages"), "exam"), _BY_LENGTH, 50))
_search("exact_topk", "customer", "er#0000001", replace(TOP, exact=True), sql.ordered(sql.exact(_source("customer"), "er#0000001"), _BY_LENGTH, 10))
_search("exact_unlimited", "part", "ed", replace(ALL, exact=True, extended=False), sql.ordered(sql.exact(_source("part"), "ed"), _BY_LENGTH, None))
_search("empty_query", "nation", "", ALL, sql.ordered(f"SELECT id, display, CAST(3500 AS BIGINT) AS score FROM ({_source('nation')})", _BY_LENGTH, None))
_search("separators_only", "nation", "  ", ALL, sql.ordered(f"SELECT id, display, CAST(0 AS BIGINT) AS score FROM ({_source('nation')})", _BY_LENGTH, None))


def _both_spellings(table: str, query: str) -> str:
    """Two variants: the query as typed and its normal form; the better score holds."""
    return (
        f"SELECT id, display, max(score) AS score FROM ({sql.greedy(_source(table), query)} UNION ALL "
        f"{sql.greedy(_source(table), query.lower(), add=3450)}) GROUP BY id, display"
    )


# ---- case
_search("case_ignore", "part", "RG", ALL.with_case("RG", "ignore"), sql.ordered(_both_spellings("part", "RG"), _BY_LENGTH, None))
_search("case_respect", "customer", "cus1", ALL.with_case("cus1", "respect"), sql.ordered(sql.greedy(_source("customer"), "cus1", True), _BY_LENGTH, None))
_search("case_smart", "customer", "Cus1", ALL.with_case("Cus1", "smart"), sql.ordered(sql.greedy(_source("customer"), "Cus1", True), _BY_LENGTH, None))


_TYPED = "CASE WHEN p_partkey % 3 = 0 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) ELSE p_name END"


@_query("smart_case_policy", f"SELECT p_partkey AS id, {_TYPED} AS query, p_partkey % 3 = 0 AS case_sensitive FROM part")
def smart_case_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, f"SELECT p_partkey AS id, {_TYPED} AS query, is_case_sensitive({_TYPED}, 'smart') AS case_sensitive FROM {{part}}", "part")


# ---- extended queries
def _extended(name: str, table: str, query: str, groups: list[list[tuple[str, str]]], config: SearchConfig = ALL) -> None:
    """groups: (mode, text) of each term; a mode with ! before it is negated. Fuzzy terms are joined in by id."""
    fuzzy = list(dict.fromkeys(t for g in groups for m, t in g if m.lstrip("!") == "fuzzy"))
    joins = "".join(f" LEFT JOIN (SELECT id AS i{k}, score AS f{k} FROM ({sql.greedy(_source(table), t)})) ON id = i{k}" for k, t in enumerate(fuzzy))
    value = lambda m, t: f"f{fuzzy.index(t)}" if m == "fuzzy" else sql.term(m, t)
    ways = []
    for g in groups:
        holds = " AND ".join(f"({value(m.lstrip('!'), t)}) IS {'' if m[0] == '!' else 'NOT '}NULL" for m, t in g)
        total = " + ".join([f"({value(m, t)})" for m, t in g if m[0] != "!"] or ["0"])
        ways.append(f"CASE WHEN {holds} THEN {total} END")
    score = f"list_max([{', '.join(ways)}])"
    body = f"SELECT id, display, CAST({score} AS BIGINT) AS score FROM (SELECT id, display, display AS t FROM ({_source(table)})){joins} WHERE {score} IS NOT NULL"
    _search(name, table, query, config, sql.ordered(body, _BY_LENGTH, None))


_extended("ext_and_or_not", "pages", "http !blog en/ | ^https .net", [[("fuzzy", "http"), ("!exact", "blog"), ("fuzzy", "en/")], [("prefix", "https"), ("fuzzy", ".net")]])
_extended("ext_prefix_suffix_equal", "part", "^red | gear$ | ^hot\\ bolt$", [[("prefix", "red")], [("suffix", "gear")], [("equal", "hot bolt")]])
_extended("ext_exact", "customer", "'#00000001 '5", [[("exact", "#00000001"), ("exact", "5")]])
_extended("ext_boundary", "pages", "'en'", [[("boundary", "en")]])
_extended("ext_negated_only", "part", "!red !hot", [[("!exact", "red"), ("!exact", "hot")]])
_extended("ext_negated_anchor", "part", "!^red !gear$ i", [[("!prefix", "red"), ("!suffix", "gear"), ("fuzzy", "i")]])
_extended("ext_exact_flips_quote", "part", "'rd ring", [[("fuzzy", "rd"), ("exact", "ring")]], replace(ALL, exact=True))
_extended("ext_exact_case_bonus", "customer", "'Customer 'CUSTOMER", [[("exact", "Customer"), ("exact", "CUSTOMER")]])
_extended("ext_or_first_wins", "part", "'red | 'ring | 'bolt", [[("exact", "red")], [("exact", "ring")], [("exact", "bolt")]])

# ---- ranking
_Q = "exam"
_PLACE = "CASE WHEN instr(lower(display), 'exam') > 0 THEN instr(lower(display), 'exam') - 1 ELSE 9223372036854775807 END"
_ORDERS = {
    "length": "length(display)",
    "begin": _PLACE,
    "end": "CASE WHEN instr(lower(display), 'exam') > 0 THEN instr(reverse(lower(display)), 'maxe') - 1 ELSE 9223372036854775807 END",
    "chunk": "CASE WHEN instr(lower(display), 'exam') > 0 THEN strlen(display) ELSE 9223372036854775807 END",
    "pathname": f"CASE WHEN instr(lower(regexp_extract(display, '[^/]*$')), 'exam') > 0 THEN 0 ELSE 1 END, {_PLACE}",
    "index": "id",
}
for _name, _order in _ORDERS.items():
    _search(f"tiebreak_{_name}", "pages", _Q, SearchConfig(limit=40, disabled=True, tiebreaks=parse_tiebreaks(_name)), sql.ordered(f"SELECT id, display, CAST(0 AS BIGINT) AS score FROM ({_source('pages')})", f"score DESC, {_order}, id", 40))
_search("scheme_history", "part", "rd", SearchConfig(tiebreaks=parse_tiebreaks(scheme="history")), sql.ordered(sql.greedy(_source("part"), "rd"), "score DESC, id", 10))
_search("no_sort_limit", "part", "rd", SearchConfig(no_sort=True, limit=25), sql.ordered(sql.greedy(_source("part"), "rd"), "id", 25))
_search("disabled_rank", "part", "rd", SearchConfig(disabled=True, limit=25), sql.ordered(f"SELECT id, display, CAST(0 AS BIGINT) AS score FROM ({_source('part')})", _BY_LENGTH, 25))
_search("limit_zero", "part", "rd", SearchConfig(limit=0), sql.ordered(sql.greedy(_source("part"), "rd"), _BY_LENGTH, 0))

_MANY = {"a": "rd", "b": "bolt", "c": "gz"}


@_query("multi_query_batch", " UNION ALL ".join(
    f"SELECT {sql.quoted(n)} AS query_id, id, display, score, 'Original' AS key_kind, CAST(0 AS INTEGER) AS key_index, CAST(row_number() OVER (ORDER BY {_BY_LENGTH}) AS INTEGER) AS rank FROM ({sql.greedy(_source('part'), q)}) QUALIFY row_number() OVER (ORDER BY {_BY_LENGTH}) <= 10"
    for n, q in _MANY.items()
))
def multi_query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_many(_index(spark, sf_dir, "part"), _MANY)


# ---- tables of queries: one for each part, over longer texts made from the same table
_LABELS = "SELECT p_partkey AS id, p_name || '/' || p_brand || '_' || p_partkey AS display FROM part"
_ASKED = "substr(p_name, 1, 2) || 'B' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')"
_RANKED = "query_id, id, display, score, 'Original' AS key_kind, CAST(0 AS INTEGER) AS key_index, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(display), id) AS INTEGER) AS rank"


def _parts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit("/"), "p_brand", F.lit("_"), F.col("p_partkey").cast("string"))
    return index.build_index(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), text.alias("search_text")))


def _asked(spark: SparkSession, sf_dir: str, query: Column) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("query_id"), query.alias("query"))


def _fuzzy_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir, F.concat(F.substring("p_name", 1, 2), F.lit("B"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")))


_PAIRS = sql.greedy_pairs(f"SELECT q.p, i.id, i.display FROM (SELECT DISTINCT {_ASKED} AS p FROM part) q, ({_LABELS}) i", 5, "p")


def _of_pairs(cut: str) -> str:
    return f"SELECT {_RANKED} FROM (SELECT p_partkey AS query_id, f.id, f.display, f.score FROM part JOIN ({_PAIRS}) f ON f.p = {_ASKED}){cut}"


@_query("query_table_fuzzy", _of_pairs(" QUALIFY rank <= 5"))
def query_table_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_table(_parts_index(spark, sf_dir), _fuzzy_asked(spark, sf_dir), config=SearchConfig(limit=5))


@_query("query_table_ranks", f"SELECT {_RANKED.replace('query_id', 'p', 1).replace('PARTITION BY query_id', 'PARTITION BY p').replace('p, id', 'p AS query_id, id', 1)} FROM ({_PAIRS})")
def query_table_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows that each distinct query finds, ranked without a limit."""
    asked = _fuzzy_asked(spark, sf_dir).select(F.col("query").alias("query_id"), "query").distinct()
    return search_table(_parts_index(spark, sf_dir), asked, config=SearchConfig(limit=None))


def _typed_sql(k: str, text: str) -> str:
    return f"CASE WHEN substr(display, {k}, length({text})) = {text} THEN 75 ELSE 0 END"


_TERMS_SQL = f"""SELECT {_RANKED} FROM (
  SELECT query_id, id, display, CAST(11500 - length(display) + {_typed_sql("1", "w1")} + 10000 - 5 * (instr(lower(display), lower(w2)) - 1) - length(display) + {_typed_sql("instr(lower(display), lower(w2))", "w2")} AS BIGINT) AS score
  FROM (SELECT p_partkey AS query_id, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_brand AS no FROM part) q
  JOIN ({_LABELS}) i ON starts_with(lower(display), lower(w1)) AND instr(lower(display), lower(w2)) > 0 AND instr(lower(display), lower(no)) = 0) QUALIFY rank <= 3"""


@_query("query_table_terms", _TERMS_SQL)
def query_table_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix, a word, and a brand that must not occur."""
    words = F.split("p_name", " ")
    return search_table(_parts_index(spark, sf_dir), _asked(spark, sf_dir, F.concat(F.lit("^"), words[0], F.lit(" '"), words[1], F.lit(" !"), "p_brand")), config=SearchConfig(limit=3))


@_query("optimal_match_set", f"SELECT id FROM ({_source('pages')}) WHERE lower(display) LIKE '%e%x%7%'")
def optimal_match_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(_index(spark, sf_dir, "pages"), "ex7", config=SearchConfig(algorithm="nucleo")).select("id")


@_query("search_stats", "SELECT count(*) AS candidates_seen, count(*) AS keys_seen, CAST(1 AS BIGINT) AS variants_seen, count(*) AS fuzzy_calls, CAST(0 AS BIGINT) AS quality_score_calls, CAST(0 AS BIGINT) AS reading_generation_calls FROM part")
def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_with_stats(_index(spark, sf_dir, "part"), "rd")[1]


@_query("search_stats_extended", "SELECT count(*) AS candidates_seen, n AS keys_seen, CAST(3 AS BIGINT) AS variants_seen, n AS fuzzy_calls, CAST(0 AS BIGINT) AS quality_score_calls, CAST(0 AS BIGINT) AS reading_generation_calls FROM part, (SELECT 2 * count(*) + count(*) FILTER (lower(p_name) LIKE '%r%d%') AS n FROM part) GROUP BY n")
def search_stats_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a group are tried in turn, so the second is tried where the first holds."""
    return search_with_stats(_index(spark, sf_dir, "part"), "rd bo | sm ^x")[1]


@_query("explain_topk", f"SELECT id, score, 'Original' AS key_kind, 'ring' AS query, substr(display, k, 4) AS matched_text, CAST(k - 1 AS INTEGER) AS key_start, CAST(k + 3 AS INTEGER) AS key_end, display AS key_text, CAST(k - 1 AS INTEGER) AS source_start, CAST(k + 3 AS INTEGER) AS source_end, substr(display, k, 4) AS source_text FROM (SELECT *, instr(lower(display), 'ring') AS k FROM ({sql.ordered(sql.greedy(_source('part'), 'ring'), _BY_LENGTH, 10)}))")
def explain_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _index(spark, sf_dir, "part")
    return explain(search(own, "ring"), own, "ring")


# ---- fields and records
_URLS = "SELECT page_id AS id, url FROM pages"
_PARTS = "string_split(url, '/')"


def _fields(name: str, spec: str, oracle: str, delimiter: str | None = "/", table: str = "pages", text: str = "url") -> None:
    key = _TEXTS[table][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("id"), F.col(text).alias("url"))
        return rows.select("id", fields.render(spec, F.col("url"), F.col("id"), fields.Delimiter(delimiter)).alias("out"))

    _query(name, f"SELECT id, {oracle} AS out FROM (SELECT {key} AS id, {text} AS url FROM {table})")(run)


_fields("nth_single", "3", f"coalesce({_PARTS}[3], '')")
_fields("nth_negative", "-1", f"coalesce({_PARTS}[-1], '')")
_fields("nth_range", "2..4", f"CASE WHEN len({_PARTS}) < 4 THEN '' ELSE array_to_string({_PARTS}[2:4], '/') END")
_fields("nth_open_range", "3..", f"array_to_string({_PARTS}[3:], '/')")
_fields("nth_list", "3,1,99,0", f"CASE WHEN len({_PARTS}) >= 3 THEN array_to_string([{_PARTS}[3], {_PARTS}[1]], '/') ELSE {_PARTS}[1] END")
_fields("nth_template", "{n}:{3}:{1}", f"id || ':' || coalesce({_PARTS}[3], '') || ':' || coalesce({_PARTS}[1], '')")
_fields("nth_regex_joiner", "1..2", "CASE WHEN len(regexp_split_to_array(url, '[/.]')) < 2 THEN '' ELSE array_to_string(regexp_split_to_array(url, '[/.]')[1:2], '[/.]') END", delimiter="[/.]")
_fields("nth_whitespace", "2", "coalesce(list_filter(string_split_regex(url, '\\s+'), lambda x: x <> '')[2], '')", delimiter=None, table="part", text="p_name")


@_query("accept_nth", f"SELECT id, display, score, encode(coalesce(string_split(u, '/')[4], '')) AS output FROM (SELECT s.*, url AS u FROM ({sql.ordered(sql.greedy('SELECT page_id AS id, string_split(url, ' + chr(39) + '/' + chr(39) + ')[3] AS display FROM pages', 'exne'), _BY_LENGTH, 20)}) s JOIN pages ON page_id = id)")
def accept_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    slash = fields.Delimiter("/")
    records = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.col("url").cast("binary").alias("raw"), F.col("url").alias("display"))
    items = fields.prepare_items(records, nth="3", delimiter=slash)
    found = search(index.build_index(items), "exne", config=SearchConfig(limit=20))
    return fields.look_up(found, items, "4", slash).select("id", "display", "score", "output")


@_query("header_tail_tac", "SELECT CAST(row_number() OVER (ORDER BY p_partkey DESC) - 1 AS BIGINT) AS id, p_name FROM (SELECT * FROM (SELECT * FROM part ORDER BY p_partkey OFFSET 3) ORDER BY p_partkey DESC LIMIT 50)")
def header_tail_tac(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name", "p_partkey")
    low = rows.agg(F.min("p_partkey")).first()[0]
    body, _ = fields.slice_records(rows.select("p_name", (F.col("p_partkey") - F.lit(low)).alias("pos")), header=3, tail=50, tac=True)
    return body.select("id", "p_name")


@_query("history_dedup", "SELECT text AS line, max(pos) AS pos FROM (SELECT text, conv_id * 1000 + turn AS pos FROM conversations) GROUP BY text")
def history_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("text").alias("line"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return index.newest_first(rows)


@_query("alias_join", "SELECT n_nationkey AS id, CASE n_name WHEN 'NATION_3' THEN 'third' WHEN 'NATION_7' THEN 'seventh' END AS alias FROM nation")
def alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir, "nation").select("id", F.col("search_text").alias("original"), F.col("search_text").alias("display"), "search_text")
    aliases = spark.createDataFrame([("third", "NATION_3"), ("seventh", "NATION_7"), ("none", "NOWHERE")], "query string, display string")
    out = index.apply_aliases(index.build_index(items), items, aliases)
    return out.select("id", F.get("keys", F.lit(0))["text"].alias("alias"))


@_query("ansi_strip", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 3 THEN 'x' ELSE p_name END AS out FROM part")
def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    esc, id = F.lit("\x1b"), F.col("p_partkey")
    text = F.when(id % 4 == 0, F.concat(esc, F.lit("[3"), (id % 8).cast("string"), F.lit("m"), "p_name", esc, F.lit("[0m"))).when(id % 4 == 1, F.col("p_name"))
    text = text.when(id % 4 == 2, F.concat(F.substring("p_name", 1, 2), esc, F.expr("substring(p_name, 3)"))).otherwise(F.concat(F.lit("x"), esc, F.lit("[1"), (id % 10).cast("string")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(id.alias("id"), norm.strip_ansi_col(text).alias("out"))


# ---- normalisation and languages
@_query("normalize_urls", "SELECT page_id AS id, lower(url) AS norm, TRUE AS case_fold_only FROM pages")
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, "pages").select("id", "norm", "case_fold_only")


@_query("normalize_documents", "SELECT doc_id AS id, lower(text) AS norm FROM documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), norm.normalize_col(F.col("text")).alias("norm"))


def _keys_table(items: DataFrame, backend, config: SearchConfig = ALL) -> DataFrame:
    own = index.build_index(items, backend=backend, config=config)
    return own.select("id", "display", F.posexplode(F.transform("keys", lambda k: F.struct(k["text"].alias("text"), k["kind"].alias("kind")))).alias("pos", "k")).select("id", "display", "pos", F.col("k.text").alias("text"), F.col("k.kind").alias("kind"))


def _values(columns: str, rows: list[tuple]) -> str:
    cell = lambda x: sql.quoted(x) if isinstance(x, str) else f"CAST({x} AS INTEGER)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({columns})"


# ---- tables of other scripts, made by rule from the keys of a table
_JOINED = "SELECT p_partkey AS id, chr(CAST(12449 + p_partkey % 86 AS INTEGER)) AS kana, chr(CAST(44032 + p_partkey * 7919 % 11172 AS INTEGER)) AS hangul, chr(CAST(19968 + p_partkey * 91 % 20000 AS INTEGER)) AS han FROM part"


def _char(code) -> F.Column:
    """The character of a code point below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and one character of each script; the SQL is _JOINED."""
    id = F.col("p_partkey").cast("long")
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")).select(id.alias("id"), _char(12449 + id % 86).alias("kana"), _char(44032 + id * 7919 % 11172).alias("hangul"), _char(19968 + id * 91 % 20000).alias("han"))


@_query("kana_tables", f"SELECT id, kana || 'x' AS katakana, chr(CAST(unicode(kana) - 96 AS INTEGER)) || 'x' AS hiragana, kana || 'x' AS again FROM ({_JOINED})")
def kana_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("kana", F.lit("x"))
    hira = norm.to_hiragana_col(text)
    return _scripts(spark, sf_dir).select("id", text.alias("katakana"), hira.alias("hiragana"), norm.to_katakana_col(hira).alias("again"))


_MIXED = f"SELECT id, CASE id % 4 WHEN 0 THEN kana WHEN 1 THEN han WHEN 2 THEN hangul ELSE 'plain' END || CAST(id AS VARCHAR) AS t FROM ({_JOINED})"


def _mixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("id") % 4 == 0, F.col("kana")).when(F.col("id") % 4 == 1, F.col("han")).when(F.col("id") % 4 == 2, F.col("hangul")).otherwise("plain")
    return _scripts(spark, sf_dir).select("id", F.concat(own, F.col("id").cast("string")).alias("t"))


@_query("script_flags", f"SELECT id, id % 4 = 0 AS kana, id % 4 = 1 AS han, id % 4 = 2 AS hangul, length(t) + CASE WHEN id % 4 < 3 THEN 1 ELSE 0 END AS width, substr(t, 2, 2) AS sliced FROM ({_MIXED})")
def script_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _mixed_texts(spark, sf_dir).select("id", norm.has_kana_col(t).alias("kana"), norm.has_han_col(t).alias("han"), norm.has_hangul_col(t).alias("hangul"), width_col(t).cast("long").alias("width"), norm.char_slice_col(t, 1, 3).alias("sliced"))


_LANGUAGES = f"SELECT id, CASE id % 4 WHEN 0 THEN 'ja' WHEN 2 THEN 'ko' ELSE 'plain' END AS lang FROM ({_MIXED})"


@_query("detect_by_script", _LANGUAGES)
def detect_by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT id, text_language(t, 'C') AS lang FROM {texts}", texts=_mixed_texts(spark, sf_dir))


@_query("detect_language", f"SELECT id, CASE WHEN id % 4 = 1 THEN CASE id % 8 WHEN 1 THEN 'plain' ELSE 'zh' END WHEN id % 4 = 3 THEN 'plain' ELSE lang END AS lang FROM ({_LANGUAGES})")
def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain query over one text each: the text's script and the locale decide."""
    texts = _mixed_texts(spark, sf_dir)
    locale = "CASE WHEN id % 8 = 1 THEN 'C' WHEN id % 4 = 0 THEN 'ja_JP' WHEN id % 4 = 2 THEN 'ko_KR' ELSE 'zh_CN' END"
    return _sql(spark, sf_dir, f"SELECT id, query_language('abc', t, {locale}) AS lang FROM {{texts}}", texts=texts)


@_query("normalize_cjk", f"SELECT id, kana || chr(CAST(97 + id % 26 AS INTEGER)) || '-' || id AS norm, chr(CAST(unicode(kana) - 96 AS INTEGER)) || chr(CAST(65313 + id % 26 AS INTEGER)) || chr(8208) || id AS hiragana, TRUE AS kana FROM ({_JOINED})")
def normalize_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    texts = _scripts(spark, sf_dir).select("id", F.concat("kana", _char(65313 + F.col("id") % 26), F.lit("\u2010"), F.col("id").cast("string")).alias("text"))
    return texts.select("id", norm.normalize_col(t).alias("norm"), norm.to_hiragana_col(t).alias("hiragana"), norm.has_kana_col(t).alias("kana"))


# ---- words of other scripts, one for each part, with the part's key behind it
def _worded(spark: SparkSession, sf_dir: str, words: list[str], gap: str = "") -> DataFrame:
    id = F.col("p_partkey").cast("long")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(id.alias("id"), F.concat(F.get(F.array(*map(F.lit, words)), (id % len(words)).cast("int")), F.lit(gap), id.cast("string")).alias("search_text"))


def _of_words(n: int, columns: str, rows: list[tuple], select: str) -> str:
    """select over parts p and, by the part's number, rows of constants v."""
    return f"SELECT {select} FROM (SELECT p_partkey AS id FROM part) p JOIN ({_values(columns, rows)}) v ON v.m = p.id % {n}"


@_query("korean_keys", _of_words(3, "m, base, joined, spaced, initials, typed", [(0, "한글", "hangeul", "han geul", "ㅎㄱ", "gksrmf"), (1, "한국.md", "hanguk", "han guk", "ㅎㄱ", "gksrnr"), (2, "abc", "", "", "", "")], "id, base || id AS text, joined, spaced, initials, typed"))
def korean_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("search_text")
    return _worded(spark, sf_dir, ["한글", "한국.md", "abc"]).select("id", t.alias("text"), korean.romanized_col(t).alias("joined"), korean.romanized_col(t, " ").alias("spaced"), korean.initials_col(t).alias("initials"), korean.keyboard_col(t).alias("typed"))


@_query("chinese_keys", _of_words(3, "m, base, pos, text, kind", [(0, "北京地铁", 0, "bei jing di tie", "PinyinFull"), (0, "北京地铁", 1, "beijingditie", "PinyinJoined"), (0, "北京地铁", 2, "bjdt", "PinyinInitials"), (1, "重庆", 0, "chong qing", "PinyinFull"), (1, "重庆", 1, "chongqing", "PinyinJoined"), (1, "重庆", 2, "cq", "PinyinInitials")], "id, base || id AS display, pos, text, kind"))
def chinese_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys_table(_worded(spark, sf_dir, ["北京地铁", "重庆", "notes"]), backend_for("zh", polyphone="none"))


@_query("japanese_keys", _of_words(3, "m, base, pos, text, kind", [(0, "カメラ.txt", 0, "かめら.txt", "KanaReading"), (0, "カメラ.txt", 1, "kamera.txt", "RomajiReading"), (1, "コード", 0, "こ-ど", "KanaReading"), (1, "コード", 1, "ko-do", "RomajiReading")], "id, base || '_' || id AS display, pos, text || '_' || id AS text, kind"))
def japanese_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys_table(_worded(spark, sf_dir, ["カメラ.txt", "コード", "notes"], "_"), BACKENDS["ja"])


_ROMAJI = "CASE p_partkey % 4 WHEN 0 THEN 'shinjuku' WHEN 1 THEN 'kamera' WHEN 2 THEN 'tokyo' ELSE 'hachigatsu' END"


@_query("romaji_variants", _of_words(4, "m, query, kana", [(0, "shinjuku", "しんじゅく"), (1, "kamera", "かめら"), (2, "tokyo", "ときょ"), (2, "tokyo", "とうきょう"), (3, "hachigatsu", "はちがつ")], "id, query, kana"))
def romaji_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, f"SELECT id, query, v.text AS kana FROM (SELECT p_partkey AS id, {_ROMAJI} AS query FROM {{part}}) q, LATERAL query_variants(query, 'ja') v WHERE v.kind = 'RomajiToKana'", "part")


_FIRST = "substr(p_name, 1, 3)"


@_query("query_variants", f"SELECT p_partkey AS id, {_FIRST} AS query, v_idx, {_FIRST} AS text, kind, weight FROM part, (VALUES (CAST(0 AS INTEGER), 'Original', CAST(500 AS INTEGER)), (CAST(1 AS INTEGER), 'Initials', CAST(250 AS INTEGER))) v(v_idx, kind, weight)")
def variants_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, f"SELECT id, query, v.* FROM (SELECT p_partkey AS id, {_FIRST} AS query FROM {{part}}) q, LATERAL query_variants(query, 'zh') v", "part")


@_query("sql_keys", _of_words(3, "m, base, text, kind", [(0, "한글", "ㅎㄱ", "KoreanInitials"), (0, "한글", "gksrmf", "KoreanKeyboard"), (1, "한국", "ㅎㄱ", "KoreanInitials"), (1, "한국", "gksrnr", "KoreanKeyboard")], "id, base || id AS display, text, kind"))
def sql_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = "SELECT id, search_text AS display, k.text, k.kind FROM {texts} t, LATERAL search_keys(search_text, 'ko') k WHERE k.kind IN ('KoreanInitials', 'KoreanKeyboard')"
    return _sql(spark, sf_dir, query, texts=_worded(spark, sf_dir, ["한글", "한국", "notes"]))


@_query("sql_scores", f"SELECT a.id, a.p AS query, coalesce(b.score, -1) AS score FROM (SELECT p_partkey AS id, p_name AS display, substr(p_type, 1, 2) AS p FROM part) a LEFT JOIN ({sql.greedy_pairs('SELECT p_partkey AS id, p_name AS display, substr(p_type, 1, 2) AS p FROM part', 2, 'p')}) b ON a.id = b.id")
def sql_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the head of its type, in SQL text alone."""
    return _sql(spark, sf_dir, "SELECT id, query, coalesce(fuzzy_score(query, display) + 3500, -1) AS score FROM (SELECT p_partkey AS id, p_name AS display, substr(p_type, 1, 2) AS query FROM {part})", "part")


@_query("sql_terms", "SELECT p_partkey AS id, CAST(0 AS INTEGER) AS grp, v.pos, CASE v.pos WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN split_part(p_name, ' ', 2) ELSE p_brand END AS text, v.pos = 2 AS negated, v.mode FROM part, (VALUES (CAST(0 AS INTEGER), 'prefix'), (CAST(1 AS INTEGER), 'exact'), (CAST(2 AS INTEGER), 'exact')) v(pos, mode)")
def sql_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT id, t.* FROM (SELECT p_partkey AS id, '^' || split_part(p_name, ' ', 1) || ' \\'' || split_part(p_name, ' ', 2) || ' !' || p_brand AS query FROM {part}), LATERAL query_terms(query) t", "part")


_SOUNDS = [("ko", "hangeul", ["한글.txt", "notes.txt"], 0, "KoreanRomanized"), ("ko", "gksrmf", ["한글.txt", "notes.txt"], 0, "KoreanKeyboard"), ("zh", "bjdx", ["北京地铁", "北京大学", "北京大厦"], 1, "PinyinInitials"), ("zh", "huanmei", ["还没", "notes.txt"], 0, "PinyinJoined"), ("ja", "kamera", ["カメラ_1.txt", "docs"], 0, "RomajiReading"), ("ja", "tokyodai", ["東京電機大学", "東北大学", "東京大学"], 2, "RomajiReading")]


@_query("search_by_sound", " UNION ALL ".join(f"(SELECT {sql.quoted(lang)} AS lang, {sql.quoted(q)} AS query, p_partkey AS id, {sql.quoted(texts[m])} || '_' || p_partkey AS display, {sql.quoted(kind)} AS kind FROM part WHERE p_partkey % {len(texts)} = {m} ORDER BY length(CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 3)" for lang, q, texts, m, kind in _SOUNDS))
def search_by_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for lang, query, texts, *_ in _SOUNDS:
        backend = backend_for(lang, readings=True)
        own = index.build_index(_worded(spark, sf_dir, texts, "_"), backend=backend)
        part = search(own, query, config=SearchConfig(limit=3), backend=backend).select(F.lit(lang).alias("lang"), F.lit(query).alias("query"), "id", "display", F.col("key_kind").alias("kind"))
        out = part if out is None else out.union(part)
    return out


@_query("numeric_readings", "SELECT CAST(m AS INTEGER) AS month, m || 'gatsu' AS query, p_partkey AS id, 5 AS source_start, CAST(6 + length(CAST(m AS VARCHAR)) AS INTEGER) AS source_end FROM part, (SELECT unnest([1, 8, 10, 12]) AS m) WHERE p_partkey % 12 + 1 = m")
def numeric_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits in Japanese texts are found as they stand, and lead back to where they stand."""
    ja = backend_for("ja", readings=True)
    id = F.col("p_partkey").cast("long")
    own = index.build_index(spark.read.parquet(f"{sf_dir}/part.parquet").select(id.alias("id"), F.concat(F.lit("2025年"), (id % 12 + 1).cast("string"), F.lit("月")).alias("search_text")), backend=ja)
    own = stored(own, "numeric")  # read by four searches, and by what explains them
    out = None
    for m in (1, 8, 10, 12):
        got = matches(own, f"{m}gatsu", backend=ja).where(F.col("id") % 12 == m - 1)
        part = explain(got, own, f"{m}gatsu", backend=ja).select(F.lit(m).alias("month"), F.lit(f"{m}gatsu").alias("query"), "id", "source_start", "source_end")
        out = part if out is None else out.union(part)
    return out


# Words of a small dictionary over ten characters, for texts that longest match reads wrongly: surface, left and right class,
# cost, reading.
_WORDS = [
    ("東京都", 1, 1, 1907, "トウキョウト"), ("東京", 1, 1, 613, "トウキョウ"), ("東", 1, 1, 1103, "ヒガシ"), ("京都", 1, 1, 709, "キョウト"), ("京", 1, 1, 1301, "キョウ"), ("都", 2, 2, 401, "ト"), ("大学", 1, 3, 503, "ダイガク"),
    ("大学生", 1, 1, 1709, "ダイガクセイ"), ("学生", 1, 1, 607, "ガクセイ"), ("大", 3, 1, 907, "ダイ"), ("学", 3, 3, 811, "ガク"), ("生", 2, 2, 1009, "セイ"), ("生会", 3, 3, 2503, "セイカイ"), ("会", 2, 1, 701, "カイ"), ("学生会", 1, 2, 2309, "ガクセイカイ"),
    ("日本", 1, 1, 557, "ニホン"), ("日本語", 1, 1, 1499, "ニホンゴ"), ("本語", 3, 3, 2903, "ホンゴ"), ("日", 1, 2, 1201, "ヒ"), ("本", 1, 1, 1051, "ホン"), ("語", 2, 2, 353, "ゴ"), ("語学", 1, 1, 797, "ゴガク"), ("会日", 2, 3, 2111, "カイビ"), ("生東京", 3, 1, 3119, "ナマトウキョウ"),
]
_NEXT = [(1, 2, -211), (2, 1, 83), (1, 3, 307), (3, 2, -97), (2, 2, 401), (3, 3, 59), (1, 1, 127), (3, 1, 13), (2, 3, 223), (1, 0, 17), (2, 0, -31), (3, 0, 71)]
_DIGITS = "東京都大学生会日本語"
_KANJI = "translate(lpad(CAST((p_partkey * 7919 + 13) % 1000000 AS VARCHAR), 6, '0'), '0123456789', '" + _DIGITS + "')"
_LATTICE = f"""
WITH RECURSIVE w AS ({_values("surface, l, r, cost, reading", [(s, a, b, c, norm.to_hiragana(r)) for s, a, b, c, r in _WORDS])}), c AS ({_values("r, l, cost", _NEXT)}),
go AS (SELECT p_partkey AS id, {_KANJI} AS t, 0 AS place, 0 AS class, 0 AS total, '' AS reading FROM part
  UNION ALL
  SELECT g.id, g.t, g.place + length(w.surface), w.r, g.total + w.cost + coalesce(c.cost, 0), g.reading || w.reading
  FROM go g JOIN w ON starts_with(substr(g.t, g.place + 1), w.surface) LEFT JOIN c ON c.r = g.class AND c.l = w.l WHERE g.place < 6)
SELECT id, t AS display, arg_min(reading, total + coalesce(c.cost, 0)) AS reading FROM go LEFT JOIN c ON c.r = go.class AND c.l = 0 WHERE place = 6 GROUP BY id, t
"""


@_query("kanji_lattice", _LATTICE)
def kanji_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by the cheapest way through a dictionary that Spark writes and reads; each different run is read once."""
    path = f"{shared_folder(spark)}/dictionary-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(f"{s},{a},{b},{c},*,*,*,*,*,*,{s},{r},{r}",) for s, a, b, c, r in _WORDS], "value string")
    rows.write.text(f"{path}/words")
    spark.createDataFrame([("4 4",), *[(f"{a} {b} {c}",) for a, b, c in _NEXT]], "value string").write.text(f"{path}/matrix")
    own = lattice.Dictionary.of_tables(lattice.read_dictionary(spark, f"{path}/words"), lattice.read_connections(spark, f"{path}/matrix"))
    backend = backend_for("ja", readings=True, tokenizer=lattice.LatticeTokenizer(own, spark))
    items = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.expr(_KANJI.replace("VARCHAR", "STRING")).alias("search_text"))
    key = F.filter("keys", lambda k: k["kind"] == "KanaReading")[0]["text"]
    return index.build_index_by_runs(items, backend=backend).select("id", "display", key.alias("reading"))


_PHRASED = [("银行", "yin hang"), ("行走", "xing zou"), ("长江", "chang jiang"), ("校长", "xiao zhang"), ("音乐", "yin yue"), ("快乐", "kuai le"), ("会计", "kuai ji"), ("还书", "huan shu"), ("还有", "hai you"), ("重庆", "chong qing"), ("重要", "zhong yao")]


def _phrase_sql(made: str) -> str:
    pick = f"[{', '.join(sql.quoted(a) for a, _ in _PHRASED)}]", f"[{', '.join(sql.quoted(b) for _, b in _PHRASED)}]"
    part = lambda k, col: f"{pick[k]}[{col} % {len(_PHRASED)} + 1]"
    return f"SELECT p_partkey AS id, {part(0, 'p_partkey')} || {part(0, 'p_size')} AS display, {made.format(part(1, 'p_partkey'), part(1, 'p_size'))} AS text FROM part"


@_query("pinyin_phrases", f"SELECT id, display, text, 'PinyinFull' AS kind FROM ({_phrase_sql('{} || {}'.replace('||', chr(124) * 2 + repr(' ') + chr(124) * 2))}) UNION ALL SELECT id, display, replace(text, ' ', '') AS text, 'PinyinJoined' AS kind FROM ({_phrase_sql('{} || {}')})")
def pinyin_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two phrases, in which a character's reading depends on its phrase."""
    names = F.array(*[F.lit(a) for a, _ in _PHRASED])
    at = lambda c: F.get(names, (F.col(c) % len(_PHRASED)).cast("int"))
    items = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.concat(at("p_partkey"), at("p_size")).alias("search_text"))
    return _keys_table(items, backend_for("zh", polyphone="phrase")).where("kind <> 'PinyinInitials'").select("id", "display", "text", "kind")


@_query("detect_of_table", "SELECT * FROM (VALUES ('zh_CN.UTF-8', 'zh'), ('ja_JP', 'ja'), ('ko_KR', 'ko'), ('C', 'plain')) v(locale, lang)")
def detect_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _mixed_texts(spark, sf_dir).withColumnRenamed("t", "search_text")
    return spark.createDataFrame([(x, detect_language_of(items, "abc", locale=x)) for x in ("zh_CN.UTF-8", "ja_JP", "ko_KR", "C")], "locale string, lang string")


def _hangul_sql(lists: tuple, code: str = "k") -> str:
    cell = lambda t: "[" + ", ".join(map(sql.quoted, t)) + "]"
    return f"{cell(lists[0])}[{code} // 588 + 1] || {cell(lists[1])}[{code} % 588 // 28 + 1] || {cell(lists[2])}[{code} % 28 + 1]"


_KO = f"SELECT id, 'a' || hangul || '-' || CAST(id AS VARCHAR) AS t, unicode(hangul) - 44032 AS k FROM ({_JOINED})"
_KO_FAMILIES = (
    ("KoreanRomanized", _hangul_sql((korean.ROMAN_INITIAL, korean.ROMAN_VOWEL, korean.ROMAN_FINAL))),
    ("KoreanInitials", _hangul_sql((list(korean.INITIALS), [""] * 21, [""] * 28))),
    ("KoreanKeyboard", _hangul_sql((korean.KEY_INITIAL, korean.KEY_VOWEL, korean.KEY_FINAL))),
)


@_query("korean_index", " UNION ALL ".join(f"SELECT id, {sql.quoted(kind)} AS kind, {text} AS text FROM ({_KO})" for kind, text in _KO_FAMILIES))
def korean_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that an index gives to one syllable each, of all families."""
    texts = _scripts(spark, sf_dir).select("id", F.concat(F.lit("a"), "hangul", F.lit("-"), F.col("id").cast("string")).alias("search_text"))
    own = index.build_index(texts, backend=BACKENDS["ko"])
    return own.select("id", F.explode("keys").alias("key")).select("id", "key.kind", "key.text").distinct()


@_query("korean_one_family", f"SELECT id, {_KO_FAMILIES[1][1]} AS text FROM ({_KO})")
def korean_one_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _scripts(spark, sf_dir).select("id", F.concat(F.lit("a"), "hangul", F.lit("-"), F.col("id").cast("string")).alias("search_text"))
    own = index.build_index(texts, backend=replace(BACKENDS["ko"], ko_families=frozenset({"initials"})))
    return own.select("id", F.explode("keys").alias("key")).select("id", "key.text")


@_query("kana_index", f"SELECT id, chr(CAST(unicode(kana) - 96 AS INTEGER)) || '/' || CAST(id AS VARCHAR) AS text FROM ({_JOINED})")
def kana_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _scripts(spark, sf_dir).select("id", F.concat("kana", F.lit("/"), F.col("id").cast("string")).alias("search_text"))
    own = index.build_index(texts, backend=BACKENDS["ja"])
    return own.select("id", F.explode("keys").alias("key")).where("key.kind = 'KanaReading'").select("id", "key.text")


@_query("visible_controls", "SELECT p_partkey AS id, p_name || chr(CAST(9216 + 1 + p_partkey % 31 AS INTEGER)) || 'z' AS shown FROM part")
def visible_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat("p_name", F.chr(1 + F.col("p_partkey") % 31), F.lit("z"))
    return own.select(F.col("p_partkey").alias("id"), norm.visible_controls_col(text).alias("shown"))


# ---- records, fields and histories of whole tables
@_query("order_ids", "SELECT p_partkey, row_number() OVER () - 1 AS id FROM part")
def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_ids(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"))


def _written(spark: SparkSession, sf_dir: str, nul: bool) -> DataFrame:
    """Names of parts as records in files, read again."""
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").cast("binary").alias("output"))
    text.write_records(rows, path, nul=nul)
    return text.read_records(spark, path, nul=nul).select("display")


_query("records_by_line", "SELECT p_name AS display FROM part")(lambda spark, d: _written(spark, d, False))
_query("records_by_nul", "SELECT p_name AS display FROM part")(lambda spark, d: _written(spark, d, True))


@_query("with_nth_shown", "SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS display, p_name AS original FROM part WHERE len(string_split(p_name, ' ')) >= 2")
def with_nth_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").cast("binary").alias("raw"), F.col("p_name").alias("display"))
    out = fields.prepare_items(rows, with_nth="2")
    return out.where("display <> ''").select("id", "display", "original")


@_query("history_of_names", "SELECT p_name AS line, max(p_partkey) AS pos FROM part GROUP BY p_name")
def history_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("line"), F.col("p_partkey").alias("pos"))
    return index.newest_first(lines)


@_query("own_matcher", f"SELECT id, display, CAST(3500 + length(display) AS BIGINT) AS score FROM ({_source('part')}) WHERE contains(display, 'ed')")
def own_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer that a caller registers."""
    register_matcher("by_length", lambda pattern, t, cased: F.when(F.contains(t, F.lit(pattern)), F.length(t)), folds_case=True)
    return matches(_index(spark, sf_dir, "part"), "ed", config=replace(ALL, algorithm="by_length")).select("id", "display", "score")


@dataclass(frozen=True)
class _Backwards(Backend):
    """A language of a caller's own: texts are also found written backwards."""

    def keys(self, text: str, config: SearchConfig) -> list[Key]:
        return [Key(text[::-1], "LearnedAlias")]


@_query("own_backend", f"SELECT id, CASE WHEN contains(t, 'Ω') THEN reverse(t) END AS key FROM (SELECT p_partkey AS id, p_name || 'Ω' AS t FROM part)")
def own_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), F.concat("p_name", F.lit("Ω")).alias("search_text"))
    own = index.build_index(items, backend=_Backwards("backwards"))
    return own.select("id", F.get("keys", F.lit(0))["text"].alias("key"))


@_query("highlight_contiguous", "SELECT p_partkey AS id, [CAST(instr(p_name, 'red') - 1 AS INTEGER), CAST(instr(p_name, 'red') AS INTEGER), CAST(instr(p_name, 'red') + 1 AS INTEGER)] AS places FROM part WHERE contains(p_name, 'red')")
def highlight_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _index(spark, sf_dir, "part")
    return highlight(matches(own, "red", config=replace(ALL, exact=True)), own, "red").select("id", "places")


# ---- streaming
@_query("live_search", sql.ordered(sql.greedy(_source("part"), "rd"), _BY_LENGTH, 10))
def live_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in three batches; the answer is that of one search."""
    live = LiveSearch(f"{shared_folder(spark)}/live-{uuid.uuid4().hex}", "rd")
    items = _items(spark, sf_dir, "part")
    for k in range(3):
        live.add(items.where(F.col("id") % 3 == k), k)
    return live.results(spark).drop("query", "case_sensitive", "batch_id")


@_query("scorer_columns", f"SELECT g.id, g.score AS greedy, e.score AS exact FROM ({sql.greedy(_source('pages'), 'com', add=0)}) g LEFT JOIN ({sql.exact(_source('pages'), 'com', add=0)}) e USING (id)")
def scorer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("search_text")
    return _items(spark, sf_dir, "pages").select("id", scorers.greedy("com", text).alias("greedy"), scorers.exact("com", text).alias("exact")).where("greedy IS NOT NULL")


#: Names that callers of the catalog may need.
__all__ = ["ORACLES", "QUERIES", "chinese", "optimal"]
