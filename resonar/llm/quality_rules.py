"""Quality rules: a table of thresholds compiled into one Spark projection of built-in functions.

Each rule bounds a ratio of lengths, symbols, stop words or lines. Measures are built-in expressions over the text, in
a few layers so that arrays which later expressions use several times are computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WS = r"[\x20\x09-\x0D]"
#: Words of a repeated window, least words of a document, most percent of words in repeated windows.
SPAN, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in that is was for it with as his on be at by he had this not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis "
    "le la les de des du et en un une que qui dans est pour pas au sur ne se ce il sont avec par plus son elle ou mais nous vous leur cette "
    "el los las y del al lo una su por con para es no más se ha como sus le pero fue ser sin entre ya muy también"
).split()


@dataclass(frozen=True)
class Rule:
    """value must lie between least and most, in documents of at least from_words words."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


RULES = (
    Rule("short", "n_words", least=LEAST_WORDS),
    Rule("repeated", "100.0 * n_repeat_words / greatest(n_words, 1)", most=MOST_REPEATED),
    Rule("word_length", "1.0 * word_chars / greatest(n_words, 1)", least=2.0, most=14.0),
    Rule("symbols", "1.0 * n_symbols / greatest(n_words, 1)", most=0.5),
    Rule("exclamations", "1.0 * n_exclamations / greatest(n_words, 1)", most=0.5),
    Rule("digits", "1.0 * n_digits / greatest(word_chars, 1)", most=0.4),
    Rule("stop_words", "1.0 * n_stop_words / greatest(n_words, 1)", least=0.01, from_words=100),
    Rule("same_lines", "1.0 * n_dup_lines / greatest(n_lines, 1)", most=0.5),
    Rule("ellipses", "1.0 * n_ellipsis_lines / greatest(n_lines, 1)", most=0.5),
    Rule("bullets", "1.0 * n_bullet_lines / greatest(n_lines, 1)", most=0.9),
)
BASE = ("short", "repeated")


def _fails(rule: Rule) -> str:
    value = f"({rule.value})"
    out = [f"{value} < {rule.least}"] * (rule.least is not None) + [f"{value} > {rule.most}"] * (rule.most is not None)
    return f"(n_words >= {max(rule.from_words, 1)} AND ({' OR '.join(out)}))" if rule.name != "short" else f"(n_words < {rule.least})"


def failed_expression(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL, in Spark and elsewhere, for the names of the rules that a document fails, comma-joined."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_fails(r)} THEN '{r.name}' END" for r in rules) + ")"


def _removed(chars: str) -> Column:
    return F.length("text") - F.length(F.translate("text", chars, ""))


def _repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from raw, lead and n_words."""
    one = F.col("lead") + 1
    keys = F.transform(F.sequence(one, F.col("lead") + F.col("n_words") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("raw", i.cast("int"), SPAN)))
    df = df.withColumn("keys", F.when(F.col("n_words") >= SPAN, keys))
    again = F.size(F.array_distinct("keys")) < F.size("keys")
    df = df.withColumn("sorted", F.when(again, F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    same = lambda s, j, to: F.coalesce(F.get(F.col("sorted"), j + to)["k"] == s["k"], F.lit(False))
    found = F.transform("sorted", lambda s, j: F.when(same(s, j, -1) | same(s, j, 1), s["i"]))
    df = df.withColumn("starts", F.sort_array(F.array_compact(found)))
    own = F.transform("starts", lambda x, k: F.coalesce(F.least(F.lit(SPAN), F.get(F.col("starts"), k + 1) - x), F.lit(SPAN)))
    total = F.aggregate(own, F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("keys", "sorted", "starts")


def measure(docs: DataFrame) -> DataFrame:
    """docs (all columns; text not null) with all measures that rules use."""
    own = docs.columns
    split = docs.withColumn("raw", F.split("text", f"{_WS}+", -1))
    lead = (F.element_at("raw", 1) == "").cast("int")
    tail = ((F.size("raw") > 1) & (F.element_at("raw", -1) == "")).cast("int")
    split = split.withColumn("lead", lead).withColumn("n_words", (F.size("raw") - lead - tail).cast("long"))
    split = _repeats(split)
    split = split.withColumn("n_stop_words", F.size(F.filter("raw", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long")).drop("raw", "lead")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = split.withColumn("lines", lines)
    count = lambda f: F.size(F.filter("lines", f)).cast("long")
    return split.select(
        *own,
        "n_words",
        F.length(F.regexp_replace("text", f"{_WS}+", "")).cast("long").alias("word_chars"),
        _removed(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        _removed("!").cast("long").alias("n_exclamations"),
        _removed("0123456789").cast("long").alias("n_digits"),
        "n_stop_words",
        F.size("lines").cast("long").alias("n_lines"),
        count(lambda x: x.endswith("...") | x.endswith("…")).alias("n_ellipsis_lines"),
        count(lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• ")).alias("n_bullet_lines"),
    )


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed of each document.

    Words are runs of characters other than white space (space, 0x09-0x0D). A null text has no words and fails. Rows
    with equal or null doc_id stay rows of their own; whole texts are measured; other columns are ignored. An empty table
    gives an empty table.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = measure(base).withColumn("failed", F.expr(failed_expression(rules)))
    names = F.split("failed", ",")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.element_at(names, 1) == "")).alias("kept"), "failed")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, words[i:i + {SPAN - 1}] AS k FROM (SELECT rid, words, unnest(range(1, len(words) - {SPAN - 2})) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {SPAN})) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             length(text) - length(replace(text, '!', '')) AS n_exclamations,
             length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
             len(list_filter(words, lambda x: list_contains([{", ".join(map(_quoted, STOP_WORDS))}], lower(x)))) AS n_stop_words,
             len(lines) AS n_lines,
             len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines,
             len(list_filter(lines, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '• '))) AS n_bullet_lines
      FROM w LEFT JOIN covered USING (rid)),
f AS (SELECT *, {failed_expression()} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       failed = '' AS kept, failed
FROM f
"""
