"""Field projections: splitting a line, choosing fields, templates; all compiled to built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import strip_ansi_col
from .index import with_ids


class Delimiter:
    """A regular expression between fields, or white space where it is None. A bad expression fails here, as a ValueError."""

    def __init__(self, pattern: str | None = None):
        if pattern is not None:
            self._check(pattern)
        self.pattern = pattern

    @staticmethod
    def _check(pattern: str) -> None:
        """Java runs the expression, so Java checks it; Python does where there is no session yet."""
        session = SparkSession.getActiveSession()
        try:
            if session is None:
                re.compile(pattern)
            else:
                session.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        except (re.error, Py4JJavaError, PySparkException) as e:
            raise ValueError(f"bad delimiter {pattern!r}: {e}") from e

    @property
    def joiner(self) -> str:
        """What chosen fields are joined with: a space, or the expression's own source text."""
        return " " if self.pattern is None else self.pattern

    def split(self, text: Column) -> Column:
        if self.pattern is None:
            return F.filter(F.split(text, r"\p{IsWhite_Space}+", -1), lambda x: x != "")
        return F.split(text, self.pattern, -1)


def _place(text: str, default: int | None) -> int | None:
    """A field number; None where it is not one, and for 0."""
    text = text.strip()
    if not text:
        return default
    return int(text) if re.fullmatch(r"[+-]?\d+", text) and int(text) else None


def _resolved(n: int, fields: Column) -> Column:
    """1-based place of field n, counted from the end where n is negative; null outside."""
    k = F.lit(n) if n > 0 else F.size(fields) + 1 + n
    return F.when((k >= 1) & (k <= F.size(fields)), k)


def _one(expression: str, fields: Column) -> Column:
    nothing = F.array().cast("array<string>")
    text = expression.strip()
    if ".." not in text:
        n = _place(text, None)
        if n is None:
            return nothing
        return F.coalesce(F.when(_resolved(n, fields).isNotNull(), F.array(F.try_element_at(fields, F.lit(n)))), nothing)
    left, right = text.split("..", 1)
    a, b = _place(left, 1), _place(right, -1)
    if a is None or b is None:
        return nothing
    start, end = _resolved(a, fields), _resolved(b, fields)
    return F.coalesce(F.when(start <= end, F.slice(fields, start, end - start + 1)), nothing)


def select_fields(spec: str, text: Column, delimiter: Delimiter = Delimiter()) -> Column:
    """Fields of a comma list of N, -N, A..B, A.., ..B and .., joined. What does not exist is empty, never an error."""
    fields = delimiter.split(text)
    return F.array_join(F.concat(*[_one(x, fields) for x in spec.split(",")]), delimiter.joiner)


def render(template: str, text: Column, ordinal: Column, delimiter: Delimiter = Delimiter()) -> Column:
    """Text with {expression} and {n}, the row's number. A template without braces is a field list."""
    if "{" not in template:
        return select_fields(template, text, delimiter)
    parts, k = [], 0
    while (start := template.find("{", k)) >= 0:
        end = template.find("}", start)
        if end < 0:
            raise ValueError("a { has no }")
        name = template[start + 1 : end]
        parts += [F.lit(template[k:start]), ordinal.cast("string") if name == "n" else select_fields(name, text, delimiter)]
        k = end + 1
    return reduce(lambda a, b: F.concat(a, b), [*parts, F.lit(template[k:])])


def prepare_items(records: DataFrame, *, nth: str | None = None, with_nth: str | None = None, delimiter: Delimiter = Delimiter(), ansi: bool = False) -> DataFrame:
    """id, raw, original, display, search_text from records with id, raw, display.

    with_nth changes what is shown (of the text without terminal escapes, with ansi); nth narrows what is searched, of
    what is shown.
    """
    own = F.col("display")
    shown = strip_ansi_col(own) if ansi else own
    display = render(with_nth, shown, F.col("id"), delimiter) if with_nth else shown
    base = records.select("id", "raw", own.alias("original"), display.alias("display"))
    return base.withColumn("search_text", select_fields(nth, F.col("display"), delimiter) if nth else F.col("display"))


def accept(items: DataFrame, spec: str | None = None, delimiter: Delimiter = Delimiter()) -> DataFrame:
    """id and output (binary): raw bytes, or the projection of the original text."""
    out = F.col("raw") if spec is None else F.encode(render(spec, F.col("original"), F.col("id"), delimiter), "utf-8")
    return items.select("id", out.alias("output"))


def look_up(results: DataFrame, items: DataFrame, spec: str | None = None, delimiter: Delimiter = Delimiter()) -> DataFrame:
    """Results with their output. Results are few, items are not: the small side's ids go to the items."""
    return results.join(accept(items, spec, delimiter), "id")


def _refuse_stream(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{what} needs a whole table; a stream has no last row")


def slice_records(records: DataFrame, *, header: int = 0, tail: int | None = None, tac: bool = False, position: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(rows with id, header rows) of records numbered by `position` from 0: header lines leave first, then all but the last `tail` rows, then the order turns. ids are given at the end."""
    _refuse_stream(records, "header, tail or tac")
    body = records.where(F.col(position) >= header)
    if tail is not None:
        last = records.agg(F.max(position)).first()[0]
        body = body.where(F.col(position) >= (0 if last is None else last + 1 - tail))
    if tail is None and not header and not tac:
        return body.withColumn("id", F.col(position).cast("long")), records.limit(0)
    bounds = body.agg(F.min(position), F.max(position)).first()
    low, high = bounds[0] or 0, bounds[1] or 0
    number = F.lit(high) - F.col(position) if tac else F.col(position) - F.lit(low)
    return body.withColumn("id", number.cast("long")), records.where(F.col(position) < header).orderBy(position)


def number_records(records: DataFrame, position: str = "pos") -> DataFrame:
    return with_ids(records, position)
