"""Width of text on a terminal, for results that are shown: wide characters count two, combining marks none."""

from __future__ import annotations

import unicodedata

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from .normalize import is_ascii


def clusters(text: str) -> list[str]:
    """Characters with the marks, joiners and selectors that follow them."""
    out: list[str] = []
    for c in text:
        joins = unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Mc") or c in "‍︎️"
        if out and (joins or out[-1].endswith("‍")):
            out[-1] += c
        else:
            out.append(c)
    return out


def width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c[0]) in "WF" or "️" in c else 0 if unicodedata.category(c[0]) in ("Mn", "Me", "Cc", "Cf") else 1 for c in clusters(text))


def prefix(text: str, most: int) -> str:
    out, used = "", 0
    for c in clusters(text):
        used += width(c)
        if used > most:
            break
        out += c
    return out


def shorten(text: str, most: int) -> str:
    """text, or as much of it as fits before an ellipsis."""
    return text if width(text) <= most else prefix(text, max(0, most - 1)) + "…" * (most > 0)


@F.pandas_udf(IntegerType())
def _width(text: pd.Series) -> pd.Series:
    return text.map(width, na_action="ignore").astype("Int32")


def width_col(text: Column) -> Column:
    """Printable ASCII is as wide as it is long; only other rows reach a Python worker."""
    plain = is_ascii(text) & ~text.rlike(r"[\x00-\x1f\x7f]")
    return F.when(plain, F.length(text)).otherwise(_width(F.when(~plain, text)))


def shorten_col(text: Column, most: int) -> Column:
    @F.pandas_udf(StringType())
    def run(own: pd.Series) -> pd.Series:
        return own.map(lambda t: shorten(t, most), na_action="ignore")

    return run(text)
