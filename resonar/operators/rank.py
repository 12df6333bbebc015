"""Order of results: score, tiebreaks, input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig, total_order
from ..functions.normalize import normalize
from ..shared import stored

FAR = (1 << 63) - 1


def tiebreak_query(query: str) -> str:
    """What tiebreaks look for: the normal form of the first word of the query, operators and all."""
    words = query.split()
    return normalize(words[0]) if words else ""


def _begin(text: Column, q: Column) -> Column:
    k = F.position(q, text)
    return F.when(k > 0, F.octet_length(F.substring(text, F.lit(1), k - 1)).cast("long")).otherwise(F.lit(FAR))


def tie_columns(q: Column, tiebreaks: tuple[str, ...]) -> list[Column]:
    """Ascending keys over display, norm and id, of tiebreaks that look for q; an empty q is in all places alike."""
    norm = F.col("norm")
    out = []
    asked = lambda c: F.when(q != "", c).otherwise(F.lit(0))
    for name in total_order(tiebreaks):
        if name == "index":
            out.append(F.col("id"))
        elif name == "length":
            out.append(F.length("display"))
        elif name == "begin":
            out.append(asked(_begin(norm, q)))
        elif name == "end":
            back = F.reverse(norm)
            k = F.position(F.reverse(q), back)
            out.append(asked(F.when(k > 0, F.octet_length(F.substring(back, F.lit(1), k - 1)).cast("long")).otherwise(F.lit(FAR))))
        elif name == "chunk":
            pairs = F.arrays_zip(F.split("display", r"\p{IsWhite_Space}+").alias("own"), F.split(norm, r"\p{IsWhite_Space}+").alias("norm"))
            held = F.filter(pairs, lambda p: F.contains(p["norm"], q) & (p["own"] != ""))
            out.append(asked(F.coalesce(F.array_min(F.transform(held, lambda p: F.octet_length(p["own"]).cast("long"))), F.lit(FAR))))
        elif name == "pathname":
            base = F.regexp_extract(norm, r"[^/\\]*\z", 0)
            inside = F.position(q, base) > 0
            out += [asked(F.when(inside, 0).otherwise(1)), asked(F.when(inside, _begin(base, q)).otherwise(_begin(norm, q)))]
    return out


def sort_columns(query: str, tiebreaks: tuple[str, ...]) -> list[Column]:
    """Ascending keys over display, norm and id."""
    return tie_columns(F.lit(tiebreak_query(query)), tiebreaks)


def exact_ranks(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's place from 1 within its group, in an order that leaves no ties, however large a group is.

    Rows are dealt out by ranges of group and order, sorted, numbered and stored; a row's place is its number from where its
    group begins in the range, and what the group has in earlier ranges. The table of beginnings has a row for each range
    and group that meet: about as many as there are ranges and groups.
    """
    keys = [f"_order{k}" for k in range(len(order))]
    keyed = df.withColumns({k: c for k, c in zip(keys, order, strict=True)})
    sorted_ = keyed.repartitionByRange(*by, *keys).sortWithinPartitions(*by, *keys).drop(*keys)
    dealt = stored(sorted_.withColumns({"_range": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "ranks")
    counts = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", *by, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    both = dealt.join(starts, ["_range", *by])
    return both.select(*df.columns, (F.col("_nth") + F.col("_offset")).cast("int").alias(name))


RESULT = ("id", "display", "score", "key_kind", "key_index")


def ranked(scored: DataFrame, query: str, config: SearchConfig) -> DataFrame:
    """The best `limit` rows of scored, in order; all of them where limit is None. Sorting and cutting is one top-k."""
    order = [F.col("id")] if config.no_sort else [F.desc("score"), *sort_columns(query, config.tiebreaks)]
    out = scored.orderBy(*order)
    out = out if config.limit is None else out.limit(config.limit)
    return out.select(*RESULT)
