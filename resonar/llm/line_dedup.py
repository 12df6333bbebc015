"""Removal of lines that spread over many sites, with DataFrame functions only.

How many distinct sites show a line is sketched: a HyperLogLog for each line hash, merged by aggregation. Only lines
whose estimate is near the threshold get an exact distinct count. A line that spreads that far is boilerplate and goes
everywhere but at its first place, so that no text is lost altogether.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, with_rows

MIN_SITES, LOG_K = 6, 12


def _lines(docs: DataFrame, text: str, site: str, row: list[str]) -> DataFrame:
    """A row for each line with more than spaces: r0, r1 (its row), place, site and two hashes."""
    own = [F.col(c).alias(f"r{k}") for k, c in enumerate(row)]
    each = docs.select(*own, F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    trimmed = each.withColumn("line", F.trim("line")).where("line <> ''")
    return trimmed.select(*(f"r{k}" for k in range(len(row))), "place", F.xxhash64("site").alias("site"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def spread_lines(lines: DataFrame, order: list[str], *, min_sites: int = MIN_SITES, log_k: int = LOG_K) -> DataFrame:
    """(h1, h2, first): lines found on at least min_sites sites, and the first place of each by `order`."""
    margin = max(2, math.ceil(5 * 1.04 / math.sqrt(2**log_k) * min_sites))
    sketched = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_k))).alias("sites"), F.min(F.struct(*order)).alias("first"))
    scratch = Scratch(lines.sparkSession, "lines")
    likely = scratch.save(sketched.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites - margin)), "likely")
    sure = likely.where(F.col("sites") > min_sites + margin)
    near = likely.where(F.col("sites") <= min_sites + margin)
    pairs = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").count().where(F.col("count") >= min_sites).select("h1", "h2")
    return scratch.save(sure.select("h1", "h2", "first").union(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first")), "spread")


def dedup_lines(docs: DataFrame, *, text: str = "text", site: str = "source", key: str = "doc_id", min_sites: int = MIN_SITES, log_k: int = LOG_K) -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines and n_removed (long), which replace columns so named.

    A line counts without the spaces around it; lines of spaces only are never boilerplate. A null site counts as one
    site of its own. Of a boilerplate line the copy in the smallest key stays (a null key comes first; of rows with one
    key any), at its first place. A null text stays null and has no lines; the empty text has one. An empty table gives an
    empty table. Other columns, of any name, stay as they are. Rows are known by file and place in it, so all scans agree;
    a table that is not read from files is stored first.
    """
    given, row = with_rows(docs, Scratch(docs.sparkSession, "lines"))
    keyed = _lines(given, text, site, [key, *row])
    spread = spread_lines(keyed, ["r0", "r1", "r2", "place"], min_sites=min_sites, log_k=log_k)
    lines = keyed.drop("r0", "site")
    first = F.col("first")
    hits = lines.join(spread, ["h1", "h2"]).where(~((first["r1"] == F.col("r1")) & (first["r2"] == F.col("r2")) & (first["place"] == F.col("place"))))
    _places, _lines_, *own = fresh(given, "_places", "_lines", *row)
    places = hits.groupBy(F.col("r1").alias(own[0]), F.col("r2").alias(own[1])).agg(F.collect_list("place").alias(_places))
    both = given.join(places, (given[row[0]] == places[own[0]]) & (given[row[1]] == places[own[1]]), "left").drop(*own, *row)
    both = both.withColumn(_lines_, F.split(text, "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size(_lines_) - 1), _places)
    kept = F.array_join(F.transform(left, lambda i: F.get(_lines_, i)), "\n")
    size = F.coalesce(F.size(_lines_), F.lit(0)).cast("long")
    n_removed = F.when(F.col(_places).isNull(), 0).otherwise(F.size(_places)).cast("long")
    clean = F.when(F.col(_places).isNull(), F.col(text)).otherwise(kept)
    columns = [clean.alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return both.select(*columns, F.when(F.col(text).isNull(), 0).otherwise(size).alias("n_lines"), n_removed.alias("n_removed"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, '') AS site FROM documents),
l AS (SELECT rid, doc_id, site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM d WHERE text IS NOT NULL),
spread AS (SELECT trim(line) AS k, min((doc_id, place)) AS first FROM l WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (SELECT rid, place, line, k IS NOT NULL AND (doc_id, place) <> first AS gone FROM l LEFT JOIN spread ON trim(line) = k),
back AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS clean, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM marked GROUP BY rid)
SELECT doc_id, clean AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM d LEFT JOIN back USING (rid)
"""
