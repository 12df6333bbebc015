"""Readings by a lattice of dictionary words: the cheapest way through word costs and costs between neighbours.

The dictionary is a table in the layout that morphological dictionaries are published in: comma-separated surface, left
class, right class, cost, and features, of which the eighth is the reading; costs between classes are lines of right class
of the first word, left class of the second, cost. Both are read by Spark, checked for size, and sent to the workers once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..normalize import has_kana

#: Where the reading stands among all columns, and most entries that are sent to workers.
READING, MOST = 11, 2_000_000
#: Cost of a character that no entry covers, and its classes; the class of both ends.
UNKNOWN_COST, END = 20_000, 0


def read_dictionary(spark: SparkSession, path: str, *, encoding: str = "UTF-8") -> DataFrame:
    """surface, left, right, cost, reading of each entry; `*` and a missing reading are null. Lines that are not entries go."""
    columns = ", ".join(["surface string", "left int", "right int", "cost int", *[f"f{k} string" for k in range(4, READING)], "reading string"])
    rows = spark.read.schema(columns).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
    reading = F.when(F.col("reading").isNotNull() & ~F.col("reading").isin("*", ""), F.col("reading"))
    return rows.where("surface IS NOT NULL AND left IS NOT NULL AND right IS NOT NULL AND cost IS NOT NULL").select("surface", "left", "right", "cost", reading.alias("reading"))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """right, left, cost from lines of three numbers; the line of sizes, which has two, goes."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) == 3).select(parts[0].cast("int").alias("right"), parts[1].cast("int").alias("left"), parts[2].cast("int").alias("cost"))


@dataclass
class Dictionary:
    """Entries by surface, as a trie of characters, and costs between classes; a pair without a cost costs nothing."""

    trie: dict = field(default_factory=dict)
    costs: dict[tuple[int, int], int] = field(default_factory=dict)

    def add(self, surface: str, left: int, right: int, cost: int, reading: str | None) -> None:
        node = self.trie
        for c in surface:
            node = node.setdefault(c, {})
        node.setdefault("", []).append((left, right, cost, reading))

    @classmethod
    def of_tables(cls, entries: DataFrame, connections: DataFrame | None = None, *, most: int = MOST) -> Dictionary:
        """A dictionary is a bounded resource: larger tables than `most` are refused."""
        out = cls()
        for name, table in (("entries", entries), ("connections", connections)):
            if table is None:
                continue
            if (n := table.limit(most + 1).count()) > most:
                raise ValueError(f"more than {most} {name}")
            for row in table.toLocalIterator() if n else ():
                if name == "entries":
                    out.add(*row)
                else:
                    out.costs[row[0], row[1]] = row[2]
        return out

    def words(self, text: str, at: int):
        """(end, left, right, cost, reading) of the entries that begin at a place."""
        node = self.trie
        for k in range(at, len(text)):
            node = node.get(text[k])
            if node is None:
                return
            for left, right, cost, reading in node.get("", ()):
                yield k + 1, left, right, cost, reading

    def path(self, text: str) -> list[tuple[int, int, str | None]]:
        """(start, end, reading) of the words of the cheapest way; of equally cheap ones that found first, in the order of
        starts and then of entries. A character that no entry covers is a word of its own, dear, and reads as itself where
        it is kana or ASCII."""
        # at each place, by right class: cost, previous place and class, reading
        best: list[dict[int, tuple]] = [{} for _ in range(len(text) + 1)]
        best[0][END] = (0, -1, END, None)
        for at in range(len(text)):
            if not best[at]:
                continue
            found = list(self.words(text, at))
            if not any(end == at + 1 for end, *_ in found):
                c = text[at]
                found.append((at + 1, END, END, UNKNOWN_COST, c if has_kana(c) or c.isascii() else None))
            for end, left, right, cost, reading in found:
                for before, (total, *_) in best[at].items():
                    now = total + self.costs.get((before, left), 0) + cost
                    if right not in best[end] or now < best[end][right][0]:
                        best[end][right] = (now, at, before, reading)
        if not text:
            return []
        last = min(best[-1], key=lambda right: best[-1][right][0] + self.costs.get((right, END), 0))
        out, at = [], len(text)
        while at:
            _, start, before, reading = best[at][last]
            out.append((start, at, reading))
            at, last = start, before
        return out[::-1]


class LatticeTokenizer:
    """A tokenizer for readings. With a broadcast the dictionary reaches each worker once, not with each plan."""

    def __init__(self, dictionary: Dictionary, spark: SparkSession | None = None):
        self.held = dictionary if spark is None else spark.sparkContext.broadcast(dictionary)
        self.sent = spark is not None

    def __call__(self, text: str) -> list[tuple[str, list[str], int, int]]:
        own: Dictionary = self.held.value if self.sent else self.held
        return [(text[a:b], [] if reading is None else [reading], a, b) for a, b, reading in own.path(text)]
