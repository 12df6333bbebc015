"""What a filter run hands to its caller: output bytes and an exit code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from ..sources.text import ordered_bytes
from .fields import Delimiter, accept

FOUND, NONE, ERROR, ABORTED = 0, 1, 2, 130


@dataclass(frozen=True)
class Outcome:
    output: bytes
    code: int


def filter_outcome(results: DataFrame, items: DataFrame, query: str, *, accept_nth: str | None = None, delimiter: Delimiter = Delimiter(), nul: bool = False, print_query: bool = False, explain: bool = False) -> Outcome:
    """Results, which are ordered, as output. The query comes first where asked for; no result is code 1.

    Places are numbered where the rows are, and stored; the output's bytes alone come to the driver, a partition at a time.

    Where a caller would ask a person to choose, decide() says first whether there is anything to ask.
    """
    if explain and nul:
        raise ValueError("an explanation is lines of text and cannot be separated by NUL")
    # ids of a sorted result grow with its order
    order = stored(results.select("id").withColumn("place", F.monotonically_increasing_id()), "outcome")
    if order.isEmpty():
        return Outcome(f"{query}\n".encode() if print_query else b"", NONE)
    out = ordered_bytes(accept(items, accept_nth, delimiter).join(order, "id").orderBy("place"), nul=nul)
    end = b"\0" if nul else b"\n"
    return Outcome((query.encode() + end if print_query else b"") + out, FOUND)


def decide(matches: DataFrame, *, select_1: bool = False, exit_0: bool = False) -> tuple[str, int | None]:
    """What to do before a person is asked to choose among matches: ("select", id) of the only one with select_1, ("exit",
    None) where there is none with exit_0, else ("ask", None). Two rows at most are looked at; a filter run, which asks
    nobody, needs none of this."""
    first = matches.select("id").limit(2).collect()
    if select_1 and len(first) == 1:
        return "select", first[0].id
    return ("exit", None) if exit_0 and not first else ("ask", None)
