"""Runs of words that repeat with a period, and texts without the repeats.

At each scale the text's aligned blocks of a power of two words, as sequences of word numbers, are the keys of one
Aho-Corasick automaton, which is then searched over the whole text. A run of period q holds a block of the scale that q
belongs to in its first words, and the same block again q words on; so blocks that occur again at a distance of their
scale are seeds, and each seed is extended word by word, left and right, to the whole run.
"""

from __future__ import annotations

import hashlib
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column

LEAST = 12


def _spans(block: int, least: int, n: int) -> list[tuple[int, int]]:
    """Ranges of periods up to n // 2 that belong to blocks of this size.

    A run has max(q, least - q) words or more that recur q words on, and any 2 * block - 1 words hold an aligned block:
    a period belongs to the largest blocks that such words surely hold.
    """
    short = [q for q in range(1, min(least, n // 2 + 1)) if 2 * block - 1 <= max(q, least - q) <= 4 * block - 2]
    out = []
    for q in short:
        if out and out[-1][1] == q - 1:
            out[-1] = (out[-1][0], q)
        else:
            out.append((q, q))
    low, high = max(least, 2 * block - 1), min(n // 2, 4 * block - 2)
    if low <= high:
        if out and out[-1][1] == low - 1:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def _until_again(words: np.ndarray) -> np.ndarray:
    """For each word the distance to its next occurrence; that of last occurrences exceeds the text."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), len(words) + 1)
    again = words[order[1:]] == words[order[:-1]]
    out[order[:-1][again]] = np.diff(order)[again]
    return out


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many first items of x and y, of one length, are equal."""
    at, step = 0, 64
    while at < len(x):
        differ = x[at : at + step] != y[at : at + step]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + step, step * 4
    return len(x)


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def _has_less(words: np.ndarray, start: int, q: int) -> bool:
    """Whether 2 * q words of period q have a smaller one: then a divisor of q is one."""
    return any(np.array_equal(words[start : start + q], words[start + d : start + d + q]) for d in (q // p for p in _primes(q)))


class _Names:
    """Stretches of a power of two words as numbers, equal for equal stretches, made from those of half the length."""

    def __init__(self, words: np.ndarray):
        self.at, self.size = words, 1

    def of(self, size: int) -> np.ndarray:
        """The number of the stretch of so many words that starts at each place; sizes may only grow."""
        while self.size < size:
            pairs = self.at[: -self.size] * (self.at.max() + 1) + self.at[self.size :]
            self.at, self.size = np.unique(pairs, return_inverse=True)[1], 2 * self.size
        return self.at


def _matches(names: _Names, n: int, block: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the aligned blocks among keys (-1: no key), and start and number of each place where a key occurs.

    A long block's sequence is that of its eighths, so that the automaton is no deeper, and searching no slower, for long
    blocks that repeat within themselves. The text is then searched once from each place of an eighth.
    """
    size = max(1, block // 8)
    at, length = names.of(size), block // size
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    own = np.full(n // block, -1)
    for k, key in zip(keys.tolist(), at[keys[:, None] * block + size * np.arange(length)].tolist(), strict=True):
        number = automaton.get(key := tuple(key), None)
        if number is None:
            number = len(automaton)
            automaton.add_word(key, number)
        own[k] = number
    automaton.make_automaton()
    starts, found = [], []
    for r in range(size):
        for end, number in automaton.iter(tuple(at[r::size].tolist())):
            starts.append(r + size * (end - length + 1))
            found.append(number)
    return own, np.array(starts, np.int64), np.array(found, np.int64)


def find_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run in words, given as numbers from 0: sorted by start, then period.

    A run is a stretch with smallest period q and length >= max(least, 2 * q) that goes on at neither end with period q.
    Room is some hundred bytes a word at most, for the automaton of one scale and the places found.
    """
    n = len(words)
    if n < max(least, 2):
        return []
    again = _until_again(words)
    names = _Names(words)
    out: list[tuple[int, int, int]] = []
    block = 1
    while block <= n and 2 * block - 1 <= max(n // 2, least):
        spans = _spans(block, least, n)
        if spans:
            whole = n // block
            # each word of a seed's block occurs again within the period
            keys = np.flatnonzero(again[: whole * block].reshape(whole, block).max(1) <= spans[-1][1])
            if len(keys):
                out += _grown(words, _seeds(*_matches(names, n, block, keys), block, spans), block, least, out)
        block *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def _seeds(names: np.ndarray, starts: np.ndarray, found: np.ndarray, block: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rows of period and start: aligned blocks that occur again that much later."""
    rows = []
    for low, high in spans:
        first = -((high - starts) // block)  # the first block that starts high or less before
        for k in range((high - low) // block + 2):
            at = first + k
            fits = (at >= 0) & (at * block <= starts - low)
            at, start, name = at[fits], starts[fits], found[fits]
            same = names[at] == name
            rows.append(np.column_stack((start[same] - at[same] * block, at[same] * block)))
    seeds = np.concatenate(rows)
    return seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))]


def _grown(words: np.ndarray, seeds: np.ndarray, block: int, least: int, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs that seeds extend to."""
    n = len(words)
    if block >= least and known and len(seeds):
        # what lies in a run whose period is at most a block, and is longer than both periods, has a multiple of that
        # run's period: it is no run of its own
        reach = np.zeros(n, np.int64)
        for start, length, q in known:
            if q <= block:
                np.maximum(reach[start : start + length], start + length, out=reach[start : start + length])
        seeds = seeds[reach[seeds[:, 1]] < seeds.sum(1) + block]
    out = []
    last, end = 0, 0
    for q, at in seeds.tolist():
        if q == last and at + q + block <= end:
            continue  # of the stretch just looked at
        left = _agree(words[:at][::-1], words[q : q + at][::-1])
        right = _agree(words[at + block : n - q], words[at + block + q :])
        start, last, end = at - left, q, at + block + q + right
        if end - start >= max(least, 2 * q) and not _has_less(words, start, q):
            out.append((start, end - start, q))
    return out


def numbers_of(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 0, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds beyond its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def with_repeats(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of some documents, told by a hash of the id, with their tail replaced by repeats of the tail's start."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """doc_id, start, length, period of each run in each text. Words are split at ASCII white space, case matters.

    Null and empty texts, and texts of fewer than `least` words, have no runs. Whole texts are searched, each in one
    task. Rows of equal or null doc_id are searched each on its own; an empty table gives an empty table; other columns
    are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = [(doc, *r) for doc, text in zip(batch.column(0).to_pylist(), binary_column(batch), strict=True) for r in find_runs(numbers_of(text.split()), least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "length", "period"])

    return _base(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse_repeats(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """docs with texts that hold runs rewritten: words beyond a run's first period go, the others are joined by one space.

    Texts without runs stay as they are, null too; all columns stay.
    """
    where = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(where).to_pylist():
                words = (text or "").encode().split()
                runs = find_runs(numbers_of(words), least)
                out.append(b" ".join([words[k] for k in np.flatnonzero(kept_words(len(words), runs))]).decode() if runs else text)
            columns = list(batch.columns)
            columns[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


_FORM = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(docs: DataFrame, *, least: int = LEAST, repeats: bool = False) -> DataFrame:
    """Per document: n_runs, the longest run (ties: smallest start, then period; nulls without a run) and digests.

    runs_sha256 is that of the runs' lines `start,length,period`, collapsed_sha256 that of the words left, joined by one
    space. With `repeats`, words are first rewritten by with_repeats. Nulls, odd texts and tables as in periodic_runs; the
    digests of documents without runs or words are those of what is left, if only the empty string.
    """

    def run(batches):
        kinds = (*[pa.int64()] * 6, pa.string(), pa.string())
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), binary_column(batch), strict=True):
                words = text.split()
                if repeats:
                    words = with_repeats(doc, words)
                runs = find_runs(numbers_of(words), least)
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                left = words if not runs else [words[k] for k in np.flatnonzero(kept_words(len(words), runs))]
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                rows.append((doc, len(runs), start, length, period, length and 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _FORM.split(", ")])

    return _base(docs).mapInArrow(run, _FORM)
