"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

How many pieces there are of each length is all that packing needs to know, and that table has at most `capacity` rows.
The driver packs lengths into bin patterns: each bin is filled greedily with the longest piece that fits; then its
smallest piece gives way to two unpacked pieces where those fill the widened gap more tightly. A pattern is repeated
while its lengths last. Executors number the pieces of each length and look up their places.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary_column, fresh, in_chunks, numbered
from .wordcache import WordCache

CAPACITY, END_ID = 4096, 1
#: Pieces of one length that are numbered in one task, roughly.
GROUP = 100_000
#: Words and parts of words that a worker's cache keeps at least.
HALF = 800_000
#: Words learnt at once, and bytes of texts whose new words are learnt together.
LEARN, TOGETHER = 50_000, 1 << 22
#: Rows of a batch whose texts are held as Python strings at once.
ROWS = 1024
_TAIL = b",.;:!?*%$#&|"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Letters below are letters to every version of Unicode in use.
_OLD = 0x0530
_loaded: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        last = np.zeros(own.get_vocab_size(), bool)
        last[[k for t, k in own.get_vocab().items() if t.endswith("</w>")]] = True
        marks = [x.content.encode() for x in own.get_added_tokens_decoder().values()]
        if any(m.split() != [m] for m in marks):
            raise ValueError("an added token holds white space, so words cannot be encoded one by one")
        _loaded[path] = own, WordCache(HALF), last, marks
    return _loaded[path]


def _ends_in_letter(stem: bytes) -> bool:
    """Whether the tokenizer, which composes and then lower-cases, will surely see a letter at the end of stem."""
    if stem[-1] < 128:
        return stem[-1] in _LETTERS
    last = unicodedata.normalize("NFC", stem.decode())[-1].lower()[-1]
    return last.isalpha() and ord(last) < _OLD


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _all_old(text: str) -> bool:
    low = unicodedata.normalize("NFC", text).lower()
    return low.isalpha() and ord(max(low)) < _OLD


def _split(word: bytes, marks: list[bytes]) -> tuple[bytes, bytes]:
    """A word without its closing punctuation, and that; the tokenizer's own splitting always parts a letter from it.

    ASCII words are lower-cased here, as the tokenizer will do; others keep their case, as it composes before that. Words
    that hold an added token stay as they are: those are found before letters are lower-cased.
    """
    if marks and any(m in word.lower() for m in marks):
        return word, b""
    stem = word.rstrip(_TAIL)
    if len(stem) == len(word):
        return word.lower() if word.isascii() else word, b""
    if len(stem) < len(word) and not (stem and _ends_in_letter(stem)):
        stem = word
    return stem.lower() if stem.isascii() else stem, word[len(stem) :]


def _learn(path: str, words: list[bytes]) -> None:
    """Puts words into the cache; their parts, lower-cased, are kept there too."""
    own, cache, last, marks = _tokenizer(path)
    low = b" ".join(words).lower()
    marks = [m for m in marks if m in low]
    split = [_split(w, marks) for w in words]
    new = cache.lacking({p for both in split for p in both if p})
    # letters alone are one word to the tokenizer, and only a word's last token is marked, so many go in one text
    plain, other = [], []
    for p in new:
        text = p.decode()
        (plain if text.isalpha() and (p.isascii() or _all_old(text)) else other).append((p, text))
    runs = [plain[k : k + 4096] for k in range(0, len(plain), 4096)]
    for some, e in zip(runs, own.encode_batch_fast([" ".join([t for _, t in r]) for r in runs], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, "<u4")
        cut = (4 * (np.flatnonzero(last[ids]) + 1)).tolist()
        if len(cut) != len(some):
            other += some
            continue
        data, start = ids.tobytes(), 0
        for (p, _), end in zip(some, cut, strict=True):
            cache[p] = data[start:end]
            start = end
    for (p, _), e in zip(other, own.encode_batch_fast([t for _, t in other], add_special_tokens=False), strict=True):
        cache[p] = _packed(e.ids)
    for w, (stem, tail) in zip(words, split, strict=True):
        if tail:
            cache[w] = cache[stem] + cache[tail]
        elif stem != w:
            cache[w] = cache[stem]


def tokens_of(path: str, texts: list[bytes]) -> list[bytes]:
    """Little-endian 32-bit ids of texts of some megabytes. The tokenizer drops white space and never joins over it, so words
    are encoded once each, those that are new in any of the texts together."""
    _, cache, _, marks = _tokenizer(path)
    cache.turn()
    out, waiting, new = [], [], set()

    def words(text: bytes) -> list[bytes]:
        low = text.lower()
        return (low if text.isascii() and not any(m in low for m in marks) else text).split()

    for k, text in enumerate(texts):
        own = words(text)
        try:
            out.append(b"".join([cache[w] for w in own]))
        except KeyError:
            new.update([w for w in own if w not in cache])
            waiting.append(k)
            out.append(b"")
    lacking = cache.lacking(new)
    for k in range(0, len(lacking), LEARN):
        _learn(path, lacking[k : k + LEARN])
    for k in waiting:  # split again: all texts' words at once would take ten times the texts' room
        out[k] = b"".join([cache[w] for w in words(texts[k])])
    return out


def token_bytes(path: str, text: bytes) -> bytes:
    """Little-endian 32-bit ids of a text."""
    return tokens_of(path, [text])[0]


def _cut(path: str, capacity: int, end_id: int, keep_ids: bool, known: int = HALF):
    step = 4 * capacity

    def run(batches):
        end = np.array([end_id], "<u4").tobytes()
        _tokenizer(path)[1].half = known
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            ids = batch.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], [], []]
            texts = binary_column(batch)
            for a, b in in_chunks(texts, TOGETHER):
                for doc, own in zip(ids[a:b], tokens_of(path, texts[a:b]), strict=True):
                    data = own + end
                    for k in range(0, len(data), step):
                        part = data[k : k + step]
                        for to, value in zip(rows, (doc, k // step, k // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                            to.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)][: 6 if keep_ids else 5], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5])

    return run


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, known: int = HALF) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian, if kept) of each piece of each document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_cut(tokenizer, capacity, end_id, keep_ids, known), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in one bin, number of such bins). counts[n] is the number of pieces of length n; index 0 is not used."""
    left = counts.astype(np.int64).copy()
    at = np.arange(capacity + 1)
    out = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        free = left.copy()
        held, gap = [top], capacity - top
        free[top] -= 1
        there = np.maximum.accumulate(np.where(free > 0, at, 0))
        while gap:
            best = int(there[gap])
            if not best:
                break
            n = min(int(free[best]), gap // best)
            held += [best] * n
            gap -= best * n
            free[best] -= n
            if not free[best]:
                there = np.maximum.accumulate(np.where(free > 0, at, 0))
        least = held[-1]
        if gap and least > 1 and len(held) > 1:
            wide = gap + least
            a = at[1:wide][free[1:wide] > 0]
            if len(a):
                b = there[wide - a].copy()
                same = (b == a) & (free[a] < 2)
                b[same] = there[a[same] - 1]
                total = np.where(b > 0, a + b, 0)
                k = int(total.argmax())
                if total[k] > least:
                    held[-1:] = sorted((int(a[k]), int(b[k])), reverse=True)
        sizes, times = np.unique(held, return_counts=True)
        n = int((left[sizes] // times).min())
        left[sizes] -= times * n
        out.append((held, n))


def _places(made: list[tuple[list[int], int]]):
    """Sorted keys (length and first rank) and, for each, pieces a bin, first bin, and where its offsets begin."""
    keys, per, bins, begin, offsets = [], [], [], [], []
    taken: dict[int, int] = {}
    base = 0
    for held, n in made:
        at, where = 0, {}
        for size in held:
            where.setdefault(size, []).append(at)
            at += size
        for size, own in where.items():
            keys.append((size << 44) | taken.get(size, 0))
            taken[size] = taken.get(size, 0) + n * len(own)
            per.append(len(own))
            bins.append(base)
            begin.append(len(offsets))
            offsets += own
        base += n
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    pick = lambda x: np.array(x, np.int64)[order]
    return pick(keys), pick(per), pick(bins), pick(begin), np.array(offsets, np.int64)


def _place(tables, rank_name: str):
    def run(batches):
        keys, per, bins, begin, offsets = tables.value
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", rank_name))
            k = np.searchsorted(keys, (size << 44) | rank, side="right") - 1
            nth = rank - (keys[k] & ((1 << 44) - 1))
            sequence, offset = bins[k] + nth // per[k], offsets[begin[k] + nth % per[k]]
            kept = [c for c in batch.schema.names if c != rank_name]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(parts: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of parts (length of 1 to capacity, any others) with sequence_id and offset, which replace columns so named.

    parts is read twice and must give the same rows each time; rows that are equal throughout are interchangeable. Nulls in
    other columns and other columns' names do not matter; an empty table gives an empty table.
    """
    spark = parts.sparkSession
    parts = parts.drop("sequence_id", "offset")
    (rank,) = fresh(parts, "_rank")
    got = parts.groupBy("length").count().toArrow()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[got.column("length").to_numpy()] = got.column("count").to_numpy()
    tables = spark.sparkContext.broadcast(_places(plan(counts, capacity)))  # bounded by capacity
    order = [F.col(c).asc_nulls_first() for c in parts.columns]
    salts = 1 + int(counts.sum()) // group
    salt = F.pmod(F.xxhash64(*[c for c in parts.columns if c != "length"]), F.lit(salts))
    ranked = numbered(parts, "length", order, rank, salts, salt)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.mapInArrow(_place(tables, rank), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, known: int = HALF) -> DataFrame:
    """Tokenises documents and packs their pieces: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Null and empty texts are the end id alone. Long texts are tokenised whole and cut only into pieces of `capacity`.
    Rows with equal or null doc_id are documents of their own. An empty table gives an empty table. Other columns are
    ignored. A sequence's ids are its pieces' ids joined by offset. `known` is how many words a worker remembers at least, some
    200 bytes each for up to twice as many; fewer cost time alone.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    return pack(scratch.save(pieces(docs, tokenizer, capacity=capacity, end_id=end_id, keep_ids=keep_ids, known=known), "pieces"), capacity=capacity)
