"""SentencePiece encoding by an agenda of adjacent symbol pairs, for merge-type vocabularies.

A text's symbols begin as its characters. The agenda holds pairs of neighbours whose joined form is in the vocabulary;
the pair of best score, leftmost among equals, is merged first, until the agenda is empty. What is not in the
vocabulary becomes bytes. No vocabulary piece has a space mark behind another character, nor a line break, so texts
fall apart into chunks there, and each worker encodes a chunk once. Short chunks of one length are merged together: a
row of a matrix is the agenda of one chunk, and each step takes the best pair of every row. Long chunks have a heap.
All new chunks of an Arrow batch are checked against the sentencepiece library, whose ids hold where the two should
differ.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks
from .wordcache import WordCache

SPACE = "▁"
_CHUNK = re.compile("[ ▁]+[^ ▁\n]*|[^ ▁\n]+|\n")
#: Longest chunk whose agenda is a row of a matrix, and rows of a matrix.
SHORT, ROWS = 32, 8192
#: Chunks that a worker's cache keeps at least; texts, in characters, that are encoded together.
HALF, TOGETHER = 400_000, 1 << 22
_NONE = np.int32(1 << 30)
_loaded: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Encodes with a merge-type model whose normaliser is the identity with a space mark before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [k for k in range(n) if not (lib.is_control(k) or lib.is_unknown(k) or lib.is_byte(k) or lib.is_unused(k))]
        self.id_of = {lib.id_to_piece(k): k for k in plain}
        # pieces of one score share a rank, so that of equal pairs the leftmost is first; single characters are never joined
        whole = [p for p in self.id_of if len(p) > 1]
        order = {x: r for r, x in enumerate(sorted({-lib.get_score(self.id_of[p]) for p in whole}))}
        self.rank = {p: order[-lib.get_score(self.id_of[p])] for p in whole}
        self.byte_of = {int(lib.id_to_piece(k)[3:5], 16): k for k in range(n) if lib.is_byte(k)}
        self.decimal = list(map(str, range(n)))
        self.end = lib.eos_id()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id_of) or len(self.byte_of) != 256:
            raise ValueError("the vocabulary joins over spaces or line breaks, or has no bytes to fall back on")
        self._pairs()
        # a rank names its piece only where no two pieces have one score, so chunks that hold such pieces have a heap
        shared = Counter(self.rank.values())
        tied = [p for p in whole if shared[self.rank[p]] > 1]
        self.tied = [p for p in tied if not any(q != p and q in p for q in tied)]
        self.short = SHORT if len(self.tied) <= 8 else 0
        self.cache = WordCache(HALF)
        self.corrected = 0

    def _pairs(self) -> None:
        """The table of pairs that the vocabulary joins, by the numbers of both symbols, and the rank of what they join to.

        Numbers are ids; single characters outside the vocabulary join with nothing and have none.
        """
        id_of = self.id_of
        rows = [(id_of[a], id_of[b], self.rank[p]) for p in self.rank for cut in range(1, len(p)) if (a := p[:cut]) in id_of and (b := p[cut:]) in id_of]
        left, right, rank = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        key = (left << 32) | right
        order = np.argsort(key)
        self.pair_key, self.pair_rank = np.append(key[order], np.int64(-1)), np.append(rank[order], _NONE).astype(np.int32)
        self.by_rank = np.zeros(len(id_of) + 1, np.int32)
        self.by_rank[list(self.rank.values())] = list(map(id_of.get, self.rank))
        single = [c for c in id_of if len(c) == 1]
        self.letters = np.full(0x110000, -1, np.int32)
        self.letters[[ord(c) for c in single]] = [id_of[c] for c in single]
        #: A filter in front of the search: most pairs of symbols join to nothing.
        self.may = np.zeros(1 << 22, bool)
        self.may[self._spot(key)] = True

    @staticmethod
    def _spot(key):
        return ((key * np.int64(0x5851F42D4C957F2D)) >> np.int64(40)) & np.int64((1 << 22) - 1)

    def _joined(self, left, right):
        """Ranks of what neighbours join to; _NONE where they do not."""
        out = np.full(len(left), _NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        may = np.flatnonzero(self.may[self._spot(key)] & (left >= 0) & (right >= 0))
        some = key[may]
        at = np.searchsorted(self.pair_key[:-1], some)
        out[may] = np.where(self.pair_key[at] == some, self.pair_rank[at], _NONE)
        return out

    def _merge_rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols, and which places still begin one, of chunks of one length, given as rows of code points."""
        n, width = codes.shape
        symbol = self.letters[codes]
        alive = np.ones((n, width), bool)
        agenda = np.full((n, width), _NONE, np.int32)
        agenda[:, :-1] = self._joined(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width - 1)
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        row = np.arange(n)
        while True:
            k = agenda[row].argmin(axis=1) if len(row) < n else agenda.argmin(axis=1)
            best = agenda[row, k]
            going = best < _NONE
            row, k, best = row[going], k[going], best[going]
            if not len(row):
                return symbol, alive
            j = after[row, k]
            symbol[row, k] = self.by_rank[best]
            alive[row, j] = False
            agenda[row, j] = agenda[row, k] = _NONE
            j = after[row, k] = after[row, j]
            i = before[row, k]
            inner = j < width
            r, at, to = row[inner], k[inner], j[inner]
            before[r, to] = at
            outer = i >= 0
            r, at, to = np.concatenate((r, row[outer])), np.concatenate((at, i[outer])), np.concatenate((to, k[outer]))
            agenda[r, at] = self._joined(symbol[r, at], symbol[r, to])

    def _merge_all(self, chunks: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk."""
        out: list[bytes] = [b""] * len(chunks)
        by_length: dict[int, list[int]] = {}
        for k, c in enumerate(chunks):
            if len(c) > self.short or any(p in c for p in self.tied):
                out[k] = np.array(self.merge(c), "<i4").tobytes()
            else:
                by_length.setdefault(len(c), []).append(k)
        for width, own in by_length.items():
            for start in range(0, len(own), ROWS):
                some = own[start : start + ROWS]
                codes = np.frombuffer("".join([chunks[k] for k in some]).encode("utf-32-le"), np.uint32).reshape(len(some), width)
                symbol, alive = self._merge_rows(codes)
                strange = (symbol < 0).any(axis=1)
                data, ends = symbol[alive].astype("<i4").tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()
                begin = 0
                for k, end, odd in zip(some, ends, strange.tolist(), strict=True):
                    out[k] = np.array(self.merge(chunks[k]), "<i4").tobytes() if odd else data[begin:end]
                    begin = end
        return out

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk, in which spaces are marks, by the agenda."""
        rank, id_of = self.rank, self.id_of
        if chunk in id_of and len(chunk) == 1:
            return [id_of[chunk]]
        symbols = list(chunk)
        n = len(symbols)
        agenda = [(r, k, 2) for k in range(n - 1) if (r := rank.get(symbols[k] + symbols[k + 1])) is not None]
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                _, k, size = heapq.heappop(agenda)
                left = symbols[k]
                j = after[k]
                if not left or j >= n or len(left) + len(symbols[j]) != size:
                    continue
                symbols[k] = left = left + symbols[j]
                symbols[j] = ""
                after[k] = j = after[j]
                if j < n:
                    before[j] = k
                    if (r := rank.get(left + symbols[j])) is not None:
                        heapq.heappush(agenda, (r, k, size + len(symbols[j])))
                if (i := before[k]) >= 0 and (r := rank.get(symbols[i] + left)) is not None:
                    heapq.heappush(agenda, (r, i, size + len(symbols[i])))
        out = []
        for s in symbols:
            if s:
                if (k := id_of.get(s)) is not None:
                    out.append(k)
                else:
                    out.extend([self.byte_of[b] for b in s.encode()])
        return out

    def _by_library(self, chunks: list[str]) -> list[bytes]:
        """The library's ids of each chunk. It puts a mark before each text, so a chunk without one is held behind a line break."""
        bare = [c[0] == SPACE and len(c) > 1 for c in chunks]
        texts = [c[1:] if b else f"\n{c}" for b, c in zip(bare, chunks, strict=True)]
        skip = [0 if b else 2 for b in bare]
        return [np.array(ids[k:], "<i4").tobytes() for ids, k in zip(self.library.encode(texts, num_threads=1), skip, strict=True)]

    def _checked(self, chunks: list[str], own: list[bytes]) -> list[bytes]:
        """own, or the library's ids where they differ. Chunks with a mark are checked many at a time, as one text."""
        out = list(own)
        marked = [k for k, c in enumerate(chunks) if c[0] == SPACE]
        apart = [k for k, c in enumerate(chunks) if c[0] != SPACE]
        runs = [marked[k : k + 1024] for k in range(0, len(marked), 1024)]
        for some, ids in zip(runs, self.library.encode(["".join([chunks[k] for k in run])[1:] for run in runs], num_threads=1), strict=True):
            if np.array(ids, "<i4").tobytes() != b"".join([own[k] for k in some]):
                apart += some
        for k, theirs in zip(apart, self._by_library([chunks[k] for k in apart]), strict=True):
            if out[k] != theirs:
                self.corrected += 1
                out[k] = theirs
        return out

    def learn(self, chunks: list[str]) -> None:
        marked = [c.replace(" ", SPACE) for c in chunks]
        self.cache.update(zip(chunks, self._checked(marked, self._merge_all(marked)), strict=True))

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(f" {text}") if text else []

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text the 32-bit ids of its chunks, without the end id."""
        out = []
        for start, stop in in_chunks(texts, TOGETHER):
            self.cache.turn()
            split = [self.chunks(t) for t in texts[start:stop]]
            if lacking := self.cache.lacking(c for own in split for c in own):
                self.learn(lacking)
            cache = self.cache
            out += [b"".join([cache[c] for c in own]) for own in split]
        return out

    def ids(self, text: str) -> list[int]:
        """All ids of one text, the end id last."""
        (data,) = self.encode_batch([text])
        return [*np.frombuffer(data, "<i4").tolist(), self.end]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a model file."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def _texts(batch: pa.RecordBatch, k: int) -> list[str]:
    return [t or "" for t in batch.column(k).to_pylist()]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _digests(path: str):
    def run(batches):
        own = encoder(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                before = own.corrected
                count, ids_sha, text_sha = [], [], []
                for data in own.encode_batch(_texts(batch, 1)):
                    ids = [*np.frombuffer(data, "<i4").tolist(), own.end]
                    count.append(len(ids))
                    ids_sha.append(_sha(" ".join(map(own.decimal.__getitem__, ids))))
                    text_sha.append(_sha(own.decode(ids)))
                fixed = [own.corrected - before] + [0] * (batch.num_rows - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(fixed, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"])

    return run


def _encoded(path: str):
    def run(batches):
        own = encoder(path)
        for batch in batches:
            ids = [[*np.frombuffer(data, "<i4").tolist(), own.end] for data in own.encode_batch(_texts(batch, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids array<int> of each document; null and empty texts are the end id alone. An empty table gives an empty table."""
    return _base(docs).mapInArrow(_encoded(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the text that ids stand for; null ids give an empty text. An empty table gives an empty table."""

    def run(batches):
        own = encoder(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, ids first encoded and then decoded.

    Null and empty texts are the end id alone. Whole texts are encoded, however long; chunks without a space are merged
    in n log n steps. Rows with equal or null doc_id stay rows of their own; other columns are ignored. An empty table
    gives an empty table. n_corrected
    counts, on the first row of each Arrow batch, chunks for which the library's ids replaced the agenda's: 0 throughout
    unless the two differ.
    """
    return _base(docs).mapInArrow(_digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long")
