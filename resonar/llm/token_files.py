"""Token ids of documents in binary files of independent blocks, written and read by Spark as a data source.

A folder holds a frequency table, files, and a manifest that the driver writes last: files of lost or repeated attempts
are not in it and so do not exist to readers. A file is

    header    "RTOK", version, checksum of the table
    blocks    each: counts and checksums, the documents that start in it, checkpoints, words (see rans)
    index     place, size, first token, tokens and starting documents of each block
    footer    place, length and checksum of the index, "RTOK"

Integers are little-endian. Documents follow one another over blocks and files in the order of their ids; a reader's
partition is a run of blocks and gives the documents that start there, reading on into later blocks, and files, never
before. Files are reached through pyarrow's file systems, so any store that pyarrow knows will do.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import rans
from .common import Scratch, binary_column, in_chunks, with_rows
from .wordcache import WordCache

END_ID = 0
LANES, STEPS, EVERY = 32, 1024, 256
BLOCK = LANES * STEPS
#: Blocks encoded or decoded side by side.
TOGETHER = 64
#: Blocks of a reader's partition, and tokens of a file, roughly.
SPLIT, FILE_TOKENS = 256, 1 << 25
VERSION = 1
_HEADER = struct.Struct("<4sII")
_BLOCK = struct.Struct("<IIIIII")  # tokens, starting documents, checkpoints, words, checksum of ids, checksum of what follows
_FOOTER = struct.Struct("<QQI4s")
_INDEX = np.dtype([("at", "<u8"), ("size", "<u8"), ("first", "<u8"), ("tokens", "<u4"), ("docs", "<u4")])
#: A document that starts in a block: its id, whether it has one, its place in the block and its length.
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("at", "<u4"), ("tokens", "<u8")])


# ---- token ids
#: White space outside ASCII, and control characters that libraries take for white space or not.
_WIDE_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8d\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")
#: What texts with such white space hold.
_WIDE_SIGNS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe1\xa0", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"\xef\xbb")
#: White space that is more than one space or one line end between words.
_LOOSE_SIGNS = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c")
#: A word with the space before it, or white space that no word takes: the tokenizer never joins over their borders.
_CHUNKS = re.compile(rb" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
#: The tokenizer parts letters from these, where they follow.
_TAIL = b".,;:!?*%$#&|"
_IS_TAIL = np.isin(np.arange(256), list(_TAIL))
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Words in one call of the library, and words that a worker's caches keep at least.
_RUN, _HALF = 4096, 500_000
_loaded: dict[str, _Words] = {}


class _Words:
    """A tokenizer, and the ids of chunks of text already seen: words with the space before them, and white space."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = own = Tokenizer.from_file(path)
        how = json.loads(own.to_str())
        self.by_words = how["normalizer"] is None and how["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.marks = [x.content.encode() for x in own.get_added_tokens_decoder().values()]
        self.cache = WordCache(_HALF)
        self.opens = np.zeros(max(own.get_vocab().values()) + 1, bool)
        self.opens[[k for t, k in own.get_vocab().items() if t.startswith("\u0120")]] = True  # stands for a space

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        """A space begins a token wherever it follows a word, so that many words go into one text, whose ids are parted
        where a token begins with a space."""
        cache = self.cache
        bare, new = [], []
        for c in chunks:
            (bare if c[0] != 32 or len(c) == 1 or c[1:2].isspace() else new).append(c)
        cache.update(zip(bare, self.whole(bare), strict=True))
        for k in range(0, len(new), _RUN):
            some = new[k : k + _RUN]
            ids = np.array(self.own.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
            if len(cut) != len(some) + 1:
                raise ValueError("the tokenizer joins words over spaces")
            data = ids.tobytes()
            cache.update(zip(some, [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True))

    def _values(self, chunks: pa.Array) -> list[bytes]:
        """Ids of different chunks. Letters are parted from punctuation that ends a word, as the tokenizer does, so that
        fewer words are kept."""
        stems, tails, cache = chunks.to_numpy(zero_copy_only=False).tolist(), {}, self.cache
        edges, points = (np.frombuffer(x, t) for x, t in zip(chunks.buffers()[1:], (np.int64, np.uint8), strict=True))
        edges = edges[chunks.offset : chunks.offset + len(chunks) + 1]
        for k in np.flatnonzero(_IS_TAIL[points[edges[1:] - 1]] & (points[edges[:-1]] == 32)).tolist():
            stems[k], tail = _parted(stems[k])
            if tail:
                tails[k] = tail
        cache.turn()
        values = list(map(cache.get, stems))
        lost = [k for k, v in enumerate(values) if v is None]
        self._learn(cache.lacking([*(stems[k] for k in lost), *set(tails.values())]))
        for k in lost:
            values[k] = cache[stems[k]]
        for k, tail in tails.items():
            values[k] += cache[tail]
        return values

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts of some megabytes: each different chunk is looked up once, and new ones are learnt together."""
        out: list[bytes | None] = [None] * len(texts)
        signs, marks = _present(texts, _WIDE_SIGNS), _present(texts, self.marks)
        known = [k for k, t in enumerate(texts) if not (marks and any(m in t for m in marks)) and not (signs and any(x in t for x in signs) and _WIDE_SPACE.search(t))]
        if not self.by_words:
            known = []
        for k in set(range(len(texts))).difference(known):
            out[k] = self.whole([texts[k]])[0]
        data = b"".join([texts[k] for k in known])
        if not data:
            return [b"" if x is None else x for x in out]
        ends = np.cumsum([len(texts[k]) for k in known])
        number = _starts(data, [texts[k] for k in known], ends)
        edges = pa.py_buffer(np.append(number, len(data)).astype(np.int64))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(number), [None, edges, pa.py_buffer(data)]).dictionary_encode()
        values = self._values(chunks.dictionary)
        size = np.array(list(map(len, values)), np.int32) // 4
        first = np.cumsum(size, dtype=np.int32) - size
        which = chunks.indices.to_numpy()
        count = size[which]
        after = np.cumsum(count, dtype=np.int32)  # of a few megabytes' ids
        found = np.frombuffer(b"".join(values), "<u4")[np.repeat(first[which] - (after - count), count) + np.arange(after[-1], dtype=np.int32)].tobytes()
        # where each text's chunks end
        last = np.concatenate(([0], after))[np.searchsorted(number, ends)]
        at = 0
        for k, end in zip(known, (4 * last).tolist(), strict=True):
            out[k] = found[at:end]
            at = end
        return out


def _parted(chunk: bytes) -> tuple[bytes, bytes]:
    stem = chunk.rstrip(_TAIL)
    return (stem, chunk[len(stem) :]) if stem[-1] in _LETTERS else (chunk, b"")


def _present(texts: list[bytes], signs) -> list[bytes]:
    """Those of signs that some text holds."""
    whole = b"\x00".join(texts)
    points, seen = np.frombuffer(whole, np.uint8), np.zeros(256, np.int64)
    for k in range(0, len(points), 1 << 20):  # counting takes eight times the room
        seen += np.bincount(points[k : k + (1 << 20)], minlength=256)
    there = set(np.flatnonzero(seen).tolist())
    return [x for x in signs if there.issuperset(x) and x in whole]


def _starts(data: bytes, texts: list[bytes], ends: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that are joined: a word with the space before it is one, other white space another."""
    starts = [(ends - [len(t) for t in texts])[[len(t) > 0 for t in texts]]]
    signs = _present(texts, _LOOSE_SIGNS)
    loose = np.array([t[:1].isspace() or t[-1:].isspace() or bool(signs) and any(x in t for x in signs) for t in texts])
    points = np.frombuffer(data, np.uint8)
    space, line = np.flatnonzero(points == 32), np.flatnonzero(points == 10)
    if loose.any():
        space, line = (x[~loose[np.searchsorted(ends, x, side="right")]] for x in (space, line))
        for k in np.flatnonzero(loose):
            starts.append(ends[k] - len(texts[k]) + np.array([m.start() for m in _CHUNKS.finditer(texts[k])]))
    out = np.sort(np.concatenate([*starts, space, line, line + 1]), kind="stable")  # of runs in order
    out = out[out < len(data)]
    return out[np.diff(out, prepend=-1) > 0]


def _tokenizer(path: str) -> _Words:
    if path not in _loaded:
        _loaded[path] = _Words(path)
    return _loaded[path]


def vocabulary_size(path: str) -> int:
    return len(_tokenizer(path).opens)


def token_ids(path: str, text: bytes) -> bytes:
    """Little-endian 32-bit ids of a text, as the tokenizer gives them.

    A byte-level tokenizer splits before it merges, so words are encoded once each. Texts with an added token, or with
    white space on which libraries may differ, are given to the tokenizer whole.
    """
    return _tokenizer(path).ids([text])[0]


def tokenized(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, carry: tuple[str, ...] = (), kind: str = "<u4") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, 32-bit by default) of each document, the end id last, and the columns to carry."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    end = np.array([end_id], "<u4").tobytes()
    kinds = "doc_id long, " + "".join(f"`{c}` {base.schema[c].dataType.simpleString()}, " for c in carry) + "n_tokens long, ids binary"

    def run(batches):
        own = _tokenizer(tokenizer)
        for batch in batches:
            texts = binary_column(batch)
            for a, b in in_chunks(texts, 1 << 24):
                ids = [x + end for x in own.ids(texts[a:b])]
                kept = [c.slice(a, b - a) for c in (batch.column(0), *batch.columns[2:])]
                size = pa.array([len(x) // 4 for x in ids], pa.int64())
                if kind != "<u4":
                    ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([*kept, size, pa.array(ids, pa.binary())], names=["doc_id", *carry, "n_tokens", "ids"])

    return base.mapInArrow(run, kinds)


def _counted(size: int, kind: str):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = [x for x in batch.column(0).to_pylist() if x]
            for a, b in in_chunks(ids, 1 << 23):  # the counts are as long as the vocabulary
                total += np.bincount(np.frombuffer(b"".join(ids[a:b]), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return run


# ---- files
def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def _read_all(store: pafs.FileSystem, path: str) -> bytes:
    with store.open_input_file(path) as f:
        return f.read()


def _put(store: pafs.FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as f:
        f.write(data)


def _block_bytes(ids: np.ndarray, docs: np.ndarray, made) -> bytes:
    states, places, words = made
    body = docs.tobytes() + states.astype("<u8").tobytes() + places.astype("<u4").tobytes() + words.astype("<u4").tobytes()
    return _BLOCK.pack(len(ids), len(docs), len(places), len(words), zlib.crc32(ids.tobytes()), zlib.crc32(body)) + body


@dataclass
class _Block:
    tokens: int
    crc: int
    docs: np.ndarray
    states: np.ndarray
    places: np.ndarray
    words: np.ndarray

    @classmethod
    def parse(cls, data: bytes) -> _Block:
        tokens, n_docs, marks, n_words, crc, body_crc = _BLOCK.unpack_from(data)
        body = memoryview(data)[_BLOCK.size :]
        if zlib.crc32(body) != body_crc:
            raise ValueError("a block's bytes do not have its checksum")
        cut = np.cumsum([n_docs * _DOC.itemsize, marks * LANES * 8, marks * 4, n_words * 4])
        if cut[3] != len(body):
            raise ValueError("a block does not have its size")
        states = np.frombuffer(body[cut[0] : cut[1]], "<u8").reshape(marks, LANES)
        return cls(tokens, crc, np.frombuffer(body[: cut[0]], _DOC), states, np.frombuffer(body[cut[1] : cut[2]], "<u4"), np.frombuffer(body[cut[2] :], "<u4"))


def _decoded(table: rans.Table, blocks: list[_Block]) -> list[np.ndarray]:
    """Ids of blocks, from all their checkpoints side by side."""
    if not blocks:
        return []
    before = np.concatenate(([0], np.cumsum([len(b.words) for b in blocks])))
    marks = np.concatenate(([0], np.cumsum([len(b.places) for b in blocks])))
    states = np.concatenate([b.states for b in blocks])
    places = np.concatenate([b.places.astype(np.int64) + at for b, at in zip(blocks, before, strict=False)])
    ids = rans.decode(table, states, places, np.concatenate([b.words for b in blocks]), EVERY)
    out = []
    for k, b in enumerate(blocks):
        own = ids[marks[k] : marks[k + 1]].reshape(-1)[: b.tokens].astype("<u4")
        if zlib.crc32(own.tobytes()) != b.crc:
            raise ValueError("a block's ids do not have their checksum")
        out.append(own)
    return out


class _FileWriter:
    """Takes documents in order and writes whole blocks, many at once; at most TOGETHER blocks and one batch are held."""

    def __init__(self, out, table: rans.Table, table_crc: int):
        self.out, self.table = out, table
        self.ids: list[np.ndarray] = []
        self.held = self.tokens = self.n_docs = 0
        self.done = 0  # tokens in blocks written
        self.docs: list[tuple[int, int, int, int]] = []  # of which first, known, id, tokens
        self.index: list[tuple] = []
        self.at = out.write(_HEADER.pack(b"RTOK", VERSION, table_crc))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        own = ids.astype("<u4")
        self.docs.append((self.tokens, doc_id is not None, doc_id or 0, len(own)))
        self.ids.append(own)
        self.held += len(own)
        self.tokens += len(own)
        self.n_docs += 1
        if self.held >= TOGETHER * BLOCK:
            self._flush(self.held // BLOCK)

    def _flush(self, blocks: int) -> None:
        joined = np.concatenate(self.ids)
        for k in range(0, blocks, TOGETHER):
            n = min(TOGETHER, blocks - k)
            own = joined[k * BLOCK : (k + n) * BLOCK].reshape(n, STEPS, LANES)
            for b, made in zip(own, rans.encode(self.table, own, EVERY), strict=True):
                self._write(b.reshape(-1), made)
        self.ids = [joined[blocks * BLOCK :]]
        self.held = len(self.ids[0])

    def _write(self, ids: np.ndarray, made) -> None:
        end = self.done + len(ids)
        n = next((k for k, d in enumerate(self.docs) if d[0] >= end), len(self.docs))
        here = np.array([(i, known, first - self.done, size) for first, known, i, size in self.docs[:n]], _DOC)
        del self.docs[:n]
        data = _block_bytes(ids, here, made)
        self.index.append((self.at, len(data), self.done, len(ids), n))
        self.at += self.out.write(data)
        self.done = end

    def close(self) -> None:
        if self.held >= BLOCK:
            self._flush(self.held // BLOCK)
        if self.held:
            rest = np.concatenate(self.ids)
            steps = -(-len(rest) // LANES)
            common = int(self.table.freq.argmax())
            own = np.append(rest, np.full(steps * LANES - len(rest), common, np.uint32)).reshape(1, steps, LANES)
            self._write(rest, rans.encode(self.table, own, EVERY)[0])
        data = np.array(self.index, _INDEX).tobytes()
        self.out.write(data)
        self.out.write(_FOOTER.pack(self.at, len(self.index), zlib.crc32(data), b"RTOK"))


class TokenFile:
    """A file's blocks, read by index."""

    def __init__(self, folder: str, name: str, table_crc: int):
        store, root = _store(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        at, n, crc, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        head, version, own = _HEADER.unpack(self.file.read_at(_HEADER.size, 0))
        if magic != b"RTOK" or head != b"RTOK" or version != VERSION:
            raise ValueError(f"{name} is no token file")
        if own != table_crc:
            raise ValueError(f"{name} was written with another table")
        data = self.file.read_at(n * _INDEX.itemsize, at)
        if zlib.crc32(data) != crc:
            raise ValueError(f"the index of {name} is damaged")
        self.index = np.frombuffer(data, _INDEX)

    def block(self, k: int) -> _Block:
        return _Block.parse(self.file.read_at(int(self.index["size"][k]), int(self.index["at"][k])))


def _manifest(folder: str) -> dict:
    store, root = _store(folder)
    return json.loads(_read_all(store, f"{root}/manifest.json"))


def _table(folder: str) -> tuple[rans.Table, int]:
    store, root = _store(folder)
    data = _read_all(store, f"{root}/table.bin")
    return rans.Table.from_bytes(data), zlib.crc32(data)


@dataclass
class _Wrote(WriterCommitMessage):
    part: int
    name: str
    tokens: int
    docs: int
    blocks: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, kind: str):
        self.folder, self.kind = folder, kind

    def write(self, batches):
        part = TaskContext.get().partitionId()
        table, crc = _table(self.folder)
        store, root = _store(self.folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        out, own = None, None
        try:
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if own is None:
                        out = store.open_output_stream(f"{root}/{name}")
                        own = _FileWriter(out, table, crc)
                    own.add(doc, np.frombuffer(ids, self.kind))
            if own is None:
                return _Wrote(part, "", 0, 0, 0)
            own.close()
        finally:
            if out is not None:
                out.close()
        return _Wrote(part, name, own.tokens, own.n_docs, len(own.index))

    def commit(self, messages):
        store, root = _store(self.folder)
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.part):
            files.append({"name": m.name, "start": start, "tokens": m.tokens, "docs": m.docs, "blocks": m.blocks})
            start += m.tokens
        _put(store, f"{root}/manifest.json", json.dumps({"version": VERSION, "tokens": start, "files": files}).encode())

    def abort(self, messages):
        store, root = _store(self.folder)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/{m.name}")


@dataclass
class _Split(InputPartition):
    file: dict
    first: int
    stop: int
    crc: int


class _Reader(DataSourceReader):
    def __init__(self, folder: str, split: int):
        self.folder, self.split = folder, split

    def partitions(self):
        crc = _table(self.folder)[1]
        return [_Split(f, k, min(k + self.split, f["blocks"]), crc) for f in _manifest(self.folder)["files"] for k in range(0, f["blocks"], self.split)] or [_Split({}, 0, 0, crc)]

    def read(self, partition):
        if not partition.file:
            return
        table, _ = _table(self.folder)
        file = TokenFile(self.folder, partition.file["name"], partition.crc)
        k, rows, size = partition.first, [], 0
        open_docs: list[list] = []  # [id, start, tokens, ids so far]
        while k < len(file.index) and (k < partition.stop or open_docs):
            stop = min(k + TOGETHER, partition.stop if k < partition.stop else k + 1)
            some = [file.block(j) for j in range(k, stop)]
            for j, (block, ids) in enumerate(zip(some, _decoded(table, some), strict=True), k):
                if open_docs:
                    doc = open_docs[-1]
                    doc[3].append(ids[: doc[2] - sum(map(len, doc[3]))])
                if j < partition.stop:
                    base = partition.file["start"] + int(file.index["first"][j])
                    for doc_id, known, at, tokens in block.docs.tolist():
                        open_docs.append([doc_id if known else None, base + at, tokens, [ids[at : at + tokens]]])
                for doc_id, start, tokens, found in open_docs[:-1]:  # only the last can go on
                    rows.append((doc_id, start, tokens, found[0].tobytes() if len(found) == 1 else b"".join(x.tobytes() for x in found)))
                    size += 4 * tokens
                del open_docs[:-1]
                if open_docs and sum(map(len, open_docs[0][3])) == open_docs[0][2]:
                    doc_id, start, tokens, found = open_docs.pop()
                    rows.append((doc_id, start, tokens, b"".join(x.tobytes() for x in found)))
                    size += 4 * tokens
                if size > 1 << 24:
                    yield _batch(rows)
                    rows, size = [], 0
            k = stop
        if open_docs:
            raise ValueError(f"{partition.file['name']} ends within a document")
        if rows:
            yield _batch(rows)


_ROW = "doc_id long, start long, n_tokens long, ids binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "start", "n_tokens", "ids"])


class TokenSource(DataSource):
    """Reads and writes folders of token files: spark.read.format("token_files").load(folder)."""

    @classmethod
    def name(cls):
        return "token_files"

    def schema(self):
        return _ROW

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("ids", "<u4"))


# ---- the operator
def write_tokens(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> None:
    """Encodes documents and writes their ids to a new folder, in ascending order of doc_id, nulls first.

    Rows of one doc_id follow one another in the order of their place in the table. A null text is an empty one: the end id
    alone. Long texts go over as many blocks as they need. Columns other than doc_id and text are ignored. An empty table
    gives a folder without files. Files are ranges of (doc_id, place), so rows of one id may go over several files.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    given, row = with_rows(docs, scratch)
    size = max(vocabulary_size(tokenizer), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    ids = scratch.save(tokenized(given, tokenizer, end_id=end_id, carry=tuple(row), kind=kind), "ids", "zstd")
    found = ids.select("ids").mapInArrow(_counted(size, kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most the vocabulary
    counts = np.zeros(size, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    if not counts.any():
        counts[end_id] = 1
    store, root = _store(folder)
    if store.get_file_info(root).type != pafs.FileType.NotFound:
        raise ValueError(f"{folder} is there already")
    store.create_dir(root, recursive=True)
    _put(store, f"{root}/table.bin", rans.Table.of_counts(counts).to_bytes())
    spark.dataSource.register(TokenSource)
    by = [F.col("doc_id").asc_nulls_first(), *row]
    ranged = ids.repartitionByRange(1 + int(counts.sum()) // file_tokens, *by).sortWithinPartitions(*by)
    ranged.select("doc_id", "ids").write.format("token_files").option("ids", kind).mode("append").save(folder)
    scratch.drop(ids)


def read_tokens(spark: SparkSession, folder: str, *, split: int = SPLIT) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian 32-bit) of each document in a folder."""
    spark.dataSource.register(TokenSource)
    return spark.read.format("token_files").option("split", split).load(folder)


def tokens_at(folder: str, start: int, n: int) -> np.ndarray:
    """n ids from a place in the whole sequence of ids on, decoded from the nearest checkpoints."""
    table, crc = _table(folder)
    out = [np.zeros(0, "<u4")]
    for f in _manifest(folder)["files"]:
        low, high = max(start, f["start"]) - f["start"], min(start + n, f["start"] + f["tokens"]) - f["start"]
        if low >= high:
            continue
        file = TokenFile(folder, f["name"], crc)
        for k in range(low // BLOCK, (high - 1) // BLOCK + 1):
            block, first = file.block(k), k * BLOCK
            a, b = max(low - first, 0), min(high - first, block.tokens)
            marks = slice(a // (EVERY * LANES), (b - 1) // (EVERY * LANES) + 1)
            ids = rans.decode(table, block.states[marks], block.places[marks], block.words, EVERY).reshape(-1)
            out.append(ids[a - marks.start * EVERY * LANES : b - marks.start * EVERY * LANES])
    return np.concatenate(out)


def token_digests(docs: DataFrame, tokenizer: str, folder: str, **how) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from files written to a new folder and read back."""
    write_tokens(docs, tokenizer, folder, **how)
    return read_tokens(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
