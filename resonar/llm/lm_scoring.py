"""Language-model scores of documents: a unigram base, and a bitwise model of words mixed with what follows which word.

Word counts come from all training documents by aggregation. The bitwise model's low contexts are sums over all distinct
words and their counts; its context of the whole word so far is read off the sorted vocabulary, so it grows with it. Its
weights are learnt online over parts of the vocabulary that do not depend on the cluster's layout; a part is some pieces
of the sorted words, of bounded size, and is told what words beyond them count for. Each distinct word is scored once.

Across words, a hashed context of the previous word says how often the next one followed it in other documents. Its share
against the bitwise model is a gated weight, set by how often the previous word has been seen and how many of the last
words came as expected, and refined online within each document.

Documents are dealt into chunks. A chunk asks for its distinct words and pairs, in buckets by hash, and buckets answer, so
a word or pair travels once for each chunk however often it occurs, and nothing is broadcast that grows with the input.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bit_model import CUT, END, SLOTS, BitModel, Borders, summed
from .common import Scratch, binary_column, crc_of_id, mix64, word_hashes

#: Bytes of text in a chunk, distinct words in a part of the vocabulary, tokens for each bucket: sizes of tasks' work.
CHUNK_BYTES, PART_WORDS, BUCKET_TOKENS = 4 << 20, 100_000, 3 << 20
#: Distinct words that a task gathers before it hands them on.
GATHER = 200_000
#: Pieces of the sorted vocabulary in a part, words drawn for each piece's cut, and a word's bytes, roughly.
PIECES, DRAWN, WORD_BYTES = 4, 16, 12
LOG10_2 = math.log10(2)
#: Gates by how often the previous word was seen (a power of 4 each) and how many of the last words followed theirs.
SEEN_LEVELS, RUNS = 12, 4
#: A share's logit in each gate to begin with, how fast it learns, and tokens between steps.
FIRST = np.tile([-1.5, -0.5, 0.5, 1.5], SEEN_LEVELS)
RATE, TURN = 0.5, 32
_END_HASH = np.uint64(0xE220A8397B1DCDAF)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def _count(batches):
    """(word, n): occurrences in training documents; words of other documents count 0. The end of a text is a line break."""
    train: Counter = Counter()
    other: set = set()

    def out():
        words = list(train) + [w for w in other if w not in train]
        n = list(train.values()) + [0] * (len(words) - len(train))
        train.clear()
        other.clear()
        for k in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000], pa.binary()), pa.array(n[k : k + 50_000], pa.int64())], names=["word", "n"])

    for batch in batches:
        for held, text in zip(batch.column(0).to_pylist(), binary_column(batch), strict=True):
            words = text.lower().split()
            words.append(END)
            if held:
                other.update(words)
            else:
                train.update(words)
            if len(train) + len(other) > GATHER:
                yield from out()
    yield from out()


def _tables(shared):
    def run(batches):
        table = np.zeros(2 * SLOTS)
        for batch in batches:
            shared.value.count(batch.column(0).to_pylist(), batch.column(1).to_numpy(), table)
        where = np.flatnonzero(table)
        for k in range(0, len(where), 1 << 16):
            w = where[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(table[w])], names=["slot", "n"])

    return run


def _edges(shared):
    """How words share their first bits with the cuts beside them, as codes and counts."""

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            own = shared.value.edges(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            held = summed(*(np.concatenate(x) for x in zip(held, own, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["code", "n"])

    return run


def _deal(shared, parts: int):
    """Words with the number of their part: pieces are dealt in turn, so that a part has words of all the vocabulary."""

    def run(batches):
        for batch in batches:
            part = shared.value[1].pieces(batch.column(0).to_pylist()) % parts
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], names=["part", "word", "n"])

    return run


def _learn(shared):
    """The weights and map that one part of the vocabulary leads to, and how much they have seen."""

    def run(table: pa.Table) -> pa.Table:
        given, borders = shared.value
        model = BitModel()
        model.table = given.table
        words, n, seen = borders.in_order(table.column("word").to_pylist(), table.column("n").to_numpy())
        size = np.array([len(w) + 1 for w in words])
        start = np.cumsum(size) - size
        order = np.random.default_rng(len(words)).permutation(len(words))
        for k in range(0, len(order), 4096):
            some = order[k : k + 4096]
            own = np.repeat(start[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
            model.learn([words[j] for j in some], n[some], seen[:, own])
        return pa.table({"weight": pa.array([model.weight.tobytes()], pa.binary()), "map": pa.array([model.map.tobytes()], pa.binary()), "seen": pa.array([model.seen])})

    return run


_DEALT = "part int, word binary, n long"
_ASKED = "bucket int, kind int, chunk long, keys binary, counts binary"
#: Kinds of rows in a bucket: words with their counts and scores, words asked for, pairs asked for.
WORDS, ASK_WORDS, ASK_PAIRS = 0, 1, 2


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """In the order of keys."""
    return (((keys >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def _sliced(kind: int, chunk: int, buckets: int, keys: np.ndarray, values: list[np.ndarray]) -> list[tuple]:
    """One row for each bucket that sorted keys fall into."""
    edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
    return [(b, kind, chunk, keys[lo:hi].tobytes(), b"".join([v[lo:hi].tobytes() for v in values])) for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if hi > lo]


def _packed(x: np.ndarray) -> bytes:
    """Counts, most of them small, as a byte each; those of 255 and more follow in whole."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.int64).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.int64)
    return out


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(columns)], names=[c for c, _ in columns])


def _word_keys(words: list[bytes]) -> np.ndarray:
    """Hashes of words, of which the end of a text has its own."""
    keys, _ = word_hashes([b" ".join([w for w in words if w != END])])
    out = np.full(len(words), _END_HASH)
    out[[k for k, w in enumerate(words) if w != END]] = keys
    return out


def _score_words(shared, weight: np.ndarray, map_: np.ndarray, buckets: int):
    """The words of one part of the vocabulary with what they cost, for their buckets."""

    def run(table: pa.Table) -> pa.Table:
        given, borders = shared.value
        model = BitModel()
        model.table, model.weight, model.map = given.table, weight, map_
        words, n, seen = borders.in_order(table.column("word").to_pylist(), table.column("n").to_numpy())
        keys, cost = _word_keys(words), (-LOG10_2 * model.bits(words, seen)).astype(np.float64)
        order = np.argsort(keys)
        return pa.Table.from_batches([_rows(_sliced(WORDS, -1, buckets, keys[order], [n[order], cost[order]]), _ASKED)])

    return run


class Tokens:
    """Tokens of a chunk's documents, an end after each, and the pairs of each with the one before it."""

    def __init__(self, texts: list[bytes]):
        words, first = word_hashes(texts)
        many = np.diff(first)
        n = len(texts)
        self.size = many + 1
        self.start = np.cumsum(self.size) - self.size
        self.doc = np.repeat(np.arange(n), self.size)
        self.key = np.full(len(words) + n, _END_HASH)
        self.key[np.arange(len(words)) + np.repeat(np.arange(n), many)] = words
        before = np.concatenate(([_END_HASH], self.key[:-1]))
        self.words, self.word = np.unique(self.key, return_inverse=True)
        self.pairs, self.pair = np.unique(mix64(before * _PAIR + self.key), return_inverse=True)
        end = np.searchsorted(self.words, _END_HASH)
        self.before = np.concatenate(([end], self.word[:-1]))

    def own(self, what: np.ndarray, n: int) -> np.ndarray:
        """How often what each token has occurs in its document."""
        _, back, times = np.unique(self.doc * n + what, return_inverse=True, return_counts=True)
        return times[back]


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]


def _ask(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        tokens = Tokens(_texts(table))
        chunk = table.column("chunk")[0].as_py()
        train = ~table.column("held_out").to_numpy()[tokens.doc]
        times = np.bincount(tokens.pair, train, len(tokens.pairs)).astype(np.int64)
        rows = _sliced(ASK_WORDS, chunk, buckets, tokens.words, [])
        # within a bucket the lower half of a hash tells pairs apart
        for b, kind, own, keys, counts in _sliced(ASK_PAIRS, chunk, buckets, tokens.pairs, [times]):
            rows.append((b, kind, own, np.frombuffer(keys, np.uint64).astype(np.uint32).tobytes(), _packed(np.frombuffer(counts, np.int64))))
        return pa.Table.from_batches([_rows(rows, _ASKED)])

    return run


_ANSWER = "chunk long, kind int, bucket int, n long, answer binary"


def _answers(rows: list[tuple]):
    """(chunk, kind, bucket, number of values, values) for all that one bucket is asked."""
    known = [(np.frombuffer(keys, np.uint64), np.frombuffer(values[: len(keys)], np.int64), np.frombuffer(values[len(keys) :])) for _, kind, _, keys, values in rows if kind == WORDS]
    key, n, cost = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(key)
    key, n, cost = key[order], n[order], cost[order]
    for bucket, kind, chunk, keys, _ in rows:
        if kind == ASK_WORDS:
            want = np.frombuffer(keys, np.uint64)
            at = np.searchsorted(key, want)
            if (key[at] != want).any():
                raise ValueError("a word is not in the vocabulary: the table changed between scans")
            yield chunk, kind, bucket, len(want), cost[at].astype(np.float32).tobytes() + _packed(n[at])
    asked = [r for r in rows if r[1] == ASK_PAIRS]
    if asked:
        pairs = np.concatenate([np.frombuffer(r[3], np.uint32) for r in asked])
        times = np.concatenate([_unpacked(r[4], len(r[3]) // 4) for r in asked])
        _, back = np.unique(pairs, return_inverse=True)
        total = np.bincount(back, times).astype(np.int64)
        at = 0
        for bucket, kind, chunk, keys, _ in asked:
            n_own = len(keys) // 4
            yield chunk, kind, bucket, n_own, _packed(total[back[at : at + n_own]])
            at += n_own


def _answer(batches):
    held: list[tuple] = []

    def out():
        for row in _answers(held):
            yield _rows([row], _ANSWER)

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if held and row[0] != held[0][0]:
                yield from out()
                held = []
            held.append(row)
    if held:
        yield from out()


def mixed(word: np.ndarray, seen: np.ndarray, together: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log10 probability of each document.

    Of each token: word, its log10 probability by itself; seen, how often the token before it was seen in other documents;
    together, how often the two were. Documents are start : start + size. The share of together / seen is the logistic of
    a weight that the gate picks; after every TURN tokens of a document its weights move along the gradient.
    """
    alone = 10.0 ** np.maximum(word, -300)
    after = np.where(seen > 0, together / np.maximum(seen, 1), 0)
    came = (together > 0).astype(np.int64)
    run = np.zeros(len(word), np.int64)
    streak = np.ones(len(word), np.int64)
    place = np.arange(len(word)) - np.repeat(start, size)
    for back in range(1, RUNS):
        streak[back:] *= came[:-back] if back < len(came) else 0
        streak[place < back] = 0
        run += streak
    level = np.minimum(np.log2(seen + 1) / 2, SEEN_LEVELS - 1).astype(np.int64)
    gate = level * RUNS + run
    out = np.zeros(len(start))
    gates = SEEN_LEVELS * RUNS
    weight = np.tile(FIRST, (len(start), 1))
    order = np.argsort(-size, kind="stable")
    for turn in range(0, int(size.max(initial=0)), TURN):
        docs = order[: np.searchsorted(-size[order], -turn)]  # those longer than turn
        n = np.minimum(TURN, size[docs] - turn)
        doc = np.repeat(np.arange(len(docs)), n)
        at = np.repeat(start[docs] + turn - np.cumsum(n) + n, n) + np.arange(n.sum())
        own, g = docs[doc], gate[at]
        share = np.where(seen[at] > 0, 1 / (1 + np.exp(-weight[own, g])), 0)
        p = share * after[at] + (1 - share) * alone[at]
        out[docs] += np.bincount(doc, np.log10(np.maximum(p, 1e-300)), len(docs))
        slope = share * (1 - share) * (after[at] - alone[at]) / np.maximum(p, 1e-300)
        weight[docs] += RATE * np.bincount(doc * gates + g, slope, len(docs) * gates).reshape(-1, gates)
    return out


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long"


def _score(left: pa.Table, right: pa.Table) -> pa.Table:
    """Scores of a chunk's documents, from what buckets have answered."""
    texts = _texts(left)
    names = [c.split()[0] for c in _SCORED.split(", ")]
    if not texts:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], names=names)
    tokens = Tokens(texts)
    n, cost, together = [], [], []
    for kind, _, many, answer in sorted(zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "n", "answer")), strict=True)):
        if kind == ASK_WORDS:
            cost.append(np.frombuffer(answer[: 4 * many], np.float32))
            n.append(_unpacked(answer[4 * many :], many))
        else:
            together.append(_unpacked(answer, many))
    n, cost, together = (np.concatenate(x) for x in (n, cost, together))
    if len(n) != len(tokens.words) or len(together) != len(tokens.pairs):
        raise ValueError("a chunk's answers are not those to its questions: the table changed between scans")
    count = n[tokens.word]
    held = left.column("held_out").to_numpy()
    train = ~held[tokens.doc]
    # what a document itself has taught is left out of what it is told
    seen = n[tokens.before] - train * tokens.own(tokens.before, len(tokens.words))
    pairs = together[tokens.pair].astype(np.float64) - train * tokens.own(tokens.pair, len(tokens.pairs))
    score = mixed(cost[tokens.word].astype(np.float64), np.maximum(seen, 0).astype(np.float64), np.maximum(pairs, 0), tokens.start, tokens.size)
    total = lambda x: np.add.reduceat(x, tokens.start)
    return pa.table([left.column("doc_id"), left.column("held_out"), pa.array(tokens.size), pa.array(total((count > 0).astype(np.int64))), pa.array(total(np.log10(count + 1.0))), pa.array(score), pa.array([len(t) for t in texts], pa.int64())], names=names)


def _borders(vocabulary: DataFrame, known: DataFrame, part_words: int) -> Borders:
    """Cuts of the sorted vocabulary into pieces of about as many bytes, however many words begin alike, and their edges.

    Words are drawn by hash, longer ones more often, and each DRAWN-th in order is a cut, so cuts depend on the words alone.
    What comes to the driver are the first CUT bytes of one word in some 20 kilobytes of vocabulary, and of each cut as
    many counts as words beside it share bits with it. Words that are alike in their first CUT bytes share a piece.
    """
    spark = vocabulary.sparkSession
    step = max(1, part_words * WORD_BYTES // (PIECES * DRAWN))
    key = F.concat("word", F.lit(b" "))
    drawn = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(step)) < F.octet_length("word") + 1).select(F.substring(key, 1, CUT).alias("key"))
    borders = Borders(sorted(set(sorted(bytes(k) for k in drawn.toArrow().column("key").to_pylist())[DRAWN::DRAWN])))
    if borders.cuts:
        shared = spark.sparkContext.broadcast(borders)
        edges = known.mapInArrow(_edges(shared), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        borders.set_edges(edges.column("code").to_numpy(), edges.column("n").to_numpy())
        shared.unpersist()
    return borders


def score_documents(docs: DataFrame, *, modulus: int = 7, held_out: int = 2, chunk_bytes: int = CHUNK_BYTES, part_words: int = PART_WORDS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each document.

    Documents whose crc32(doc_id) modulo `modulus` is `held_out` teach nothing. base_score is the add-one unigram log10
    probability, score the model's; both cover all words and one end. What follows which word is told to a training
    document without its own occurrences. bits_per_byte divides the model's bits by the text's bytes and one. Null and
    empty texts are an end alone. Long texts and words are read whole. Rows with equal or null doc_id stay rows of their
    own, and equal rows score alike; other columns, of any name, are ignored; an empty table gives an empty table; without
    training documents every count is 0. docs is read several times and must give the same rows each time.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id() % modulus == held_out).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = int(base.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0)
    base = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // chunk_bytes)))
    found = base.select("held_out", "text").mapInArrow(_count, "word binary, n long")
    vocabulary = scratch.save(found.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    sums = vocabulary.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    n, v = int(sums[0] or 0), int(sums[1] or 0)
    known = vocabulary.where("n > 0")
    borders = _borders(vocabulary, known, part_words)
    model = BitModel()
    shared = spark.sparkContext.broadcast(model)
    # at most SLOTS slots
    sent = known.mapInArrow(_tables(shared), "slot int, n double").groupBy("slot").agg(F.sum("n").cast("float").alias("n")).toArrow()
    joint = np.zeros(2 * SLOTS)
    joint[sent.column("slot").to_numpy()] = sent.column("n").to_numpy()
    model.set_tables(joint)
    del sent, joint
    shared.unpersist()
    shared = spark.sparkContext.broadcast((model, borders))
    dealt = _deal(shared, len(borders.cuts) // PIECES + 1)
    learnt = known.mapInArrow(dealt, _DEALT).groupBy("part").applyInArrow(_learn(shared), "weight binary, map binary, seen double").toArrow().to_pylist()
    if total := sum(p["seen"] for p in learnt):
        learnt.sort(key=lambda p: (p["seen"], p["weight"]))  # sums do not depend on which task was first
        mean = lambda c, like: sum(p["seen"] * np.frombuffer(p[c]) for p in learnt).reshape(like.shape) / total
        model.weight, model.map = mean("weight", model.weight), mean("map", model.map)
    buckets = 1 + size // 6 // bucket_tokens
    scored = vocabulary.mapInArrow(dealt, _DEALT).groupBy("part").applyInArrow(_score_words(shared, model.weight, model.map, buckets), _ASKED)
    scored = scratch.save(scored, "scored")
    asked = base.groupBy("chunk").applyInArrow(_ask(buckets), _ASKED)
    answers = asked.union(scored).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer, _ANSWER)
    out = base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score, _SCORED)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        "score",
        (F.col("score") / (-LOG10_2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
