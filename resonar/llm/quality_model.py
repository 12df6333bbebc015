"""Quality classifier: a factorisation machine over hashed words and structure statistics of a text.

A text's features are its distinct words, hashed, and one bin of each structure statistic. The model adds a weight for
each feature and the inner product of latent vectors for each pair; by the sum-of-squares identity all pairs cost as
much as the features themselves. Length is the only metadata used: labels, language, source and id are no inputs.

All labelled documents are learnt from. They are dealt into groups by hash; each group is fitted from the same start, and
each number of the model is the mean over the groups that have moved it.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary_column, crc_of_id, fresh

WORD_BITS, LATENT = 16, 8
BINS = 16
#: Labelled documents that one task learns from, roughly; models are summed in steps of 1 / FINE.
GROUP, FINE = 8000, 1 << 32
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 64, 0.06, 2e-6, 5

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&|<>@^~=+_{}[]\\"
_STOP = b".,;:?"
_LETTER = bytes(range(ord("a"), ord("z") + 1)) + _UPPER


def _share(part: int, whole: int) -> int:
    """A bin of 0 to 15 for a share, finer near nothing."""
    return min(BINS - 1, int(4 * math.sqrt(max(part, 0) / whole) * 4)) if whole > 0 and part > 0 else 0


def statistics(text: bytes, words: list[bytes], distinct: int) -> list[int]:
    """One bin for each structure statistic."""
    n, size = len(words), len(text)
    without = lambda chars: size - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip()]
    in_words = sum(map(len, words))
    return [
        min(BINS - 1, size.bit_length()),
        min(BINS - 1, n.bit_length()),
        min(BINS - 1, round(2 * in_words / n)) if n else 0,
        _share(without(_UPPER), size),
        _share(without(_DIGIT), size),
        _share(without(_SYMBOL), size),
        _share(text.count(b"!"), max(n, 1)),
        _share(text.count(b"|"), max(n, 1)),
        _share(without(_STOP), max(n, 1)),
        _share(size - len(text.translate(None, _LETTER)), size),
        min(BINS - 1, int(4 * math.log2(1 + n / len(lines)))) if lines else 0,
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(n - distinct, n),
    ]


N_STATISTICS = 13
SIZE = (1 << WORD_BITS) + N_STATISTICS * BINS


def features(text: bytes) -> tuple[np.ndarray, int]:
    """Feature numbers of a text, words first, and how many are words."""
    words = text.lower().split()
    own = set(words)
    hashed = np.fromiter(map(crc32, own), np.int64, len(own)) & ((1 << WORD_BITS) - 1)
    hashed.sort()  # a set's order differs between processes
    stats = np.array(statistics(text, words, len(own)), np.int64) + (1 << WORD_BITS) + BINS * np.arange(N_STATISTICS)
    return np.concatenate((hashed, stats)), len(own)


def _values(n_words: int) -> np.ndarray:
    """Words weigh one together, as do statistics."""
    return np.concatenate((np.full(n_words, 1 / math.sqrt(max(n_words, 1))), np.full(N_STATISTICS, 1 / math.sqrt(N_STATISTICS))))


class FactorisationMachine:
    def __init__(self, bias: float, weight: np.ndarray, latent: np.ndarray):
        self.bias, self.weight, self.latent = bias, weight, latent
        self.square = (latent.astype(np.float64) ** 2).sum(axis=1)

    def logit(self, found: np.ndarray, n_words: int) -> float:
        x = _values(n_words)
        pooled = x @ self.latent[found]
        return float(self.bias + self.weight[found] @ x + 0.5 * (pooled @ pooled - self.square[found] @ (x * x)))

    def score(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.logit(*features(text))))))


def _latent(seed: int) -> tuple[np.random.Generator, np.ndarray]:
    """Latent vectors before any row, and the generator that goes on from them."""
    rng = np.random.default_rng(seed)
    return rng, rng.normal(0, 0.05, (SIZE, LATENT))


def fit(rows: list[tuple[np.ndarray, int, int]], seed: int = SEED) -> FactorisationMachine:
    """Logistic loss, AdaGrad, mini-batches in a seeded order. rows: (features, words, label). Without rows all scores are 0.5."""
    rng, latent = _latent(seed)
    weight = np.zeros(SIZE)
    grown_w, grown_v = np.full(SIZE, 1e-4), np.full(SIZE, 1e-4)
    bias, grown_b = 0.0, 1e-4
    if not rows:
        return FactorisationMachine(0.0, weight, np.zeros((SIZE, LATENT)))
    order = np.arange(len(rows))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for k in range(0, len(order), BATCH):
            some = [rows[j] for j in order[k : k + BATCH]]
            at = np.concatenate([r[0] for r in some])
            x = np.concatenate([_values(r[1]) for r in some])
            size = np.array([len(r[0]) for r in some])
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            y = np.array([r[2] for r in some], float)
            v = latent[at]
            vx = v * x[:, None]
            pooled = np.add.reduceat(vx, start)
            z = bias + np.add.reduceat(weight[at] * x, start) + 0.5 * ((pooled**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), start))
            slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(some)
            each = np.repeat(slope, size) * x
            unique, back = np.unique(at, return_inverse=True)
            gw = np.bincount(back, each, len(unique)) + DECAY * weight[unique]
            full = each[:, None] * (np.repeat(pooled, size, axis=0) - vx)
            gv = np.stack([np.bincount(back, full[:, f], len(unique)) for f in range(LATENT)], axis=1) + DECAY * latent[unique]
            grown_w[unique] += gw**2
            grown_v[unique] += (gv**2).mean(axis=1)
            weight[unique] -= RATE * gw / np.sqrt(grown_w[unique])
            latent[unique] -= RATE * gv / np.sqrt(grown_v[unique])[:, None]
            grown_b += slope.sum() ** 2
            bias -= RATE * slope.sum() / math.sqrt(grown_b)
    return FactorisationMachine(bias, weight, latent)


def _featurise(batches):
    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            batch = whole.slice(k, 512)
            found = [features(t) for t in binary_column(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array([f.astype("<i4").tobytes() for f, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int32())], names=["doc_id", "found", "n_words"])


def _moved(seed: int):
    """How far one group moves each number of the model: bias, weights, latent vectors. Whole numbers, so that sums do not
    depend on which task was first."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("found", "n_words", "quality")), strict=True))
        model = fit([(np.frombuffer(f, "<i4"), n, q) for f, n, q in rows], seed)
        far = np.concatenate(([model.bias], model.weight, (model.latent - _latent(seed)[1]).ravel()))
        place = np.flatnonzero(far)
        return pa.table({"place": pa.array(place.astype(np.int32)), "value": pa.array(np.rint(far[place] * FINE).astype(np.int64))})

    return run


def train(docs: DataFrame, labels: DataFrame, *, group: int = GROUP, seed: int = SEED) -> FactorisationMachine:
    """Fits on all labelled documents that are not held out (crc32 of doc_id modulo 3 of 1), in groups of about `group`.

    Of repeated labels of one doc_id the smallest holds; null ids and labels are left out. Rows of one doc_id are each
    fitted, those with the same features once. Groups follow from ids and features, not from the table's layout. What
    comes to the driver is one model, whatever the table's size. Empty tables give a model that scores 0.5.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    taught = crc_of_id() % 3 != 1
    label = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(taught).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(taught)
    # features first, so that texts stay where they are
    found = text.mapInArrow(_featurise, "doc_id long, found binary, n_words int").join(label, "doc_id")
    found = scratch.save(found.distinct(), "found", "zstd")
    groups = 1 + found.count() // group
    dealt = found.withColumn("deal", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "found"), F.lit(groups)))
    parts = dealt.groupBy("deal").applyInArrow(_moved(seed), "place int, value long")
    got = parts.groupBy("place").agg(F.sum("value").alias("value"), F.count("*").alias("n")).toArrow()  # one model
    scratch.drop(found)
    if not got.num_rows:
        return fit([], seed)
    far = np.zeros(1 + SIZE * (1 + LATENT))
    far[got.column("place").to_numpy()] = got.column("value").to_numpy() / got.column("n").to_numpy() / FINE
    return FactorisationMachine(float(far[0]), far[1 : 1 + SIZE], _latent(seed)[1] + far[1 + SIZE :].reshape(SIZE, LATENT))


def _score(model, name: str):
    def run(batches):
        own = model.value
        for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            got = [own.score(t) for t in binary_column(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: FactorisationMachine, name: str = "score") -> DataFrame:
    """docs and a column `name`, the probability of label 1, which replaces one so named. Null texts count as empty; whole
    texts are read."""
    docs = docs.drop(name)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), name), f"{kinds}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, *, group: int = GROUP) -> DataFrame:
    """doc_id, held_out, score, predicted of each document, by a model trained on those that are not held out.

    Rows with equal or null doc_id stay rows of their own; other columns are ignored; an empty table gives an empty
    table. Without labels every score is 0.5.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(base, train(base, labels, group=group)).drop("text")
    return out.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, *, group: int = GROUP, threshold: float = 0.5) -> DataFrame:
    """docs without those that score below threshold. Columns, of any name, and repeated rows stay as they are; null and
    empty texts are scored like others; an empty table gives an empty table."""
    model = train(docs, labels, group=group)
    (name,) = fresh(docs, "_quality_score")
    return score(docs, model, name).where(F.col(name) >= threshold).select(*docs.columns)
