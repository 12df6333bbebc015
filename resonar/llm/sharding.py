"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

Rows fall into blocks by a hash. How many rows each block sends to each shard is drawn exactly, as a uniform random
permutation of all rows would have it: the rows of a matrix with given row and column sums, each a multivariate
hypergeometric draw from what the blocks before have left. A block permutes its rows and deals them out in those
numbers; a shard permutes what it receives.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, numbered

SHARDS, SEED = 40, 20_240_501
#: Rows that one task sorts, roughly; most blocks there may be.
GROUP, MOST_BLOCKS = 50_000, 16_384
#: Rows of a file that write_shards writes.
FILE_ROWS = 100_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones are among `draws` of good + bad, for totals of any size."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    mean = draws * good / total
    sd = math.sqrt(max(mean * (bad / total) * ((total - draws) / max(total - 1, 1)), 1.0))
    low, high = max(0, draws - bad, int(mean - 14 * sd) - 2), min(draws, good, int(mean + 14 * sd) + 2)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    log = np.concatenate(([0.0], np.cumsum(steps)))
    weight = np.exp(log - log.max())
    return low + int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right"))


def matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows each block sends to each shard. Row sums are `sizes`; column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(sizes), shards), np.int64)
    for b, size in enumerate(sizes):
        rest, open_ = size, sum(left)
        for s in range(shards):
            open_ -= left[s]
            got = hypergeometric(rng, left[s], open_, rest)
            out[b, s] = got
            left[s] -= got
            rest -= got
    return out


def _deal(tables, kept: list[str], block: str, rank: str):
    def run(batches):
        keys, shards = tables.value
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            at = np.searchsorted(keys, (column(block).to_numpy() << 44) | column(rank).to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([*(column(c) for c in kept), pa.array(shards[at])], names=[*kept, "shard"])

    return run


def shuffle(rows: DataFrame, *, shards: int = SHARDS, seed: int = SEED, by: list[str] | None = None, group: int = GROUP) -> DataFrame:
    """rows with shard (int, from 0) and slot (long, gapless from 0 in each shard); shard sizes differ by one at most.

    `by` are the columns that random keys are made from, all by default; rows that are equal there are told apart by
    their order only. rows is read several times and must give the same rows each time, so hand over a stored table.
    Nulls, repeated rows and an empty table need nothing special. Columns named shard and slot are replaced; others, of
    any name, stay.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    by = by or rows.columns
    total = rows.count()
    block, rank = fresh(rows, "_block", "_rank")
    kept = rows.columns
    random = lambda k: F.xxhash64(F.lit(seed + k), *by)
    ties = [F.col(c).asc_nulls_first() for c in by]
    blocks = min(MOST_BLOCKS, 1 + total // group) if total > group else 8
    blocked = rows.withColumn(block, F.pmod(random(0), F.lit(blocks)))
    found = dict(blocked.groupBy(block).count().collect())  # one row for each block
    sizes = [int(found.get(b, 0)) for b in range(blocks)]
    sent = matrix(sizes, shards, seed)
    keys, to = [], []
    for b in range(blocks):
        start = 0
        for s in np.flatnonzero(sent[b]):
            keys.append((b << 44) | start)
            to.append(s)
            start += int(sent[b, s])
    tables = spark.sparkContext.broadcast((np.array(keys, np.int64), np.array(to, np.int32)))  # at most blocks * shards
    # salts follow the random key's order, so groups of salts keep the order a permutation
    salt = lambda k, n: F.shiftright(F.shiftrightunsigned(random(k), 40) * F.lit(n), 24)
    inner = 1 + (max(sizes, default=0) // (4 * group))
    local = numbered(blocked, block, [random(1), *ties], rank, inner, salt(1, inner))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = Scratch(spark, "shards").save(local.mapInArrow(_deal(tables, kept, block, rank), f"{kinds}, shard int"), "dealt")
    outer = 1 + total // shards // group
    return numbered(dealt, "shard", [random(2), *ties], "slot", outer, salt(2, outer))


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document, under the law `rows`.

    size is the text's UTF-8 bytes plus 16; a null text has none and the checksum of the empty text. Rows with equal or
    null doc_id are rows of their own. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle(Scratch(docs.sparkSession, "sizes").save(base, "sizes"), shards=shards, seed=seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, seed: int = SEED, file_rows: int = FILE_ROWS) -> None:
    """Writes whole documents, with all columns and slot, as one folder for each shard.

    A shard's slots are cut into files of about file_rows, each by one task and in slot order, so a file holds a random
    part of the shard and no task takes a whole one. docs is stored first, so that all steps see the same rows; nulls,
    repeated rows and an empty table need nothing special.
    """
    out = shuffle(Scratch(docs.sparkSession, "rows").save(docs, "rows"), shards=shards, seed=seed)
    (part,) = fresh(out, "_part")
    out = out.withColumn(part, F.floor(F.col("slot") / file_rows))
    parts = max(1, out.select("shard", part).distinct().count())
    ranged = out.repartitionByRange(parts, "shard", part).sortWithinPartitions("shard", "slot")
    ranged.drop(part).write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
