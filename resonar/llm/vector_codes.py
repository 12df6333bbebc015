"""Product codes of vectors: each part of a vector becomes the index of its nearest entry in that part's codebook.

Components become integers, and equal integer parts at one position are one weighted row. Lloyd's rounds run over these
distinct rows alone: each task sums its rows' weighted components by nearest entry, so that what leaves it is bounded by
the codebooks. At the end each distinct part has a code and an error, which are joined back to the vectors.

Parts that many vectors share are few, whatever the table's size, and are broadcast; all others are rare, so that the
join by part has no hot key.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers must be smaller, so that squares of a vector and sums over 2**38 vectors fit 64 bits.
LIMIT = 1 << 24
#: A part is broadcast if it makes up more than this share of its position: fewer than so many can.
COMMON = 4096
#: Sums by label are broadcast up to so many labels.
LABELS = 100_000
#: Distances made at once.
AT_ONCE = 1 << 20


def _floors(column: pa.Array, scale: int):
    """The rows to keep, their lengths, and their components as integers, still in doubles, one after the other."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = column.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    values = column.flatten()
    numbers = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null is nan
    row = np.repeat(np.arange(len(size)), size)
    bad = np.zeros(len(size), bool)
    bad[row[~np.isfinite(numbers)]] = True
    keep = there & ~bad
    with np.errstate(over="ignore"):
        return keep, size[keep], np.floor(scale * numbers[keep[row]])


def _measure(scale: int):
    def run(batches):
        n, low, high, most = 0, None, None, 0.0
        for batch in batches:
            keep, size, whole = _floors(batch.column(0), scale)
            if len(size):
                n += len(size)
                low = min(int(size.min()), size.min() if low is None else low)
                high = max(int(size.max()), size.max() if high is None else high)
                most = max(most, float(np.abs(whole).max(initial=0)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (n, int(low), int(high), most)], names=["n", "low", "high", "most"])

    return run


def _width(most: float) -> np.dtype:
    return next(np.dtype(t) for t in ("<i1", "<i2", "<i4") if most < np.iinfo(t).max)


def _pack(scale: int, width: np.dtype):
    def run(batches):
        for batch in batches:
            keep, size, whole = _floors(batch.column(2), scale)
            data = whole.astype(width).tobytes()
            step = int(size[0]) * width.itemsize if len(size) else 0
            packed = [data[k * step : (k + 1) * step] for k in range(len(size))]
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(packed, pa.binary())], names=batch.schema.names)

    return run


def _rows(keys: pa.Array, width: np.dtype, size: int) -> np.ndarray:
    """Parts of one length as a matrix of integers."""
    joined = b"".join(keys.to_pylist())
    return np.frombuffer(joined, width).astype(np.int64).reshape(len(keys), size)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the first of equally near ones, and its squared distance."""
    most = int(max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, rows.shape[1]) < 1 << 53 else np.int64  # whole numbers, exact either way
    entries = book.astype(kind)
    own = (entries * entries).sum(1)
    at, far = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    step = max(1, AT_ONCE // max(1, len(book)))
    for k in range(0, len(rows), step):
        some = rows[k : k + step].astype(kind)
        away = (some * some).sum(1)[:, None] - 2 * (some @ entries.T) + own
        at[k : k + step] = best = away.argmin(1)
        far[k : k + step] = away[np.arange(len(some)), best]
    return at, far


def _by_part(batch: pa.RecordBatch):
    part = batch.column(0).to_numpy()
    for p in np.unique(part):
        yield int(p), np.flatnonzero(part == p)


def _sums(books: np.ndarray, width: np.dtype):
    """part, entry, place, total: weighted sums of components by nearest entry, and at place -1 the weights."""

    def run(batches):
        parts, entries, size = books.shape
        total = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            for p, own in _by_part(batch):
                rows = _rows(batch.column(1).take(pa.array(own)), width, size)
                weight = batch.column(2).to_numpy()[own]
                at, _ = nearest(rows, books[p])
                np.add.at(total[p], at, np.column_stack((weight, rows * weight[:, None])))
        p, e = np.nonzero(total[:, :, 0])
        if len(p):
            place = np.tile(np.arange(-1, size), len(p))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, size + 1).astype(np.int32)), pa.array(np.repeat(e, size + 1).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[p, e].ravel())], names=["part", "entry", "place", "total"])

    return run


def _assign(books: np.ndarray, width: np.dtype):
    def run(batches):
        for batch in batches:
            code, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, own in _by_part(batch):
                code[own], away[own] = nearest(_rows(batch.column(1).take(pa.array(own)), width, books.shape[2]), books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(away)], names=[*batch.schema.names, "entry", "away"])

    return run


@dataclass
class Coded:
    """vectors: id, label, code, error. parts: distinct parts with weight, entry and distance. books: part, entry, place."""

    vectors: DataFrame
    parts: DataFrame | None
    books: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _refined(distinct: DataFrame, books: np.ndarray, width: np.dtype) -> np.ndarray:
    """One round of weighted Lloyd. Entries without parts stay."""
    found = distinct.mapInArrow(_sums(books, width), "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
    got = found.toArrow()  # at most one row for each number in the codebooks, and one for each entry
    p, e, place, total = (got.column(c).to_numpy() for c in ("part", "entry", "place", "total"))
    sums = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    sums[p, e, place + 1] = total
    weight = sums[:, :, :1]
    return np.where(weight > 0, sums[:, :, 1:] // np.maximum(weight, 1), books)  # // floors


def encode_vectors(
    vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, common: int = COMMON
) -> Coded:
    """Codebooks and codes of vectors; see Coded. Columns other than the three named are ignored.

    Rows whose vector is null or holds null or non-finite components are dropped. All others must have one length, a
    multiple of `parts`, and components below 2**24 / scale; else a ValueError says so. Codebooks start with the rows of
    smallest id, nulls last, and rows of one id in the order of their integers. Repeated rows count as often as they
    occur. A table without rows to keep gives an empty table and empty codebooks.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("codes have 1 to 256 entries in one part or more")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    base = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kinds = f"id {base.schema['id'].dataType.simpleString()}, label {base.schema['label'].dataType.simpleString()}"
    found = base.select("vector").mapInArrow(_measure(scale), "n long, low long, high long, most double")
    n, low, high, most = found.agg(F.sum("n"), F.min("low"), F.max("high"), F.max("most")).first()
    if not n:
        empty = spark.createDataFrame([], f"{kinds}, code string, error long")
        return Coded(empty, None, np.zeros((parts, 0, 0), np.int64), scale)
    if low != high or low % parts:
        raise ValueError(f"vectors must have one length that {parts} divides; lengths from {low} to {high} were found")
    if most >= LIMIT:
        raise ValueError(f"components must be below {LIMIT // scale}")
    width, size = _width(most), low // parts
    step = size * width.itemsize
    packed = scratch.save(base.mapInArrow(_pack(scale, width), f"{kinds}, packed binary").withColumn("rid", F.monotonically_increasing_id()), "packed")
    slices = F.array(*[F.substring("packed", k * step + 1, step) for k in range(parts)])
    exploded = packed.select("rid", F.posexplode(slices).alias("part", "key"))
    distinct = scratch.save(exploded.groupBy("part", "key").agg(F.count("*").alias("weight")), "distinct")

    first = packed.orderBy(F.col("id").asc_nulls_last(), "packed").limit(entries).select("packed").collect()
    books = np.stack([np.frombuffer(r[0], width).astype(np.int64).reshape(parts, size) for r in first], 1)
    for _ in range(rounds):
        books = _refined(distinct, books, width)
    coded = scratch.save(distinct.mapInArrow(_assign(books, width), "part int, key binary, weight long, entry int, away long"), "coded")
    scratch.drop(distinct)

    is_common = F.col("weight") * common > n
    frequent = F.broadcast(coded.where(is_common).select("part", "key", "entry", "away"))  # under `common` rows a part
    met = exploded.join(frequent, ["part", "key"], "left")
    joined = met.where("entry is not null").select("rid", "part", "entry", "away")
    if not coded.where(~is_common).isEmpty():
        rare = coded.where(~is_common).select("part", "key", "entry", "away")
        joined = joined.unionByName(met.where("entry is null").select("rid", "part", "key").join(rare, ["part", "key"]).select("rid", "part", "entry", "away"))
    # eight entries to a long, so that a vector's parts are put together by an aggregation in place
    slot = F.expr("shiftleft(cast(entry as long), 8 * (7 - part % 8))")
    longs = [F.bit_or(F.when(F.floor(F.col("part") / 8) == k, slot).otherwise(F.lit(0))).alias(f"w{k}") for k in range(-(-parts // 8))]
    whole = joined.groupBy("rid").agg(F.sum("away").alias("error"), *longs)
    code = F.lower(F.substring(F.concat(*[F.lpad(F.hex(f"w{k}"), 16, "0") for k in range(len(longs))]), 1, 2 * parts))
    out = packed.select("rid", "id", "label").join(whole, "rid").select("id", "label", code.alias("code"), "error")
    return Coded(scratch.save(out, "vectors"), coded, books, scale)


def compress_vectors(vectors: DataFrame, *, id: str = "vec_id", label: str = "label", labels: int = LABELS, **how) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of each vector that encode_vectors keeps; null labels are one label.

    Errors are summed by label before they meet the vectors again, so a label of a third of all rows is no hot key.
    """
    made = encode_vectors(vectors, id=id, label=label, **how)
    sums = Scratch(vectors.sparkSession, "labels").save(made.vectors.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "sums")
    if sums.count() <= labels:
        sums = F.broadcast(sums)
    both = made.vectors.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return both.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256"))


def decode_vectors(coded: DataFrame, books: np.ndarray, *, scale: int = SCALE, code: str = "code", vector: str = "vector") -> DataFrame:
    """coded with the vector that each code stands for, at the middle of its integers' cells; a null code gives null."""
    parts = books.shape[0]
    middle = (books + 0.5) / scale
    (name,) = fresh(coded, vector)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)

    def run(batches):
        for batch in batches:
            codes = batch.column(batch.schema.get_field_index(code)).to_pylist()
            out = [None if c is None else middle[np.arange(parts), np.frombuffer(bytes.fromhex(c), np.uint8)].ravel().tolist() for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, name])

    return coded.mapInArrow(run, f"{kinds}, `{name}` array<double>")


_SLICE = "list_slice(v, 4 * p + 1, 4 * p + 4)"


def _oracle() -> str:
    """DuckDB SQL for compress_vectors on vectors of 64 components, with the parameters above."""

    def nearest_of(book: str, keys: str) -> str:
        away = "list_inner_product(k.key, k.key) - 2 * list_inner_product(k.key, c.key) + list_inner_product(c.key, c.key)"
        return f"SELECT k.p, k.key, k.w, min(CAST({away} AS BIGINT) * 64 + c.e) AS m FROM {keys} k JOIN {book} c USING (p) GROUP BY ALL"

    def refined(old: str, near: str) -> str:
        means = f"SELECT p, m % 64 AS e, j, floor(sum(w * key[j]) / sum(w)) AS x FROM {near}, range(1, 5) t(j) GROUP BY ALL"
        return f"SELECT o.p, o.e, coalesce(n.key, o.key) AS key FROM {old} o LEFT JOIN (SELECT p, e, list(x ORDER BY j) AS key FROM ({means}) GROUP BY p, e) n ON n.p = o.p AND n.e = o.e"

    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({SCALE} * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS rid FROM kept),
cut AS (SELECT rid, p, {_SLICE} AS key FROM numbered, range(0, {PARTS}) t(p)),
keys AS (SELECT p, key, count(*) AS w FROM cut GROUP BY ALL),
c0 AS (SELECT p, rid - 1 AS e, key FROM cut WHERE rid <= {ENTRIES}),
n0 AS ({nearest_of("c0", "keys")}), c1 AS ({refined("c0", "n0")}),
n1 AS ({nearest_of("c1", "keys")}), c2 AS ({refined("c1", "n1")}),
n2 AS ({nearest_of("c2", "keys")}),
coded AS (SELECT vec_id, label, rid, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error
  FROM cut JOIN n2 USING (p, key) JOIN numbered USING (rid) GROUP BY ALL),
book AS (SELECT sha256(string_agg(CAST(CAST(key[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM c2, range(1, 5) t(j))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book
"""


ORACLE = _oracle()
