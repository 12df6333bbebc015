"""Shared pieces: scratch tables in the cluster's shared folder, word and shingle hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="resonar-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that later steps neither recompute nor depend on lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/resonar-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        _left.append((spark, self.base))

    def save(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:02d}-{name}"
        df.write.parquet(path, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in frames:
            _delete(self.spark, df._scratch_path)


    def clear(self) -> None:
        """Deletes all of its tables."""
        _delete(self.spark, self.base)


_left: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    """When the driver ends, results have been read and what is left in the shared folder can go, if Spark still runs."""
    for spark, folder in _left:
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc().isStopped() is False:
            _delete(spark, folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to be a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _is_scan(df: DataFrame) -> bool:
    """Whether df is files and nothing but columns and filters over them, so that each row is one row of a file."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def with_rows(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """df with columns that identify a row, the same in every scan, and their names.

    Rows of files are known by their file and place in it. Any other table is stored first, with numbers.
    """
    names = fresh(df, "_file", "_place")
    if _is_scan(df):
        try:
            meta = df.metadataColumn("_metadata")
            return df.select("*", F.xxhash64(meta["file_path"]).alias(names[0]), meta["row_index"].cast("long").alias(names[1])), names
        except AnalysisException:  # a format without such columns
            pass
    stored = df.select("*", F.lit(0).cast("long").alias(names[0]), F.monotonically_increasing_id().alias(names[1]))
    return scratch.save(stored, "rows"), names


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id written in decimal; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def binary_column(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words after lower-casing A-Z. bytes.lower and bytes.split know ASCII letters and white space only."""
    return text.lower().split()


def splitmix(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    x = np.uint64(seed & MASK) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(x)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = splitmix(11, 256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SHINGLE = splitmix(13, 64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_STEP = 1 << 12


def _powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2**64."""
    out = np.full(n, base & MASK, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_LOW, _BACK = _powers(_BASE, _STEP), _powers(pow(_BASE, -1, 1 << 64), _STEP)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z lower-cased, and where each text's words start (one more entry).

    A word's hash is a polynomial of its bytes, taken as the difference of two running sums over all texts and divided by
    the power at its start, so it is computed for all words at once.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    edge = np.flatnonzero(np.diff(SPACE[joined], prepend=True))
    begin, end = edge[::2], edge[1::2]
    first = np.concatenate(([0], np.searchsorted(begin, ends)))
    if not len(begin):
        return np.zeros(0, np.uint64), first
    own = np.empty(len(begin), np.uint64)
    lo = 0
    while lo < len(begin):  # stretches of about a megabyte: sums take many times the text's room
        hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + (1 << 20))))
        own[lo:hi] = _stretch_hashes(joined[begin[lo] : end[hi - 1]], begin[lo:hi] - begin[lo], end[lo:hi] - begin[lo])
        lo = hi
    return mix64(own + (end - begin).astype(np.uint64)), first


def _stretch_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    steps = len(data) // _STEP + 1
    high, back = _powers(pow(_BASE, _STEP, 1 << 64), steps), _powers(pow(_BASE, -_STEP, 1 << 64), steps)
    total = _BYTE[data]
    total *= np.multiply.outer(high, _LOW).ravel()[: len(data)]
    np.cumsum(total, out=total)
    before = np.where(begin > 0, total[begin - 1], np.uint64(0))
    return (total[end - 1] - before) * back[begin // _STEP] * _BACK[begin % _STEP]


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of its word shingles; fewer words count as one shingle, none as no shingle."""
    words, first = word_hashes(texts)
    n = len(words)
    if n >= width:
        whole = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            whole += words[k : n - width + 1 + k] * _SHINGLE[k]
        whole = mix64(whole)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            out.append(mix64((words[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def in_chunks(texts: list[bytes], limit: int = 1 << 20):
    """(start, stop) of runs of texts that hold about limit bytes; one long text is a run of its own."""
    start = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, k
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def numbered(df: DataFrame, by: str, order: list[Column], name: str, salts: int = 1, salt: Column | None = None) -> DataFrame:
    """df with a gapless number from 0 within each value of `by`.

    With more than one salt a value's rows are numbered in that many groups, and each group starts where those of
    smaller salt end, so that no task sorts all rows of one value. df is read twice and must not change in between.
    """
    if salts <= 1:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))
    _salt, _before, _own = fresh(df, "_salt", "_before", "_own")
    salted = df.withColumn(_salt, salt)
    earlier = Window.partitionBy(by).orderBy(_salt).rowsBetween(Window.unboundedPreceding, -1)
    counted = salted.groupBy(by, _salt).agg(F.count("*").alias(_own))
    before = counted.select(by, _salt, F.coalesce(F.sum(_own).over(earlier), F.lit(0)).alias(_before))
    own = F.row_number().over(Window.partitionBy(by, _salt).orderBy(*order))
    both = salted.withColumn(_own, own).join(before, [by, _salt])
    return both.select(*df.columns, (F.col(_before) + F.col(_own) - 1).cast("long").alias(name))
