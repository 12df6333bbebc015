"""Connected components of a graph of long ids, without collecting links to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links that one task may take whole.
TASK_LINKS = 1_000_000


def _forest(batches):
    """Union-find over one partition's links; a (node, root) row for each node that is not its root, roots smallest."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    ids, codes = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(codes[: len(u)].tolist(), codes[len(u) :].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    top = np.array([find(k) for k in range(len(ids))])
    moved = np.flatnonzero(top != np.arange(len(ids)))
    for k in range(0, len(moved), 1 << 16):
        m = moved[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[m]), pa.array(ids[top[m]])], names=["u", "v"])


def components(links: DataFrame, scratch: Scratch, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) for each node of links(u, v) that is not its component's smallest; component is that smallest.

    Links are first contracted within each partition. While more than task_links are left, large-star and small-star
    rounds move them to the smallest nodes; both only take minima and equi-joins, so that a hot node's links can be
    split. What fits one task ends there. An empty table gives an empty table.
    """
    spark = links.sparkSession
    plain = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    now = scratch.save(plain.mapInArrow(_forest, "u long, v long").distinct(), "links")
    before = None
    while (count := now.count()) > task_links:
        mark = now.agg(F.bit_xor(F.xxhash64("u", "v"))).first()[0]
        if (count, mark) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = count, mark
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = scratch.save(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(now, large)
        now = after
    done = now.coalesce(1).mapInArrow(_forest, "u long, v long") if count else spark.createDataFrame([], "u long, v long")
    return scratch.save(done.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
