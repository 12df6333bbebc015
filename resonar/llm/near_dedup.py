"""Near-duplicate documents by an LSH forest over MinHash signatures.

Each document's MinHash signature is written in several orders. In each order all signatures are sorted, and a
document's candidates are its neighbours that share the longest prefixes with it: where few documents share the first
values all of them are neighbours, where many do the neighbours agree to a greater depth. Candidates are confirmed on
full shingle sets; confirmed links are united over all orders.

Where more documents share the first values than neighbours are looked at, the order alone would lose pairs. Such crowds
are joined exactly: by their rarest shingles, as far into each set as a pair that is near enough must have met.

Documents with equal shingle sets form one class, found by a digest, so groups of copies are never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, binary_column, in_chunks, shingle_sets, splitmix
from .graph import components

WIDTH, PERCENT = 5, 75
#: Sorted orders, values by which each sorts, values that a candidate must share, neighbours looked at on either side.
TREES, DEPTH, SHARED, REACH = 20, 8, 4, 4
VALUES = TREES * SHARED
_A = splitmix(41, VALUES) | np.uint64(1)
_B = splitmix(42, VALUES)
#: Sets of a crowd that meet in one task because of one shingle.
TOGETHER = 8192
#: Bits of the map of documents that have candidates.
MAP_BITS = 1 << 22


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _signature(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(found), 2048):
        v = ((found[None, k : k + 2048] * _A[:, None] + _B[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, v.min(axis=1), out=least)
    return least


def _orders(signature: np.ndarray) -> list[bytes]:
    """For each sorted order its values as bytes that sort alike."""
    big = signature.astype(">u4")
    return [np.take(big, range(t * SHARED, t * SHARED + DEPTH), mode="wrap").tobytes() for t in range(TREES)]


_SIGNED = "n_shingles long, digest binary, signature binary"


def _sign(width: int):
    def run(batches):
        for batch in batches:
            kept, names = batch.columns[:-1], batch.schema.names[:-1]
            texts = binary_column(batch)
            size, digest, signature = [], [], []
            for a, b in in_chunks(texts):
                for found in shingle_sets(texts[a:b], width):
                    size.append(len(found))
                    digest.append(_digest(found) if len(found) else None)
                    signature.append(_signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())],
                names=[*names, "n_shingles", "digest", "signature"],
            )

    return run


def _grow(batches):
    """A row for each sorted order of each class."""
    for batch in batches:
        node = batch.column(0).to_numpy()
        keys = [_orders(np.frombuffer(s, np.uint32)) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(node))),
                pa.array([k for own in keys for k in own], pa.binary()),
                pa.array(np.repeat(node, TREES)),
            ],
            names=["tree", "key", "node"],
        )


_NEIGHBOURS = "a long, b long, apart int, tree int, key binary"


def _neighbours(batches):
    """Pairs of neighbours of one sorted run of rows. The first and last rows come out too (b null), for its borders.

    A row that shares its first values with another more than REACH places away is paired with itself: it is in a crowd.
    """
    edge = REACH + 1
    held = None
    first = True

    def border(tree, key, node):
        n = len(node)
        return pa.RecordBatch.from_arrays(
            [pa.array(node), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(tree), pa.array(list(key), pa.binary())],
            names=["a", "b", "apart", "tree", "key"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, key, node = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
        if first:
            yield border(tree[:edge], key[:edge], node[:edge])
            first = False
        if held:
            tree, key, node = np.concatenate((held[0], tree)), held[1] + key, np.concatenate((held[2], node))
        fresh = len(held[2]) if held else 0
        values = np.frombuffer(b"".join(key), ">u4").reshape(len(key), DEPTH)
        for apart in range(1, edge + 1):
            if len(node) <= apart:
                break
            alike = (values[apart:, :SHARED] == values[:-apart, :SHARED]).all(axis=1) & (tree[apart:] == tree[:-apart])
            at = np.flatnonzero(alike)
            at = at[at + apart >= fresh]
            x, y = node[at], node[at + apart]
            if apart == edge:
                x = y = np.unique(np.concatenate((x, y)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.full(len(x), apart, np.int32)), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.binary())],
                names=["a", "b", "apart", "tree", "key"],
            )
        held = tree[-edge:], key[-edge:], node[-edge:]
    if held:
        yield border(*held)


def _candidates(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b, apart): pairs of classes that are neighbours in some order, with the least distance at which they are; and
    (node): classes that are in a crowd in some order."""
    spark = classes.sparkSession
    rows = classes.select("node", "signature").mapInArrow(_grow, "tree int, key binary, node long")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = rows.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    found = scratch.save(order.mapInArrow(_neighbours, _NEIGHBOURS), "neighbours")
    # a few rows from each partition: pairs that stand across a border
    borders = found.where("b is null").select("tree", "key", F.col("a").alias("node")).distinct()
    across = borders.coalesce(1).sortWithinPartitions("tree", "key", "node").mapInArrow(_neighbours, _NEIGHBOURS)
    pairs = scratch.save(found.union(across).where("b is not null").groupBy("a", "b").agg(F.min("apart").alias("apart")), "pairs")
    scratch.drop(found)
    return pairs.where("a <> b"), pairs.where("a = b").select(F.col("a").alias("node"))


def _wanted(ids: DataFrame) -> bytes:
    """A bit map, of fixed size, of the hashes of doc_id that verification needs."""
    bits = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("bit"))
    rows = bits.groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    got = rows.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


def _full_sets(width: int, bits):
    def run(batches):
        wanted = np.frombuffer(bits.value, np.int64)
        for batch in batches:
            bit = batch.column(1).to_numpy()
            keep = np.flatnonzero((wanted[bit >> 6] >> (bit & 63)) & 1)
            if not len(keep):
                continue
            texts = binary_column(batch.take(pa.array(keep)))
            digest, whole = [], []

            def out():
                return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(whole, pa.binary())], names=["digest", "whole"])

            for a, b in in_chunks(texts):
                for found in shingle_sets(texts[a:b], width):
                    if len(found):
                        digest.append(_digest(found))
                        whole.append(found.tobytes())
                yield out()
                digest, whole = [], []

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            left, right = (batch.column(batch.schema.get_field_index(c)) for c in ("wa", "wb"))
            for k in range(batch.num_rows):
                x, y = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are near enough. Sizes that rule a pair out are looked at first."""
    sizes = sets.select("node", "n_shingles")
    near = (
        pairs.join(sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na")), "a")
        .join(sizes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb")), "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        .select("a", "b")
    )
    whole = sets.select("node", "whole")
    return (
        near.join(whole.select(F.col("node").alias("a"), F.col("whole").alias("wa")), "a")
        .join(whole.select(F.col("node").alias("b"), F.col("whole").alias("wb")), "b")
        .mapInArrow(_confirm(percent), "a long, b long")
    )


def _spell(batches):
    """(node, token): the shingles of each set."""
    for batch in batches:
        for node, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = np.frombuffer(whole.as_buffer(), np.int64)
            for k in range(0, len(tokens), 1 << 16):
                t = tokens[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), node))], names=["token", "node"])


def _meetings(token, node, size, place, component, percent: int):
    """Pairs of rows of one token whose sets can still be near enough, unless they are in one component. Rows are sorted
    by token, size and node; place is the token's place in its set, rarest first."""
    cuts = np.flatnonzero(np.diff(token)) + 1
    group = np.zeros(len(token), np.int64)
    group[cuts] = 1
    group = np.cumsum(group)
    # of each token's rows those of the commonest component meet only the others
    order = np.lexsort((component, group))
    heads = np.flatnonzero(np.concatenate(([True], (np.diff(group[order]) != 0) | (np.diff(component[order]) != 0))))
    runs = np.diff(np.append(heads, len(order)))
    best = np.lexsort((runs, group[order[heads]]))
    last = best[np.append(np.diff(group[order[heads]][best]) != 0, True)]
    main = component == component[order[heads[last]]][group]
    # the smaller set's rest, from this token on, must hold the whole overlap; so must the larger one's
    rest = (100 + percent) * (size - place)
    first = np.flatnonzero(rest >= 2 * percent * size)
    key = (group << 32) | size
    end = np.searchsorted(key, (group[first] << 32) | np.minimum(rest[first] // percent - size[first], (1 << 32) - 1), side="right")
    for own, others in ((main[first], np.flatnonzero(~main)), (~main[first], np.arange(len(token)))):
        y = first[own]
        start = np.searchsorted(others, y + 1)
        many = np.maximum(np.searchsorted(others, end[own]) - start, 0)
        total = np.cumsum(many)
        k = 0
        while k < len(y):
            stop = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + (1 << 22), side="right")))
            n = many[k:stop]
            at = np.repeat(start[k:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
            a, b = np.repeat(y[k:stop], n), others[at]
            ok = (component[a] != component[b]) & (rest[b] >= percent * (size[a] + size[b]))
            a, b = node[a[ok]], node[b[ok]]
            if len(a):
                yield np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
            k = stop


def _meet(percent: int):
    def run(batches):
        def out(columns):
            if len(columns[0]):
                for a, b in _meetings(*columns, percent):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy() for c in batch.columns]
            if held:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            yield from out([c[:cut] for c in now])
            held = [c[cut:] for c in now]
        if held:
            yield from out(held)

    return run


def _crowded(crowd: DataFrame, sets: DataFrame, known: DataFrame, scratch: Scratch, percent: int, together: int) -> DataFrame:
    """(a, b): all pairs of classes of crowds that can be near enough and that known(node, component) has not united.

    With a set's shingles in one order for all, rarest first, the first one that two sets share stands so early in both
    that what follows can hold their overlap. Shingles that one set alone has count for the places only. The rows of a
    shingle that more than `together` sets hold are dealt into blocks, and each pair of blocks meets by itself.
    """
    tokens = scratch.save(sets.join(crowd, "node").select("node", "whole").mapInArrow(_spell, "token long, node long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    whole = Window.partitionBy("node")
    sizes = sets.select("node", F.col("n_shingles").alias("size")).join(known, "node", "left").select("node", "size", F.coalesce("component", "node").alias("component"))
    placed = (
        tokens.join(often, "token")
        .withColumn("rank", F.row_number().over(whole.orderBy("times", "token")))
        .withColumn("shared", F.count("*").over(whole))
        .join(sizes, "node")
        .select("token", F.ceil(F.col("times") / together).cast("int").alias("blocks"), "node", "size", (F.col("size") - F.col("shared") + F.col("rank") - 1).alias("place"), "component")
        .where((F.col("size") - F.col("place")) * 100 >= F.col("size") * percent)
    )
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("own", own).withColumn("other", other)
    # cells of one number by chance only meet in vain: pairs are confirmed later
    cell = F.when(F.col("blocks") == 1, F.col("token")).otherwise(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
    cells = dealt.select(cell.alias("cell"), "node", "size", "place", "component")
    out = cells.repartition("cell").sortWithinPartitions("cell", "size", "node").mapInArrow(_meet(percent), "a long, b long")
    out = scratch.save(out.distinct(), "meetings")
    scratch.drop(tokens)
    return out


def near_groups(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, carry: tuple[str, ...] = (), together: int = TOGETHER) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, and first: true for one row of each component,
    of the smallest doc_id, also where ids are null or repeated. `carry` names long columns of docs to return with them.

    Words are runs of bytes other than white space, A-Z in lower case. Documents link when
    100 * intersection >= percent * union of their sets of width-word shingles; component_id is the smallest doc_id
    reachable. A document with fewer words has its whole sequence as its one shingle; null, empty and blank texts have
    an empty set and link with nothing. Rows with equal doc_id are documents of their own; a null doc_id is never a
    component_id unless all of its component have none. Texts of any length are hashed whole. Other columns, of any name,
    are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).cast("long").alias(f"carry{k}") for k, c in enumerate(carry)))
    own = ["rid", "doc_id", *(f"carry{k}" for k in range(len(carry)))]
    numbered = base.withColumn("rid", F.monotonically_increasing_id()).select(*own, "text")
    signed = scratch.save(numbered.mapInArrow(_sign(width), ", ".join(f"{c} long" for c in own) + f", {_SIGNED}"), "signed")
    full = signed.where("n_shingles > 0")
    classes = scratch.save(
        full.groupBy("digest").agg(F.min(F.struct("rid", "doc_id")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")).select(F.col("first.rid").alias("node"), F.col("first.doc_id").alias("doc_id"), "digest", "n_shingles", "signature"),
        "classes",
    )
    pairs, crowd = _candidates(classes, scratch)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = scratch.save(classes.join(nodes, "node").select("node", "doc_id", "digest", "n_shingles"), "needed")
    bits = spark.sparkContext.broadcast(_wanted(needed))
    sets = base.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("bit")).mapInArrow(_full_sets(width, bits), "digest binary, whole binary")
    sets = sets.join(needed, "digest").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("whole").alias("whole"))
    sets = scratch.save(sets, "sets")
    # direct neighbours first; of the others only pairs that those have not already brought together
    near = scratch.save(_verified(pairs.where("apart = 1"), sets, percent), "links")
    known = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    named = lambda c, to: known.select(F.col("node").alias(c), F.col("component").alias(to))
    rest = (
        pairs.where("apart > 1")
        .join(named("a", "ca"), "a", "left")
        .join(named("b", "cb"), "b", "left")
        .where("coalesce(ca, a) <> coalesce(cb, b)")
        .select("a", "b")
    )
    more = scratch.save(_verified(rest, sets, percent), "more")
    joined = components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), scratch)
    if not crowd.isEmpty():
        more = scratch.save(_verified(_crowded(crowd, sets, joined, scratch, percent, together), sets, percent), "crowded")
        joined = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), scratch)
    scratch.drop(sets)
    member = (
        classes.select("node", "digest", "n_shingles")
        .join(joined, "node", "left")
        .select("digest", F.coalesce("component", "node").alias("component"))
    )
    of_class = full.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")).join(member, "digest")
    least = of_class.groupBy("component").agg(F.min("least").alias("least"))
    named = of_class.select("digest", "component").join(least, "component").select("digest", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("top"))
    out = signed.join(named, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        (F.coalesce("top", "rid") == F.col("rid")).alias("first"),
        *(F.col(f"carry{k}").alias(c) for k, c in enumerate(carry)),
    )
