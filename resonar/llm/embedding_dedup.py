"""Near-duplicate embeddings by sorted projection passes.

Each pass sorts the vectors of each label by the bits of random projections. A window is a run of neighbours with equal
leading bits, as long a prefix as its region's density asks for, so that no window holds more than `window` vectors; all
pairs in a window are compared. Tasks get the vectors by cells, a few windows large: as many leading bits as a label's count
asks for, and more where a cell would be too large (the driver sees only the counts of such cells); each task sorts its
cells itself. How far a vector lies from the planes that bound its window says how likely one at exactly the threshold falls
on the other side of one of them; a vector goes on to further passes until that chance, over all its passes, is below
`miss`. What is still above it after `most` passes is compared in blocks, so nothing is left to chance in regions that no
projection parts.

Vectors travel as 16-bit integers with a bound of their error; only pairs within the bound are looked up in the stored
vectors. A vector with very many links in one window is counted against its whole component instead, block by block, and
its links are handed on as a spanning forest, so dense regions are never written out as pairs. Equal vectors of one label
form one class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64
from .graph import components

COSINE = 0.98
#: Most vectors of a window; the chance that a link may be missed; passes after which blocks take over.
WINDOW, MISS, MOST = 4096, 1e-4, 64
#: Links in one window beyond which a vector is counted against its component.
MANY = 64
#: Vectors on one side of a block of pairs.
BLOCK, SEED, BITS = 16_384, 77, 63
#: Windows that a cell may fill, half as many being aimed at; passes of all vectors that travel at once.
CELL, TOGETHER = 8, 4


def _sums(flags: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[stop] - total[start]


def _clean(batches):
    """(rid, vec_id, label, size, digest, vector): size and what follows are null where the vector links with nothing.

    A vector is its components as doubles, or as floats where those say the same, after a byte with their width.
    """
    for batch in batches:
        rows = batch.column(3)
        x = rows.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0 and 0 are one value, a null is no number
        start, stop = (rows.offsets.to_numpy().astype(np.int64)[k : len(rows) + k] for k in (0, 1))
        ok = batch.column(2).is_valid().to_numpy(zero_copy_only=False) & rows.is_valid().to_numpy(zero_copy_only=False)
        ok &= (stop > start) & (_sums(~np.isfinite(x), start, stop) == 0) & (_sums(x != 0, start, stop) > 0)
        with np.errstate(over="ignore", invalid="ignore"):
            single = x.astype("<f4")
            narrow = _sums(single != x, start, stop) == 0
        whole, half = x.astype("<f8", copy=False).data.cast("B") if len(x) else b"", single.data.cast("B") if len(x) else b""
        digest, vector = [None] * len(rows), [None] * len(rows)
        for k in np.flatnonzero(ok).tolist():
            i, j = int(start[k]), int(stop[k])
            digest[k] = xxhash.xxh3_128_digest(whole[8 * i : 8 * j])
            vector[k] = b"\4" + half[4 * i : 4 * j] if narrow[k] else b"\10" + whole[8 * i : 8 * j]
        size = pa.array((stop - start).astype(np.int32), mask=~ok)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), size, pa.array(digest, pa.binary()), pa.array(vector, pa.binary())], names=["rid", "vec_id", "label", "size", "digest", "vector"])


def _unpack(vectors: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if len({len(x) for x in vectors}) == 1:
        raw = np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1)
        return np.ascontiguousarray(raw[:, 1:]).view(f"<f{raw[0, 0]}").astype(np.float64)
    return np.stack([np.frombuffer(x, f"<f{x[0]}", offset=1).astype(np.float64) for x in vectors])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


_COLUMNS = {"label": pa.int64(), "size": pa.int32(), "node": pa.int64(), "code": pa.binary(), "error": pa.float64()}
_CODED = "label long, size int, node long, code binary, error double"


def _encode(batches):
    """Unit vectors as 16-bit integers, and how far each is from what the integers say."""
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
        sizes = get("size").to_numpy()
        for size in np.unique(sizes).tolist():
            own = pa.array(np.flatnonzero(sizes == size))
            unit = _unit(_unpack(get("vector").take(own).to_pylist()))
            top = np.abs(unit).max(axis=1, keepdims=True)
            small = np.rint(unit * (32767 / top)).astype("<i2")
            raw = np.hstack((top.astype("<f8").view(np.uint8), small.view(np.uint8)))
            error = np.sqrt(((unit - small * (top / 32767)) ** 2).sum(axis=1)) + 1e-12
            code = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, raw.size + 1, raw.shape[1], dtype=np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([get("label").take(own), get("size").take(own), get("node").take(own), code, pa.array(error)], names=list(_COLUMNS))


def _decode(codes: pa.Array) -> np.ndarray:
    codes = codes.cast(pa.binary())
    at = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
    raw = np.frombuffer(codes.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(codes), -1)
    top = np.ascontiguousarray(raw[:, :8]).view(np.float64)
    return np.ascontiguousarray(raw[:, 8:]).view("<i2") * (top / 32767)


def _planes(seed: int, size: int, turn: int) -> np.ndarray:
    return np.random.default_rng([seed, size, turn]).standard_normal((size, BITS))


def _misses(unit: np.ndarray, planes: np.ndarray, cosine: float) -> np.ndarray:
    """The chance that a vector at the threshold from each row is parted from it by some of the planes.

    Its projection is `cosine` of the row's own and, at right angles, a normal part of any direction.
    """
    if not planes.shape[1]:
        return np.full(len(unit), 1e-12)
    x = np.abs(unit @ planes) * (cosine / math.sqrt(2 * (1 - cosine * cosine)))
    t = 1 / (1 + 0.3275911 * x)  # half the complementary error function, by a well-known polynomial
    tail = 0.5 * np.exp(-x * x) * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.clip(-np.expm1(np.log1p(-np.minimum(tail, 0.5)).sum(axis=1)), 1e-12, 1)


def _signs(first: int, passes: int, seed: int):
    """A function of a batch: (pass, size, rows, key) of each pass, the key being the sign bits of random projections."""
    planes: dict[int, np.ndarray] = {}
    powers = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def of(batch):
        sizes, turns = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("size", "passes"))
        codes = batch.column(batch.schema.get_field_index("code"))
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            x = _decode(codes.take(pa.array(own)))
            if size not in planes:
                planes[size] = np.stack([_planes(seed, size, first + k) for k in range(passes)])
            for k in range(passes):
                use = turns[own] > k
                if use.any():
                    yield first + k, size, own[use], ((x[use] @ planes[size][k]) > 0) @ powers

    return of


def _counts(first: int, passes: int, seed: int):
    """(pass, label, size, depth, start, n): vectors of each cell in each batch."""

    def run(batches):
        signs = _signs(first, passes, seed)
        for batch in batches:
            labels, depths = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("label", "depth"))
            for turn, size, own, key in signs(batch):
                cell, n = np.unique(np.stack((labels[own], depths[own], key >> (BITS - depths[own]))), axis=1, return_counts=True)
                full = lambda x, kind: pa.array(np.full(len(n), x), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([full(turn, pa.int32()), pa.array(cell[0]), full(size, pa.int32()), pa.array(cell[1].astype(np.int32)), pa.array(cell[2]), pa.array(n)], names=["pass", "label", "size", "depth", "start", "n"])

    return run


def _keys(first: int, passes: int, seed: int, crowded: dict):
    """(pass, label, size, key, node) of the vectors of crowded cells, which are starts by pass, label and size."""

    def run(batches):
        signs = _signs(first, passes, seed)
        for batch in batches:
            labels, depths, node = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("label", "depth", "node"))
            for turn, size, own, key in signs(batch):
                start = key >> (BITS - depths[own])
                for label in np.unique(labels[own]).tolist():
                    use = np.flatnonzero((labels[own] == label) & np.isin(start, crowded.get((turn, label, size), [])))
                    if len(use):
                        full = lambda x, kind: pa.array(np.full(len(use), x), kind)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([full(turn, pa.int32()), full(label, pa.int64()), full(size, pa.int32()), pa.array(key[use]), pa.array(node[own[use]])], names=["pass", "label", "size", "key", "node"])

    return run


_SPOT = "cell long, pass int, label long, size int, depth int, key long, node long, code binary, error double"


def _project(first: int, passes: int, seed: int, cells: dict):
    """Each vector with its key and its cell in each pass. cells: lowest keys and depths of the parts of crowded ones."""

    def run(batches):
        signs = _signs(first, passes, seed)
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            labels, depths = get("label").to_numpy(), get("depth").to_numpy()
            for turn, size, own, key in signs(batch):
                label, depth = labels[own], depths[own].astype(np.int64)
                for x in np.unique(label).tolist():
                    if (turn, x, size) in cells:
                        low, deep = cells[turn, x, size]
                        use = np.flatnonzero(label == x)
                        at = np.searchsorted(low, key[use], "right") - 1
                        inside = (at >= 0) & (low[at] >> (BITS - deep[at]) == key[use] >> (BITS - deep[at]))
                        depth[use[inside]] = deep[at[inside]]
                name = mix64(np.full(len(own), turn * 64, np.uint64) + depth.astype(np.uint64))
                for part in (np.full(len(own), size), label, key >> (BITS - depth)):
                    name = mix64(name ^ part.astype(np.int64).view(np.uint64))
                rows, full = pa.array(own), lambda x: pa.array(np.full(len(own), x, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), full(turn), pa.array(label), full(size), pa.array(depth.astype(np.int32)), pa.array(key), get("node").take(rows), get("code").take(rows), get("error").take(rows)], names=["cell", "pass", "label", "size", "depth", "key", "node", "code", "error"])

    return run


def _cells(active: DataFrame, first: int, passes: int, seed: int, limit: int, turn: Scratch) -> dict:
    """Lowest keys and depths of the parts of cells with more than limit vectors, by pass, label and size."""
    counts = active.mapInArrow(_counts(first, passes, seed), "pass int, label long, size int, depth int, start long, n long")
    crowded: dict = {}
    out: dict = {}
    base: dict = {}
    for r in counts.groupBy("pass", "label", "size", "depth", "start").agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect():
        crowded.setdefault((r["pass"], r.label, r.size), []).append(r.start)
        base[r.label, r.size] = r.depth
    if crowded:
        keys = turn.save(active.mapInArrow(_keys(first, passes, seed, crowded), "pass int, label long, size int, key long, node long"), "keys")
        for r in _windows(keys, limit, turn).select("pass", "label", "size", "depth", "start").distinct().collect():
            own, depth, start = (r["pass"], r.label, r.size), r.depth, r.start
            if depth < base[r.label, r.size]:  # keys that are all equal, so of one cell, and no more than that cell
                start = next(x for x in crowded[own] if x >> (base[r.label, r.size] - depth) == start)
                depth = base[r.label, r.size]
            out.setdefault(own, []).append((start << (BITS - depth), depth))
    return {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for k, v in out.items()}


def _windows(keys: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """keys with depth, start and block: the number of leading bits that a window shares, those bits, and a part of windows
    that no bit divides. A region whose run of equal bits is too long goes as deep as its count and its bits ask for."""
    run = ["pass", "label", "size", "depth", "start"]
    start = F.expr(f"shiftright(key, {BITS} - depth)")
    now = keys.withColumn("depth", F.lit(0)).withColumn("start", F.lit(0).cast("long"))
    done = None
    while True:
        count = now.groupBy(*run).agg(F.count("*").alias("n"), F.expr("bit_or(key)").alias("any"), F.expr("bit_and(key)").alias("all"))
        count = scratch.save(count, "runs")
        both = now.join(count, run)
        fits = F.col("n") <= window
        whole = F.col("any") == F.col("all")
        part = F.when(fits, F.lit(0)).otherwise(F.pmod(F.xxhash64("pass", "node"), F.ceil(F.col("n") / window).cast("long"))).cast("int")
        ready = both.where(fits | whole).select(*run, part.alias("block"), (~fits).alias("cut"), "node")
        ready = scratch.save(ready, "windows")
        done = ready if done is None else done.union(ready)
        if count.where((F.col("n") > window) & (F.col("any") != F.col("all"))).isEmpty():
            return done
        # the first bit by which the run differs, and as many more as its count would ask for if bits halved it; counted in
        # whole numbers, as a logarithm that comes out too large leaves a run at its depth for ever
        differs = F.lit(BITS) - F.length(F.bin(F.expr("any ^ all")))
        deeper = F.least(F.lit(BITS), differs + F.length(F.bin(F.expr(f"(n - 1) div {window}"))))
        now = scratch.save(both.where(~fits & ~whole).select("pass", "label", "size", "key", "node", deeper.alias("depth")).withColumn("start", start), "deeper")


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric matrix."""
    a, b = [], []
    fresh = np.ones(len(near), bool)
    for root in range(len(near)):
        if not fresh[root]:
            continue
        fresh[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            found = np.flatnonzero(near[x] & fresh)
            fresh[found] = False
            todo += found.tolist()
            a.append(np.full(len(found), x))
            b.append(found)
    return np.concatenate(a), np.concatenate(b)


_FOUND = "a long, b long, sure boolean, many boolean, miss double"


def _found(a, b, sure, many, miss):
    n = len(a)
    full = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(np.broadcast_to(x, n), kind)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), full(b, pa.int64()), full(sure, pa.bool_()), full(many, pa.bool_()), full(miss, pa.float64())], names=["a", "b", "sure", "many", "miss"])


def _in_window(node, unit, error, cosine: float, limit: int):
    """Sure and unsure pairs of one window, and which rows have more than limit of them."""
    own = _hits(unit.astype(np.float32), cosine - 2 * error.max() - 1e-5)
    many = np.zeros(len(node), bool)
    if not len(own):
        return [], many
    pairs, many[own] = _pairs_of(node[own], unit[own], error[own], cosine, limit)
    return pairs, many


def _hits(single: np.ndarray, least: float) -> np.ndarray:
    """Rows that have another one at least so near."""
    hit = np.zeros(len(single), bool)
    for k in range(0, len(single), 256):
        near = single[k : k + 256] @ single[k:].T >= least
        np.fill_diagonal(near, False)
        found = np.flatnonzero(near)
        if len(found):
            hit[k + found // near.shape[1]] = hit[k + found % near.shape[1]] = True
    return np.flatnonzero(hit)


def _pairs_of(node, unit, error, cosine: float, limit: int):
    n = len(node)
    single = unit.astype(np.float32)
    sure, count = np.zeros((n, n), bool), np.zeros(n, np.int64)
    out = []
    for k in range(0, n, 512):
        s = single[k : k + 512] @ single.T
        slack = (error[k : k + 512, None] + error[None, :] + 4e-6).astype(np.float32)
        near = s + slack >= cosine
        mine = sure[k : k + 512]
        np.greater_equal(s - slack, cosine, out=mine)
        near[np.arange(len(s)), np.arange(k, k + len(s))] = mine[np.arange(len(s)), np.arange(k, k + len(s))] = False
        count[k : k + 512] = near.sum(axis=1)
        a, b = np.nonzero(near & ~mine)
        a += k
        out.append((a[a < b], b[a < b], False))
    many = count > limit
    crowd = np.flatnonzero(many)
    if len(crowd):
        a, b = _forest(sure[np.ix_(crowd, crowd)])
        out.append((crowd[a], crowd[b], True))
        sure[np.ix_(crowd, crowd)] = False
    if count.any():
        a, b = np.nonzero(sure)
        out.append((a[a < b], b[a < b], True))
    return [(np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), flag) for a, b, flag in out if len(a)], many


def _split(key: np.ndarray, depth: int, window: int):
    """(start, stop, depth) of the windows of a cell's sorted keys, depth being None where no bit parts too many of them."""
    lo, n = 0, len(key)
    while lo < n:
        own = int(key[lo])
        deep = max(depth, BITS + 1 - (own ^ int(key[lo - 1])).bit_length()) if lo else depth
        if lo + window < n:
            deep = max(deep, BITS + 1 - (own ^ int(key[lo + window])).bit_length())
        if deep > BITS:
            hi = int(np.searchsorted(key, own, "right"))
            yield from ((k, min(k + window, hi), None) for k in range(lo, hi, window))
        else:
            last = ((own >> (BITS - deep)) + 1 << (BITS - deep)) - 1
            hi = int(np.searchsorted(key, last, "right"))
            yield lo, hi, deep
        lo = hi


def _compare(cosine: float, many: int, seed: int, window: int, limit: int):
    """Pairs of each window, and for each of its vectors (b null) whether it has very many and the chance of a miss there."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        planes: dict[tuple[int, int], np.ndarray] = {}

        def compared(rows, turn, depth):
            node = rows.column("node").to_numpy()
            unit = _decode(rows.column("code").combine_chunks())
            pairs, crowd = [], np.zeros(len(node), bool)
            if len(node) > 1:
                pairs, crowd = _in_window(node, unit, rows.column("error").to_numpy(), cosine, many)
            for a, b, flag in pairs:
                for k in range(0, len(a), 1 << 16):
                    yield _found(a[k : k + (1 << 16)], b[k : k + (1 << 16)], flag, None, None)
            miss = 1.0
            if depth is not None:
                if (turn, unit.shape[1]) not in planes:
                    planes[turn, unit.shape[1]] = _planes(seed, unit.shape[1], turn)
                miss = _misses(unit, planes[turn, unit.shape[1]][:, :depth], cosine)
            yield _found(node, None, None, crowd, miss)

        def cell(rows, cut):
            """A whole cell, or a part of one that holds more than limit vectors, as its keys are equal."""
            what = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("pass", "label", "size", "depth")])
            if (what != what[:, :1]).any():  # two cells of one name
                _, part = np.unique(what, axis=1, return_inverse=True)
                for k in range(int(part.max()) + 1):
                    yield from cell(rows.take(pa.array(np.flatnonzero(part.ravel() == k))), cut)
                return
            turn, _, _, depth = what[:, 0].tolist()
            key = rows.column("key").to_numpy()
            order = np.argsort(key, kind="stable")
            rows, key = rows.take(pa.array(order)), key[order]
            start = key >> (BITS - depth)
            edges = [0, *(np.flatnonzero(start[1:] != start[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                for lo, hi, deep in _split(key[i:j], depth, window):
                    yield from compared(rows.slice(i + lo, hi - lo), turn, None if cut else deep)

        def held_rows():
            return pa.Table.from_batches(held).combine_chunks()

        last, n, cut = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            edges = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own = int(name[lo])
                if held and own != last:
                    yield from cell(held_rows(), cut)
                    held, n, cut = [], 0, False
                held.append(batch.slice(lo, hi - lo))
                last, n = own, n + hi - lo
                if n > limit:
                    yield from cell(held_rows(), True)
                    held, n, cut = [], 0, True
        if held:
            yield from cell(held_rows(), cut)

    return run


def _verify(cosine: float):
    def run(batches):
        for batch in batches:
            left, right = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("va", "vb"))
            keep = [float((_unit(_unpack([x])) @ _unit(_unpack([y])).T)[0, 0]) >= cosine for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """rows(group, node, asks, blocks, ...) as cells of pairs: each row in its own block of columns, and each row that asks
    in one block of rows for every block of columns."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    own_asks = F.pmod(F.xxhash64("node"), F.col("ask_blocks")).cast("int")
    columns = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("ask_blocks").cast("int") - 1)).alias("i"), own.alias("j"), F.lit(1).alias("side"))
    asking = rows.where("asks").select("*", own_asks.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("j"), F.lit(0).alias("side"))
    return columns.union(asking).groupBy(*group, "i", "j")


def _counted(cosine: float):
    """(node, links): of each asking row, how many rows of the block it links with; of each other row, how many asking ones."""

    def run(table: pa.Table) -> pa.Table:
        side, node, count = (table.column(c).to_numpy() for c in ("side", "node", "count"))
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        unit = _unit(_unpack(table.column("vector").to_pylist()))
        links, back = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for k in range(0, len(x), 512):
            near = (unit[x[k : k + 512]] @ unit[y].T >= cosine) & (node[x[k : k + 512], None] != node[None, y])
            links[k : k + 512] = near @ count[y]
            back += count[x[k : k + 512]] @ near
        other = np.flatnonzero((back > 0) & ~asks[y])
        return pa.table({"node": np.concatenate((node[x], node[y[other]])), "links": np.concatenate((links, back[other]))})

    return run


def _rest_pairs(cosine: float, limit: int):
    """Links of the rows that ask, in one cell; a row with very many is told apart and its links come as a forest."""

    def run(table: pa.Table) -> pa.Table:
        side, node = (table.column(c).to_numpy() for c in ("side", "node"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        if len(x) and len(y):
            unit = _unit(_unpack(table.column("vector").to_pylist()))
            tree = np.arange(len(y))  # of each column, the tree that crowded rows have joined it to
            for k in range(0, len(x), 512):
                own = x[k : k + 512]
                near = (unit[own] @ unit[y].T >= cosine) & (node[own, None] != node[None, y])
                crowd = np.flatnonzero(near.sum(axis=1) > limit)
                out.append(_found(node[own[crowd]], None, None, True, 1e-12))
                for r in crowd:  # one link to each tree holds as much together as all links do
                    linked = np.flatnonzero(near[r])
                    trees, first = np.unique(tree[linked], return_index=True)
                    tree[np.isin(tree, trees)] = trees[0]
                    near[r] = False
                    near[r, linked[first]] = True
                a, b = np.nonzero(near)
                a, b = node[own[a]], node[y[b]]
                out.append(_found(np.minimum(a, b), np.maximum(a, b), True, None, None))
        empty = _found(np.zeros(0, np.int64), None, None, None, None)
        return pa.Table.from_batches(out or [empty])

    return run


def _turns(n, window: int, cosine: float, miss: float):
    """Passes that n vectors need at least, if bits halve them."""
    agree = 1 - math.acos(cosine) / math.pi
    depth = _depth(n, window)
    return F.when(depth <= 0, 1).otherwise(F.ceil(math.log(miss) / F.log(1 - F.pow(F.lit(agree), depth)))).cast("int")


def _depth(n, limit: int):
    """Bits that part n vectors into runs of limit, if each halves them."""
    return F.least(F.greatest(F.ceil(F.log2(n / limit)), F.lit(0)), F.lit(BITS)).cast("int")


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS, most: int = MOST, many: int = MANY, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    Vectors are compared by cosine, in double precision, only where labels and lengths are equal. A vector that is
    null, empty, zero or holds a null or a non-finite component, or whose label is null, links with nothing. n_links
    counts rows, so repeated vectors count each. Rows with equal or null vec_id are vectors of their own; ties in the
    projections share a window or its blocks. Other columns, of any name, are ignored; an empty table gives an empty
    table. A link is missed with a chance of `miss` at most, by the distances of its vectors from their windows' planes; labels
    of up to `window` different vectors lose none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    embedding = F.col("embedding")
    if dict(vectors.dtypes)["embedding"] not in ("array<float>", "array<double>"):
        embedding = embedding.cast("array<double>")
    base = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), embedding.alias("embedding"))
    rows = scratch.save(base.mapInArrow(_clean, "rid long, vec_id long, label long, size int, digest binary, vector binary"), "rows")
    valid = rows.where("size is not null")
    grouped = valid.groupBy("label", "size", "digest").agg(F.min("rid").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("count"))
    grouped = scratch.save(grouped, "classes")
    vector = valid.select(F.col("rid").alias("node"), "vector")
    coded = scratch.save(grouped.select("label", "size", "node").join(vector, "node").mapInArrow(_encode, _CODED), "coded")
    limit = CELL * window
    plain = grouped.groupBy("label", "size").agg(F.count("*").alias("n")).select("label", "size", F.least(_turns(F.col("n"), window, cosine, miss), F.lit(most)).alias("plan"), _depth(F.col("n"), limit // 2).alias("depth"))
    plain = scratch.save(plain, "plan")
    plan, total = plain.agg(F.max("plan")).first()[0], grouped.count()
    found = None

    def run(active: DataFrame, first: int, passes: int) -> DataFrame:
        turn = Scratch(spark, "vector-passes")
        cells = _cells(active, first, passes, seed, limit, turn)
        spots = active.mapInArrow(_project(first, passes, seed, cells), _SPOT).repartition("cell").sortWithinPartitions("cell")
        got = scratch.save(spots.mapInArrow(_compare(cosine, many, seed, window, limit), _FOUND), "found")
        turn.clear()
        return got

    at, rest, seen = 0, None, None
    while plan and at < plan:  # as many passes as a label's count asks for, a few at a time
        step = min(TOGETHER, plan - at)
        active = coded.join(plain, ["label", "size"]).withColumn("passes", F.col("plan") - at).where("passes > 0")
        got = run(active.select(*_COLUMNS, "depth", "passes"), at, step)
        found = got if found is None else found.union(got)
        at += step
    while found is not None:  # and as many as a vector's distances from the planes ask for
        lost = (found if seen is None else got).where("b is null").select(F.col("a").alias("node"), F.log("miss").alias("lost"))
        lost = lost if seen is None else lost.union(seen)
        seen = scratch.save(lost.groupBy("node").agg(F.sum("lost").alias("lost")).where(F.col("lost") > math.log(miss)), "open")
        open_ = seen.select("node")
        left = open_.count()
        if not left or at >= most:
            rest = open_ if left else None
            break
        step = min(at, most - at, TOGETHER * total // left)
        active = scratch.save(coded.join(open_, "node"), "active")
        own = active.groupBy("label", "size").agg(_depth(F.count("*"), limit // 2).alias("depth"), F.lit(step).alias("passes"))
        got = run(active.join(own, ["label", "size"]).select(*_COLUMNS, "depth", "passes"), at, step)
        found = found.union(got)
        scratch.drop(active)
        at += step
    if found is None:
        return _named(rows, None)
    if rest is not None:
        own = grouped.select("label", "size", "node").join(rest, "node").join(vector, "node")
        sizes = own.groupBy("label", "size").agg(F.ceil(F.count("*") / block).alias("blocks"))
        cells = _blocks(own.join(sizes, ["label", "size"]).select("*", F.lit(True).alias("asks"), F.col("blocks").alias("ask_blocks")), ["label", "size"], block)
        found = found.union(scratch.save(cells.applyInArrow(_rest_pairs(cosine, many), _FOUND), "rest"))
    crowded = scratch.save(found.where("many").select(F.col("a").alias("node")).distinct(), "crowded")
    pairs = found.where("b is not null").groupBy("a", "b").agg(F.max("sure").alias("sure"))
    pairs = scratch.save(pairs, "pairs")
    unsure = pairs.where("not sure").select("a", "b")
    with_ = lambda c, v: vector.select(F.col("node").alias(c), F.col("vector").alias(v))
    checked = unsure.join(with_("a", "va"), "a").join(with_("b", "vb"), "b").mapInArrow(_verify(cosine), "a long, b long")
    links = scratch.save(pairs.where("sure").select("a", "b").union(checked), "links")
    of = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    comp = scratch.save(grouped.select("node", "least", "count").join(of, "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    # of vectors with many links only a part is written as pairs: these are counted
    dense = comp.join(crowded, "node").groupBy("component").agg(F.count("*").alias("asking"))
    members = comp.join(dense, "component").join(crowded.withColumn("asks", F.lit(True)), "node", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).alias("blocks"), F.ceil(F.first("asking") / block).alias("ask_blocks"))
    cells = _blocks(members.select("component", "node", "count", "asks").join(sizes, "component").join(vector, "node"), ["component"], block)
    exact = cells.applyInArrow(_counted(cosine), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    exact = scratch.save(exact, "dense")
    count = comp.select("node", "count")
    both = links.select("a", "b").union(links.select("b", "a"))
    # and so are their links at the other end
    listed = both.join(crowded.select(F.col("node").alias("a")), "a", "left_anti").join(crowded.select(F.col("node").alias("b")), "b", "left_anti")
    listed = listed.join(count.select(F.col("node").alias("b"), "count"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("count").alias("plain"))
    least = comp.groupBy("component").agg(F.min("least").alias("component_id"))
    known = comp.join(listed, "node", "left").join(exact, "node", "left").join(least, "component")
    known = known.select("node", (F.coalesce("links", F.lit(0)) + F.coalesce("plain", F.lit(0)) + F.col("count") - 1).cast("long").alias("n_links"), "component_id")
    return _named(rows, grouped.select("label", "size", "digest", "node").join(known, "node"))


def _named(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        out = rows.select("vec_id", F.lit(0).alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    else:
        out = rows.join(known.select("label", "size", "digest", "n_links", "component_id"), ["label", "size", "digest"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
