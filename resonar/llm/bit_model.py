"""A bitwise model of words: hashed-context predictors mixed in the logistic domain.

A word is coded byte by byte and bit by bit, with a space after it. For each bit several predictors look up how often
it was 0 and 1 after the same bits of this byte and a context: the place in the word, the last one to four bytes, and
the whole word so far. Counts of the last are exact: words stand sorted, so those that share a prefix are a run. A gate,
set by how much that last context has been seen and by the bit's place, picks the weights that combine the predictions;
an adaptive map refines the result. Weights and map are learnt online, chunk by chunk.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

from .common import mix64, splitmix

#: log2 of the slots of each context's table: place in the word, last byte, last two, three, four bytes.
TABLE_BITS = (12, 16, 18, 20, 20)
OFFSET = np.cumsum([0, *(1 << b for b in TABLE_BITS)])
SLOTS = int(OFFSET[-1])
#: First bytes of words that Heads tells apart, and the most bytes of a place at which the sorted vocabulary is cut.
HEAD, CUT = 3, 256
INPUTS = len(TABLE_BITS) + 2
LEVELS, MAP = 10, 33
GATES = LEVELS * 8
CHUNK = 1 << 13
RATE, MAP_RATE = 0.02, 0.02

_NODE = splitmix(53, 256)
_ORDER = splitmix(54, 8)
#: What stands for the end of a text: no word holds it.
END = b"\n"


class Flat:
    """Bytes of words with a space after each, and the context hashes of every byte."""

    def __init__(self, words: list[bytes]):
        size = np.array([len(w) for w in words], np.int64) + 1
        self.start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        self.owner = np.repeat(np.arange(len(words)), size)
        b = self.bytes = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        n = len(b)
        place = np.arange(n) - self.start[self.owner]
        last = np.zeros(n, np.uint64)
        self.context = [mix64(np.minimum(place, 15).astype(np.uint64) ^ _ORDER[0])]
        for k in range(1, 5):
            back = np.zeros(n, np.uint64)
            back[k:] = b[:-k] if k < n else b[:0]
            back[place < k] = 0
            last |= back << np.uint64(8 * (k - 1))
            self.context.append(mix64(last ^ _ORDER[k]))

    def bits(self):
        """(bit's place, slots in the joint table for each context, bit) for each of the eight bits."""
        node = np.ones(len(self.bytes), np.int64)
        for k in range(8):
            mark = _NODE[node]
            slots = [((c ^ mark) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - bits)).astype(np.int64) + OFFSET[j] for j, (c, bits) in enumerate(zip(self.context, TABLE_BITS, strict=True))]
            bit = (self.bytes >> (7 - k)) & 1
            yield k, slots, bit
            node = node * 2 + bit


def chunks(words: list[bytes], limit: int = CHUNK):
    start = total = 0
    for k, w in enumerate(words):
        if total and total + len(w) + 1 > limit:
            yield start, k
            start, total = k, 0
        total += len(w) + 1
    if start < len(words):
        yield start, len(words)


def prefix_counts(data: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[bit's place, byte, 0 or 1]: how many of all occurrences n that share all bits before go on with a 0 or a 1.

    Strings are bytes data[start : start + size] and stand sorted. A string that shares its prefix with no other counts
    by itself, so only bytes at which strings are still together are looked at one by one.
    """
    out = np.zeros((8, len(data), 2), np.float32)
    weight = n.astype(np.float64)
    whole = np.repeat(weight, size)
    every = np.arange(len(data))
    for k in range(8):
        out[k, every, (data >> (7 - k)) & 1] = whole
    own, group, j = np.arange(len(start)), np.zeros(len(start), np.int64), 0
    while len(own):
        at = start[own] + j
        key = (group << 8) | data[at]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        run = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
        many, value = np.add.reduceat(weight[own], new), key[new]
        for k in range(8):
            lead = value >> (8 - k)
            first = np.flatnonzero(np.diff(lead, prepend=-1))
            part = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(lead))))
            ones = np.add.reduceat(many * ((value >> (7 - k)) & 1), first)
            out[k, at, 1] = ones[part][run]
            out[k, at, 0] = (np.add.reduceat(many, first) - ones)[part][run]
        j += 1
        on = (np.bincount(run)[run] > 1) & (size[own] > j)
        own, group = own[on], run[on]
    return out


def shared_bits(data: np.ndarray, start: np.ndarray, size: np.ndarray, cuts: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How many first bits each string data[start : start + size] has in common with row `which` of cuts, of that length."""
    many = np.minimum(size, length[which])
    owner = np.repeat(np.arange(len(start)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    differ = data[start[owner] + place] ^ cuts[which[owner], place]
    at = np.flatnonzero(differ)
    at = at[np.diff(owner[at], prepend=-1) > 0]  # the first of each string
    out = 8 * many
    out[owner[at]] = 8 * place[at] + 8 - np.frexp(differ[at].astype(np.float64))[1]
    return out


class Borders:
    """Where the sorted vocabulary is cut into pieces, and what words of other pieces add to a piece's prefix counts.

    cuts are sorted byte strings; piece p holds the words, with the space after them, from cut p - 1 on and before cut p.
    Only prefixes of a piece's two cuts go beyond it, so of each cut it is enough to know below[m] and above[m]: how often
    words before it, and from it on, occur that have its first m bits. Its size is that of the cuts, not of the vocabulary.
    """

    def __init__(self, cuts: list[bytes]):
        self.cuts = cuts
        self.length = np.array([len(c) for c in cuts], np.int64)
        self.bytes = np.zeros((len(cuts), max(map(len, cuts), default=0)), np.uint8)
        for k, c in enumerate(cuts):
            self.bytes[k, : len(c)] = np.frombuffer(c, np.uint8)
        self.below = self.above = [np.zeros(1)] * len(cuts)

    def pieces(self, words: list[bytes]) -> np.ndarray:
        return np.array([bisect_right(self.cuts, w + b" ") for w in words], np.int64)

    def edges(self, words: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, occurrences): a code stands for a cut, its side and how many first bits words beside it share with it."""
        piece = self.pieces(words)
        keys = [(w + b" ")[:CUT] for w in words]
        size = np.array([len(k) for k in keys], np.int64)
        start, data = np.cumsum(size) - size, np.frombuffer(b"".join(keys), np.uint8)
        codes, counts = [], []
        for side in (0, 1):  # words before the cut, and from it on
            own = np.flatnonzero(piece > 0 if side else piece < len(self.cuts))
            cut = piece[own] - side
            codes.append((2 * cut + side) * (8 * CUT + 1) + shared_bits(data, start[own], size[own], self.bytes, self.length, cut))
            counts.append(n[own])
        return summed(np.concatenate(codes), np.concatenate(counts))

    def set_edges(self, code: np.ndarray, n: np.ndarray) -> None:
        """Sets below and above from all codes; words of pieces further off share what the cuts between share too."""
        many = len(self.cuts)
        place, bits = np.divmod(code, 8 * CUT + 1)
        order = np.argsort(place, kind="stable")
        edge = np.searchsorted(place[order], np.arange(2 * many + 1))
        start = np.arange(many) * self.bytes.shape[1]
        alike = np.zeros(many + 1, np.int64)  # of each cut and the one before it
        if many > 1:
            alike[1:many] = shared_bits(self.bytes.ravel(), start[1:], self.length[1:], self.bytes, self.length, np.arange(many - 1))

        def gathered(k: int, side: int, far: np.ndarray, common: int) -> np.ndarray:
            own = order[edge[2 * k + side] : edge[2 * k + side + 1]]
            direct = np.bincount(bits[own], n[own], 1)[::-1].cumsum()[::-1]
            far = far[: common + 1]
            out = np.zeros(max(len(direct), len(far)))
            out[: len(direct)] = direct
            out[: len(far)] += far
            return out

        self.below, self.above = [], []
        for k in range(many):
            self.below.append(gathered(k, 0, self.below[-1] if k else np.zeros(1), alike[k]))
        for k in reversed(range(many)):
            self.above.append(gathered(k, 1, self.above[-1] if k < many - 1 else np.zeros(1), alike[k + 1]))
        self.above.reverse()

    def in_order(self, words: list[bytes], n: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words of whole pieces sorted by their bytes with the space after them, n and prefix counts in all of the vocabulary."""
        order = np.array(sorted(range(len(words)), key=[w + b" " for w in words].__getitem__), np.int64)
        words, n = [words[k] for k in order], n[order]
        keys = [w + b" " for w in words]
        size = np.array([len(k) for k in keys], np.int64)
        end = np.concatenate(([0], np.cumsum(size)))
        seen = np.empty((8, int(end[-1]), 2), np.float32)
        lo = 0
        while lo < len(words):
            piece = bisect_right(self.cuts, keys[lo])
            hi = len(keys) if piece == len(self.cuts) else bisect_left(keys, self.cuts[piece], lo)
            data = np.frombuffer(b"".join(keys[lo:hi]), np.uint8)
            start = end[lo:hi] - end[lo]
            own = seen[:, end[lo] : end[hi]]
            own[:] = prefix_counts(data, start, size[lo:hi], n[lo:hi])
            if piece:
                self._add(own, data, start, size[lo:hi], piece - 1, self.below[piece - 1], False)
            if piece < len(self.cuts):
                self._add(own, data, start, size[lo:hi], piece, self.above[piece], True)
            lo = hi
        return words, n, seen

    def _add(self, counts, data, start, size, cut: int, outside: np.ndarray, last: bool) -> None:
        """Adds what words beyond a cut count for. Words that share most with it are a piece's first ones, or its last."""
        shared = shared_bits(data, start, size, self.bytes, self.length, np.full(len(start), cut))
        if not last:
            shared = shared[::-1]
        for m in range(len(outside)):
            many = len(shared) - int(np.searchsorted(shared, m))
            if not many or not outside[m]:
                break
            byte, bit = divmod(m, 8)
            at = (start[len(start) - many :] if last else start[:many]) + byte
            on = outside[m + 1] if m + 1 < len(outside) else 0.0
            same = self.bytes[cut, byte] >> (7 - bit) & 1
            counts[bit, at, same] += on
            counts[bit, at, 1 - same] += outside[m] - on


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and the sum of n of each."""
    own, back = np.unique(code, return_inverse=True)
    return own, np.bincount(back, n, len(own)).astype(np.int64)


class Heads:
    """How often each first HEAD bytes of a word, with the space after it, occur: for words that come with all others of
    their head, where Borders serves pieces of any size. At most 256 ** HEAD rows."""

    def __init__(self, heads: list[bytes], n: list[int]):
        order = sorted(range(len(heads)), key=heads.__getitem__)
        self.value = np.array([int.from_bytes(heads[k]) for k in order], np.int64)
        self.before = np.concatenate(([0.0], np.cumsum([n[k] for k in order])))

    def put(self, flat: Flat, counts: np.ndarray) -> None:
        """Sets the counts of all words' first bytes, for which a task's own words are not enough."""
        size = np.diff(np.append(flat.start, len(flat.bytes)))
        head = np.zeros(len(size), np.int64)
        for j in range(HEAD):
            head = head << 8 | np.where(size > j, flat.bytes[np.minimum(flat.start + j, len(flat.bytes) - 1)], 0)
        own, back = np.unique(head, return_inverse=True)
        up_to = lambda x: self.before[np.searchsorted(self.value, x)]
        for j in range(HEAD):
            there = np.flatnonzero(size > j)
            for k in range(8):
                rest = 8 * HEAD - 8 * j - k
                low = own >> rest << rest
                edges = [up_to(low + half) for half in (0, 1 << (rest - 1), 1 << rest)]
                for bit in (0, 1):
                    counts[k, flat.start[there] + j, bit] = (edges[bit + 1] - edges[bit])[back[there]]


def _stretch(zeros, ones, at_start):
    return np.log(ones + at_start) - np.log(zeros + at_start)


class BitModel:
    def __init__(self):
        self.table = None
        # to begin with the longest context that has been seen decides
        self.weight = np.tile(np.array([0.0, 0.0, 0.1, 0.3, 0.6, 1.0, 0.0]), (GATES, 1))
        self.weight[8:, : len(TABLE_BITS)] = 0.0
        self.moved, self.mass, self.turns = np.full((GATES, INPUTS), 1e-3), np.zeros(GATES), 0
        self.map_hits = np.full((LEVELS, MAP), 1e-9)
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, MAP))), (LEVELS, 1))
        self.seen = 0.0

    def count(self, words: list[bytes], counts: np.ndarray, joint: np.ndarray) -> None:
        """Adds what these words show to the joint tables; entry 2 * slot + bit."""
        for lo, hi in chunks(words, 1 << 17):
            flat = Flat(words[lo:hi])
            weight = counts[lo:hi][flat.owner].astype(np.float64)
            for _, slots, bit in flat.bits():
                for s in slots:
                    np.add.at(joint, 2 * s + bit, weight)

    def set_tables(self, joint: np.ndarray) -> None:
        both = joint.reshape(-1, 2)
        self.table = _stretch(both[:, 0], both[:, 1], 0.4).astype(np.float16)

    def _inputs(self, k, slots, seen, bit, left_out):
        if left_out:  # what a word's own occurrence adds is not known before it is read
            seen = np.maximum(seen - np.stack((1 - bit, bit), axis=1), 0)
        total = seen.sum(axis=1)
        x = np.empty((len(bit), INPUTS), np.float32)
        for j, s in enumerate(slots):
            x[:, j] = self.table[s]
        x[:, -2] = _stretch(seen[:, 0], seen[:, 1], np.float32(0.02)) * (total > 0)
        x[:, -1] = 0.3
        level = np.minimum(np.log2(total + 1).astype(np.int64) // 2 + (total > 0), LEVELS - 1)
        return x, level, level * 8 + k

    def _mixed(self, x, level, gate):
        z = np.clip((x * self.weight[gate]).sum(axis=1), -16, 16)
        p = 1 / (1 + np.exp(-z))
        at = np.rint((np.clip(z, -8, 8) + 8) * ((MAP - 1) / 16)).astype(np.int64)
        share = 0.5 / (1 + level)  # contexts seen often need the map least
        return p, at, np.clip(p + share * np.where(np.abs(z) < 8, self.map[level, at] - p, 0), 1e-7, 1 - 1e-7)

    def learn(self, words: list[bytes], counts: np.ndarray, seen: np.ndarray) -> None:
        """One online pass over words, each weighing its count; words without a count teach nothing. seen: prefix_counts
        of the words' bytes, those of each word together.

        A gate's step is measured by the mass that a chunk brings it on average so far, so a chunk with a frequent word
        counts for more, as its occurrences would one by one.
        """
        done = 0
        for lo, hi in chunks(words):
            flat = Flat(words[lo:hi])
            own = seen[:, done : done + len(flat.bytes)]
            done += len(flat.bytes)
            weight = counts[lo:hi].astype(np.float64)[flat.owner]
            self.turns += 1
            if not weight.sum():
                continue
            for k, slots, bit in flat.bits():
                x, level, gate = self._inputs(k, slots, own[k], bit, True)
                p, at, _ = self._mixed(x, level, gate)
                mass = np.bincount(gate, weight, GATES)
                slope = weight * (bit - p)
                step = np.stack([np.bincount(gate, slope * x[:, j], GATES) for j in range(INPUTS)], axis=1)
                self.mass[k::8] += (mass[k::8] - self.mass[k::8]) / self.turns
                step /= np.maximum(self.mass, 1e-9)[:, None]
                self.moved += step * step
                self.weight += RATE * step / np.sqrt(self.moved)
                cell = level * MAP + at
                hit = np.bincount(cell, weight, LEVELS * MAP)
                mean = np.bincount(cell, weight * bit, LEVELS * MAP) / np.maximum(hit, 1e-9)
                hit = hit.reshape(LEVELS, MAP)
                self.map_hits += hit
                self.map += np.where(hit > 0, np.maximum(hit / self.map_hits, MAP_RATE * 0.01), 0) * (mean.reshape(LEVELS, MAP) - self.map)
            self.seen += weight.sum()

    def bits(self, words: list[bytes], seen: np.ndarray) -> np.ndarray:
        """Bits that each word costs."""
        out, at = [], 0
        for lo, hi in chunks(words, 1 << 15):
            flat = Flat(words[lo:hi])
            own = seen[:, at : at + len(flat.bytes)]
            at += len(flat.bytes)
            cost = np.zeros(len(flat.bytes))
            for k, slots, bit in flat.bits():
                _, _, q = self._mixed(*self._inputs(k, slots, own[k], bit, False))
                cost -= np.log2(np.where(bit == 1, q, 1 - q))
            out.append(np.add.reduceat(cost, flat.start))
        return np.concatenate(out) if out else np.zeros(0)


def in_order(words: list[bytes], n: np.ndarray, heads: Heads) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words sorted by their bytes with the space after them, their numbers, n and prefix counts. words hold all words
    that share their first HEAD bytes with one of them."""
    order = np.array(sorted(range(len(words)), key=[w + b" " for w in words].__getitem__), np.int64)
    words, n = [words[k] for k in order], n[order]
    flat = Flat(words)
    seen = prefix_counts(flat.bytes, flat.start, np.diff(np.append(flat.start, len(flat.bytes))), n)
    heads.put(flat, seen)
    return words, order, n, seen
