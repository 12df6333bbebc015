"""A static range asymmetric numeral system over token ids, in numpy.

One table of frequencies serves all blocks. A block's tokens are dealt out to lanes in turn; all lanes of all blocks at
hand take a step at once. A lane's state stays in [2**31, 2**63) and sheds 32 bits at a time into the block's one stream of
words. At every checkpoint the lanes' states and the place in the stream are kept, so that what follows it can be decoded
without what precedes it; checkpoints are decoded side by side.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Frequencies add up to two to the power of this.
BITS = 20
TOTAL = 1 << BITS
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_BITS = np.uint64(BITS)
_MASK = np.uint64(TOTAL - 1)


class Table:
    """Frequencies of ids that add up to TOTAL; ids that never occur have none and cannot be encoded."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        if int(self.freq.sum()) != TOTAL:
            raise ValueError("frequencies do not add up")
        self.before = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self._ids = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Frequencies in proportion to counts, at least 1 where an id occurs; roundings go by largest remainder."""
        seen = np.flatnonzero(counts)
        if not 0 < len(seen) <= TOTAL // 2:
            raise ValueError(f"a table holds 1 to {TOTAL // 2} ids")
        exact = counts[seen] * ((TOTAL - len(seen)) / counts[seen].sum())
        own = np.floor(exact).astype(np.int64)
        short = TOTAL - len(seen) - int(own.sum())
        order = np.lexsort((seen, own - exact))
        own[order[:short]] += 1
        freq = np.zeros(len(counts), np.int64)
        freq[seen] = own + 1
        return cls(freq)

    @property
    def ids(self) -> np.ndarray:
        """The id of each slot."""
        if self._ids is None:
            self._ids = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._ids

    def to_bytes(self) -> bytes:
        data = self.freq.astype("<u4").tobytes()
        return struct.pack("<4sII", b"RTAB", len(self.freq), zlib.crc32(data)) + data

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        magic, n, crc = struct.unpack_from("<4sII", data)
        body = data[12:]
        if magic != b"RTAB" or len(body) != 4 * n or zlib.crc32(body) != crc:
            raise ValueError("the frequency table is damaged")
        return cls(np.frombuffer(body, "<u4"))


def encode(table: Table, ids: np.ndarray, every: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of ids (blocks, steps, lanes): states (checkpoints, lanes), places (checkpoints), and words.

    There is a checkpoint before each step that `every` divides.
    """
    blocks, steps, lanes = ids.shape
    x = np.full((blocks, lanes), _LOW)
    shed = np.zeros((steps, blocks, lanes), bool)
    words = np.zeros((steps, blocks, lanes), np.uint32)
    states = []
    for t in range(steps - 1, -1, -1):  # the decoder goes forward
        own = ids[:, t]
        f, c = table.freq[own], table.before[own]
        if not f.all():
            raise ValueError("an id that the table lacks")
        full = x >= f << np.uint64(63 - BITS)
        shed[t], words[t] = full, x.astype(np.uint32)
        x = np.where(full, x >> _WORD, x)
        q = x // f
        x = (q << _BITS) + (x - q * f) + c
        if t % every == 0:
            states.append(x)
    states = np.stack(states[::-1], 1)
    sums = np.concatenate((np.zeros((1, blocks), np.int64), np.cumsum(shed.sum(2), axis=0)))
    places = sums[0:steps:every].T
    return [(states[b], places[b], words[:, b][shed[:, b]]) for b in range(blocks)]


def decode(table: Table, states: np.ndarray, places: np.ndarray, words: np.ndarray, steps: int) -> np.ndarray:
    """ids (segments, steps, lanes) from the checkpoints (segments, lanes) on; places are those in words.

    Steps beyond a block's end give ids without meaning.
    """
    x, at = states.astype(np.uint64), places.astype(np.int64)
    out = np.empty((len(x), steps, x.shape[1]), np.uint32)
    words = np.append(words, np.uint32(0))
    for t in range(steps):
        slot = x & _MASK
        own = table.ids[slot.astype(np.int64)]
        out[:, t] = own
        x = table.freq[own] * (x >> _BITS) + slot - table.before[own]
        less = x < _LOW
        nth = np.cumsum(less, axis=1)
        take = np.minimum(at[:, None] + nth - 1, len(words) - 1)
        x = np.where(less, (x << _WORD) | words[take], x)
        at += nth[:, -1]
    return out
