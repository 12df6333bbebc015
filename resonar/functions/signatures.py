"""Maps of 64 bits of a text's characters and pairs of neighbours, which a text that matches a pattern must cover.

A text that holds a pattern as a subsequence has every character of it, and twice where the pattern has it twice; one that
holds it in one piece also has its pairs of neighbours. Different characters may share a bit, so a map can only fail to
rule a text out. Characters count as folded.
"""

from __future__ import annotations

import numpy as np

from .batch import Texts
from .scorers import DOTTED

#: Bits 0-25 say that a letter occurs, 26-51 that it occurs twice; other ASCII characters share 12 bits, all others all 64.
_BIT = np.zeros(128, np.uint8)
_BIT[:] = 52 + np.arange(128) % 12
_BIT[ord("a") : ord("z") + 1] = np.arange(26)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bits(points: np.ndarray) -> np.ndarray:
    wide = points.astype(np.uint64)
    out = (wide * _MIX) >> np.uint64(58)
    plain = points < 128
    out[plain] = _BIT[points[plain]]
    return np.uint64(1) << out


def _gathered(bits: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of bits of each row."""
    if not len(start):
        return np.zeros(0, np.uint64)
    out = np.bitwise_or.reduceat(np.append(bits, np.uint64(0)), start)
    return np.where(end > start, out, np.uint64(0))


def signatures(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the map of its characters and that of its pairs. Texts with a dotted capital I, which may be spelt in
    two ways, have all bits."""
    f, start, end = texts.lower, texts.start, texts.end
    row = np.repeat(np.arange(len(start)), end - start)
    f = f[: len(row)]
    chars = _gathered(_bits(f), start, end)
    letter = (f >= ord("a")) & (f <= ord("z"))
    counts = np.bincount(row[letter] * 26 + f[letter].astype(np.int64) - ord("a"), minlength=26 * len(start)).reshape(-1, 26)
    chars |= ((counts > 1).astype(np.uint64) << np.arange(26, 52, dtype=np.uint64)).sum(1, dtype=np.uint64)
    mixed = np.zeros(len(row), np.uint64)
    if len(row) > 1:
        pair = (f[:-1].astype(np.uint64) << np.uint64(21)) | f[1:].astype(np.uint64)
        mixed[:-1] = np.where(row[:-1] == row[1:], np.uint64(1) << ((pair * _MIX) >> np.uint64(58)), np.uint64(0))
    pairs = _gathered(mixed, start, end)
    if texts.data.dtype != np.uint8:
        dotted = texts.places(True, ord(DOTTED))[:-1]
        at = np.searchsorted(end, dotted, side="right")
        chars[at] = pairs[at] = _ALL
    return chars, pairs
