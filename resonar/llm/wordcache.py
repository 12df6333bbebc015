"""A bounded map kept by each Python worker: the older half goes when it is full."""

from __future__ import annotations


class WordCache(dict):
    """Keys looked up since the last turn survive; at most 2 * half entries stay."""

    def __init__(self, half: int = 200_000):
        super().__init__()
        self.half, self.old = half, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError: unknown
        self[key] = value
        return value

    def lacking(self, keys) -> list:
        """Keys, each once, for which there is no value yet."""
        old = self.old
        return [k for k in {k for k in keys if k not in self} if k not in old]

    def turn(self) -> None:
        """Call between texts: makes the present half the old one when it is full."""
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()
