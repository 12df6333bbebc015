"""Keys with, for each of their characters, the span of the text that it came from."""

from __future__ import annotations

from dataclasses import dataclass, field

Span = tuple[int, int]


@dataclass
class Key:
    text: str
    kind: str
    spans: list[Span | None] | None = None


@dataclass
class Mapped:
    """Text being built, with a span or None for each character."""

    text: str = ""
    spans: list[Span | None] = field(default_factory=list)

    def add(self, piece: str, span: Span | None) -> None:
        self.text += piece
        self.spans += [span] * len(piece)

    def fits(self, piece: str, budget: int) -> bool:
        return len(self.text.encode()) + len(piece.encode()) <= budget and len(self.spans) + len(piece) <= budget


def join(pieces: list[tuple[str, Span]], separator: str, kind: str, budget: int) -> Key | None:
    """One key of pieces; None where it would exceed budget bytes or characters."""
    out = Mapped()
    for k, (piece, span) in enumerate(pieces):
        gap = separator if k else ""
        if not out.fits(gap + piece, budget):
            return None
        out.add(gap, None)
        out.add(piece, span)
    return Key(out.text, kind, out.spans)


class KeyList:
    """Keys without repeats, at most `most` of them and `budget` bytes."""

    def __init__(self, most: int, budget: int, by_kind: bool):
        self.keys: list[Key] = []
        self.most, self.budget, self.by_kind = most, budget, by_kind

    @property
    def left(self) -> int:
        return max(0, self.budget - sum(len(k.text.encode()) for k in self.keys))

    def push(self, key: Key | None) -> None:
        if key is None or len(self.keys) >= self.most:
            return
        if not any(k.text == key.text and (k.kind == key.kind or not self.by_kind) for k in self.keys):
            self.keys.append(key)
