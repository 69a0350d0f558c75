"""Bounded memory of encoded text pieces, and the quick exact split that feeds it.

Byte-level BPE splits text by a pattern before it merges. A space that stands before a character
other than white space always opens a new match of that pattern, and so does a line feed between two
such characters. Text can therefore be cut there with `str.split` and every piece encoded alone.
Texts with other white space at those places raise `Odd` and take the plain path.
"""

from __future__ import annotations

from collections.abc import Callable


class Odd(Exception):
    """A piece whose borders are not safe."""


class Memo(dict):
    """Two generations of at most `limit` entries; the older one goes when the younger is full."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def put(self, key, value):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self.put(key, value)
        return value


def cut(text: str) -> tuple[str, list[str]]:
    """The first piece and the others, those without their leading space."""
    first, *rest = text.replace("\n", " \n").split(" ")
    if first and first[-1].isspace():
        raise Odd
    return first, rest


def whole(key: str) -> str:
    """The text of a later piece, or `Odd`."""
    if not key or key[-1].isspace():
        raise Odd
    if key[0] == "\n":
        if key[1].isspace():
            raise Odd
        return key
    if key[0].isspace():
        raise Odd
    return " " + key
