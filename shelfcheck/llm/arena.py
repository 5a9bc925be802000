"""Token ids of text pieces, looked up by whole arrays.

A text is the concatenation of pieces whose ids don't depend on their neighbours, and most pieces occur again and
again, so each piece is encoded once and then copied. The tables are kept for the life of a Python worker and bounded:
when the younger one is full it becomes the older one, whose pieces move back as they are met and are else forgotten.
What comes out doesn't depend on what is remembered.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Sequence
from itertools import chain, repeat

import numpy as np


def kept_by_worker(key: Hashable, make: Callable):
    """One object per key and Python process: a reused worker finds what an earlier task made."""
    home = sys.modules.setdefault("_training_data_worker", types.ModuleType("_training_data_worker"))
    if key not in home.__dict__.setdefault("held", {}):
        home.held[key] = make()
    return home.held[key]


class Recent:
    """A mapping of bounded size that keeps what is asked for."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if 2 * len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class _Table:
    """Pieces and their ids, one piece after the other in growing arrays."""

    def __init__(self):
        self.slot = {}
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.used = 0

    def find(self, pieces: list) -> np.ndarray:
        """Slot of each piece, -1 if it isn't here."""
        return np.fromiter(map(self.slot.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list, size: np.ndarray, ids: np.ndarray) -> None:
        at = len(self.slot)
        for name, need in (("start", at + len(pieces)), ("size", at + len(pieces)), ("ids", self.used + len(ids))):
            if need > len(old := getattr(self, name)):
                grown = np.zeros(max(need, 2 * len(old)), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.start[at : at + len(pieces)] = self.used + np.cumsum(size) - size
        self.size[at : at + len(pieces)] = size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slot.update(zip(pieces, range(at, at + len(pieces))))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[at] - ends + size, size) + np.arange(total)], size


def flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(length of each list, all their values)."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return size, np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))


class Pieces:
    """`encode`: from distinct pieces to (number of ids of each, all ids)."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.young, self.old = _Table(), _Table()

    def _learn(self, pieces: list) -> None:
        at = self.old.find(pieces)
        here = at >= 0
        if here.any():
            ids, size = self.old.gather(at[here])
            self.young.add([p for p, h in zip(pieces, here.tolist()) if h], size, ids)
            pieces = [p for p, h in zip(pieces, here.tolist()) if not h]
        if pieces:
            self.young.add(pieces, *self.encode(pieces))

    def lookup(self, pieces: list, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each piece). With `of`, those of the pieces that it numbers."""
        if 2 * len(self.young.slot) >= self.most or self.young.used > 8 * self.most:
            self.old, self.young = self.young, _Table()
        at = self.young.find(pieces)
        if len(missing := np.flatnonzero(at < 0)):
            absent = [pieces[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(absent)))
            at[missing] = self.young.find(absent)
        return self.young.gather(at if of is None else at[of])
