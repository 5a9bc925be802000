"""A bidirectional FM-index over a sorted list of words, and the search for words at one edit.

The words stand between delimiters in one text, which is indexed forwards and, with every word reversed, backwards. A
pattern is a pair of intervals of suffix ranks, one in either index, of one length; adding a symbol on the left steps
in the forward index and narrows the other interval, adding one on the right does the opposite.

Delimiters sort before all symbols and among themselves by place. As both texts hold their words in order, the rank of
the suffix that begins with the delimiter before a word is the number of that word, so nothing has to be located.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Queries that walk the index together; bounds the work arrays.
TOGETHER = 2048


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Places of `text` in the order of their suffixes. 0 is the delimiter; the last symbol is one. Of suffixes that are
    equal up to their next delimiter the earlier comes first."""
    n, bits = len(text), max(1, int(symbols).bit_length())
    width = 63 // bits
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, np.int64)])
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(width):
        now = padded[j : j + n]
        key = (key << bits) | np.where(alive, now, 0)
        alive &= now != 0
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ~alive[order[1:]]
    places, step = np.arange(n), width
    rank = np.empty(n, np.int64)
    while True:
        rank[order] = np.maximum.accumulate(np.where(new, places, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        those = order[at]
        # No delimiter lies within the first `step` symbols of these suffixes.
        later, own = rank[those + step], rank[those]
        turn = np.lexsort((later, own))
        those, later, own = those[turn], later[turn], own[turn]
        order[at] = those
        new[at] = np.concatenate([[True], (own[1:] != own[:-1]) | (later[1:] != later[:-1])])
        step *= 2


class Ranks:
    """How many symbols below a bound stand in a prefix of the transformed text: counts per 64 symbols, and their bits."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text, symbols)
        before = text[order - 1].astype(np.int64)
        before[order == 0] = symbols + 1  # nothing stands before the first
        n = len(text)
        blocks = n // 64 + 1
        self.bits = np.empty((blocks, symbols + 2), np.uint64)
        self.counts = np.zeros((blocks, symbols + 2), np.int32)
        padded = np.full(blocks * 64, symbols + 1, np.int64)
        padded[:n] = before
        for bound in range(symbols + 2):
            self.bits[:, bound] = np.packbits(padded < bound, bitorder="little").view(np.uint64)
        self.counts[1:] = np.cumsum(np.bitwise_count(self.bits[:-1]), axis=0, dtype=np.int32)

    def below(self, place: np.ndarray, bound: np.ndarray) -> np.ndarray:
        block, left = place >> 6, _ones(place)
        return self.counts[block, bound] + np.bitwise_count(self.bits[block, bound] & left)

    def below_each(self, place: np.ndarray) -> np.ndarray:
        block, left = place >> 6, _ones(place)
        return self.counts[block] + np.bitwise_count(self.bits[block] & left[:, None])


def _ones(place: np.ndarray) -> np.ndarray:
    """As many low bits as places stand before `place` in its block."""
    return (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)


class Index:
    """Bidirectional index of distinct words that hold no NUL. `alphabet`: sorted code points that queries may hold."""

    def __init__(self, words: list[str], alphabet: np.ndarray):
        self.order = sorted(range(len(words)), key=words.__getitem__)
        self.alphabet = alphabet
        ahead = sorted(words)
        back = sorted(w[::-1] for w in words)
        texts = [self.symbols("\0" + "\0".join(ws) + "\0") for ws in (ahead, back)]
        self.ahead, self.back = (Ranks(t, len(alphabet)) for t in texts)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(texts[0], minlength=len(alphabet) + 1))])

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.where(points == 0, 0, np.searchsorted(self.alphabet, points) + 1)

    def one(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of single symbols: start ahead, start backwards, length."""
        return self.first[symbol], self.first[symbol].copy(), self.first[symbol + 1] - self.first[symbol]

    def _step(self, ranks: Ranks, lo, other, size, symbol):
        a, b = ranks.below(lo, symbol), ranks.below(lo, symbol + 1)
        c, d = ranks.below(lo + size, symbol), ranks.below(lo + size, symbol + 1)
        return self.first[symbol] + (b - a), other + (c - a), (d - c) - (b - a)

    def left(self, lo, back, size, symbol):
        return self._step(self.ahead, lo, back, size, symbol)

    def right(self, lo, back, size, symbol):
        back, lo, size = self._step(self.back, back, lo, size, symbol)
        return lo, back, size

    def right_each(self, lo, back, size):
        """As `right` for every symbol from 0 on: arrays of (pattern, symbol)."""
        a, c = self.back.below_each(back), self.back.below_each(back + size)
        sizes = np.diff(c, axis=1) - np.diff(a, axis=1)
        return lo[:, None] + (c - a)[:, :-1], self.first[:-1] + np.diff(a, axis=1), sizes


def one_edit(index: Index, queries: np.ndarray, half: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, longer): indexed words that begin with the first `half` symbols of a query and differ from it after
    them by one replaced or one more symbol; `longer` marks the latter. No pair comes twice.

    `queries`: symbols, one row each, of one length. `own`: 1 where the query is an indexed word itself, else 0.

    The first half is matched exactly, from its end to the delimiter before it; the rest is matched to the right, where
    at each place a pattern without an error may take one. A pattern that only the query itself still fits is given up.
    """
    length, number = queries.shape[1], np.arange(len(queries))
    lo, back, size = index.one(queries[:, half - 1])
    for j in range(half - 2, -2, -1):
        more = size > own[number]
        lo, back, size, number = lo[more], back[more], size[more], number[more]
        lo, back, size = index.left(lo, back, size, queries[number, j] if j >= 0 else np.zeros(len(number), np.int64))
    none = np.zeros(0, np.int64)
    wrong = [none, none, none, none, np.zeros(0, bool)]  # start ahead, start backwards, length, query, longer
    for p in range(half, length + 1):
        more = size > own[number]
        lo, back, size, number = lo[more], back[more], size[more], number[more]
        here = queries[number, p] if p < length else np.zeros(len(number), np.int64)
        every = index.right_each(lo, back, size)
        row = np.arange(len(number))
        ways = every[2] > 0
        ways[:, 0] = False
        ways[row, here] = False  # a symbol put in before an equal one is the same as one put in after it
        r, c = np.nonzero(ways)
        branch = [every[0][r, c], every[1][r, c], every[2][r, c], number[r]]
        wrong = [np.concatenate([x, y]) for x, y in zip(wrong, [*branch, np.ones(len(r), bool)])]
        there = queries[wrong[3], p] if p < length else np.zeros(len(wrong[3]), np.int64)
        wrong[:3] = index.right(*wrong[:3], there)
        if p < length:
            wrong = [np.concatenate([x, y]) for x, y in zip(wrong, [*branch, np.zeros(len(r), bool)])]
            lo, back, size = (x[row, here] for x in every)
        fit = wrong[2] > 0
        wrong = [x[fit] for x in wrong]
    return wrong[3], np.asarray(index.order, np.int64)[wrong[0]] if len(wrong[0]) else none, wrong[4]


def near_words(words: list[str], asks: np.ndarray, held: np.ndarray, halves) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`one_edit` of the words marked `asks` against those marked `held`, as numbers of `words`; `halves` gives the length
    of the exact half by the length of the word."""
    kept = np.flatnonzero(held)
    if not len(kept):
        return
    alphabet = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
    index = Index([words[i] for i in kept], alphabet)
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths[asks]):
        those = np.flatnonzero(asks & (lengths == length))
        together = max(1, min(TOGETHER, (1 << 22) // int(length)))
        for i in range(0, len(those), together):
            part = those[i : i + together]
            queries = index.symbols("".join([words[k] for k in part])).reshape(len(part), length)
            query, word, longer = one_edit(index, queries, halves(int(length)), held[part].astype(np.int64))
            yield part[query], kept[word], longer
