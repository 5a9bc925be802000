"""Simple-8b: unsigned integers packed into 64-bit words.

The top four bits of a word select how many values of how many bits its other 60 hold. A value of 60 bits or more is
an escape: its word holds the number of an entry in a list beside the words. Encoding takes the selector that holds
the most values at each place; decoding works on all words of a selector at once.
"""

from __future__ import annotations

import numpy as np

# Fixed values: (bits a value, values a word) by selector; 0 is an escape, 1 a run of zeros.
SELECTORS = [(60, 1), (0, 120), (1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1)]
ESCAPE = 0

_COUNT = np.array([n for _, n in SELECTORS], np.int64)
_LOW = np.uint64((1 << 60) - 1)
_WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)  # bits of small values


def _bits(values: np.ndarray) -> np.ndarray:
    if not len(values) or values.max() < len(_WIDTHS):
        return _WIDTHS[values.astype(np.int64)]
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # may be one more than needed above 2**53


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped values) of an array of unsigned integers."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    bits = _bits(values)
    choice = np.where(bits > 60, ESCAPE, len(SELECTORS) - 1).astype(np.uint8)
    least = int(bits.min(initial=64))
    widest, span = bits, 1  # the largest of `span` values from each place on
    for selector in range(len(SELECTORS) - 2, 0, -1):
        width, count = SELECTORS[selector]
        if count > n or width < least:
            break
        while span * 2 <= count:
            widest = np.maximum(widest[: len(widest) - span], widest[span:])
            span *= 2
        largest = np.maximum(widest[: n - count + 1], widest[count - span : n - span + 1])
        np.copyto(choice[: n - count + 1], np.uint8(selector), where=largest <= width)
    after = (np.arange(n) + _COUNT[choice]).tolist()
    taken, i = [], 0
    while i < n:
        taken.append(i)
        i = after[i]
    at = np.array(taken, np.int64)
    chosen = choice[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen).tolist():
        width, count = SELECTORS[selector]
        here = chosen == selector
        start = at[here]
        if selector == ESCAPE:
            words[here] |= np.arange(len(start), dtype=np.uint64)
        elif width:
            packed = values[start]
            for j in range(1, count):
                packed |= values[start + j] << np.uint64(j * width)
            words[here] |= packed
    return words, values[at[chosen == ESCAPE]]


def unpack(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The values that `pack` was given."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[selectors]
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector in np.unique(selectors).tolist():
        width, count = SELECTORS[selector]
        here = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            out[starts[here]] = escaped[(words[here] & _LOW).astype(np.int64)]
        elif width:
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                out[starts[here] + j] = (words[here] >> np.uint64(j * width)) & mask
    return out
