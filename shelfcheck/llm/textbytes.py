"""Texts of an Arrow batch as one numpy array of UTF-8 bytes.

Word separators, line ends and ASCII letters are single bytes below 0x80, which never occur inside a longer
code point, so words and lines can be found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed value: the separators of `[^\\x20\\x09-\\x0D]+`.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; text i is bytes[offsets[i]:offsets[i + 1]]. Null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`buffers` of runs of texts of `most` bytes together, or of one longer text: bounds the work arrays."""
    raw, at = buffers(texts)
    begin = 0
    while begin < len(at) - 1:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield raw[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run never crosses the end of a text."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = inside & (~before | cut[:-1])
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = inside & (~after | cut[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def owner(at: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Number of the text that holds each byte position."""
    return np.searchsorted(at, position, "right") - 1


def running(values: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Prefix sums with a leading 0."""
    out = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=out[1:], dtype=dtype)
    return out
