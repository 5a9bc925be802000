"""Quality rules by repetition coverage.

Words are `[^\\x20\\x09-\\x0D]+`. Per text, rolling hashes of several n-gram lengths are taken over the words and
the characters that lie inside n-grams found twice or more are counted; the same for lines. A text is rejected
when it has too few words, repeats too many words in 5-word windows, or when any coverage passes its bound.

Null and empty texts have no word and are rejected by the base rule. Hashes are polynomials modulo the prime 2**61 - 1
(modulo a power of two, periodic texts collide whatever the base); n-grams and lines are compared by hash inside one
text only. Work per text is linear in its length but for one sort per length.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import unused
from .textbytes import IS_SPACE, owner, running, slices, spans

#: The base rule, and the symbols it counts.
LEAST_WORDS = 10
REPEAT_WINDOW = 5
MOST_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"

#: Largest share of a text's word characters inside repeated n-grams, by n, and inside repeated lines.
MOST_COVERED = {4: 0.45, 5: 0.30, 7: 0.25, 10: 0.20}
MOST_IN_LINES = 0.30

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
PRIME = (1 << 61) - 1
_BYTE = np.random.default_rng(7).integers(1, PRIME, 256, np.uint64)
_BASE = int(np.random.default_rng(8).integers(1 << 60, PRIME))
_BLOCK = 1 << 16  # values multiplied at a time, so that the work arrays stay in the cache

_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime: 2**61 is 1."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo the prime of values below it, from their halves: no term passes 64 bits."""
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), _BLOCK):
        x, y = a[i : i + _BLOCK], b[i : i + _BLOCK]
        x1, x0, y1, y0 = x >> _31, x & _LOW31, y >> _31, y & _LOW31
        middle = x1 * y0 + x0 * y1
        out[i : i + _BLOCK] = _reduced(((x1 * y1) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + x0 * y0)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, each known stretch multiplied to make the next."""
    out = []
    for base in (_BASE, pow(_BASE, -1, PRIME)):
        p, known = np.ones(max(n, 1), np.uint64), 1
        while known < n:
            more = min(known, n - known)
            p[known : known + more] = _times(p[:more], np.full(more, pow(base, known, PRIME), np.uint64))
            known += more
        out.append(p)
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hash of any stretch of a sequence, from one prefix sum of value * base**position. Sums of the halves of fewer than
    2**33 values fit 64 bits."""

    def __init__(self, values: np.ndarray, powers: tuple[np.ndarray, np.ndarray]):
        terms = _times(values, powers[0][: len(values)])
        upper = _reduced(running(terms >> _31, np.uint64))
        upper = _reduced((upper >> _30) + ((upper & _LOW30) << _31))  # times 2**31
        self.sums = _reduced(upper + _reduced(running(terms & _LOW31, np.uint64)))
        self.back = powers[1]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        stretch = _times(_reduced(self.sums[end] + (_P - self.sums[start])), self.back[start])
        return _mix(stretch + ((end - start).astype(np.uint64) << _61))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which have an equal key before them."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return shared, again


def measure_slice(raw: np.ndarray, at: np.ndarray, lengths: tuple[int, ...], powers) -> dict[str, np.ndarray]:
    texts = len(at) - 1
    starts, ends = spans(~IS_SPACE[raw], at)
    doc = owner(at, starts)
    chars = running((raw & 0xC0) != 0x80)
    size = chars[ends] - chars[starts]
    per_text = lambda weight, of=doc: np.bincount(of, weight, texts).astype(np.int64)
    symbols = running(_IS_SYMBOL[raw])
    out = {"n_words": per_text(None), "word_chars": per_text(size), "n_symbols": symbols[at[1:]] - symbols[at[:-1]]}
    salt = _mix(np.arange(1, texts + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    bytes_hash = Rolling(_BYTE[raw], powers)

    words = Rolling(_reduced(bytes_hash.of(starts, ends)), powers)
    for n in lengths:
        first = np.arange(max(0, len(starts) - n + 1))
        first = first[doc[first] == doc[first + n - 1]]
        shared, _ = _repeated(words.of(first, first + n) ^ salt[doc[first]])
        opened = np.zeros(len(starts) + 1, np.int8)
        opened[first[shared]] = 1
        opened[first[shared] + n] -= 1
        covered = np.cumsum(opened[:-1], dtype=np.int64) > 0
        out[f"dup_chars_{n}"] = per_text(size * covered)
        if n == REPEAT_WINDOW:
            out["n_repeat_words"] = per_text(covered)

    line_starts, line_ends = spans(raw != 0x0A, at)  # empty lines hold no word
    line_doc = owner(at, line_starts)
    begun = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    _, again = _repeated(bytes_hash.of(line_starts, line_ends) ^ salt[line_doc])
    again &= begun[1] > begun[0]
    in_words = running(size)
    out["n_dup_lines"] = per_text(again, line_doc)
    out["dup_line_chars"] = per_text(again * (in_words[begun[1]] - in_words[begun[0]]), line_doc)
    return out


def measure(texts: pa.Array, lengths: tuple[int, ...]) -> pa.Array:
    names = MEASURES + [f"dup_chars_{n}" for n in lengths]
    parts, powers = {n: [np.zeros(0, np.int64)] for n in names}, _powers(1 << 20)
    for raw, at in slices(texts):
        if len(raw) >= len(powers[0]):
            powers = _powers(len(raw) + 1)
        for n, values in measure_slice(raw, at, lengths, powers).items():
            parts[n].append(values)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(parts[n]), pa.int64()) for n in names], names)


def measured(text: Column, covered: Mapping[int, float] = MOST_COVERED) -> Column:
    """Struct of the counts of one text: `MEASURES`, and `dup_chars_<n>` for each n-gram length of `covered` and the base window."""
    lengths = tuple(sorted({*covered, REPEAT_WINDOW}))
    kind = "struct<" + ",".join(f"{n}:bigint" for n in MEASURES + [f"dup_chars_{n}" for n in lengths]) + ">"

    def run(texts: pa.Array) -> pa.Array:
        return measure(texts, lengths)

    # Nondeterministic, so that a filter on the verdict isn't pushed below and the scan run twice.
    return F.arrow_udf(run, kind).asNondeterministic()(text)


def judge(docs: DataFrame, covered: Mapping[int, float] = MOST_COVERED, in_lines: float = MOST_IN_LINES, text: str = "text", name: str = "quality") -> DataFrame:
    """`docs` with a struct column `name`: the counts, `base_failed` and `kept`. Every other column is left as it is
    (a column called `name` is replaced)."""
    own = unused(docs, "_measured")
    m = lambda c: F.col(own)[c]
    failed = (m("n_words") < LEAST_WORDS) | (100 * m("n_repeat_words") > MOST_REPEAT_PERCENT * m("n_words"))
    passed = m("dup_line_chars") <= in_lines * m("word_chars")
    for n, share in covered.items():
        passed &= m(f"dup_chars_{n}") <= share * m("word_chars")
    verdict = F.struct(f"{own}.*", failed.alias("base_failed"), (~failed & passed).alias("kept"))
    return docs.withColumn(own, measured(F.col(text), covered)).withColumn(name, verdict).drop(own)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns."""
    own = unused(docs, "_quality")
    return judge(docs, name=own).filter(F.col(own)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
