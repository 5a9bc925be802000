"""Language identification with hyperdimensional profiles.

Every letter has a random vector of `DIMENSIONS` signs, drawn from a generator seeded with its code point, so that no
alphabet has to be known. An n-gram's vector binds (multiplies) the vectors of its symbols, each permuted (rolled) by its
place; a text's vector bundles (adds) those of all its n-grams, and a language's prototype those of all its texts.
A text gets the language whose prototype has the largest cosine with the text's vector.

Texts are lower-cased; every run of other characters than letters counts as one space, also before and after the text.
Equal n-grams are counted first and bound once per slice of texts, so bundling is a product of counts and vectors.

Null texts and texts without a letter are `und` with score 0, and so are all texts if nothing was learned; neither they
nor texts with a null label are learned from. Of equal cosines the first label in code-point order wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import unused

DIMENSIONS = 2048
GRAM = 3
#: Prototypes are sent to every task; more labels than this (64 MB) are refused.
MOST_LABELS = 4096
UNKNOWN = "und"

#: Characters of a slice of texts, and n-grams that are bound together: bounds of the work arrays.
SLICE, TOGETHER = 1 << 19, 2048
_BITS = 21  # of a code point

_OTHER = regex.compile(r"\P{L}+")


def letters(text: str) -> str:
    """Lower-cased letters, one space for each run of others and at both ends; empty without a letter."""
    inner = _OTHER.sub(" ", text.lower()).strip(" ")
    return f" {inner} " if inner else ""


def numbered(grams: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, and the number of each one's; by a table of marks where the alphabet is small, else by sorting."""
    points = [(grams >> (_BITS * k)) & ((1 << _BITS) - 1) for k in range(gram)]
    alphabet = np.flatnonzero(sum(np.bincount(p, minlength=1 << _BITS) for p in points))
    if len(alphabet) ** gram > 1 << 22:
        return np.unique(grams, return_inverse=True)
    short = np.zeros(1 << _BITS, np.int64)
    short[alphabet] = np.arange(len(alphabet))
    key = sum(short[p] * len(alphabet) ** k for k, p in enumerate(points))
    marks = np.zeros(len(alphabet) ** gram, np.int64)
    marks[key] = 1
    found = np.flatnonzero(marks)
    marks[found] = np.arange(len(found))
    wide = sum(alphabet[found // len(alphabet) ** k % len(alphabet)] << (_BITS * k) for k in range(gram))
    return wide, marks[key]


def letter_bits(point: int, dimensions: int) -> np.ndarray:
    """The vector of a letter: a set bit stands for -1."""
    return np.random.default_rng([11, point]).integers(0, 2, dimensions, np.uint8)


class Space:
    """N-gram vectors; the rolled letter vectors met so far are kept, of which there are as many as letters."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        if not 1 <= gram <= 3:
            raise ValueError("an n-gram has one to three symbols")
        self.dimensions, self.gram, self.known = dimensions, gram, np.zeros(0, np.int64)
        self.rolled = np.zeros((gram, 0, dimensions // 8), np.uint8)

    def _learn(self, points: np.ndarray) -> None:
        new = np.setdiff1d(points, self.known)
        if not len(new):
            return
        bits = np.stack([letter_bits(int(p), self.dimensions) for p in new])
        rolled = np.stack([np.packbits(np.roll(bits, self.gram - 1 - k, axis=1), axis=1) for k in range(self.gram)])
        order = np.argsort(np.concatenate([self.known, new]))
        self.known = np.concatenate([self.known, new])[order]
        self.rolled = np.concatenate([self.rolled, rolled], axis=1)[:, order]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of -1 and 1 of packed n-grams."""
        points = [(grams >> (_BITS * (self.gram - 1 - k))) & ((1 << _BITS) - 1) for k in range(self.gram)]
        self._learn(np.unique(np.concatenate(points)))
        bound = np.zeros((len(grams), self.dimensions // 8), np.uint8)
        for k, p in enumerate(points):
            bound ^= self.rolled[k, np.searchsorted(self.known, p)]
        return 1 - 2 * np.unpackbits(bound, axis=1).astype(np.float32)

    def bundled(self, owner: np.ndarray, grams: np.ndarray, rows: int) -> np.ndarray:
        """Sums of the vectors of `grams` by owner, in double precision."""
        out = np.zeros((rows, self.dimensions))
        if not len(grams):
            return out
        distinct, which = numbered(grams, self.gram)
        for i in range(0, len(distinct), TOGETHER):
            some = (which >= i) & (which < i + TOGETHER) if len(distinct) > TOGETHER else slice(None)
            width = min(TOGETHER, len(distinct) - i)
            counts = np.bincount(owner[some] * width + (which[some] - i), minlength=rows * width).reshape(rows, width)
            out += counts.astype(np.float32) @ self.vectors(distinct[i : i + TOGETHER])
        return out


def packed(shown: list[str], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, packed n-gram) of every n-gram of the texts."""
    points = np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(s) for s in shown])
    owner = np.repeat(np.arange(len(shown)), sizes)
    last = len(points) - gram + 1
    if last <= 0:
        return owner[:0], points[:0]
    grams = points[:last].copy()
    for k in range(1, gram):
        grams = (grams << _BITS) | points[k : last + k]
    inside = owner[:last] == owner[gram - 1 :]
    return owner[:last][inside], grams[inside]


def slices(texts: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and letters of the texts that have any, in runs of about `SLICE` characters or one longer text."""
    numbers, shown, size = [], [], 0
    for i, text in enumerate(texts):
        s = letters(text.as_py() or "")
        if s and size + len(s) > SLICE and numbers:
            yield numbers, shown
            numbers, shown, size = [], [], 0
        if s:
            numbers.append(i)
            shown.append(s)
            size += len(s)
    if numbers:
        yield numbers, shown


def prototypes(texts: DataFrame, text: str, label: str, dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[list[str], np.ndarray]:
    """Labels in code-point order, and one unit vector for each. All texts are read; tasks send one sum for each label of a batch."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dimensions, gram)
        for batch in batches:
            names, of = np.unique(np.asarray(batch.column(1).to_pylist(), object), return_inverse=True)
            total = np.zeros((len(names), dimensions))
            for numbers, shown in slices(batch.column(0)):
                owner, grams = packed(shown, gram)
                total += space.bundled(of[numbers][owner], grams, len(names))
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.string()), pa.array([total[i].tobytes() for i in some], pa.binary())], ["label", "bundle"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimensions)
        for batch in batches:
            for x in batch.column("bundle"):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([total.tobytes()], pa.binary())], ["label", "bundle"])

    kind = "label string, bundle binary"
    known = texts.select(F.col(text), F.col(label)).filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    found = known.mapInArrow(learn, kind).groupBy("label").applyInArrow(add, kind).limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    found = sorted((r.label, np.frombuffer(r.bundle)) for r in found)
    matrix = np.array([v / (np.linalg.norm(v) or 1) for _, v in found]).reshape(len(found), dimensions)
    return [name for name, _ in found], matrix


def judge(texts: pa.Array, names: list[str], matrix: np.ndarray, space: Space) -> tuple[list[str], np.ndarray]:
    """Label and cosine (0 at least) of each text."""
    found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for numbers, shown in slices(texts) if names else ():
        vectors = space.bundled(*packed(shown, space.gram), len(shown))
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        cosine = (vectors / np.where(size > 0, size, 1)) @ matrix.T
        best = cosine.argmax(axis=1)
        for i, k in zip(numbers, best):
            found[i] = names[k]
        score[numbers] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
    return found, score


def predicted(text: Column, names: list[str], matrix: np.ndarray, gram: int = GRAM) -> Column:
    """Struct of `lang` and `score` of a text."""
    prepared = []

    def run(texts: pa.Array) -> pa.Array:
        if not prepared:
            prepared.append(Space(matrix.shape[1], gram))
        found, score = judge(texts, names, matrix, prepared[0])
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(score)], ["lang", "score"])

    return F.arrow_udf(run, "lang string, score double").asNondeterministic()(text)


def identified(docs: DataFrame, known: DataFrame, text: str = "text", label: str = "lang", name: str = "language") -> DataFrame:
    """`docs` with a struct column `name`: the language that the texts of `known` make likeliest, and its cosine. Every
    other column is left as it is (a column called `name` is replaced)."""
    own = unused(docs, "_language")
    return docs.withColumn(own, predicted(F.col(text), *prototypes(known, text, label))).withColumn(name, F.col(own)).drop(*([own] if own != name else []))
