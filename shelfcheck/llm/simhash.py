"""Near-duplicates by SimHash, found through deletion-variant signatures.

A text is lower-cased (A-Z), cut into words `[^\\x20\\x09-\\x0D]+` and word shingles; each bit of its 64-bit
fingerprint is set if it is set in over half the shingles' XXH64 hashes. Two fingerprints are linked at `distance`
or fewer differing bits.

Search: with distance // 2 + 1 segments, two linked fingerprints differ by at most one bit in some segment. Each
distinct fingerprint is indexed once per bit, by its segment with that bit left out (64 rows); two segments that
differ by at most one bit share such a variant. Rows are sorted by variant and compared inside it. A pair is looked
at in one variant only: of its first segment with at most one differing bit, the one without that bit (without the
segment's first bit if none differs).

A variant's bucket emits no more than a spanning forest of its links, never all pairs. A bucket larger than `block`
is cut into blocks, and pairs of blocks are compared in tasks of their own, so a bucket of any size is compared
completely and none is compared in one task. Copies share a fingerprint and enter the index once.

Null texts count as empty; texts without words have fingerprint 0 and are linked like any other. A null id is
replaced by a number above 2**62 made from the text's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .tables import unused, written
from .textbytes import buffers

SHINGLE_WORDS = 4
SEED = 42
DISTANCE = 4
BITS = 64
BLOCK = 8192

#: For each byte, its eight bits as eight bytes of one 64-bit number, so that 255 of them can be added without a carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `words` words, joined by one space; of the whole sequence if it is shorter."""
    found = text.lower().split()  # on bytes: A-Z, and the six ASCII spaces
    if not found:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for i in range(0, len(octets), 255):
        counts += _SPREAD[octets[i : i + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint as a signed long."""

    def run(texts: pa.Array) -> pa.Array:
        raw, at = buffers(texts)
        out = [fingerprint(shingle_hashes(raw[a:b].tobytes())) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.array(out, pa.int64())

    return F.arrow_udf(run, "bigint").asNondeterministic()(text)


class Variants:
    """Which bits make the segments, and which variant a pair is compared in."""

    def __init__(self, distance: int):
        if distance < 2:
            raise ValueError("a variant's bit and value must fit 64 bits: distance 2 or more")
        count = distance // 2 + 1
        cuts = [BITS * i // count for i in range(count + 1)]
        self.distance = distance
        self.segments = [(lo, ((1 << hi) - (1 << lo))) for lo, hi in zip(cuts, cuts[1:])]
        self.width = max(b - a for a, b in zip(cuts, cuts[1:]))

    def keys(self, value: str) -> Column:
        """Rows of (bit, variant): the column named `value` with one bit of one segment left out."""
        signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
        parts = [
            F.expr(f"shiftrightunsigned({value} & {signed(mask & ~(1 << bit))}L, {lo}) | {bit << self.width}L")
            for lo, mask in self.segments
            for bit in range(BITS)
            if mask >> bit & 1
        ]
        return F.explode(F.array(*parts))

    def linked(self, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which pairs are linked and belong to this variant."""
        differs = a ^ b
        yes = np.flatnonzero(np.bitwise_count(differs) <= self.distance)
        differs, bit = differs[yes], (key[yes] >> np.int64(self.width)).astype(np.uint64)
        home = np.zeros(len(yes), np.uint64)
        open_ = np.ones(len(yes), bool)
        for lo, mask in self.segments:
            part = differs & np.uint64(mask)
            here = open_ & (np.bitwise_count(part) <= 1)
            home[here] = np.where(part[here] == 0, np.uint64(1 << lo), part[here])
            open_ &= ~here
        return yes[home == np.uint64(1) << bit]


class Forest:
    """Union-find over row numbers; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = int(p[i])
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        new = p[i] != p[j]
        for x, y in zip(i[new].tolist(), j[new].tolist()):
            a, b = self._root(x), self._root(y)
            if a != b:
                p[max(a, b)] = min(a, b)
                self.kept.append((x, y))
        if new.any():
            while (q := p[p]).tobytes() != p.tobytes():
                p[:] = q


def bucket_links(key: np.ndarray, value: np.ndarray, variants: Variants) -> np.ndarray:
    """(n, 2) values: a spanning forest of the links inside each bucket; `key` is sorted."""
    n, forest, lag = len(key), Forest(len(key)), 1
    left = np.arange(n - 1) if n > 1 else np.zeros(0, np.int64)
    while len(left):
        left = left[left + lag < n]
        left = left[key[left] == key[left + lag]]
        if len(left):
            yes = left[variants.linked(value[left], value[left + lag], key[left])]
            forest.add(yes, yes + lag)
        lag += 1
    return value[np.array(forest.kept, np.int64).reshape(-1, 2)]


def block_links(key: int, a: np.ndarray, b: np.ndarray, same: bool, variants: Variants, rows: int = 256) -> np.ndarray:
    """The same for two blocks of one bucket, each compared with the other."""
    forest, every = Forest(len(a) + len(b)), np.arange(len(b))
    for begin in range(0, len(a), rows):
        i = np.repeat(np.arange(begin, min(begin + rows, len(a))), len(b))
        j = np.tile(every, len(i) // max(1, len(b)))
        if same:
            i, j = i[i < j], j[i < j]
        yes = variants.linked(a[i], b[j], np.full(len(i), key, np.int64))
        forest.add(i[yes], (j if same else j + len(a))[yes])
    return (a if same else np.concatenate([a, b]))[np.array(forest.kept, np.int64).reshape(-1, 2)]


_FOUND = "a bigint, b bigint, variant bigint, block int, members binary"


def _rows(links: np.ndarray | None = None, blocks: list[tuple[int, int, bytes]] = ()) -> pa.RecordBatch:
    links = np.zeros((0, 2), np.uint64) if links is None else links
    none = [None] * len(links)
    columns = [
        pa.array([*links[:, 0].view(np.int64), *([None] * len(blocks))], pa.int64()),
        pa.array([*links[:, 1].view(np.int64), *([None] * len(blocks))], pa.int64()),
        pa.array([*none, *(x[0] for x in blocks)], pa.int64()),
        pa.array([*none, *(x[1] for x in blocks)], pa.int32()),
        pa.array([*none, *(x[2] for x in blocks)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "variant", "block", "members"])


def _search(variants: Variants, block: int):
    """Sorted (variant, fp) rows to links, and to blocks of the buckets larger than `block`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value, cut = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0  # cut: blocks of the first bucket that are out
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            value = np.concatenate([value, batch.column(1).to_numpy().view(np.uint64)])
            while len(key):
                end = int(np.searchsorted(key, key[0], "right"))
                if cut or end > block:  # a large bucket at the front
                    if end > block:
                        yield _rows(blocks=[(int(key[0]), cut, value[:block].tobytes())])
                        key, value, cut = key[block:], value[block:], cut + 1
                        continue
                    if end == len(key):
                        break
                    yield _rows(blocks=[(int(key[0]), cut, value[:end].tobytes())])
                    key, value, cut = key[end:], value[end:], 0
                    continue
                last = int(np.searchsorted(key, key[-1], "left"))  # the last bucket may go on
                starts = np.flatnonzero(np.concatenate([[True], key[1:last] != key[: last - 1]])) if last else np.zeros(0, np.int64)
                sizes = np.diff(np.append(starts, last))
                large = starts[sizes > block]
                last = int(large[0]) if len(large) else last
                if last:
                    yield _rows(bucket_links(key[:last], value[:last], variants))
                    key, value = key[last:], value[last:]
                if not len(large):
                    break
            # what is left is one bucket of at most `block` rows
        if cut and len(key):
            yield _rows(blocks=[(int(key[0]), cut, value.tobytes())])
        elif len(key):
            yield _rows(bucket_links(key, value, variants))

    return run


def _compare(variants: Variants):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                a, b = np.frombuffer(x["left"], np.uint64), np.frombuffer(x["right"], np.uint64)
                links = block_links(x["variant"], a, b, x["i"] == x["j"], variants).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def links(values: DataFrame, value: str = "fp", distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that are linked."""
    variants = Variants(distance)
    indexed = values.select(F.col(value).alias("fp")).distinct().select(variants.keys("fp").alias("variant"), "fp")
    found = written(indexed.repartition("variant").sortWithinPartitions("variant").mapInArrow(_search(variants, block), _FOUND), "simhash-links")
    small = found.filter("a is not null").select("a", "b")
    blocks = found.filter("members is not null")
    left = blocks.select("variant", F.col("block").alias("i"), F.col("members").alias("left"))
    right = blocks.select("variant", F.col("block").alias("j"), F.col("members").alias("right"))
    pairs = left.join(right, "variant").filter("i <= j").repartition("variant", "i", "j")
    return small.unionByName(pairs.mapInArrow(_compare(variants), "a bigint, b bigint"))


def _id(id_column: str, text: str) -> Column:
    stand_in = F.xxhash64(F.col(text)).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.coalesce(F.col(id_column), stand_in).cast("bigint")


def row_keys(id_column: str, text: str) -> list[Column]:
    """(id, mark): the row's id or its stand-in, and a hash of its text. Rows of one id and different texts differ in mark."""
    return [_id(id_column, text).alias("id"), F.xxhash64(F.col(text)).alias("mark")]


def kept_rows(docs: DataFrame, keys: DataFrame, id_column: str, text: str) -> DataFrame:
    """The rows of `docs` that have one of the (id, mark) in `keys`, one row for each."""
    own, mark = unused(docs, "_kept"), unused(docs, "_mark")
    keys = keys.select(F.col("id").alias(own), F.col("mark").alias(mark)).distinct()
    found = row_keys(id_column, text)
    tagged = docs.withColumns({own: found[0], mark: found[1]})
    return tagged.join(keys, [own, mark], "left_semi").dropDuplicates([own, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])


def grouped(docs: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, own, fp, component, mark, root) for each row of `docs`: component is the smallest id reachable over links, its
    own included; mark is the text's hash; root is a fingerprint that names the component, also where two share an id.
    Other columns are not read, so their names don't matter."""
    id_, mark = row_keys(id_column, text)
    marked = docs.select(id_, F.col(id_column).alias("own"), fingerprints(F.col(text)).alias("fp"), mark)
    marked = written(marked, "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected(links(marked, "fp", distance), "a", "b")
    linked = written(nodes.join(roots, nodes.fp == roots.node).select("fp", "first", "root"), "simhash-classes")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    classes = linked.join(least, "root").select("fp", "least", "root")
    classes = nodes.join(classes, "fp", "left").select("fp", F.coalesce("least", "first").alias("component"), F.coalesce("root", "fp").alias("root"))
    # A table of its own: the join back then shuffles for itself alone, and Spark can split the copies of one text.
    classes = written(classes, "simhash-components")
    return marked.join(classes, "fp").select("id", "own", "fp", "component", "mark", "root")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id (of equal ids, the one with the smallest text hash)."""
    first = grouped(docs, id_column, text).groupBy("root").agg(F.min(F.struct("id", "mark")).alias("first"))
    return kept_rows(docs, first.select("first.id", "first.mark"), id_column, text)
