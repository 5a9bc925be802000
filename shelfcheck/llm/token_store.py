"""Token ids of documents in a block file format, written and read in ascending document order.

A file is Parquet with one row per block. A block holds whole documents, up to `BLOCK_IDS` ids together or one longer
document: its ids as Simple-8b words and escapes, the documents' ids and sizes, and the block's offsets: ids and words
of its part before it. A block is decoded by itself with whole-array operations. Parts follow the order of the
documents' ids, so the place of every document in the whole stream follows from one number per part.

Rows are range-partitioned by (id, hash of the text): the ids need no single task, and repeated rows stay, in any order
between equal ones. Null ids come first. Null texts count as empty: they hold the end id alone.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .arena import Pieces, kept_by_worker
from .tables import small_batches, written
from .textbytes import slices

BLOCK_IDS = 1 << 16
BLOCKS = "part int, block int, ids_before bigint, words_before bigint, n_ids bigint, doc_ids array<bigint>, sizes array<bigint>, words binary, escaped binary"

# First and last code points of the runs with Unicode's White_Space property.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_BLANK = "".join(f"{chr(a)}-{chr(b)}" for a, b in WHITE_SPACE)
_PIECES = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+").findall
_FAR_BLANK = re.compile("|".join(re.escape(chr(c)) for a, b in WHITE_SPACE for c in range(a, b + 1) if c > 0x7F).encode()).search
_BLANKS = frozenset(chr(c) for a, b in WHITE_SPACE for c in range(a, b + 1))


_IS_BLANK, _IS_LETTER, _IS_MARK = (np.array([chr(c) in kind for c in range(256)]) for kind in ("\t\n\v\f\r ", string.ascii_letters, string.digits + string.punctuation))
#: Bytes of a piece that are packed into two words.
_PACKED = 16


def split(raw: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pieces, number of each piece in order, pieces of each text) of texts without white space beyond ASCII.

    A piece begins with a text, where white space follows anything else, and where a mark or a digit follows an ASCII
    letter: no word of the tokenizer goes over such a place, and none looks back over it. Short pieces are told apart
    as pairs of integers; equal ones may come twice among the distinct.
    """
    begins = np.zeros(len(raw) + 1, bool)
    blank = _IS_BLANK[raw]
    begins[1:-1] = (blank[1:] & ~blank[:-1]) | (_IS_MARK[raw[1:]] & _IS_LETTER[raw[:-1]])
    begins[at] = True
    starts = np.flatnonzero(begins)
    starts, ends = starts[:-1], starts[1:]
    counts = np.diff(np.searchsorted(starts, at))
    size = ends - starts
    short = np.flatnonzero(size <= _PACKED)
    window = np.concatenate([raw, np.zeros(_PACKED, np.uint8)])[starts[short, None] + np.arange(_PACKED)]
    window[np.arange(_PACKED) >= size[short, None]] = 0
    a, b = window.view(np.uint64).T
    key = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) ^ size[short].astype(np.uint64)
    order = np.argsort(key)
    a, b, n = a[order], b[order], size[short][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (n[1:] != n[:-1])
    number = np.empty(len(starts), np.int64)
    number[short[order]] = np.cumsum(new) - 1
    long = np.flatnonzero(size > _PACKED)
    number[long] = np.arange(len(long)) + int(new.sum())
    data, shown = raw.tobytes(), np.concatenate([short[order[new]], long])
    return [data[i:j].decode() for i, j in zip(starts[shown].tolist(), ends[shown].tolist())], number, counts


class _Encoder:
    """The library's ids of stretches of text, many in one call.

    Stretches that begin with white space are parted from what stands before them by that alone, so they are encoded as one
    text, which is cut again by the numbers of bytes that the ids stand for. Others are separated by a special token, which
    is encoded apart from what stands around it. Stretches that hold a special token themselves go one by one.
    """

    TOGETHER, CHARACTERS = 50, 4096

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(source)
        tokens, vocab = spec["added_tokens"], spec["model"]["vocab"]
        # A symbol of the vocabulary stands for one byte.
        self.bytes = np.zeros(max([*vocab.values(), *(x["id"] for x in tokens)]) + 1, np.int64)
        self.bytes[list(vocab.values())] = [len(x) for x in vocab]
        self.special = [x["content"] for x in tokens]
        plain = [x for x in tokens if not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"])]
        self.between, self.between_id = (plain[0]["content"], plain[0]["id"]) if plain else ("", -1)

    def _special_in(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = self._encode(stretches)
        return np.fromiter(map(len, each), np.int64, len(each)), np.concatenate(each)

    def __call__(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self._special_in("\0".join(stretches)):
            return self._alone(stretches)
        led = np.fromiter((x[0] in _BLANKS and x[-1] not in _BLANKS for x in stretches), bool, len(stretches))
        parts = []
        for those, encode in ((np.flatnonzero(led), self._joined), (np.flatnonzero(~led), self._separated)):
            if len(those):
                parts.append((those, *encode([stretches[i] for i in those.tolist()])))
        if len(parts) == 1:
            return parts[0][1:]
        size = np.empty(len(stretches), np.int64)
        for those, own, _ in parts:
            size[those] = own
        ids, start = np.empty(int(size.sum()), np.int32), np.cumsum(size) - size
        for those, own, values in parts:
            ids[np.repeat(start[those] - (np.cumsum(own) - own), own) + np.arange(len(values))] = values
        return size, ids

    def _joined(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(list(map(len, stretches)))
        cuts = [0, *(np.flatnonzero(np.diff(ends // self.CHARACTERS)) + 1).tolist(), len(stretches)]
        ids = np.concatenate(self._encode(["".join(stretches[a:b]) for a, b in zip(cuts, cuts[1:])]))
        wanted, reached = np.cumsum(list(map(len, map(str.encode, stretches)))), np.cumsum(self.bytes[ids])
        last = np.searchsorted(reached, wanted) + 1
        if last[-1] != len(ids) or not np.array_equal(reached[last - 1], wanted):
            return self._separated(stretches)  # an id reaches beyond its stretch
        return np.diff(last, prepend=0), ids

    def _separated(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.between:
            return self._alone(stretches)
        groups = [stretches[i : i + self.TOGETHER] for i in range(0, len(stretches), self.TOGETHER)]
        ids = np.concatenate(self._encode([self.between.join(g) + self.between for g in groups]))
        ends = np.flatnonzero(ids == self.between_id)
        if len(ends) != len(stretches):  # a stretch and the token after it were read as something else
            return self._alone(stretches)
        return np.diff(ends, prepend=-1) - 1, np.delete(ids, ends)


def _encoder(source: str) -> Pieces:
    """Byte-level BPE splits text where white space follows anything else, so the stretches between are encoded one by one."""
    return kept_by_worker(("byte-level", hash(source)), lambda: Pieces(_Encoder(source)))


def _check(source: str) -> None:
    spec = json.loads(source)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or spec["post_processor"] or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != ("ByteLevel", False, True):
        raise ValueError("the tokenizer file must be byte-level, without a normalizer or a prefix space")


def encode(source: str, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of the next texts with the end id after each, their sizes)."""
    table = _encoder(source)
    for raw, at in slices(texts):
        # A special token may stand across such places.
        if _FAR_BLANK(data := raw.tobytes()) or any(x.encode() in data for x in table.encode.special):
            found = [_PIECES(raw[a:b].tobytes().decode()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            (ids, each), counts = table.lookup([*chain.from_iterable(found)]), list(map(len, found))
        else:
            pieces, number, counts = split(raw, at)
            ids, each = table.lookup(pieces, number)
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(counts)]
        yield np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1


def _blocks(source: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, ids_before, words_before = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            names, done = batch.column(0).to_pylist(), 0
            for ids, sizes in encode(source, batch.column(1), end_id):
                ends = np.cumsum(sizes)
                i = 0
                while i < len(sizes):
                    begin = int(ends[i] - sizes[i])
                    j = max(i + 1, int(np.searchsorted(ends, begin + BLOCK_IDS, "right")))
                    own = ids[begin : ends[j - 1]]
                    words, escaped = simple8b.pack(own)
                    row = [part, block, ids_before, words_before, len(own), names[done + i : done + j], sizes[i:j], words.tobytes(), escaped.tobytes()]
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in BLOCKS.split(", ")])
                    block, ids_before, words_before, i = block + 1, ids_before + len(own), words_before + len(words), j
                done += len(sizes)

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> None:
    """Encode `docs` with the tokenizer file named `tokenizer` (on the driver) and write the blocks to `folder`, which any
    storage of Spark's may hold. Other columns are not read."""
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    _check(source)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(source, end_id), BLOCKS).write.parquet(folder)


def _documents(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = simple8b.unpack(np.frombuffer(x["words"], np.uint64), np.frombuffer(x["escaped"], np.uint64)).astype(np.uint32)
                sizes = np.array(x["sizes"], np.int64)
                ends = np.cumsum(sizes)
                if digest:
                    data, cut = ids.astype("<u4").tobytes(), (4 * ends).tolist()
                    last = pa.array([zlib.crc32(data[a:b]) for a, b in zip([0, *cut], cut)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids.astype(np.int32)))
                columns = [pa.array(x["doc_ids"], pa.int64()), pa.array(x["start"] + ends - sizes), pa.array(sizes), last]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "crc32" if digest else "ids"])

    return run


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: start is the number of ids before it in the whole stream.
    With `digest`, the CRC-32 of the ids as little-endian 32-bit integers in place of the ids."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per written part.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Written, its size is known: Spark then joins it without moving the blocks.
    placed = blocks.join(written(totals.select("part", before.alias("before")), "token-parts"), "part")
    rows = placed.select((F.col("before") + F.col("ids_before")).alias("start"), "doc_ids", "sizes", "words", "escaped")
    kind = "crc32 bigint" if digest else "ids array<int>"
    return rows.mapInArrow(_documents(digest), f"doc_id bigint, start bigint, n_tokens bigint, {kind}")
