"""Byte-pair encoding from a tokenizer file, by a priority queue of merge ranks.

The symbols of a word form a doubly linked list; every adjacent pair that has a merge waits in a heap by (rank,
place). The lowest is merged, its new neighbours are pushed, and entries whose symbols have changed meanwhile are
skipped when they surface. Decoding concatenates vocabulary strings, joined by a blank as the file (which names no
decoder) asks for.

The file's format is that of the `tokenizers` library; read here are: NFC, Replace and Lowercase normalizers, a Split
that keeps its matches, byte-level letters, an end-of-word suffix, and unnormalized special tokens, which are found in
the raw text. Truncation and padding are not used. Anything else in a file is refused. Null texts count as empty.
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arena import Pieces, Recent, flat, kept_by_worker
from .tables import small_batches
from .textbytes import slices


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(shown))
    return [chr(n) for _, n in sorted([(b, b) for b in shown] + [(b, 0x100 + i) for i, b in enumerate(others)])]


def lower(text: str) -> str:
    """Each character's lower case by itself: a sigma stays the same at a word's end."""
    return text.lower() if "Σ" not in text else "Σ".join(x.lower() for x in text.split("Σ")).replace("Σ", "σ")


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """`symbols` after all merges. `ranks`: left << 32 | right to the rank of that merge; `merged`: the new symbol by rank.

    A queue entry is rank << 32 | place of the left symbol. It is stale unless the pair that begins at its place still has
    its rank, which `waiting` keeps."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbol, after, before = symbols[:], [*range(1, n), -1], [*range(-1, n - 1)]
    get = ranks.get
    waiting = [get(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:])]
    queue = [r << 32 | i for i, r in enumerate(waiting) if r >= 0]
    waiting.append(-1)
    heapify(queue)
    while queue:
        entry = heappop(queue)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        if waiting[i] != rank:
            continue
        j = after[i]
        symbol[i] = new = merged[rank]
        symbol[j] = waiting[j] = -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            waiting[i] = r = get(new << 32 | symbol[k], -1)
            if r >= 0:
                heappush(queue, r << 32 | i)
        else:
            waiting[i] = -1
        h = before[i]
        if h >= 0:
            waiting[h] = r = get(symbol[h] << 32 | new, -1)
            if r >= 0:
                heappush(queue, r << 32 | h)
    return [x for x in symbol if x >= 0]


class Bpe:
    def __init__(self, source: str):
        """`source`: the content of a tokenizer file."""
        spec = json.loads(source)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split, letters = spec["pre_tokenizer"]["pretokenizers"]
        refused = [
            model["type"] != "BPE" or model["unk_token"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"] or model["dropout"],
            (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True),
            (letters["type"], letters["add_prefix_space"], letters["use_regex"]) != ("ByteLevel", False, False),
            spec["decoder"] is not None or spec["post_processor"] is not None,
            any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]),
        ]
        if any(refused):
            raise ValueError(f"this tokenizer file uses parts that are not read here: {refused}")
        self.steps = [{"NFC": self._nfc, "Lowercase": lambda: lower, "Replace": self._replace}[x["type"]](*([x] if x["type"] == "Replace" else [])) for x in steps]
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.letters = byte_letters()
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.plain = [self.vocab.get(x) for x in self.letters]
        self.last = [self.vocab.get(x + self.suffix) for x in self.letters]
        names = {i: x for x, i in [*self.vocab.items(), *self.special.items()]}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        self.other_space = regex.compile(r"[^\S ]").search
        self.known = Recent(150_000)

    @staticmethod
    def _nfc():
        return lambda text: text if text.isascii() else unicodedata.normalize("NFC", text)

    @staticmethod
    def _replace(step: dict):
        pattern = regex.compile(step["pattern"]["Regex"])
        content = step["content"]
        return lambda text: pattern.sub(lambda _: content, text) if pattern.search(text) else text

    def word(self, word: str) -> list[int]:
        data = word.encode()
        symbols = [*map(self.plain.__getitem__, data[:-1]), self.last[data[-1]]]
        if None in symbols:
            symbols = [x for x in symbols if x is not None]
        return merge(symbols, self.ranks, self.merged)

    def normalized(self, text: str) -> str:
        for step in self.steps:
            text = step(text)
        return text

    def split(self, text: str) -> list[int]:
        """Ids of a normalized text."""
        out: list[int] = []
        for word in [text] if text.isascii() and text.isalpha() else self.words(text):
            if (ids := self.known.get(word)) is None:
                ids = self.word(word)
                if len(word) <= 32:
                    self.known.put(word, ids)
            out += ids
        return out

    def segment(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        return self.split(self.normalized(text))

    def stretches(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of stretches without ASCII spaces. If they hold neither other spaces nor special tokens, they are
        normalized together, with blanks between that no step changes."""
        texts = [x.decode() for x in pieces]
        joined = " ".join(texts)
        if self.other_space(joined) or any(x in joined for x in self.special):
            return [self.encode(x) for x in texts]
        return [self.split(x) for x in self.normalized(joined).split(" ")]

    def encode(self, text: str) -> list[int]:
        if not any(x in text for x in self.special):
            return self.segment(text)
        out, begin = [], 0
        for m in self.at_special.finditer(text):
            out += self.segment(text[begin : m.start()])
            out.append(self.special[m[0]])
            begin = m.end()
        return out + self.segment(text[begin:])

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The vocabulary strings of each list, joined by a blank."""
        parts = [pa.array([], pa.string())]
        for i in range(0, len(ids), 256):  # bounds the lists of strings
            part = ids[i : i + 256]
            first, last = part.offsets[0].as_py(), part.offsets[-1].as_py()
            names = self.names.take(ids.values.slice(first, last - first))
            tokens = pa.ListArray.from_arrays(pc.subtract(part.offsets, first), names, mask=part.is_null() if part.null_count else None)
            parts.append(pc.binary_join(tokens, " "))
        return pa.concat_arrays(parts)


def _worker(source: str) -> tuple[Bpe, Pieces]:
    def make():
        bpe = Bpe(source)
        return bpe, Pieces(lambda pieces: flat(bpe.stretches(pieces)), most=400_000)

    return kept_by_worker(("bpe", hash(source)), make)


def encode_batch(source: str, texts: pa.Array) -> pa.ListArray:
    """Ids of each text. Special tokens hold no space, and no word or normalization crosses an ASCII space, so the
    stretches between ASCII spaces are encoded one by one."""
    _, pieces = _worker(source)
    sizes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for raw, at in slices(texts):
        split = [raw[a:b].tobytes().split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        ids, each = pieces.lookup([x for s in split for x in s])
        ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum([0, *map(len, split)])]
        sizes.append(np.diff(ends))
        values.append(ids)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values), pa.int32()))


def encoded(text: Column, source: str) -> Column:
    """Token ids, `array<int>`, of a text column; `source` is the content of the tokenizer file (one copy a task)."""

    def run(texts: pa.Array) -> pa.Array:
        return encode_batch(source, texts)

    return F.arrow_udf(run, "array<int>").asNondeterministic()(text)


def decoded(ids: Column, source: str) -> Column:
    """The text of a column of token ids; null for null."""

    def run(lists: pa.Array) -> pa.Array:
        return _worker(source)[0].decode(lists)

    return F.arrow_udf(run, "string").asNondeterministic()(ids)


def read_source(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenized(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, decoded) of each row; `path` names the tokenizer file on the driver. Other columns are not read."""
    source = read_source(path)
    small_batches(docs.sparkSession)
    ids = docs.select(F.col(id_column).alias("id"), encoded(F.col(text), source).alias("ids"))
    return ids.select("id", "ids", decoded(F.col("ids"), source).alias("decoded"))
