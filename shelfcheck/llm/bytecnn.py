"""A quality classifier that reads bytes: a small convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it to the end. Inside a chunk, learned filters over
`WIDTH` neighbouring bytes are applied at every `STRIDE`-th place and max-pooled; a dense layer turns the mean and the
maximum of the chunks' pooled filters into one probability. Byte embeddings and filters are learned together; for
scoring they are multiplied out to one table per place in the filter, so a filter costs one lookup per byte.

Memory while scoring follows a fixed number of chunks, whatever the text's length. Texts shorter than a filter, null and
empty ones among them, are padded with zero bytes and scored like any other.

The network is fitted on a bounded sample of labelled rows (`SAMPLE_ROWS`, texts up to `SAMPLE_CHARS`), drawn in the
order of a hash of the id; scoring reads every text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import unused
from .textbytes import buffers

CHUNK, OVERLAP = 512, 32
WIDTH, STRIDE = 8, 2
FILTERS, EMBEDDING = 24, 8
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
EPOCHS, BATCH, RATE = 8, 64, 0.01
STRETCH_SHARE, STRETCH_BITS = 0.3, (3, 8)  # of the texts of label 1; lengths between powers of two

_STEP = CHUNK - OVERLAP
_PLACES = (CHUNK - WIDTH) // STRIDE + 1


class Network(NamedTuple):
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    dense: np.ndarray  # (2 * FILTERS,)
    offset: float


def chunks(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each chunk, number of its text); a text of n bytes has enough chunks to reach its last byte, at least one."""
    sizes = np.diff(at)
    n = 1 + np.maximum(0, -(-(sizes - CHUNK) // _STEP))
    text = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return at[text] + inside * _STEP, text


def chunk_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) bytes, zero beyond the text's end."""
    place = starts[:, None] + np.arange(CHUNK)
    inside = place < ends[:, None]
    return np.where(inside, raw[np.minimum(place, max(0, len(raw) - 1))], 0).astype(np.uint8) if len(raw) else np.zeros(place.shape, np.uint8)


def pooled(data: np.ndarray, tables: np.ndarray, bias: np.ndarray, where: bool = False):
    """Largest response of each filter in each chunk, with the place it stands at if `where`. Places in the padding count:
    zero bytes have learned values like any other."""
    total = np.zeros((len(data), _PLACES, tables.shape[2]), np.float32)
    for k in range(WIDTH):
        total += tables[k][data[:, k : k + (_PLACES - 1) * STRIDE + 1 : STRIDE]]
    if where:
        best = total.argmax(axis=1)
        return np.maximum(np.take_along_axis(total, best[:, None], 1)[:, 0] + bias, 0), best
    return np.maximum(total.max(axis=1) + bias, 0)


def combined(pool: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(texts, 2 * FILTERS): mean and maximum over each text's chunks; chunks of a text are neighbours."""
    first = np.searchsorted(text, np.arange(n))
    counts = np.bincount(text, minlength=n)[:, None]
    return np.hstack([np.add.reduceat(pool, first, axis=0) / counts, np.maximum.reduceat(pool, first, axis=0)])


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def with_stretches(texts: pa.Array, labels: np.ndarray, rng: np.random.Generator) -> tuple[pa.Array, np.ndarray]:
    """The sample with a short stretch of some texts of label 1 as further texts of label 1: short texts are rare among the
    labelled, and a part of a good text is good, while a part of a bad one may be either."""
    whole = texts.fill_null("").to_pylist()
    parts = []
    for text, label in zip(whole, labels.tolist()):
        size, share, place = int(2 ** rng.uniform(*STRETCH_BITS)), rng.random(), rng.random()
        if label == 1 and share < STRETCH_SHARE and len(text) > size:
            begin = int(place * (len(text) - size))
            parts.append(text[begin : begin + size])
    return pa.array(whole + parts, pa.string()), np.concatenate([labels, np.ones(len(parts), labels.dtype)])


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 3) -> Network:
    """Adam on the logistic loss. Without both labels the score is the share of label 1, one half if there is no row."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
    filters = rng.normal(0, 0.3, (WIDTH, EMBEDDING, FILTERS)).astype(np.float32)
    bias, dense, offset = np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32)
    tables = lambda: np.einsum("be,kef->kbf", embedding, filters)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    offset[0] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        return Network(tables(), bias, 0 * dense, float(offset[0]))
    texts, labels = with_stretches(texts, labels, rng)
    raw, at = buffers(texts)
    starts, owners = chunks(raw, at)
    weights = [embedding, filters, bias, dense, offset]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for begin in range(0, len(order), BATCH):
            rows = np.sort(order[begin : begin + BATCH])
            mine = np.flatnonzero(np.isin(owners, rows))
            text = np.searchsorted(rows, owners[mine])
            data = chunk_bytes(raw, starts[mine], at[owners[mine] + 1])
            # 16 bits hold place numbers; blocks bound the responses held at once
            parts = [pooled(data[i : i + 256], t, bias, where=True) for t in [tables()] for i in range(0, len(data), 256)]
            pool, best = np.concatenate([p for p, _ in parts]), np.concatenate([b for _, b in parts])
            z = combined(pool, text, len(rows))
            error = (_probability(z @ dense + offset) - labels[rows]).astype(np.float32) / len(rows)
            back = error[:, None] * dense
            counts = np.bincount(text, minlength=len(rows))[text][:, None]
            down = back[text, :FILTERS] / counts
            top = pool == z[text, FILTERS:].astype(np.float32)
            down = (down + np.where(top, back[text, FILTERS:], 0)) * (pool > 0)
            grad_e, grad_f = np.zeros_like(embedding), np.zeros_like(filters)
            rows_of = np.arange(len(data))[:, None]
            for k in range(WIDTH):
                seen = data[rows_of, best * STRIDE + k]  # the byte under place k of each filter's best response
                by_byte = np.zeros((256, FILTERS), np.float32)
                np.add.at(by_byte, (seen, np.arange(FILTERS)[None, :]), down)
                grad_e += by_byte @ filters[k].T
                grad_f[k] = embedding.T @ by_byte
            grads = [grad_e, grad_f, down.sum(axis=0), z.T @ error + 1e-4 * dense, np.array([error.sum()], np.float32)]
            step += 1
            for w, g, (m, v) in zip(weights, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(tables(), bias, dense, float(offset[0]))


def score_batch(network: Network, texts: pa.Array, block: int = 128) -> np.ndarray:
    """Probability of label 1 for each text; `block` chunks are worked on at a time."""
    raw, at = buffers(texts)
    starts, owners = chunks(raw, at)
    n = len(at) - 1
    total, most = np.zeros((n, FILTERS)), np.zeros((n, FILTERS))
    for i in range(0, len(starts), block):
        text = owners[i : i + block]
        pool = pooled(chunk_bytes(raw, starts[i : i + block], at[text + 1]), network.tables, network.bias)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        own = text[first]
        total[own] += np.add.reduceat(pool.astype(np.float64), first, axis=0)
        most[own] = np.maximum(most[own], np.maximum.reduceat(pool, first, axis=0))
    counts = np.maximum(1, np.bincount(owners, minlength=n))[:, None] if n else 1
    return _probability(np.hstack([total / counts, most]) @ network.dense.astype(np.float64) + network.offset)


def score(text: Column, network: Network) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(score_batch(network, texts), pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()(text)


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, label): up to `rows` labelled documents outside the held-out fold, of up to `chars` characters.
    Rows whose id or label is null, or whose label isn't 0 or 1, teach nothing."""
    known = labels.select("doc_id", F.col(label).alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    drawn = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return docs.select("doc_id", "text").filter(F.length("text") <= chars).join(drawn, "doc_id").limit(2 * rows)


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Network:
    """The network fitted on the driver to the bounded sample."""
    taught = sample(docs, labels, label, rows, chars).toPandas().sort_values(["doc_id", "text", "label"], kind="stable")
    return fit(pa.array(taught["text"], pa.string()), taught["label"].to_numpy().astype(np.int64))


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", name: str = "quality_score") -> DataFrame:
    """`docs` with the column `name`: the probability that its text is labelled 1. A column of that name is replaced."""
    return docs.withColumn(name, score(F.col(f"`{text}`"), learned(docs, labels)))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score is `least` or more, with their columns."""
    own = unused(docs, "_score")
    return judged(docs, labels, name=own).filter(F.col(own) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
