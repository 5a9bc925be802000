"""Nearest neighbours by largest inner product, over robust-pruned directed graphs.

Distinct vectors are dealt to shards by band of length, then by hash. Each shard's graph is built by inserting its points
in batches: a greedy beam search from the entry point proposes neighbours, and relaxed distance pruning keeps a candidate
only if no kept neighbour is nearer to it by the factor `ALPHA`; reverse edges are pruned the same way when a node has too
many. A query runs a beam search on every shard, and the shards' answers are merged. Inner products are turned into
distances by one more coordinate that gives all of a shard's vectors the same length. Lengths of a shard differ by less
than `2**BAND` and are scaled to about 1, so neither one very long vector nor very short ones blur the others' distances.

Queries travel to the graphs: a shard's graph is sent as often as it takes to keep every core busy, which is once where
there are many shards, and the queries stream past it in Arrow batches. Work arrays hold one shard and one batch. Equal
vectors are one point of the graph that carries the smallest `k + 1` of their ids, which is as many as any query's answer
can need, so groups of copies of any size cost nothing.

Vectors that are null, empty or all zero, hold null or non-finite components, or have another length than most of the
table's take no part, nor do rows without an id. Rows equal in id and vector count once. A query never returns its own
id. Scores are computed in double precision from the original vectors; ties go to the smaller id. Vectors of doubles keep
their precision, other numbers are read as floats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 160
ALPHA = 1.2
SHARD_ROWS = 16_384
BAND = 6  # binary digits by which the lengths of a shard's vectors may differ
_LOCKSTEP = 256  # queries that walk together
_EXPAND = 4  # nodes a query opens at a time


def _walk(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of some queries in lockstep: (ids, squared distances) of each query's `beam` nearest points met, unsorted;
    -1 where it met fewer."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    norms = np.einsum("nd,nd->n", points, points)
    own = np.einsum("nd,nd->n", queries, queries)[:, None]
    ids = np.full((n, beam), -1, np.int32)
    far = np.full((n, beam), np.inf, np.float32)
    opened = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(points) + 1), bool)  # the last column stands for "no neighbour"
    seen[:, -1] = True
    ids[:, 0] = entry
    far[:, 0] = norms[entry] + own[:, 0] - 2 * queries @ points[entry]
    seen[:, entry] = True
    active = np.arange(n)
    while len(active):
        f = np.where(opened[active] | (ids[active] < 0), np.inf, far[active])
        pick = np.argpartition(f, _EXPAND - 1, axis=1)[:, :_EXPAND] if beam > _EXPAND else np.argsort(f, axis=1)
        good = np.isfinite(np.take_along_axis(f, pick, 1))
        live = good.any(axis=1)
        active, pick, good = active[live], pick[live], good[live]
        if not len(active):
            break
        a = active[:, None]
        opened[a, pick] |= good
        near = np.where(good[:, :, None], graph[ids[a, pick]], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[a, near]] = -1
        seen[a, near] = True
        r, c = np.nonzero(near >= 0)
        at = near[r, c]
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = norms[at] + own[active[r], 0] - 2 * np.einsum("nd,nd->n", points[at], queries[active[r]])
        all_ids, all_far = np.hstack([ids[active], near]), np.hstack([far[active], d])
        all_open = np.hstack([opened[active], np.zeros(near.shape, bool)])
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        ids[active], far[active], opened[active] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_far, all_open))
    ids[~np.isfinite(far)] = -1
    return ids, far


def _prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(len(of), degree) neighbours chosen from each row of candidates (-1: none), nearest first: a candidate goes when a
    chosen one is nearer to it, by the factor, than the node itself is."""
    n, width = candidates.shape
    candidates = np.sort(candidates, axis=1)
    gone = candidates < 0
    gone[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    gone |= candidates == of[:, None]
    x = points[np.maximum(candidates, 0)]
    norms = np.einsum("ncd,ncd->nc", x, x)
    mine = points[of]
    d = norms + np.einsum("nd,nd->n", mine, mine)[:, None] - 2 * np.einsum("ncd,nd->nc", x, mine)
    between = norms[:, :, None] + norms[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
    out, rows = np.full((n, degree), -1, np.int32), np.arange(n)
    left = np.where(gone, np.inf, np.maximum(d, 0))
    for slot in range(degree):
        pick = left.argmin(axis=1)
        some = np.isfinite(left[rows, pick])
        if not some.any():
            break
        out[some, slot] = candidates[rows, pick][some]
        left[alpha * alpha * between[rows, pick] <= left] = np.inf
        left[rows, pick] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 10) -> tuple[np.ndarray, int]:
    """(neighbours of each point, -1 for none; entry point)."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int32)
    centre = points.mean(axis=0)
    entry = int(np.einsum("nd,nd->n", points - centre, points - centre).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry]
    begin = 0
    while begin < len(order):
        batch = order[begin : begin + max(1, min(_LOCKSTEP, (begin + 1) // 2))]
        begin += len(batch)
        met, _ = _walk(points, graph, entry, points[batch], min(beam, n))
        graph[batch] = _prune(points, batch, met, degree, alpha)
        source = np.repeat(batch, degree)
        target = graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(nodes), int(counts.max())), -1, np.int32)
        more[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        both = np.hstack([graph[nodes], more])
        full = (both >= 0).sum(axis=1) > degree
        packed = -np.sort(-both, axis=1)[:, :degree]  # existing edges first doesn't matter: the order isn't used
        graph[nodes[~full]] = packed[~full]
        for i in range(0, int(full.sum()), _LOCKSTEP):
            part = np.flatnonzero(full)[i : i + _LOCKSTEP]
            graph[nodes[part]] = _prune(points, nodes[part], both[part], degree, alpha)
    return graph, entry


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors, scaled to components of at most 1, with one more coordinate that makes them equally long: the largest
    inner product with a query that has 0 there is the smallest distance."""
    vectors = vectors.astype(np.float64)
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(initial=0))[1])
    norms = np.einsum("nd,nd->n", vectors, vectors)
    rest = np.sqrt(np.maximum(0, norms.max(initial=0) - norms))
    return np.hstack([vectors, rest[:, None]]).astype(np.float32)


def search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int = SEARCH_BEAM) -> np.ndarray:
    """Up to `beam` point numbers for each query, -1 for none. Queries are scaled to length 1 first: that changes no order."""
    out = np.full((len(queries), beam), -1, np.int32)
    scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
    scaled /= np.sqrt(np.einsum("nd,nd->n", scaled, scaled))[:, None]
    flat = np.hstack([scaled, np.zeros((len(queries), 1))]).astype(np.float32)
    for i in range(0, len(queries), _LOCKSTEP):
        ids, _ = _walk(points, graph, entry, flat[i : i + _LOCKSTEP], min(beam, len(points)))
        out[i : i + len(ids), : ids.shape[1]] = ids
    return out


def sound(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def band(vector: Column) -> Column:
    """Number of a vector's band of length; the band of length 1 has it in the middle."""
    largest = F.array_max(F.transform(vector, F.abs)).cast("double")
    square = F.aggregate(vector, F.lit(0.0), lambda sum_, x: sum_ + (x / largest) * (x / largest))
    return F.floor((F.log2(largest) + F.log2(square) / 2) / BAND + 0.5).cast("int")


_SHARD = "shard int, ids array<array<bigint>>, vectors binary, graph binary, entry int"


def _index(kind: type):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        vectors = np.array(table["vector"].to_pylist(), kind)
        graph, entry = build(lifted(vectors))
        row = [key[0].as_py(), table["ids"].to_pylist(), vectors.tobytes(), graph.tobytes(), entry]
        kinds = [pa.int32(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.binary(), pa.int32()]
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in _SHARD.split(", ")])

    return run


_FOUND = "query_id bigint, vec_id bigint, score double"


class Shard:
    """A graph with its vectors and their ids, ready to be asked."""

    def __init__(self, row: dict, kind: type):
        self.members = row["ids"].as_py()
        self.vectors = np.frombuffer(row["vectors"].as_buffer(), kind).reshape(len(self.members), -1)
        self.graph = np.frombuffer(row["graph"].as_buffer(), np.int32).reshape(len(self.members), -1)
        self.entry, self.points = row["entry"].as_py(), lifted(self.vectors)

    def answers(self, ids: list[int], queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        out: list[tuple[int, int, float]] = []
        for own, vector, at in zip(ids, queries, search(self.points, self.graph, self.entry, queries)):
            at = at[at >= 0]
            scores = (self.vectors[at].astype(np.float64) * vector).sum(axis=1)
            best = np.argsort(-scores, kind="stable")
            # every point as good as the (k + 1)-th: one of them may be the query itself
            edge = scores[best[min(k, len(best) - 1)]]
            pairs = [(own, v, s) for p, s in zip(at[scores >= edge].tolist(), scores[scores >= edge].tolist()) for v in self.members[p] if v != own]
            out += sorted(pairs, key=lambda r: (-r[2], r[1]))[:k]
        return out


def _answers(k: int, kind: type):
    """Rows come in order: a graph, then the queries that it is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            graphs = np.flatnonzero(batch.column("graph").is_valid()).tolist()
            out: list[tuple[int, int, float]] = []
            for begin, end in zip([-1, *graphs], [*graphs, batch.num_rows]):
                if begin >= 0:
                    shard = Shard({n: batch.column(n)[begin] for n in ("ids", "vectors", "graph", "entry")}, kind)
                asked = batch.slice(begin + 1, end - begin - 1)
                if asked.num_rows:
                    queries = asked.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(asked.num_rows, -1)
                    out += shard.answers(asked.column("id").to_pylist(), queries, k)
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that fits the condition `queries`, its `k` nearest among all other rows
    that the graphs lead to. Other columns are not read."""
    spark = vectors.sparkSession
    double = vectors.select(F.col(f"`{vector}`").alias("v")).schema["v"].dataType.simpleString() == "array<double>"
    kind, numbers = (np.float64, "array<double>") if double else (np.float32, "array<float>")
    rows = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast(numbers).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & sound(F.col("vector")))
    rows = written(rows.groupBy("vector", "id").agg(F.max("asks").alias("asks")), "ann-rows")
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("vector") == (width["n"] if width else 0))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    points = rows.select("vector", "id").withColumn("place", first).filter(F.col("place") <= k + 1)
    points = points.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = written(points.withColumn("band", band(F.col("vector"))), "ann-points")

    shards, dealt = 0, F.lit(0)
    for b, n in points.groupBy("band").count().orderBy("band").collect():  # at most some 350 bands of doubles, 50 of floats
        own = -(-n // shard_rows)
        dealt = F.when(F.col("band") == b, shards + F.pmod(F.xxhash64("vector"), F.lit(own))).otherwise(dealt)
        shards += own
    index = points.select(dealt.cast("int").alias("shard"), "vector", "ids").groupBy("shard").applyInArrow(_index(kind), _SHARD)
    index = written(index, "ann-index")
    shards = max(1, shards)
    copies = max(1, -(-2 * spark.sparkContext.defaultParallelism // shards))  # of a graph, so that few shards keep all cores busy

    numbered = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    graphs = index.select("*", numbered(copies).alias("copy"))
    # A query goes to every shard: the stated query set against all rows.
    asked = rows.filter("asks").select("id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(copies)).cast("int").alias("copy"), numbered(shards).alias("shard"))
    asked = asked.join(index.select("shard").distinct(), "shard", "left_semi")
    both = graphs.unionByName(asked, allowMissingColumns=True).withColumn("task", F.col("shard") * copies + F.col("copy"))
    placed = both.repartitionById(shards * copies, "task").sortWithinPartitions("task", F.asc_nulls_first("id"))
    found = placed.select("ids", "vectors", "graph", "entry", "id", "vector").mapInArrow(_answers(k, kind), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
