import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcheck.llm import ann

SF = "/root/testdata/sf0.01"


def brute(rows, asks, k):
    """Every query against all other rows, with the rules for what takes part."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, a in good:
        if asks(q):
            scored = [(-float(np.dot(np.array(np.float32(a), np.float64), np.array(np.float32(b), np.float64))), i) for i, b in good if i != q]
            out[q] = [(n + 1, i, pytest.approx(-s, rel=1e-12)) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = answers(ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=200))
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    hits = [len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    for q in got:
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])


def test_recall_of_a_large_shard():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(3000, 24)) @ rng.normal(size=(24, 24)) * rng.uniform(0.5, 2, size=(3000, 1))
    lifted = ann.lifted(points.astype(np.float32))
    graph, entry = ann.build(lifted)
    queries = rng.normal(size=(100, 24))
    met = ann.search(lifted, graph, entry, queries)
    best = np.argsort(-(queries @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 20 for a, b in zip(met, best)]) >= 0.9


def test_copies_ties_and_unsound_vectors(spark):
    """A third of the rows are one vector; few rows otherwise, so the answer is exact."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(0, 120, 2)] + [(1000 + i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(40)]
    rows += [(2001, None), (2002, []), (2003, [0.0, 0.0, 0.0]), (2004, [1.0, None, 0.0]), (2005, [float("nan"), 1.0, 1.0]), (2006, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(1000, rows[60][1]), (1040, [-0.0, 0.0, 1.0]), (1060, [0.0, 0.0, 1.0]), (1080, [2.0, 0.0, 1.0]), (2000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' as id", "1 as vector")
    got = answers(ann.nearest(df, F.col("vec_id") % 20 == 0, k=7))
    assert got == brute(rows, lambda i: i % 20 == 0, 7)


def test_vectors_of_another_length_take_no_part(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [3.0]), (40, [2.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()} == {(20, 1), (20, 3)}


def test_few_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], kind), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(20, [1.0])], kind), F.col("vec_id") % 20 == 0).count() == 0
    two = ann.nearest(spark.createDataFrame([(20, [1.0]), (3, [-1.0])], kind), F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in two] == [(20, 1, 3, -1.0)]


@pytest.mark.parametrize("factor", [1e3, 1e4, 1e20, 1e-20])
def test_vectors_of_very_different_lengths(spark, factor):
    """A few vectors far longer or shorter than the rest don't blur the others' neighbours."""
    rng = np.random.default_rng(4)
    points = (rng.normal(size=(600, 12)) * np.where(np.arange(600) % 97 == 5, factor, 1)[:, None]).astype(np.float32)
    rows = list(enumerate(points.tolist()))
    got = answers(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, shard_rows=400))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    hits = [len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / 20 for q in want]
    assert got.keys() == want.keys() and np.mean(hits) >= 0.95
    scores = {(q, i): s for q in want for _, i, s in want[q]}
    assert all(s == scores[q, i] for q in got for _, i, s in got[q] if (q, i) in scores)


def test_doubles_keep_their_precision(spark):
    """Lengths beyond a float's, and differences below its precision."""
    rows = [(i, [1.0 + i * 1e-12, 1.0, 1e-300]) for i in range(30)] + [(100 + i, [(1 + i) * 1e120, 0.0, 0.0]) for i in range(30)]
    got = answers(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=40))
    best = sorted(((-sum(x * y for x, y in zip(rows[0][1], v)), i) for i, v in rows if i), key=lambda r: r)[:40]
    assert [(r, i) for r, i, _ in got[0]] == [(n + 1, i) for n, (_, i) in enumerate(best)]
