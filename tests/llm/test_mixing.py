import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcheck.llm import mixing


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by giving out again and again what capped sources leave."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 200), ("b", 3), ("é", 60), ("B", 40), (None, 30), ("zero", 2), ("tiny", 1)):
        for _ in range(n):
            size = 0 if s == "zero" else rng.choice([0, 1, 2, 3, 50, rng.randint(1, 400)]) + (s == "tiny")
            rows.append((len(rows), " ".join(["w"] * size) if size else rng.choice([None, "", " \n"]), s))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_sizes_targets_and_budgets(docs_of, seed):
    rows = corpus(seed)
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    by = Counter()
    for i, _, s in rows:
        by[s] += sizes[i]
    want = shared(by)
    docs = docs_of(rows).withColumn("size", F.lit("clash"))
    got = mixing.mixed(docs, mixing.words(F.col("text"))).select("doc_id", "source", "mix.*").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    taken = Counter()
    for r in got:
        assert r.size == sizes[r.doc_id] and r.source_size == by[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s in by:
        assert want[s] - 1.5 <= taken[s] <= want[s] + 0.5 or by[s] < 1500, (s, want[s], taken[s])
    again = {(r.doc_id, r.mix.copies) for r in mixing.mixed(docs.repartition(5), mixing.words(F.col("text"))).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_one_length_holds_nearly_all_rows(docs_of):
    """A hot (source, length) is chosen from in pieces, and exactly as many as planned are taken."""
    rows = [(i, "a b c", "hot") for i in range(3000)] + [(9000 + i, "x " * 7, "other") for i in range(100)] + [(9500, "y " * 11, "third")]
    got = mixing.mixed(docs_of(rows), mixing.words(F.col("text"))).select("source", "mix.*").collect()
    target = {r.source: r.target for r in got}
    for s in target:
        taken = sum(r.size * r.copies for r in got if r.source == s)
        assert target[s] - max(r.size for r in got if r.source == s) <= taken <= target[s] + 0.5


def test_repeats_nulls_and_nothing(docs_of):
    rows = [(1, "a b c d", "s")] * 6 + [(None, "a b c d", "s")] * 5 + [(2, None, None)]
    docs = docs_of(rows).withColumn("mix", F.lit("own"))
    assert sum(r.copies * r.size for r in mixing.mixed(docs.drop("mix"), mixing.words(F.col("text"))).select("mix.*").collect()) == 44
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and out.count() == 11 and {r.mix for r in out.collect()} == {"own"}
    assert mixing.repeated(docs.limit(0)).count() == 0
    assert mixing.repeated(docs_of([(1, None), (2, "")])).count() == 0


def test_subset_is_the_best_there_is():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        sizes, counts, budget = rng.choice(np.arange(0, 40), n, replace=False), rng.integers(0, 6, n), int(rng.integers(0, 120))
        taken = mixing.subset(sizes, counts, budget)
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        assert (taken <= counts).all() and (taken >= 0).all() and int((taken * sizes).sum()) == max(x for x in sums if x <= budget)


@pytest.mark.parametrize("factor", [0, 1e-6, 0.1, 0.77, 1, 1.5, 2.999, 3])
def test_fit_comes_near_large_budgets(factor):
    rng = np.random.default_rng(3)
    sizes, counts = np.arange(6000), rng.integers(1, 60, 6000)
    total = int((sizes * counts).sum())
    copies, more = mixing.fit(sizes, counts, factor * total)
    assert 0 <= copies <= 3 and (more <= counts).all() and abs(copies * total + int((more * sizes).sum()) - factor * total) <= 1


def test_clashing_names(docs_of):
    """Columns called like those that the operator makes come back as they were."""
    names = ["_mix_size", "_mix_own", "_mix_copy", "_mix_rank", "_mix_none", "_row_0", "MIX", "a.b"]
    docs = docs_of([(i, "a b c", "s" if i % 3 else "t") for i in range(60)])
    plain = sorted((r.doc_id, r.source) for r in mixing.repeated(docs).collect())
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted((r.doc_id, r.source) for r in rows) == plain and all(r[n] == n for r in rows for n in names)
    assert {"_mix_size", "_row_0", "a.b", "mix"} <= set(mixing.mixed(docs, mixing.words(F.col("text"))).columns)
