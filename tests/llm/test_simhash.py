import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfcheck.llm import components, simhash


def slow_fingerprint(text):
    words, now = [], ""
    for c in "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""):
        if c in " \t\n\x0b\x0c\r":
            words, now = words + [now] * bool(now), ""
        else:
            now += c
    words += [now] * bool(now)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(marks, distance):
    """Smallest id reachable, by trying every pair."""
    parent = {i: i for i, _ in marks}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(marks):
        for j, b in marks[:n]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in marks}


def flipped(value, bits, rng):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def texts():
    rng = random.Random(5)
    base = [" ".join("".join(rng.choices("abcdEé", k=rng.randint(1, 6))) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 30, 80, 200, 400, 300)]
    near = [t.replace(" a", " b", 1) for t in base] + [t + " tail" for t in base] + [t.upper() for t in base]
    return base + near + base[:4] + [None, "", " \n\t ", "x", "x\x0by", "long " * 30_000]


def test_fingerprints_and_components_equal_brute_force(docs_of):
    rows = list(enumerate(texts()))
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.grouped(docs_of(rows)).collect()}
    marks = [(i, slow_fingerprint(t)) for i, t in rows]
    assert {i: f for i, (f, _) in got.items()} == dict(marks)
    assert {i: c for i, (_, c) in got.items()} == slow_components(marks, 4)


@pytest.mark.parametrize("distance", [2, 3, 4, 6])
@pytest.mark.parametrize("block", [3, 8192])
def test_links_connect_what_pairs_connect(spark, distance, block):
    """Dense groups, chains and unrelated values, with buckets inside one block and over many."""
    rng = random.Random(distance)
    seeds = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    values = set(seeds)
    for s in seeds[:6]:
        values |= {flipped(s, rng.randint(1, 8), rng) for _ in range(25)}
    chain = seeds[7]
    for _ in range(12):
        chain = flipped(chain, distance, rng)
        values.add(chain)
    values = sorted(values)
    found = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(3), distance=distance, block=block)
    roots = {r.node: r.root for r in components.connected(found, "a", "b").collect()}
    got = {v: roots.get(signed(v), signed(v)) for v in values}
    classes = slow_components([(v, v) for v in values], distance)
    together = lambda of: {frozenset(v for v in values if of[v] == r) for r in set(of.values())}
    assert together(got) == together(classes)
    for a, b in [(r.a, r.b) for r in found.collect()]:
        assert 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= distance


def test_large_buckets_are_cut_and_stay_whole():
    """All values in one bucket over many batches: every row comes out in exactly one block."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 62, 1000).astype(np.int64)
    key = np.array([3] * 4 + [5] * 990 + [9] * 6)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 77]), pa.array(values[i : i + 77])], ["variant", "fp"]) for i in range(0, 1000, 77)]
    rows = [r for b in simhash._search(simhash.Variants(4), 64)(iter(batches)) for r in b.to_pylist() if r["members"]]
    assert {r["variant"] for r in rows} == {5}
    assert sorted(r["block"] for r in rows) == list(range(16))
    assert sorted(x for r in rows for x in np.frombuffer(r["members"], np.int64)) == sorted(values[4:994])


def test_components_of_chains_stars_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 501), (501, 500), (None, 3)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 500: 500, 501: 500}
    assert components.connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_keep_one_of_each_group(docs_of):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(4, text), (2, text), (2, text), (9, text + " more"), (5, "other words stand here alone today"), (6, None), (8, ""), (None, "without an id it still counts as a document")]
    docs = docs_of(rows).withColumn("component", F.lit("clash")).withColumn("fp", F.lit(1.5))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 5, 6]


def test_rows_of_one_id_and_different_texts_stay(docs_of):
    """Two groups meet in id 2 and a third one has a lower id for one of its texts; each keeps its document."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(300)) for c in "abc")
    rows = [(2, one), (2, two), (3, two), (1, three), (2, three), (5, one), (2, one)]
    assert sorted((r.doc_id, r.text[0]) for r in simhash.keep_one(docs_of(rows)).collect()) == [(1, "c"), (2, "a"), (2, "b")]


def test_empty_table(docs_of):
    assert simhash.grouped(docs_of([]).limit(0)).count() == 0
    assert simhash.keep_one(docs_of([]).limit(0)).count() == 0
