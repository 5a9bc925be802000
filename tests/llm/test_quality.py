import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from shelfcheck.llm import quality, sql

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def texts():
    rng = random.Random(2)
    words = ["a", "bé", "the", "wörd", "x|y", "<p>", "longer-word", "漢字", "#"]
    out = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 3, 4, 5, 9, 10, 11, 40, 200)]
    out += ["\n".join(rng.choices(["one two", "one  two", " ", "", "three", "a b c d e f"], k=n)) for n in (2, 8, 30)]
    out += [None, "", " \t\r\n\x0b\x0c ", "same " * 50, "one\u2003word only\u00a0here", "w" * 5000, "\n" * 40]
    fresh = [f"w{i}" for i in range(400)]
    passage = " ".join(fresh[:30])
    out += [" ".join(fresh), passage + " " + " ".join(fresh[30:60]) + " " + passage, "\n".join([passage] * 3 + fresh[30:]), " ".join(f"v{i}" for i in range(60_000))]
    return out


def plain(text):
    """Counts and verdict by comparing every n-gram and line with every other."""
    text = text or ""
    words, now = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words, now = words + [now] * bool(now), ""
        else:
            now += c
    chars = sum(map(len, words))
    covered = {}
    for n in (4, 5, 7, 10):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 1000 else set()
        covered[n] = {i + k for i, g in enumerate(grams) if g in twice for k in range(n)}
    seen, again = set(), []
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            again += [line] * (line in seen)
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered[5]) > 20 * len(words)
    in_lines = sum(len(c) for line in again for c in [line.translate({ord(x): None for x in " \t\r\x0b\x0c"})])
    passed = in_lines <= 0.30 * chars and all(sum(len(words[i]) for i in covered[n]) <= share * chars for n, share in quality.MOST_COVERED.items())
    return (len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), len(again), len(covered[5]), failed, not failed and passed)


def test_counts_equal_plain_version(docs_of):
    rows = list(enumerate(texts()))
    docs = docs_of(rows).withColumn("_measured", F.lit(1))
    got = {r.doc_id: tuple(r.quality[c] for c in COUNTS) for r in quality.judge(docs).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_sql_says_the_same(docs_of):
    rows = [(i, t) for i, t in enumerate(texts()) if t is None or len(t) < 20_000]
    documents = docs_of(rows).toPandas()  # noqa: F841  read by DuckDB
    want = duckdb.sql(sql.quality(quality.MOST_COVERED, quality.MOST_IN_LINES, quality.LEAST_WORDS, quality.REPEAT_WINDOW, quality.MOST_REPEAT_PERCENT)).fetchall()
    assert {r[0]: r[1:] for r in want} == {i: plain(t) for i, t in rows}


def test_long_texts_and_slices_do_not_mix(docs_of):
    """Texts longer than a slice, and many in one batch, are measured as if alone."""
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(0, long), (1, "one two three four five six seven eight nine ten"), (2, long), (3, long + "\n" + long)]
    got = {r.doc_id: r.quality for r in quality.judge(docs_of(rows)).collect()}
    assert [got[i].n_repeat_words for i in range(4)] == [0, 0, 0, 600_000]
    assert [got[i].kept for i in range(4)] == [True, True, True, False]
    assert got[3].n_dup_lines == 1


def test_keeps_columns_and_clean_documents(docs_of):
    clean = " ".join(f"w{i}" for i in range(50))
    docs = docs_of([(1, clean), (1, clean), (2, "too short"), (3, None), (4, "again " * 80)]).withColumn("_quality", F.lit("x")).withColumn("quality", F.lit("y"))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert [(r.doc_id, r._quality, r.quality) for r in kept.collect()] == [(1, "x", "y")] * 2
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_periodic_words_and_lines_are_told_apart(docs_of):
    """A string of two letters and its complement, built by doubling, collide in polynomial hashes modulo a power of two."""
    a, b = "a", "b"
    while len(a) < 8192:
        a, b = a + b, b + a
    rows = [(1, f"{a}\n{b}"), (2, f"{a} w x y z {b} w x y z"), (3, f"{a}\n{a}")]
    got = {r.doc_id: r.quality for r in quality.judge(docs_of(rows)).collect()}
    assert [got[i].n_dup_lines for i in (1, 2, 3)] == [0, 0, 1]
    assert [got[i].n_repeat_words for i in (1, 2, 3)] == [0, 0, 0]


def test_products_modulo_the_prime():
    rng = np.random.default_rng(1)
    ends = np.array([0, 1, quality.PRIME - 1, quality.PRIME - 1], np.uint64)
    a, b = (np.concatenate([ends[:: 1 - 2 * k], rng.integers(0, quality.PRIME, 100_000, np.uint64)]) for k in (0, 1))
    assert quality._times(a, b).tolist() == [x * y % quality.PRIME for x, y in zip(a.tolist(), b.tolist())]
    powers, back = quality._powers(1000)
    assert powers.tolist() == [pow(quality._BASE, i, quality.PRIME) for i in range(1000)]
    assert set(quality._times(powers, back).tolist()) == {1}
