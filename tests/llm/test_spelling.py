import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from shelfcheck.llm import fm_index, spelling, sql


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """{word: (form, root, n, n_near, form_n)} by comparing every word with every other."""
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[: crc % len(run)] + run[crc % len(run) + 1 :] if crc % 31 == 0 else run] += 1
    n = {w: k for w, k in total.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def slips(rng, word, letters):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


def corpus(seed=1, size=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abéÉß", k=rng.choice([6, 7, 8, 9, 10, 11, 13, 14, 15, 20, 21, 30]))) for _ in range(25)]
    words += [slips(rng, w, "abéz") for w in words * 3] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "STRASSEN", "strassen", "Ärztliche", "ärztliche"]
    weights = [1000 // (i + 1) + 1 for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 5, 60, 300])))) for i in range(size)]
    return rows + [(500, None), (501, ""), (502, "123 -- × ÷÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷÷"), (None, words[0] + "," + words[0].upper()), rows[3], rows[3], (503, "q" * 3000 + " " + "q" * 3000 + " " + "q" * 2999 + "x")]


def test_equals_plain_version_and_sql(spark, docs_of, tmp_path):
    rows = corpus()
    docs = docs_of(rows)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.grouped(docs).collect()}
    want = plain(rows)
    assert got == want and any(v[0] for v in want.values()) and max(v[3] for v in want.values()) > 3
    documents = docs.toPandas()  # noqa: F841  read by DuckDB
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    said = duckdb.sql(f"select word, form, root, n, n_near, form_n from ({sql.SPELLING})").fetchall()
    assert {r[0]: r[1:] for r in said} == want


@pytest.mark.parametrize("piece,shard", [(1, 1), (3, 10), (1 << 17, 5)])
def test_cut_keys_and_shards_lose_nothing(spark, docs_of, piece, shard):
    docs = docs_of(corpus(2, 60))
    got = sorted(map(tuple, spelling.grouped(docs, piece=piece, shard=shard).collect()), key=str)
    assert got == sorted(map(tuple, spelling.grouped(docs).collect()), key=str)


def test_empty_table_and_no_words(spark, docs_of):
    docs = docs_of(corpus(3, 4))
    assert spelling.grouped(docs.limit(0)).count() == 0
    assert spelling.grouped(docs_of([(1, "short words only"), (2, None)])).count() == 0


def test_chain_of_forms(spark, docs_of):
    rows = [(i, " ".join(["abcdefgh"] * 200 + ["abcdefgx"] * 20 + ["abcdefyx"] * 2)) for i in range(3, 6)]
    got = {r.word: r for r in spelling.grouped(docs_of(rows)).collect()}
    want = plain(rows)
    assert {w: (r.form, r.root, r.n, r.n_near, r.form_n) for w, r in got.items()} == want


@pytest.mark.parametrize("seed", range(12))
def test_searches_find_every_pair_once(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abé"[: seed % 3 + 1], k=rng.randint(2, 9))) for _ in range(60)} | {"a" * k for k in range(2, 40)})
    rng.shuffle(words)
    asks, held = (np.array([rng.random() < 0.8 for _ in words]) for _ in range(2))
    found = set()
    for reverse in (False, True):
        shown = [w[::-1] for w in words] if reverse else words
        for q, w, longer in fm_index.near_words(shown, asks, held, (lambda n: n - n // 2) if reverse else (lambda n: n // 2)):
            pairs = set(zip(q.tolist(), w.tolist()))
            assert len(pairs) == len(q) and all((len(words[b]) > len(words[a])) == m for a, b, m in zip(q, w, longer))
            found |= pairs
    every = range(len(words))
    assert found == {(i, j) for i in every for j in every if asks[i] and held[j] and is_near(words[i], words[j]) and len(words[j]) >= len(words[i])}


@pytest.mark.parametrize("text", ["aaaa", "ababababab" * 50, "abc" * 7 + "b", "é" * 300])
def test_suffix_order(text):
    symbols = np.array([0] + [1 + sorted(set(text)).index(c) for c in text] + [0] + [1, 1, 0])
    order = fm_index.suffix_order(symbols, int(symbols.max()))
    ends = [next(j for j in range(i, len(symbols)) if symbols[j] == 0) for i in range(len(symbols))]
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: (symbols[i : ends[i]].tolist(), i))
