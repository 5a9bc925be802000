import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfcheck.llm import simple8b, token_store
from shelfcheck.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, (1 << 64) - 1), st.just(0)), max_size=400))
@settings(max_examples=200, deadline=None)
def test_round_trip(values):
    words, escaped = simple8b.pack(np.array(values, np.uint64))
    assert simple8b.unpack(words, escaped).tolist() == values


def test_runs_and_bounds():
    for values in ([0] * 1000, [1] * 121, [(1 << 60) - 1, 1 << 60, (1 << 64) - 1, 0], [1 << k for k in range(64)], list(range(5000))):
        words, escaped = simple8b.pack(np.array(values, np.uint64))
        assert simple8b.unpack(words, escaped).tolist() == values
    assert len(simple8b.pack(np.zeros(1200, np.uint64))[0]) == 10


def texts():
    rng = random.Random(9)
    pool = list("abZ'sst 01.,!\n\t\r") + ["\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u3000", "é", "e\u0301", "漢字", "🙂", "²", "_", "\u200b", "  ", " \n", "'ll", "<|endoftext|>", "<|endof", "text|>"]
    return ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(600)] + [None, "", " ", "  \n ", "word " * 90_000]


@pytest.mark.parametrize("parts", [1, 7])
def test_files_give_back_the_librarys_ids(spark, docs_of, tmp_path, parts):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    random.Random(parts).shuffle(rows)
    folder = str(tmp_path / uuid.uuid4().hex)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        token_store.write(docs_of(rows).selectExpr("*", "1 as part", "2 as id").repartition(4), folder, PATH, end_id=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, start = [], 0
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    got = sorted(tuple(r) for r in token_store.read(spark, folder).collect())
    assert got == want
    crc = sorted(tuple(r) for r in token_store.read(spark, folder, digest=True).collect())
    assert crc == [(i, s, n, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, n, ids in want]


LIBRARY = Tokenizer.from_file(PATH)


def library_ids(texts):
    return [[*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def ours(texts):
    with open(PATH, encoding="utf-8") as f:
        source = f.read()
    out = []
    for ids, sizes in token_store.encode(source, pa.array(texts, pa.string()), 2):
        out += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


@given(st.lists(st.lists(st.sampled_from([*"abZst'’01.,!-_|\n\t\r ", "\x0b", "\x1c", "\x1f", "é", "e\u0301", "ß", "漢", "🙂", "²", "'s", "'ll", "  ", " word", "ness"]), max_size=40).map("".join), max_size=12))
@settings(max_examples=300, deadline=None)
def test_pieces_cut_on_bytes_give_the_librarys_ids(texts):
    assert ours(texts) == library_ids(texts)


@pytest.mark.parametrize("odd", ["\u3000", "\x85", "<|endoftext|>"])
def test_other_white_space_and_special_tokens(odd):
    texts = [f"one{odd}two's three{odd}", f"{odd}", "plain text, 12 words", None, f"x{odd[:5]} y"]
    assert ours(texts) == library_ids(texts)


def test_a_very_long_text():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 24))) for _ in range(3000)]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "\n\n", "-", "'t "]) for _ in range(300_000))
    assert ours([text, "short", text[:7]]) == library_ids([text, "short", text[:7]])


def test_repeats_nulls_and_nothing(spark, docs_of, tmp_path):
    token_store.write(docs_of([(5, "b"), (None, "a"), (5, "b"), (2, None)]), str(tmp_path / "a"), PATH, end_id=2)
    got = sorted((r.start, r.doc_id, r.ids) for r in token_store.read(spark, str(tmp_path / "a")).collect())
    assert [(s, d) for s, d, _ in got] == [(0, None), (2, 2), (3, 5), (5, 5)] and got[2][2] == got[3][2]
    token_store.write(docs_of([]).limit(0), str(tmp_path / "b"), PATH, end_id=2)
    assert token_store.read(spark, str(tmp_path / "b")).count() == 0
