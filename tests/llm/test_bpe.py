import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcheck.llm import bpe
from shelfcheck.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(7)
    pool = list("abzZ'sStTdDmrevl 019.,!?\n\t\r<|>") + ["\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "É", "ß", "İ", "Σ", "ς", "e\u0301", "\u0301", "ﬁ", "²", "½", "Ⅷ", "漢字", "한국", "अमी", "🙂", "👍🏽", "Å", "\ufeff", "\u200b"]
    pool += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "don't"]
    return ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(4000)] + [None, "", " ", "a" * 3000, "ab " * 3000, "é" * 900]


def test_ids_and_text_equal_the_library(library):
    source = bpe.read_source(PATH)
    own = bpe.Bpe(source)
    ids = bpe.encode_batch(source, pa.array(texts(), pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts()]
    assert ids.to_pylist() == want
    assert own.decode(ids).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]
    assert own.decode(ids[7:20]).to_pylist() == own.decode(ids).to_pylist()[7:20]
    assert own.decode(pa.array([[1], None, []], pa.list_(pa.int32()))).to_pylist() == [own.names[1].as_py(), None, ""]


def test_merges_lowest_rank_first():
    """Against merging the lowest and then leftmost pair again and again."""
    rng = random.Random(1)
    for _ in range(300):
        pairs = list({(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(8)})
        ranks, merged = {a << 32 | b: r for r, (a, b) in enumerate(pairs)}, [rng.choice([r % 6, 6 + r]) for r in range(len(pairs))]
        symbols = [rng.randint(0, 5) for _ in range(rng.randint(0, 14))]
        slow = symbols[:]
        while found := [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(slow, slow[1:])) if a << 32 | b in ranks]:
            if len(slow) < 2:
                break
            rank, i = min(found)
            slow[i : i + 2] = [merged[rank]]
        assert bpe.merge(symbols, ranks, merged) == slow


def test_table_of_any_shape(docs_of, library):
    docs = docs_of([(1, "Hello, World"), (1, "Hello, World"), (2, None), (None, "x")]).withColumn("ids", F.lit("clash"))
    got = sorted(((r.id, r.ids, r.decoded) for r in bpe.tokenized(docs, PATH).collect()), key=str)
    hello = library.encode("Hello, World", add_special_tokens=False).ids
    want = [(1, hello, library.decode(hello))] * 2 + [(2, [], ""), (None, library.encode("x").ids, library.decode(library.encode("x").ids))]
    assert got == sorted(want, key=str)
    assert bpe.tokenized(docs.limit(0), PATH).count() == 0


def test_small_tables_change_nothing():
    from shelfcheck.llm.arena import Pieces, flat

    def spell(pieces):
        return flat([list(p) for p in pieces])

    words = [bytes([65 + i % 26]) * (i % 7) for i in range(500)]
    one, small = Pieces(spell), Pieces(spell, most=5)
    for begin in range(0, 500, 50):
        a, b = one.lookup(words[begin : begin + 50]), small.lookup(words[begin : begin + 50])
        assert a[0].tolist() == b[0].tolist() == [c for w in words[begin : begin + 50] for c in w] and a[1].tolist() == b[1].tolist()


def test_other_files_are_refused():
    with pytest.raises((ValueError, TypeError, KeyError)):
        bpe.Bpe(bpe.read_source(tokenizer_path("byte_bpe_50k.json")))
