import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfcheck.llm import hyperlang

SF = "/root/testdata/sf0.001"


def plain_letters(text):
    out = " "
    for c in (text or "").lower():
        if c.isalpha():
            out += c
        elif not out.endswith(" "):
            out += " "
    out = out if out.endswith(" ") else out + " "
    return out if out.strip() else ""


def plain_vector(shown, dimensions=2048, gram=3):
    """Every n-gram bound letter by letter, and added."""
    total = np.zeros(dimensions)
    for i in range(len(shown) - gram + 1):
        bound = np.ones(dimensions)
        for k, c in enumerate(shown[i : i + gram]):
            bound *= np.roll(1.0 - 2.0 * hyperlang.letter_bits(ord(c), dimensions), gram - 1 - k)
        total += bound
    return total


def plain(rows, known):
    """(label, cosine) of each text of `rows`, learned from (text, label)."""
    sums = {}
    for text, label in known:
        if text is not None and label is not None and plain_letters(text):
            sums[label] = sums.get(label, 0) + plain_vector(plain_letters(text))
    out = []
    for text in rows:
        shown = plain_letters(text)
        if not shown or not sums:
            out.append(("und", 0.0))
            continue
        v = plain_vector(shown)
        cosine = {label: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for label, p in sums.items()}
        best = min(cosine, key=lambda label: (-cosine[label], label))
        out.append((best, min(1.0, max(0.0, cosine[best]))))
    return out


TEXTS = ["the thing and the other", "der die das und ein", "", None, "123 ... !", "A", "THE THING", "漢字かな交じり文 и русский", "the thing and the other", "l'été où ça", "İstanbul", "one\x00two"]
LABELS = ["en", "de", "en", "en", "de", "en", None, "xx", "en", "fr", "tr", "en"]


def test_equals_plain_version(spark):
    docs = spark.createDataFrame(list(zip(range(len(TEXTS)), TEXTS, LABELS, [7] * len(TEXTS))), "doc_id long, text string, lang string, _language int")
    got = hyperlang.identified(docs, docs, name="language").orderBy("doc_id").collect()
    want = plain(TEXTS, list(zip(TEXTS, LABELS)))
    assert [r.language.lang for r in got] == [w[0] for w in want]
    assert np.allclose([r.language.score for r in got], [w[1] for w in want], atol=1e-5)
    assert [r["_language"] for r in got] == [7] * len(TEXTS)
    replaced = hyperlang.identified(docs, docs, name="_language")
    assert replaced.columns == docs.columns and replaced.filter("_language.lang = 'en'").count() > 0


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.language.lang, r.language.score) for r in hyperlang.identified(docs, docs).collect()} == {("und", 0.0)}
    assert hyperlang.identified(docs.limit(0), docs.limit(0)).count() == 0


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(hyperlang, "MOST_LABELS", 2)
    docs = spark.createDataFrame([(str(i), f"l{i}") for i in range(3)] + [("abc", f"l{i}") for i in range(3)], "text string, lang string")
    with pytest.raises(ValueError):
        hyperlang.prototypes(docs, "text", "lang")


def test_tied_labels_take_the_first(spark):
    docs = spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string")
    assert {r.language.lang for r in hyperlang.identified(docs, docs).collect()} == {"a"}


@pytest.mark.parametrize("points", [range(97, 123), range(0x4E00, 0x4E00 + 3000)])
def test_very_long_text_in_many_pieces(points):
    rng = random.Random(3)
    text = "".join(chr(p) for p in rng.choices(points, k=30_000))
    space = hyperlang.Space()
    owner, grams = hyperlang.packed([hyperlang.letters(text)], 3)
    counts = {}
    for i in range(len(text)):
        g = f" {text} "[i : i + 3]
        counts[g] = counts.get(g, 0) + 1
    sample = rng.sample(sorted(counts), 50)
    packed = np.array([sum(ord(c) << 21 * (2 - k) for k, c in enumerate(g)) for g in sample])
    assert np.array_equal(space.vectors(packed), np.array([plain_vector(g) for g in sample]))
    whole = space.bundled(owner, grams, 1)[0]
    again = sum(n * space.vectors(np.array([sum(ord(c) << 21 * (2 - k) for k, c in enumerate(g))]))[0] for g, n in list(counts.items())[:2000])
    if len(counts) <= 2000:
        assert np.array_equal(whole, again)
    assert hyperlang.judge(pa.array([text * 20]), ["a", "b"], np.stack([whole, -whole]) / np.linalg.norm(whole), space)[0] == ["a"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    got = hyperlang.identified(docs.drop("lang"), docs.filter("not held")).join(docs.select("doc_id", F.col("lang").alias("told")), "doc_id").filter("held").collect()
    assert len(got) > 20 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.language.lang == r.told for r in got) >= 0.97 * len(got)
