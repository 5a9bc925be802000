import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_bytecnn import plain as plain_score
from test_mixing import shared
from test_quality import plain as plain_quality
from test_shingles import plain_groups
from test_simhash import slow_components, slow_fingerprint
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from shelfcheck.llm import bytecnn
from shelfcheck.llm.queries import QUERIES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, junk, copies, near copies and odd rows, as the tables of a folder."""
    rng = random.Random(11)
    syllables = ["ba", "lo", "mi", "ter", "sun", "ka", "é", "ri", "do", "ven"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(260):
        junk = i % 5 == 4
        t = " ".join(word().upper() + "!!" for _ in range(rng.randint(20, 120))) if junk else text(rng.randint(12, 200))
        rows.append((i, t, f"s{i % 4}"))
        labels.append((i, 0 if junk else 1, 0))
    copies = [(300 + i, rows[i][1], "s9") for i in range(0, 60, 3)] + [(400 + i, rows[i][1] + " extra", None) for i in range(0, 60, 7)]
    odd = [(500, None, "s1"), (501, "", "s1"), (502, "the same line\n" * 40, "s2"), (503, "short", "s3")]
    folder = tmp_path_factory.mktemp("corpus")
    every = rows + copies + odd
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in every], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), every


def test_run_equals_plain_version(spark, corpus):
    folder, rows = corpus
    out = corpus_pipeline.run(spark, folder).collect()
    sources, texts = {i: s for i, _, s in rows}, {i: t for i, t, _ in rows}

    left = [i for i, t, _ in rows if plain_quality(t)[-1]]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    network = bytecnn.learned(docs.where(docs.doc_id.isin(left)), spark.read.parquet(f"{folder}/labels.parquet"))
    left = [i for i in left if plain_score(network, texts[i]) >= 0.5]
    groups = plain_groups([(i, texts[i]) for i in left])
    near = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs.where(docs.doc_id.isin(left)), folder)
    left = [i for i in left if groups[i] == i]
    assert 150 < len(left) < 260  # junk and copies are gone, clean texts are not
    assert sorted(r.doc_id for r in near.collect()) == sorted(left)

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    sizes, taken, times = Counter(), Counter(), Counter(r.doc_id for r in out)
    for i in left:
        sizes[sources[i]] += len(texts[i].split())
    assert set(times) <= set(left) and max(times.values()) <= 3
    for r in out:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.source == sources[r.doc_id]
        taken[r.source] += len(texts[r.doc_id].split())
    for s, target in shared(sizes).items():
        assert abs(taken[s] - target) <= max(2, 0.02 * target) or sizes[s] < 400, (s, taken[s], target)
    again = Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect())
    assert again == times


def test_stages_keep_the_columns_and_take_nothing(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_queries_are_registered():
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == [q for q in contract.queries() if q.startswith("op")] and len(QUERIES) == 13
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert {"op1_quality_rules", "op2_warc", "op4_url_filters", "op12_merkle_manifest", "op13_spelling_variants"} <= set(contract.oracle_sql())


def test_query_digests(spark, corpus):
    """The thin queries derive what their contracts ask for."""
    import hashlib
    import zlib

    folder, rows = corpus
    word, byte = (Tokenizer.from_file(tokenizer_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    seen = {r.doc_id: r for r in QUERIES["op7_bpe"](spark, folder).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    start = 0
    stored = {r.doc_id: r for r in QUERIES["op9_token_store"](spark, folder).collect()}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = word.encode(t or "", add_special_tokens=False).ids
        assert (seen[i].n_tokens, seen[i].ids_sha256, seen[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)))
        ids = [*byte.encode(t or "", add_special_tokens=False).ids, 2]
        assert (stored[i].start, stored[i].n_tokens, stored[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    marks = [(i, slow_fingerprint(t)) for i, t, _ in rows]
    groups = slow_components(marks, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_near_dedup"](spark, folder).collect()} == {i: (f"{f:016x}", groups[i]) for i, f in marks}
    judged = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, folder).collect()}
    network = bytecnn.learned(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    for i, t, _ in rows:
        assert judged[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and judged[i].predicted == int(judged[i].score >= 0.5)
        assert judged[i].score == pytest.approx(float(bytecnn.score_batch(network, pa.array([t], pa.string()))[0]), abs=1e-6)
