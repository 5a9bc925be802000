import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfcheck.llm import bytecnn

SF = "/root/testdata/sf0.01"


def network(seed=0):
    rng = np.random.default_rng(seed)
    n = bytecnn.FILTERS
    return bytecnn.Network(rng.normal(size=(bytecnn.WIDTH, 256, n)).astype(np.float32), rng.normal(size=n).astype(np.float32), rng.normal(size=2 * n).astype(np.float32), 0.3)


def plain(net, text):
    data = (text or "").encode()
    starts = [0]
    while starts[-1] + bytecnn.CHUNK < len(data):
        starts.append(starts[-1] + bytecnn.CHUNK - bytecnn.OVERLAP)
    pools = []
    for s in starts:
        chunk = data[s : s + bytecnn.CHUNK].ljust(bytecnn.CHUNK, b"\0")
        places = range(0, bytecnn.CHUNK - bytecnn.WIDTH + 1, bytecnn.STRIDE)
        pools.append(np.maximum(0, np.max([sum(net.tables[k][chunk[p + k]].astype(float) for k in range(bytecnn.WIDTH)) for p in places], axis=0) + net.bias))
    z = np.concatenate([np.mean(pools, axis=0), np.max(pools, axis=0)])
    return 1 / (1 + np.exp(-(z @ net.dense + net.offset)))


def test_scores_equal_plain_version():
    rng = random.Random(4)
    texts = [None, "", "a", "é" * 5, "x" * 511, "x" * 512, "x" * 513] + ["".join(rng.choices("abé漢 \n", k=rng.randint(1, 4000))) for _ in range(12)]
    for block in (1, 5, 128):
        got = bytecnn.score_batch(network(), pa.array(texts, pa.string()), block)
        assert got == pytest.approx([plain(network(), t) for t in texts], abs=1e-4)


def test_chunks_cover_every_byte():
    for n in [0, 1, 511, 512, 513, 991, 992, 993, 10_000]:
        starts, _ = bytecnn.chunks(np.zeros(n, np.uint8), np.array([0, n]))
        covered = {p for s in starts.tolist() for p in range(s, s + bytecnn.CHUNK)}
        assert covered >= set(range(n)) and all(s < max(1, n) for s in starts.tolist())


def test_held_out_accuracy(spark):
    """Fitted outside the fold, it tells labels apart inside it."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    taught = bytecnn.sample(docs, labels).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in taught.doc_id)
    rows = bytecnn.judged(docs, labels).join(labels, "doc_id").filter(bytecnn.held_out(F.col("doc_id"))).select("quality_score", "quality").toPandas()
    assert ((rows.quality_score >= 0.5) == rows.quality).mean() > 0.9
    low, high = rows[rows.quality == 0].quality_score, rows[rows.quality == 1].quality_score
    assert np.mean([a < b for a in low for b in high]) > 0.95


def test_short_clean_texts_are_kept(spark):
    """Beginnings of good texts of the held-out fold, however short, are scored as good."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.filter("quality = 1"), "doc_id").filter(bytecnn.held_out(F.col("doc_id"))).select("text").toPandas().text
    network = bytecnn.learned(docs, labels)
    for size in (20, 60, 150):
        scores = bytecnn.score_batch(network, pa.array([t[:size] for t in good]))
        assert (scores >= 0.5).mean() > 0.9, size


def test_fit_is_bounded_and_reruns_agree(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert bytecnn.sample(docs, labels, rows=20).count() <= 20
    a, b = (bytecnn.learned(docs.repartition(n), labels, rows=40) for n in (2, 5))
    assert np.array_equal(a.tables, b.tables) and a.offset == b.offset


def test_odd_rows_and_few_labels(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (2, ""), (None, "x"), (3, "y" * 100_000)]).withColumn("score", F.lit("clash"))
    kinds = "doc_id long, quality int, toxic int"
    for rows in ([], [(None, 1, 0), (2, None, 0), (3, 7, 0)], [(2, 1, 0), (3, 1, 0)], [(2, 1, 0), (2, 0, 0), (3, 0, 0)]):
        got = bytecnn.judged(docs, spark.createDataFrame(rows, kinds)).collect()
        assert len(got) == 5 and all(0 <= r.quality_score <= 1 for r in got) and {r.score for r in got} == {"clash"}
    assert bytecnn.keep_good(docs.limit(0), spark.createDataFrame([], kinds)).count() == 0
    assert bytecnn.keep_good(docs, spark.createDataFrame([], kinds), least=0.0).columns == docs.columns
