"""The registered queries of this package: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, bytecnn, hyperlang, licenses, merkle, mixing, quality, simhash, spelling, sql, token_store, url_rules, warc
from .tables import new_path, written


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", *columns)


def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.col(f"quality.{c}").alias(c)
    return quality.judge(_documents(spark, d)).select("doc_id", *map(of, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]))


def op2_warc(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write(spark.read.parquet(f"{d}/pages.parquet"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    judged = bytecnn.judged(_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"), name="score")
    return judged.select("doc_id", bytecnn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_url_filters(spark: SparkSession, d: str) -> DataFrame:
    return url_rules.judged(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")).select("page_id", *[F.col(f"url_verdict.{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


def op5_license_scans(spark: SparkSession, d: str) -> DataFrame:
    found = _documents(spark, d).select("doc_id", licenses.scanned(F.col("text")).alias("found"))
    return found.select("doc_id", *[F.col(f"found.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def op6_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash.grouped(_documents(spark, d)).select(
        F.col("own").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op7_bpe(spark: SparkSession, d: str) -> DataFrame:
    tokens = bpe.tokenized(_documents(spark, d), tokenizer_path("word_bpe_49k.json"))
    return tokens.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_mixing(spark: SparkSession, d: str) -> DataFrame:
    # The sizes are counted once; the texts aren't carried along.
    sized = written(_documents(spark, d, "source").select("doc_id", "source", mixing.words(F.col("text")).alias("words")), "mix-sizes")
    of = lambda c: F.col(f"mix.{c}").alias(c)
    return mixing.mixed(sized, F.col("words")).select("doc_id", of("size"), of("source_size"), of("target"), (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op9_token_store(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "token-blocks")
    token_store.write(_documents(spark, d), folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_store.read(spark, folder, digest=True).withColumnRenamed("crc32", "ids_crc32")


def op10_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{d}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op11_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d, "lang").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    found = hyperlang.identified(docs.drop("lang"), docs.filter(~F.col("held_out")))
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op12_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d, "source", "lang", "n_chars")
    of = lambda text: merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, of(F.translate("text", upper, upper.lower())))
    leaves = docs.select("doc_id", "lang", of(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    rows = merkle.manifest(leaves, "lang", "doc_id", "leaf", ["tampered"])
    rows = rows.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("witness")))
    proof = F.sha2(merkle.siblings(F.col("witness")), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return spelling.grouped(_documents(spark, d))


_ALL = (
    op1_quality_rules,
    op2_warc,
    op3_quality_classifier,
    op4_url_filters,
    op5_license_scans,
    op6_simhash_near_dedup,
    op7_bpe,
    op8_mixing,
    op9_token_store,
    op10_nearest_neighbours,
    op11_language_id,
    op12_merkle_manifest,
    op13_spelling_variants,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {
    "op1_quality_rules": sql.quality(quality.MOST_COVERED, quality.MOST_IN_LINES, quality.LEAST_WORDS, quality.REPEAT_WINDOW, quality.MOST_REPEAT_PERCENT),
    "op2_warc": sql.WARC,
    "op4_url_filters": sql.url_rules(url_rules.LIST, url_rules.PATTERNS),
    "op12_merkle_manifest": sql.MERKLE,
    "op13_spelling_variants": sql.SPELLING,
}
