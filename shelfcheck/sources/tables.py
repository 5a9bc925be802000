"""Tables as Parquet, and the keyed updates the application makes, as whole-table transforms.

An update reads one version of a table and writes the next; it never overwrites what it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.ranking import number_rows


def scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """Write the next version of a table; fails if that version exists."""
    path = f"{folder.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/version={version}")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote a folder came to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """The newest version that was written to its end; one that was broken off is passed over."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName().partition("=")[2]) for f in (files.listStatus(top) if files.exists(top) else []) if f.getPath().getName().startswith("version=")]
    return next((v for v in sorted(found, reverse=True) if is_complete(spark, f"{folder.rstrip('/')}/version={v}")), None)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_products(stored: DataFrame, crawled: DataFrame) -> DataFrame:
    """Stored and newly crawled products, one row per url: the newest capture, keeping id and first-seen time.

    Both need url, first_seen_at, last_crawled_at. At equal times the crawled capture wins, and among equals the one
    with the greatest values. A new product without an id gets the next free number, in the order of its URL's MD5.
    """
    both = stored.withColumn("incoming", F.lit(0)).unionByName(crawled.withColumn("incoming", F.lit(1)), allowMissingColumns=True)
    captured = [c for c in both.columns if c not in ("id", "url", "first_seen_at", "incoming")]
    merged = (
        both.groupBy("url")
        .agg(
            F.min_by("id", F.when(F.col("id").isNotNull(), F.struct("first_seen_at", "id"))).alias("id"),
            F.min("first_seen_at").alias("first_seen_at"),
            F.max_by(F.struct(*captured), F.struct("last_crawled_at", "incoming", *captured)).alias("_newest"),
        )
        .select("id", "url", "first_seen_at", "_newest.*")
    )
    known = F.coalesce(both.agg(F.max("id")).scalar(), F.lit(0))
    fresh = number_rows(merged.where(F.col("id").isNull()), [], [F.substring(F.md5("url"), 1, 3)], [F.md5("url"), F.col("url")], "n")
    numbered = fresh.withColumn("id", known + F.col("n")).select(*merged.columns)
    return merged.where(F.col("id").isNotNull()).unionByName(numbered)


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> DataFrame:
    """Keep `df` as a catalogue table cut and sorted by its keys: joins on them read it without a shuffle."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").mode("errorifexists").saveAsTable(table)
    return df.sparkSession.table(table)


def merge_products(stored: DataFrame, crawled: DataFrame) -> DataFrame:
    """As `upsert_products`, for a stored side with one row per url: only the crawl is reduced and shuffled, and meets the
    stored rows by a join on url, which needs no exchange of a stored table bucketed by it."""
    captured = [c for c in stored.columns if c not in ("id", "url", "first_seen_at")]
    newest = (
        crawled.select(*[(F.col(c) if c in crawled.columns else F.lit(None)).cast(stored.schema[c].dataType).alias(c) for c in stored.columns])
        .groupBy("url")
        .agg(
            F.min_by("id", F.when(F.col("id").isNotNull(), F.struct("first_seen_at", "id"))).alias("id"),
            F.min(F.when(F.col("id").isNotNull(), F.col("first_seen_at"))).alias("id_seen_at"),
            F.min("first_seen_at").alias("first_seen_at"),
            F.max_by(F.struct(*captured), F.struct("last_crawled_at", *captured)).alias("c"),
        )
        .select("url", F.struct("id", "id_seen_at", "first_seen_at", "c").alias("n"))
    )
    own = stored.select("url", F.struct("id", "first_seen_at", F.struct(*captured).alias("c")).alias("o"))
    n, o = F.col("n"), F.col("o")
    ours = n.isNull() | (o.isNotNull() & F.coalesce(o["c"]["last_crawled_at"] > n["c"]["last_crawled_at"], n["c"]["last_crawled_at"].isNull() & o["c"]["last_crawled_at"].isNotNull()))
    earlier = n["id"].isNotNull() & (o["id"].isNull() | (F.struct(n["id_seen_at"], n["id"]) < F.struct(o["first_seen_at"], o["id"])))
    joined = own.join(newest, "url", "full").select(
        F.when(earlier, n["id"]).otherwise(o["id"]).alias("id"), "url", F.least(o["first_seen_at"], n["first_seen_at"]).alias("first_seen_at"), F.when(ours, o["c"]).otherwise(n["c"]).alias("c")
    )
    merged = joined.select("id", "url", "first_seen_at", "c.*")
    known = F.coalesce(F.greatest(stored.agg(F.max("id")).scalar(), newest.agg(F.max("n.id")).scalar()), F.lit(0))
    fresh = number_rows(merged.where(F.col("id").isNull()), [], [F.substring(F.md5("url"), 1, 3)], [F.md5("url"), F.col("url")], "n")
    return merged.where(F.col("id").isNotNull()).unionByName(fresh.withColumn("id", known + F.col("n")).select(*merged.columns))


def replace_findings(stored: DataFrame, fresh: DataFrame, audited_ids: DataFrame) -> DataFrame:
    """Findings after a re-audit: those of products not audited again, and the fresh ones."""
    return stored.join(audited_ids.select("product_id"), "product_id", "left_anti").unionByName(fresh)


def apply_audit(products: DataFrame, checked: DataFrame, audited_at: Column) -> DataFrame:
    """Products with score, segment and time of their latest audit: `audited_at` for those in `checked`."""
    marks = checked.select("id", F.struct("score", "segment", audited_at.alias("audited_at")).alias("_mark"))
    own = lambda c: F.when(F.col("_mark").isNotNull(), F.col("_mark")[c]).otherwise(F.col(c)).alias(c)
    joined = products.join(marks, "id", "left")
    return joined.select(*[own(c) if c in ("score", "segment", "audited_at") else F.col(c) for c in products.columns])


def reaudited(products: DataFrame, checked: DataFrame, audited_at: Column) -> DataFrame:
    """The next version of `products` (id, score, segment, audited_at, findings) after a re-audit: marks and findings of the
    products in `checked` are new, those of the others as they were. Findings are a column of the product, so one
    write holds both, and a reader sees either all of a product's audit or none of it."""
    found = F.filter("hits", lambda h: h.isNotNull())
    marks = checked.select("id", F.struct("score", "segment", audited_at.alias("audited_at"), found.alias("findings")).alias("_mark"))
    own = lambda c: F.when(F.col("_mark").isNotNull(), F.col("_mark")[c]).otherwise(F.col(c)).alias(c)
    joined = products.join(marks, "id", "left")
    return joined.select(*[own(c) if c in ("score", "segment", "audited_at", "findings") else F.col(c) for c in products.columns])


def reaudit(spark: SparkSession, folder: str, checked: DataFrame, audited_at: Column) -> int:
    """Write the version of the products in `folder` that follows its newest complete one. Returns its number."""
    now = latest_version(spark, folder)
    after = now + 1
    path = f"{folder.rstrip('/')}/version={after}"
    # What a broken attempt left under this number isn't read by anyone.
    reaudited(read_version(spark, folder, now), checked, audited_at).write.mode("overwrite").parquet(path)
    return after


def findings_in(products: DataFrame) -> DataFrame:
    """One row per finding of a version."""
    return products.select(F.col("id").alias("product_id"), F.explode("findings").alias("_f")).select("product_id", "_f.*")


def upsert_mappings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (product, url): the incoming retailer, match and note where given, else the stored; `is_new` marks added ones.

    Of several incoming rows with the same key the last by `line` wins.
    """
    last = incoming.groupBy("product_id", "url").agg(F.max_by(F.struct("retailer", "match", "match_note"), "line").alias("i"))
    joined = stored.select("product_id", "url", F.struct("retailer", "match", "match_note").alias("s")).join(last, ["product_id", "url"], "full")
    kept = F.coalesce("i", "s")
    return joined.select(
        "product_id", "url", kept["retailer"].alias("retailer"), kept["match"].alias("match"), kept["match_note"].alias("match_note"),
        F.col("s").isNull().alias("is_new"),
    )


def propagate_match(mappings: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Mappings with the match and note the pages showed. `keys` is ["url"] or ["product_id", "url"]; the newest page counts."""
    last = seen.groupBy(*keys).agg(F.max_by(F.struct("match", "match_note"), F.struct("captured_at", "id")).alias("n"))
    joined = mappings.join(last, keys, "left")
    n = F.col("n")
    return (
        joined.withColumn("match", F.when(n.isNotNull(), n["match"]).otherwise(F.col("match")))
        .withColumn("match_note", F.when(n.isNotNull(), n["match_note"]).otherwise(F.col("match_note")))
        .select(*mappings.columns)
    )


# --- checks ---------------------------------------------------------------------------------

ENUMS = {
    "condition": P.CONDITIONS,
    "availability": P.AVAILABILITIES,
    "severity": P.SEVERITIES,
    "match": P.MATCHES,
    "status": P.STATUSES,
    "segment": P.SEGMENT_IDS,
}


def invalid_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): values outside the documented set of each column; NULL is allowed."""
    entries = F.array(*[F.when(~F.col(c).isin(ENUMS[c]), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c in columns])
    return (
        df.select(F.explode_outer(entries).alias("_entry"))
        .where(F.col("_entry").isNotNull())
        .groupBy("_entry.column", "_entry.value")
        .agg(F.count("*").alias("n"))
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose non-NULL key has no parent row."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
