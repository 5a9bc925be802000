"""Substring search over a trigram index.

The index has one row per trigram and product whose name, brand or SKU holds it, ordered by trigram in its files, so that a
lookup reads the row groups of a few trigrams only. A needle's rarest trigrams narrow the products to candidates, on
which the text is then looked for literally; no hit is missed, as a field that holds the needle holds all its trigrams.
Needles shorter than a trigram are looked for in the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("name", "brand", "sku")
GRAM = 3
#: Trigrams of a needle that are looked up, and candidates that are asked for by id; more are joined.
LOOKED_UP, BY_ID = 3, 1000


def grams(text: Column) -> Column:
    """Distinct trigrams of a text whatever its case; none of a shorter or a missing one."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    starts = F.when(F.length(folded) >= GRAM, F.sequence(F.lit(1), F.length(folded) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(folded, i, GRAM)))


def holds(text: str, fields: tuple[str, ...] = FIELDS) -> Column:
    """Whether any field holds the text, taken literally, whatever the case."""
    found = F.lit(False)
    for field in fields:
        found = found | F.coalesce(F.lower(field).contains(text.lower()), F.lit(False))
    return found


def write_index(products: DataFrame, folder: str, fields: tuple[str, ...] = FIELDS) -> None:
    """Postings (gram, id) and their counts (gram, n). A frequent trigram's postings spread over the files by id."""
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col(f)) for f in fields])))
    postings = products.select(F.explode(every).alias("gram"), "id")
    postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{folder}/postings")
    kept = products.sparkSession.read.parquet(f"{folder}/postings")
    kept.groupBy("gram").agg(F.count("*").alias("n")).sort("gram").write.parquet(f"{folder}/counts")


def candidates(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """(id) of the products that hold the rarest trigrams of `text`, which has three characters or more."""
    folded = text.lower()
    wanted = sorted({folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)})
    counts = spark.read.parquet(f"{folder}/counts").where(F.col("gram").isin(wanted)).orderBy("n", "gram").collect()
    rarest = [r["gram"] for r in counts[:LOOKED_UP]] if len(counts) == len(wanted) else []
    postings = spark.read.parquet(f"{folder}/postings").where(F.col("gram").isin(rarest) if rarest else F.lit(False))
    return postings.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("id")


def search(products: DataFrame, folder: str, text: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The rows of `products` that hold `text` in any of the fields that the index was made of."""
    if len(text.lower()) < GRAM:
        return products.where(holds(text, fields))
    ids = candidates(products.sparkSession, folder, text)
    few = [r["id"] for r in ids.limit(BY_ID + 1).collect()]
    narrowed = products.where(F.col("id").isin(few)) if len(few) <= BY_ID else products.join(ids, "id", "left_semi")
    return narrowed.where(holds(text, fields))
