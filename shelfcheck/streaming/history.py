"""Price history over an unbounded feed, as two queries.

The first cuts each micro-batch into what it can tell alone and what needs the past. A product's rows are compared with
their predecessors in the batch by the piece-wise `lag` of the batch form, so a product with any share of the rows is
never gathered. What is left is one row per product: its first row, and its last price and availability.

The second keeps the last (price, availability) of each product as state, compares it with the first row and takes over
the last. Products are dealt by hash to a fixed number of groups that share a state entry, so that Python is entered once
for each group of a batch, not once for each product. The state store is RocksDB, which keeps what doesn't change on disk.

Rows of a batch are taken in event order; a row older than an earlier batch's counts as newly arrived. A batch that is run
again after a failure finds what it has written, and writes the rest, so every change is kept once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import price_changes
from ..schemas import PRICE_FEED
from ..sources.tables import is_complete

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = [c.split()[0] for c in PRICE_FEED.split(", ")]
#: Groups of products that share an entry of the state. An entry holds a row for each product of its group.
GROUPS = 4096
_EDGES = PRICE_FEED + ", last_price decimal(10,2), last_availability string, batch bigint"


def inner_changes(batch: DataFrame) -> DataFrame:
    """The changes of a batch but for each product's first priced row, of which the past decides."""
    return price_changes(batch, first=False).select(*_COLUMNS)


def edges(batch: DataFrame) -> DataFrame:
    """Each product's first priced row of a batch, and its last price and availability. Reduced before the shuffle."""
    when = F.struct("captured_at", "id")
    rest = [c for c in _COLUMNS if c != "product_id"]
    found = batch.where(F.col("price").isNotNull()).groupBy("product_id").agg(F.min_by(F.struct(*rest), when).alias("first"), F.max_by(F.struct("price", "availability"), when).alias("last"))
    return found.select("product_id", *[F.col("first")[c].alias(c) for c in rest], F.col("last.price").alias("last_price"), F.col("last.availability").alias("last_availability")).select(*_COLUMNS, "last_price", "last_availability")


def _kept(batch: DataFrame, number: int, folder: str) -> None:
    spark = batch.sparkSession
    for part, rows in (("inner", inner_changes(batch)), ("edges", edges(batch).withColumn("batch", F.lit(number).cast("bigint")))):
        path = f"{folder}/{part}/number={number}"
        if not is_complete(spark, path):
            rows.write.mode("overwrite").parquet(path)


def reduce_feed(feed: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start the first query: micro-batches of a feed (product_id, price, availability, captured_at, id) to `folder`/inner and /edges."""
    writer = feed.select(*_COLUMNS).writeStream.foreachBatch(lambda batch, number: _kept(batch, number, folder))
    return writer.option("checkpointLocation", f"{folder}/checkpoint-feed").trigger(**(trigger or {"availableNow": True})).start()


def _texts() -> dict[str, Column]:
    """What goes through Python, all as text, which holds every value exactly and NULL as None."""
    plain = {c: F.col(c).cast("string") for c in (*_COLUMNS, "last_price", "last_availability")}
    return plain | {"captured_at": F.unix_micros("captured_at").cast("string")}


def _first_changes(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of one group of products, the first rows that differ from what was last known of their product. A product has one
    row per batch of the feed."""
    names = [*_COLUMNS, "last_price", "last_availability", "batch"]
    rows = sorted((row for chunk in chunks for row in zip(*(chunk[c] for c in names))), key=lambda row: row[-1])
    known, kept = {product: (price, availability) for product, price, availability in json.loads(state.get[0])} if state.exists else {}, []
    for row in rows:
        product, price, availability, *_, last_price, last_availability, _ = row
        if known.get(product) != (price, availability):
            kept.append(row[: len(_COLUMNS)])
        known[product] = last_price, last_availability
    state.update((json.dumps([(product, *last) for product, last in known.items()]),))
    yield pd.DataFrame(kept, columns=_COLUMNS, dtype=object)


def merge_edges(spark: SparkSession, folder: str, groups: int = GROUPS, **trigger) -> StreamingQuery:
    """Start the second query: `folder`/edges against the state, to `folder`/first. `groups` must stay what it was at the first start."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # a query takes its settings when it starts
    try:
        found = spark.readStream.schema(_EDGES).parquet(f"{folder}/edges/number=*")
        found = found.select(F.pmod(F.xxhash64("product_id"), F.lit(groups)).alias("products"), *[c.alias(n) for n, c in _texts().items()], "batch").groupBy("products")
        changes = found.applyInPandasWithState(_first_changes, ", ".join(f"{c} string" for c in _COLUMNS), "known string", "append", GroupStateTimeout.NoTimeout)
        typed = {"captured_at": F.timestamp_micros(F.col("captured_at").cast("bigint"))}
        types = dict(c.split(" ") for c in PRICE_FEED.split(", "))
        changes = changes.select(*[typed.get(c, F.col(c).cast(types[c])).alias(c) for c in _COLUMNS])
        writer = changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint-edges")
        return writer.option("path", f"{folder}/first").trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def keep_price_changes(feed: DataFrame, folder: str) -> None:
    """Take in all that the feed holds now. Called again, it goes on where it ended."""
    reduce_feed(feed, folder).awaitTermination()
    merge_edges(feed.sparkSession, folder).awaitTermination()


def kept_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The changes kept so far."""
    return spark.read.schema(PRICE_FEED).parquet(f"{folder}/first").unionByName(spark.read.schema(PRICE_FEED).parquet(f"{folder}/inner/number=*"))
