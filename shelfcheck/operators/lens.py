"""Price lens: latest observation per page, cheapest comparable offer, gap to the own price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept_table
from .ranking import number_rows

VALUES = [
    "id", "source", "retailer", "title", "price", "item_price", "shipping_cost", "was_price", "availability",
    "match", "match_note", "status", "note", "captured_at",
]


def latest_observations(observations: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Newest observation per (product, url), ties to the higher id; NULL urls of a product count as one page.

    `max_by` reduces before the shuffle, so a page checked very often costs one row per input partition. Text among
    `columns` makes Spark sort the rows for that; name the columns that are needed.
    """
    columns = columns or [c for c in VALUES if c in observations.columns]
    return (
        observations.groupBy("product_id", "url")
        .agg(F.max_by(F.struct(*columns), F.struct("captured_at", "id")).alias("_newest"))
        .select("product_id", "url", "_newest.*")
    )


def is_priced(status: str = "status", price: str = "price") -> Column:
    return (F.col(status) == "ok") & F.col(price).isNotNull()


def is_comparable() -> Column:
    return is_priced() & ~F.col("match").eqNullSafe(F.lit("near"))


def _best(where: Column, offer: list[str]) -> Column:
    # A row that does not qualify has a NULL ordering and is ignored by min_by.
    order = F.struct("price", F.collate("retailer", "UNICODE").alias("retailer_order"), "retailer", F.coalesce("url", F.lit("")).alias("url_order"), "id")
    return F.min_by(F.struct(*offer), F.when(where, order))


def with_products(latest: DataFrame, products: DataFrame) -> DataFrame:
    own = products.select(
        F.col("id").alias("product_id"), "name", "slug", F.col("price").alias("own_price"),
        F.col("was_price").alias("own_was_price"), F.col("condition_label").alias("own_condition_label"),
    )
    return latest.join(own, "product_id")


def lens(latest: DataFrame, products: DataFrame) -> DataFrame:
    """One row per product with any check: the cheapest comparable and nearest offers, gap and gap %, dearest first."""
    offer = ["price", "retailer", "url", "match"]
    per_product = latest.groupBy("product_id").agg(
        F.count("*").alias("observations"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        _best(is_comparable(), offer).alias("cheapest"),
        _best(is_priced(), offer).alias("nearest"),
        F.max("captured_at").alias("last_fetched"),
    )
    gap = F.col("own_price") - F.col("cheapest.price")
    return (
        with_products(per_product, products)
        .withColumn("gap", gap)
        .withColumn("gap_pct", F.try_divide(F.col("gap").cast("double"), F.col("cheapest.price").cast("double")) * 100)
        .withColumn("nearest", F.when(F.col("cheapest").isNull(), F.col("nearest")))
    )


def ordered(lens_rows: DataFrame) -> DataFrame:
    return lens_rows.orderBy(F.desc_nulls_last("gap_pct"), "product_id")


def summary(lens_rows: DataFrame) -> DataFrame:
    """Counts over the lens rows: compared, own price lowest or dearer, upper median gap, failures, newest fetch."""
    compared = F.col("gap_pct").isNotNull()
    counted = lens_rows.agg(
        F.count_if(compared).alias("compared"),
        F.count_if(F.col("gap_pct") <= 0).alias("own_cheapest"),
        F.count_if(F.col("gap_pct") > 0).alias("own_dearer"),
        F.sum("failed").alias("failed_checks"),
        F.max("last_fetched").alias("last_fetched"),
    )
    share = F.round(100 * F.try_divide(F.col("own_cheapest"), F.col("compared"))).cast("int")
    return counted.withColumn("median_gap_pct", upper_median(lens_rows, "gap_pct").scalar()).withColumn("own_cheapest_share", share)


#: Cells of a round of the median, the sample that their edges are taken from, and the distinct values that are put in order at last.
CELLS, SAMPLE, FEW = 256, 16_384, 65_536


def upper_median(rows: DataFrame, column: str, few: int = FEW, cells: int = CELLS) -> DataFrame:
    """One row: the value at place n/2, rounded down, of the n values in ascending order, counted from 0; NULL without values.

    Exact without gathering the values. They become one written table of counts per distinct value. While more than `few`
    distinct values may hold the place, their range is cut at quantiles of a bounded random sample of them, so that cells hold
    about equally many whatever the values are; the counts of the cells, which are as many as edges, say which one goes on.
    Only the edges and counts of cells and the last `few` values come to one place.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    values = kept_table(counted, "median")
    distinct, total = values.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    place, inside = total // 2, values
    while distinct > few:
        sample = inside.select("v").sample(min(1.0, SAMPLE / distinct), seed=7).limit(4 * SAMPLE)
        edges = sorted(r["v"] for r in sample.collect())
        edges = sorted({edges[k * len(edges) // cells] for k in range(1, cells)}) if edges else []
        if not edges:
            break  # a sample of nothing, from more than `few` values, comes up about never; what is left is put in order
        number = F.size(F.filter(F.lit(edges), lambda e: e <= F.col("v")))
        found = inside.groupBy(number.alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()
        ahead = 0
        for cell in sorted(found, key=lambda r: r["cell"]):
            if place < ahead + cell["n"]:
                break
            ahead += cell["n"]
        place, k = place - ahead, cell["cell"]
        if cell["distinct"] == distinct:
            break
        distinct = cell["distinct"]
        inside = inside.where((F.col("v") >= edges[k - 1]) if k else F.lit(True)).where((F.col("v") < edges[k]) if k < len(edges) else F.lit(True))
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("upto", upto).where(F.col("upto") > place).agg(F.min("v").alias(column))


def refusing_retailers(latest: DataFrame) -> DataFrame:
    """Retailers that blocked or disallowed a latest check."""
    return latest.where(F.col("status").isin("blocked", "disallowed")).select("retailer").distinct()


def ranked_observations(latest: DataFrame, products: DataFrame) -> DataFrame:
    """Rank within the product: price ascending, missing prices last, then retailer by locale; with the price difference to ours.

    A product is cut at its distinct prices and, within a price, at its retailers; what remains together are one
    retailer's pages of it with one price, or without any. The latest observations are written once, in the shared folder,
    and read for the counts and for the rows.
    """
    # In whole cents, with a value beyond any price for the missing ones.
    cents = F.coalesce((F.col("price") * 100).cast("bigint"), F.lit(1 << 62))
    by_locale = F.collate(F.coalesce("retailer", F.lit("")), "UNICODE")
    order = [F.col("retailer"), F.coalesce("url", F.lit("")), F.col("id")]
    numbered = number_rows(kept_table(latest, "ranked"), ["product_id"], [cents, by_locale], order, "rank")
    difference = F.when(is_priced(), F.col("own_price") - F.col("price"))
    return with_products(numbered, products).withColumn("difference", difference)


def retailers_checked(latest: DataFrame) -> DataFrame:
    """Distinct retailers of a product in rank order. Reduced to one row per (product, retailer) before they are listed."""
    first = latest.groupBy("product_id", "retailer").agg(F.min("price").alias("price"))
    entry = F.struct(F.col("price").isNull().alias("unpriced"), "price", F.collate("retailer", "UNICODE").alias("retailer_order"), "retailer")
    return first.groupBy("product_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["retailer"]).alias("retailers")
    )
