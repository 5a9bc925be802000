"""Price history: keep a price only when it or the availability changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import with_previous


def price_changes(feed: DataFrame, piece: Column | None = None, first: bool = True) -> DataFrame:
    """Rows of the feed whose (price, availability) differs from the product's previous priced row.

    Comparing with the previous row is the same as comparing with the last kept one, since an unchanged
    row equals it. `piece` (an hour by default) cuts a product's rows so that a busy one spreads over tasks.
    Without `first`, a product's first priced row is left out, for those who must compare it with something else.
    """
    priced = feed.where(F.col("price").isNotNull())
    piece = F.date_trunc("hour", "captured_at") if piece is None else piece
    compared = with_previous(priced, "product_id", piece, ["captured_at", "id"], ["price", "availability"], "previous")
    changed = (
        (F.col("previous").isNull() & F.lit(first))
        | (F.col("previous.price") != F.col("price"))
        | (F.col("previous").isNotNull() & ~F.col("previous.availability").eqNullSafe(F.col("availability")))
    )
    return compared.where(changed).drop("previous")
