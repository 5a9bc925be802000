"""Per-key ordering that puts no more of a key into one task than a piece of it.

A key may hold any share of the rows. Both helpers cut each key into pieces by a value that grows
with the order (a day, a price), work inside the pieces, and carry what is needed from piece to piece
through a pre-aggregated table that has one row per (key, piece).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, keys: list[str], pieces: list[Column], order: list[Column], name: str) -> DataFrame:
    """`row_number` over `keys` ordered by `pieces` (ascending, none NULL) and then by `order`.

    Each element of `pieces` refines the one before it. Counts per piece are added up ahead of each
    piece, so only one innermost piece is ever sorted in one task.
    """
    cols = [f"_piece{i}" for i in range(len(pieces))]
    cut = df.select("*", *[c.alias(n) for c, n in zip(pieces, cols)])
    level, before = cut.groupBy(*keys, *cols).agg(F.count("*").alias("_n")), None
    for depth in range(len(cols), 0, -1):
        w = Window.partitionBy(*keys, *cols[: depth - 1]).orderBy(cols[depth - 1])
        upto = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
        level = level.select(*keys, *cols[:depth], "_n", upto.alias("_upto"), F.lead(F.lit(1)).over(w).alias("_next"))
        ahead = level.select(*keys, *cols[:depth], (F.col("_upto") - F.col("_n")).alias(f"_ahead{depth}"))
        before = ahead if before is None else before.join(ahead, [*keys, *cols[:depth]])
        # The last piece's running sum is the count of the piece around it, from the same shuffle.
        level = level.where(F.col("_next").isNull()).select(*keys, *cols[: depth - 1], F.col("_upto").alias("_n"))
    offset = sum((F.col(f"_ahead{d}") for d in range(1, len(cols) + 1)), F.lit(0))
    before = before.select(*keys, *cols, offset.alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, *cols).orderBy(*order))
    return (
        cut.withColumn("_inside", inside)
        .join(before, [*keys, *cols])
        .select(*df.columns, (F.col("_offset") + F.col("_inside")).alias(name))
    )


def with_previous(df: DataFrame, key: str, piece: Column, order: list[str], value: list[str], name: str) -> DataFrame:
    """Add `name`: the struct of `value` columns of the preceding row of the same key, NULL on its first row.

    `piece` must not decrease along `order`. All branches read one shuffle by (key, piece): rows find their predecessor
    inside the piece, a piece's last row is carried to the next piece, and only first rows of pieces are joined.
    """
    w = Window.partitionBy(key, "_piece").orderBy(*order)
    inside = df.withColumn("_piece", piece).select("*", F.lag(F.struct(*value)).over(w).alias("_prev"), F.lead(F.lit(1)).over(w).alias("_next"))
    last = inside.where(F.col("_next").isNull()).select(key, "_piece", F.struct(*value).alias("_last"))
    carried = last.select(key, "_piece", F.lag("_last").over(Window.partitionBy(key).orderBy("_piece")).alias("_carried"))
    first = F.col("_prev").isNull()
    rest = inside.where(~first).select(*df.columns, F.col("_prev").alias(name))
    return rest.unionByName(inside.where(first).join(carried, [key, "_piece"]).select(*df.columns, F.col("_carried").alias(name)))
