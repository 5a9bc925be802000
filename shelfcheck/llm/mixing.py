"""Mixing sources to target weights by fitting token budgets.

Each source has a size (its documents' tokens) and a target. Whole passes over a source serve as many full copies of
it as fit the target; for the rest, documents are counted by exact length and the same share of every length is taken.
What then remains of the budget is brought below `DP_BUDGET` with the longest lengths that are left, and a bounded
knapsack over the remaining counts finds the subset whose sum comes nearest below it. The documents of each length
are chosen in a seeded order.

Only counts per (source, length, bucket of the seeded order) are planned over. A length of a source may hold any share
of the rows, so its order is cut into `BUCKETS` pieces and only one piece is ever ordered in a task.

Null sizes count as 0 and a null source is a source of its own, the last one. Equal rows can't be told apart: as many
of them are taken as the plan says. Rows keep all their columns, whatever their names; a column `mix` is replaced by
`mixed` and left as it is by `repeated`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import unused, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
DP_BUDGET = 1 << 16
BUCKETS = 4096

_SOURCE = ["_mix_none", "_mix_source"]
_CELL = [*_SOURCE, "_mix_size"]


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("bigint")


def subset(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that the sum is as large as possible and at most `budget`: a bounded knapsack
    over sums, counts split into powers of two. `via` holds, for each sum, the item that first reached it, so going back
    from a sum meets each item once."""
    taken = np.zeros(len(sizes), np.int64)
    if budget <= 0:
        return taken
    reached, via, items = np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int64), []
    reached[0] = True
    for i in np.flatnonzero((sizes > 0) & (sizes <= budget) & (counts > 0)).tolist():
        left, power = min(int(counts[i]), budget // int(sizes[i])), 1
        while left and not reached[budget]:
            n = min(power, left)
            weight = n * int(sizes[i])
            new = weight + np.flatnonzero(reached[: budget + 1 - weight] & ~reached[weight:])
            reached[new], via[new] = True, len(items)
            items.append((i, n, weight))
            left, power = left - n, power * 2
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n, weight = items[via[at]]
        taken[i] += n
        at -= weight
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, target: float, most_repeats: int = MOST_REPEATS) -> tuple[int, np.ndarray]:
    """(full copies of every document, documents of each size that are taken once more) for one source."""
    total = int(sum(int(s) * int(c) for s, c in zip(sizes, counts)))
    once_more = np.zeros(len(sizes), np.int64)
    if total == 0:
        return 0, once_more
    budget = round(target)
    copies = min(most_repeats, budget // total)
    budget -= copies * total
    if copies == most_repeats or budget <= 0:
        return copies, once_more
    once_more = np.array([int(c) * budget // total for c in counts], np.int64)
    budget -= int(sum(int(s) * int(n) for s, n in zip(sizes, once_more)))
    left = counts - once_more
    for i in np.argsort(-sizes, kind="stable").tolist():
        if budget <= DP_BUDGET:
            break
        n = min(int(left[i]), budget // int(sizes[i]), -((DP_BUDGET - budget) // int(sizes[i]))) if sizes[i] else 0
        once_more[i], left[i], budget = once_more[i] + n, left[i] - n, budget - n * int(sizes[i])
    return copies, once_more + subset(sizes, left, min(budget, DP_BUDGET))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """`sources` (`_mix_none`, `_mix_source`, `_mix_total`; one row per source) with `_mix_target`: the sum of all sizes
    shared by weight, none above `most_repeats` times its size, the excess shared again.

    Sources in the order of cap per weight: as long as the next one's share exceeds its cap, it gets the cap and leaves the
    rest to the others. The windows hold one row per source."""
    every, before = Window.partitionBy(F.lit(0)), (Window.unboundedPreceding, -1)
    place = F.row_number().over(every.orderBy(*_SOURCE)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    df = sources.withColumn("_mix_weight", weight.cast("bigint")).withColumn("_mix_cap", most_repeats * F.col("_mix_total"))
    order = every.orderBy(F.col("_mix_cap") / F.col("_mix_weight"), *_SOURCE)
    left = lambda c, all_: F.sum(all_).over(every) - F.coalesce(F.sum(c).over(order.rowsBetween(*before)), F.lit(0))
    df = df.select("*", left("_mix_cap", "_mix_total").alias("_mix_left"), left("_mix_weight", "_mix_weight").alias("_mix_rest"), F.row_number().over(order).alias("_mix_place"))
    free = F.col("_mix_cap") * F.col("_mix_rest") > F.col("_mix_weight") * F.col("_mix_left")
    first = F.min_by(F.when(free, F.struct("_mix_left", "_mix_rest")), F.when(free, F.col("_mix_place"))).over(every)
    share = F.col("_mix_weight") * F.col("_mix_first._mix_left") / F.col("_mix_first._mix_rest")
    capped = F.col("_mix_cap").cast("double")
    return df.withColumn("_mix_first", first).select(*_SOURCE, "_mix_total", F.least(capped, F.coalesce(share.cast("double"), capped)).alias("_mix_target"))


def _plan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("_mix_size")  # so that reruns agree
    copies, once_more = fit(rows["_mix_size"].to_numpy(), rows["_mix_n"].to_numpy(), float(rows["_mix_target"].iloc[0]))
    return rows[_CELL].assign(_mix_copies=copies, _mix_more=once_more)


def mixed(docs: DataFrame, size: Column, source: str = "source", order: tuple[str, ...] = ("doc_id",), seed: int = 8) -> DataFrame:
    """`docs` with a struct column `mix`: size, source_size, target (of the row's source) and copies, the number of times
    that the mix takes the row. `order` names columns that tell rows apart; the seeded order is a hash of them."""
    mark = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in order])
    own = [F.col(f"`{c}`").alias(f"_row_{i}") for i, c in enumerate(docs.columns)]  # so that no name can clash with ours
    keyed = docs.select(
        *own,
        F.col(f"`{source}`").isNull().alias("_mix_none"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_mix_source"),
        F.coalesce(size.cast("bigint"), F.lit(0)).alias("_mix_size"),
        mark.alias("_mix_mark"),
        *[F.col(f"`{c}`").alias(f"_mix_order_{i}") for i, c in enumerate(order)],
        F.shiftrightunsigned(mark, 64 - BUCKETS.bit_length() + 1).cast("int").alias("_mix_bucket"),
    )
    counts = written(keyed.groupBy(*_CELL, "_mix_bucket").agg(F.count("*").alias("_mix_n")), "mix-counts")
    cells = counts.groupBy(*_CELL).agg(F.sum("_mix_n").alias("_mix_n"))
    aims = written(targets(cells.groupBy(*_SOURCE).agg(F.sum(F.col("_mix_size") * F.col("_mix_n")).alias("_mix_total"))), "mix-targets")
    plan = cells.join(aims, _SOURCE).groupBy(*_SOURCE).applyInPandas(_plan, "_mix_none boolean, _mix_source string, _mix_size bigint, _mix_copies bigint, _mix_more bigint")
    ahead = Window.partitionBy(*_CELL).orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(*_CELL, "_mix_bucket", F.coalesce(F.sum("_mix_n").over(ahead), F.lit(0)).alias("_mix_ahead"))
    steps = placed.join(plan, _CELL).join(aims, _SOURCE).withColumn("_mix_more", F.col("_mix_more") - F.col("_mix_ahead"))
    steps = written(steps.drop("_mix_ahead"), "mix-plan")
    inside = Window.partitionBy(*_CELL, "_mix_bucket").orderBy("_mix_mark", *[f"_mix_order_{i}" for i in range(len(order))])
    ranked = keyed.withColumn("_mix_rank", F.row_number().over(inside))
    copies = F.col("_mix_copies") + (F.col("_mix_rank") <= F.col("_mix_more")).cast("bigint")
    mix = F.struct(F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), copies.alias("copies"))
    joined = ranked.join(steps, [*_CELL, "_mix_bucket"])
    return joined.select(*[F.col(f"_row_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() != "mix"], mix.alias("mix"))


def repeated(docs: DataFrame, text: str = "text", source: str = "source", id_column: str = "doc_id", seed: int = 8) -> DataFrame:
    """The mix itself: each row as many times as it is taken, with the columns of `docs`."""
    held = {c: unused(docs, "_mix_own") for c in docs.columns if c.lower() == "mix"}
    out = mixed(docs.withColumnsRenamed(held), words(F.col(f"`{held.get(text, text)}`")), held.get(source, source), (held.get(id_column, id_column),), seed)
    again = F.explode(F.array_repeat(F.lit(1), F.col("mix.copies").cast("int"))).alias(unused(out, "_mix_copy"))
    return out.select("*", again).select(*[F.col(f"`{held.get(c, c)}`").alias(c) for c in docs.columns])
