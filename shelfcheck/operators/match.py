"""Is a competitor's listing the same variant? Judged on the two titles, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def _words(title: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(title, F.lit("(" + P.jvm(pattern) + ")"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda w: F.regexp_replace(F.lower(w), P.WS + "+", " ")))


def _apart(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def assess_match(own_name: Column, listing_title: Column) -> Column:
    """struct<match, note>: `near` on another colour, capacity or a bundle; `uncertain` when the listing
    names no colour but the own name does; else `exact`."""
    own, theirs = F.coalesce(own_name, F.lit("")), F.coalesce(listing_title, F.lit(""))
    own_colours, their_colours = _words(own, P.COLOUR), _words(theirs, P.COLOUR)
    own_sizes, their_sizes = _words(own, P.CAPACITY), _words(theirs, P.CAPACITY)
    bundle = P.jvm(P.BUNDLE)

    def verdict(match: str, note: Column) -> Column:
        return F.struct(F.lit(match).alias("match"), note.cast("string").alias("note"))

    def differs(what: str, a: Column, b: Column) -> Column:
        return F.concat(F.lit(f"other {what}, "), F.array_join(b, "+"), F.lit(" instead of "), F.array_join(a, "+"))

    return (
        F.when(_apart(own_colours, their_colours), verdict("near", differs("colour", own_colours, their_colours)))
        .when(_apart(own_sizes, their_sizes), verdict("near", differs("capacity", own_sizes, their_sizes)))
        .when(theirs.rlike(bundle) & ~own.rlike(bundle), verdict("near", F.lit("sold as a set")))
        .when((F.size(own_colours) > 0) & (F.size(their_colours) == 0), verdict("uncertain", F.lit("offer leaves the colour open")))
        .otherwise(verdict("exact", F.lit(None)))
    )


def match_rank(match: Column) -> Column:
    """0 for exact, 1 for uncertain, 2 for near."""
    return F.coalesce(*[F.when(match == m, F.lit(i)) for i, m in enumerate(P.MATCHES)])


def worst_match(mapped: Column, seen: Column) -> Column:
    """The page may worsen the mapping's flag, never improve it."""
    return F.when(match_rank(seen) > match_rank(mapped), seen).otherwise(mapped)


def worsened(mappings: DataFrame, seen: DataFrame) -> DataFrame:
    """(url, match) of each mapping and each row of `seen` (url, seen) with its URL. Both sides grow, so neither is broadcast."""
    return seen.join(mappings.hint("merge"), "url").select("url", worst_match(F.col("match"), F.col("seen")).alias("match"))
