"""Run the rules over listings: findings, score and segment. One projection, no shuffle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .rules import RULES, Rule, prepare


def _as_of(now: datetime | str | None) -> Column:
    return F.current_timestamp() if now is None else T.instant(F.lit(str(now)))


def _hit(rule: Rule, texts: bool) -> Column:
    fields = [F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity")]
    if texts:
        evidence = rule.evidence() if rule.evidence else F.lit(None)
        fields += [rule.message().cast("string").alias("message"), evidence.cast("string").alias("evidence")]
    return F.when(rule.when(), F.struct(*fields))


def hits(
    listings: DataFrame,
    now: datetime | str | None = None,
    rules: list[Rule] = RULES,
    texts: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """`keep` columns (all by default) plus `hits` (one entry per rule in registry order, NULL where the
    rule passes), `score` and `segment`.

    `texts=False` leaves out messages and evidence, which the aggregate reports do not need.
    """
    keep = listings.columns if keep is None else keep
    ready = prepare(listings.withColumn("r_now", _as_of(now)))
    checked = ready.select(*keep, F.array(*[_hit(r, texts) for r in rules]).alias("hits"), segment().alias("segment"))
    penalty = sum((F.when(F.get("hits", F.lit(i)).isNotNull(), P.SEVERITY_WEIGHT[r.severity]).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
    return checked.withColumn("score", F.greatest(F.lit(0), F.lit(100) - penalty))


def scores(listings: DataFrame, now: datetime | str | None = None, rules: list[Rule] = RULES, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns plus `score` and `segment`, as `hits` gives them, for those who don't ask which rules failed: one sum of
    weights, and no entry made for a finding."""
    keep = listings.columns if keep is None else keep
    ready = prepare(listings.withColumn("r_now", _as_of(now)))
    penalty = sum((F.when(r.when(), P.SEVERITY_WEIGHT[r.severity]).otherwise(0) for r in rules), F.lit(0))
    return ready.select(*keep, F.greatest(F.lit(0), F.lit(100) - penalty).alias("score"), segment().alias("segment"))


def audit(listings: DataFrame, now: datetime | str | None = None, rules: list[Rule] = RULES, keep: list[str] | None = None) -> DataFrame:
    """Listings with `findings` (only the failed rules), `score` and `segment`."""
    checked = hits(listings, now, rules, keep=keep)
    rest = [c for c in checked.columns if c not in ("hits", "score", "segment")]
    return checked.select(*rest, F.filter("hits", lambda h: h.isNotNull()).alias("findings"), "score", "segment")


def findings_of(checked: DataFrame, key: str = "id", name: str = "product_id") -> DataFrame:
    """One row per (listing, failed rule) from the result of `hits`; `position` is the rule's place in the registry.

    The outer explode keeps Spark from inferring a "non-empty array" filter, which it would push below
    the rules and so run them twice.
    """
    exploded = checked.select(F.col(key).alias(name), F.posexplode_outer("hits").alias("position", "_hit"))
    return exploded.where(F.col("_hit").isNotNull()).select(name, "position", "_hit.*")


def segment_signals() -> dict[str, Column]:
    specs = F.coalesce(F.col("specs"), F.array().cast("array<struct<label:string,value:string>>"))
    length = F.length(F.coalesce("description", F.col("json_ld.description"), F.lit("")))
    images = F.greatest(F.coalesce("gallery_image_count", F.lit(0)), F.coalesce(F.size("json_ld.images"), F.lit(0)))
    return {
        "generic_specs_only": (F.size(specs) <= 2) & F.forall(specs, lambda s: T.has(s["label"], P.GENERIC_SPEC)),
        "short_description": length < P.THIN_DESCRIPTION_CHARS,
        "single_image": images <= 1,
        "no_specs": F.size(specs) == 0,
        "no_description": length == 0,
    }


def segment() -> Column:
    s = segment_signals()
    return (
        F.when(s["generic_specs_only"] & s["short_description"] & s["single_image"], "thin-feed")
        .when(s["no_specs"] & s["no_description"], "no-copy")
        .otherwise("standard")
    )


def tallies(checked: DataFrame) -> DataFrame:
    """Listings audited and rounded mean score, then counts per rule and per segment, largest first within each kind.

    One pass: every listing contributes its own row, its segment and its failed rules as (kind, name) entries.
    """
    entries = F.concat(
        F.array(
            F.struct(F.lit("listings").alias("kind"), F.lit("all").alias("name")),
            F.struct(F.lit("segment").alias("kind"), F.col("segment").alias("name")),
        ),
        F.transform("hits", lambda h: F.when(h.isNotNull(), F.struct(F.lit("rule").alias("kind"), h["rule_id"].alias("name")))),
    )
    return (
        checked.select("score", F.explode_outer(entries).alias("_entry"))
        .where(F.col("_entry").isNotNull())
        .groupBy("_entry.kind", "_entry.name")
        .agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("_entry.kind") == "listings", F.col("score")))).cast("int").alias("mean_score"))
        .orderBy("kind", F.desc("n"), "name")
    )


SEGMENTS = [
    ("thin-feed", "Bare import", "Generic specifications only, fewer than 100 characters of copy and a single image: a feed imported as it came."),
    ("no-copy", "No copy", "Neither description nor specifications."),
    ("standard", "Standard", "None of the import signatures."),
]


def segment_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(SEGMENTS)]
    return spark.createDataFrame(rows, "position int, segment string, label string, description string")
