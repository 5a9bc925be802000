"""Report aggregates over the audited product table and the findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.audit import segment_dimension
from ..operators.rules import rule_dimension
from ..operators.search import holds

SEPARATOR = " > "


def audited(products: DataFrame) -> DataFrame:
    return products.where(F.col("score").isNotNull())


def mean_score(c: str = "score") -> Column:
    return F.round(F.avg(c)).cast("int")


def _severity_rank(c: str = "severity") -> Column:
    return F.coalesce(*[F.when(F.col(c) == s, F.lit(i)) for i, s in enumerate(P.SEVERITIES)])


def _share(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))


def level_name(level: int) -> Column:
    part = F.split_part("category_path", F.lit(SEPARATOR), F.lit(level))
    return F.coalesce(F.nullif(part, F.lit("")), F.lit("Uncategorised"))


def in_category(category: str) -> Column:
    """The category itself and all below it; the text is taken literally."""
    return (F.col("category_path") == category) | F.startswith("category_path", F.lit(category + SEPARATOR))


# --- overview ------------------------------------------------------------------


def totals(products: DataFrame, segment: str | None = None) -> DataFrame:
    rows = audited(products)
    if segment:
        rows = rows.where(F.col("segment") == segment)
    return rows.agg(F.count("*").alias("listings"), mean_score().alias("mean_score"))


def _findings_of(findings: DataFrame, products: DataFrame | None, segment: str | None) -> DataFrame:
    if not segment:
        return findings
    ids = products.where(F.col("segment") == segment).select(F.col("id").alias("product_id"))
    return findings.join(ids, "product_id", "left_semi")


def finding_totals(findings: DataFrame, products: DataFrame | None = None, segment: str | None = None) -> DataFrame:
    findings = _findings_of(findings, products, segment)
    high = F.col("severity") == "high"
    # One row per product first: distinct products then need no wide distinct.
    per_product = findings.groupBy("product_id").agg(F.count("*").alias("n"), F.count_if(high).alias("high"))
    return per_product.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("findings"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high"),
        F.count_if(F.col("high") > 0).alias("listings_with_high"),
    )


def affected_per_rule(findings: DataFrame, products: DataFrame | None = None, segment: str | None = None) -> DataFrame:
    """Listings per rule; a listing fails a rule once."""
    return _findings_of(findings, products, segment).groupBy("rule_id").agg(F.count("*").alias("affected"))


def score_histogram(products: DataFrame) -> DataFrame:
    bucket = F.least(F.floor(F.col("score") / 10), F.lit(9)).cast("int")
    return audited(products).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def labelled_histogram(products: DataFrame) -> DataFrame:
    """Ten buckets, empty ones included."""
    spark = products.sparkSession
    buckets = spark.range(10).select(F.col("id").cast("int").alias("bucket"))
    top = F.when(F.col("bucket") == 9, 100).otherwise(F.col("bucket") * 10 + 9)
    label = F.concat(F.col("bucket") * 10, F.lit("–"), top)
    return (
        buckets.join(score_histogram(products), "bucket", "left")
        .select("bucket", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("bucket")
    )


def worst_listings(products: DataFrame, n: int = 8, segment: str | None = None) -> DataFrame:
    rows = audited(products)
    if segment:
        rows = rows.where(F.col("segment") == segment)
    return rows.select("id", "name", "slug", "brand", "score").orderBy("score", "id").limit(n)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("started_at"), F.desc("run_id")).limit(1)


def segment_rollup(products: DataFrame) -> DataFrame:
    """All segments with count, mean score and share of everything audited, empty ones included."""
    counted = audited(products).groupBy("segment").agg(F.count("*").alias("n"), mean_score().alias("mean_score"))
    # The dimension holds three rows, so does this window; listings of an unnamed segment still count in the total.
    joined = segment_dimension(products.sparkSession).select("position", "segment", "label").join(counted, "segment", "full")
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        joined.withColumn("share", _share(n, F.sum(n).over(whole)))
        .where(F.col("label").isNotNull())
        .orderBy("position")
        .select("segment", "label", n.alias("n"), "mean_score", "share")
    )


def rule_shares(findings: DataFrame, products: DataFrame, segment: str | None = None) -> DataFrame:
    """Affected listings per known rule with its share of all audited (of the segment, if given) and its `place`:
    gravest and most frequent first."""
    listings = totals(products, segment).select("listings").scalar()
    rules = rule_dimension(findings.sparkSession).select("rule_id", "title", "severity", "category")
    order = Window.orderBy(_severity_rank(), F.desc("affected"), "rule_id")  # one row per rule
    return (
        affected_per_rule(findings, products, segment)
        .join(F.broadcast(rules), "rule_id")
        .withColumn("share", _share(F.col("affected"), listings))
        .withColumn("place", F.row_number().over(order))
        .orderBy("place")
    )


# --- listings --------------------------------------------------------------------


def search_listings(
    products: DataFrame,
    findings: DataFrame | None = None,
    text: str | None = None,
    segment: str | None = None,
    category: str | None = None,
    rule: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Audited listings that meet every given condition. `text` is looked for literally, whatever its case."""
    rows = audited(products)
    if text:
        rows = rows.where(holds(text))
    if segment in P.SEGMENT_IDS:
        rows = rows.where(F.col("segment") == segment)
    if category:
        rows = rows.where(in_category(category))
    if rule or severity:
        wanted = findings
        if rule:
            wanted = wanted.where(F.col("rule_id") == rule)
        if severity:
            wanted = wanted.where(F.col("severity") == severity)
        rows = rows.join(wanted.select(F.col("product_id").alias("id")), "id", "left_semi")
    return rows


def severity_counts(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Listings with their number of findings per severity."""
    counts = findings.groupBy(F.col("product_id").alias("id")).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in P.SEVERITIES]
    )
    return rows.join(counts, "id", "left").fillna(0, P.SEVERITIES)


def page_of(rows: DataFrame, page: int = 1, size: int = P.PAGE_SIZE) -> DataFrame:
    """A page by score and id. For deep pages use `page_after`, which does not read the pages before it."""
    return rows.orderBy("score", "id").offset((page - 1) * size).limit(size)


def page_after(rows: DataFrame, score: int, id: int, size: int = P.PAGE_SIZE) -> DataFrame:
    """The page that follows the listing with this score and id."""
    beyond = (F.col("score") > score) | ((F.col("score") == score) & (F.col("id") > id))
    return rows.where(beyond).orderBy("score", "id").limit(size)


def page_count(rows: DataFrame, size: int = P.PAGE_SIZE) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int"))


def category_names(products: DataFrame) -> DataFrame:
    """Top-level categories, most populated first."""
    name = F.split_part("category_path", F.lit(SEPARATOR), F.lit(1))
    return (
        products.where(F.col("category_path").isNotNull())
        .groupBy(name.alias("name"))
        .agg(F.count("*").alias("n"))
        .where(F.col("name") != "")
        .orderBy(F.desc("n"), "name")
    )


# --- one listing -------------------------------------------------------------------


def listing_detail(products: DataFrame, findings: DataFrame, history: DataFrame, observations: DataFrame, id: int) -> dict[str, DataFrame]:
    """Product row, findings with fix, last 20 price changes and last 30 observations of one product. `history` holds kept changes."""
    own = F.col("product_id") == id
    return {
        "product": products.where(F.col("id") == id).limit(1),
        "findings": findings_with_fix(findings.where(own)).orderBy("place"),
        "history": history.where(own).orderBy(F.desc("captured_at"), F.desc("id")).limit(20),
        "observations": observations.where(own).orderBy(F.desc("captured_at"), F.desc("id")).limit(30),
    }


def findings_with_fix(findings: DataFrame) -> DataFrame:
    """Findings with the rule's title and fix and their `place` in the product, gravest first."""
    rules = rule_dimension(findings.sparkSession).select("rule_id", "title", "fix", F.col("position").alias("rule_position"))
    order = Window.partitionBy("product_id").orderBy(_severity_rank(), F.asc_nulls_last("rule_position"), "rule_id")
    return (
        findings.join(F.broadcast(rules), "rule_id", "left")
        .withColumn("title", F.coalesce("title", "rule_id"))
        .withColumn("place", F.row_number().over(order))
        .drop("rule_position")
    )


def last_per_product(rows: DataFrame, k: int) -> DataFrame:
    """Newest `k` rows of every product. Spark keeps only `k` per product of each partition before it shuffles them."""
    w = Window.partitionBy("product_id").orderBy(F.desc("captured_at"), F.desc("id"))
    return rows.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= k)


# --- categories ----------------------------------------------------------------------


def _scoped(products: DataFrame, parent: str | None) -> DataFrame:
    return products.where(in_category(parent)) if parent else products


def category_scorecard(products: DataFrame, findings: DataFrame, parent: str | None = None) -> DataFrame:
    """Per category (children of `parent`, or top level): listings, mean score, thin, no copy, with high findings, thin share."""
    grave = findings.where(F.col("severity") == "high").groupBy(F.col("product_id").alias("id")).agg(F.lit(True).alias("has_high"))
    rows = audited(_scoped(products, parent)).select("id", "score", "segment", level_name(2 if parent else 1).alias("name"))
    return (
        rows.join(grave, "id", "left")
        .groupBy("name")
        .agg(
            F.count("*").alias("n"),
            mean_score().alias("mean_score"),
            F.count_if(F.col("segment") == "thin-feed").alias("thin_feed"),
            F.count_if(F.col("segment") == "no-copy").alias("no_copy"),
            F.count_if(F.col("has_high")).alias("with_high"),
        )
        .withColumn("thin_share", _share(F.col("thin_feed") + F.col("no_copy"), F.col("n")))
        .orderBy(F.desc("n"), "name")
    )


def rules_by_category(products: DataFrame, findings: DataFrame, parent: str | None = None) -> DataFrame:
    """Distinct products affected per (category, rule); findings of products not yet audited count too."""
    names = _scoped(products, parent).select(F.col("id").alias("product_id"), level_name(2 if parent else 1).alias("name"))
    # A product has one name and fails a rule once, so a plain count is distinct.
    return findings.select("product_id", "rule_id").join(names, "product_id").groupBy("name", "rule_id").agg(F.count("*").alias("affected"))


def template_wide_rules(products: DataFrame, findings: DataFrame, share: float = P.TEMPLATE_WIDE_SHARE) -> DataFrame:
    """Rules that hit nearly the whole catalogue."""
    return _wide(affected_per_rule(findings), products, share)


def _wide(affected: DataFrame, products: DataFrame, share: float) -> DataFrame:
    catalogue = audited(products).agg(F.count("*")).scalar()
    return (
        affected
        .withColumn("share", F.try_divide(F.col("affected").cast("double"), catalogue.cast("double")))
        .where(F.col("share") >= share)
    )


def top_issues(products: DataFrame, findings: DataFrame, parent: str | None = None, k: int = 3) -> DataFrame:
    """The `k` most frequent rules of each category, without the template-wide ones."""
    sizes = audited(_scoped(products, parent)).groupBy(level_name(2 if parent else 1).alias("name")).agg(F.count("*").alias("n"))
    known = rule_dimension(findings.sparkSession).select("rule_id", "title")
    order = Window.partitionBy("name").orderBy(F.desc("affected"), "rule_id")
    per = rules_by_category(products, findings, parent)
    # Over all categories, the sums per rule are the catalogue's counts.
    per_rule = affected_per_rule(findings) if parent else per.groupBy("rule_id").agg(F.sum("affected").alias("affected"))
    return (
        per.join(F.broadcast(known), "rule_id")
        .join(_wide(per_rule, products, P.TEMPLATE_WIDE_SHARE).select("rule_id"), "rule_id", "left_anti")
        .join(sizes, "name")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
        .withColumn("share", _share(F.col("affected"), F.col("n")))
        .select("name", "place", "rule_id", "title", "affected", "share")
        .orderBy("name", "place")
    )


# --- feed quality ------------------------------------------------------------------------


def segment_quality(products: DataFrame) -> DataFrame:
    return audited(products).groupBy("segment").agg(F.count("*").alias("n"), mean_score().alias("mean_score"), F.count("gtin").alias("with_gtin"))


def thin_signals(products: DataFrame) -> DataFrame:
    """How many thin listings show each sign, and the shares of the last four.

    Takes product columns plus the snapshot's `gallery_image_count`, `json_ld`, `specs` and `description`.
    """
    thin = products.where(F.col("segment") == "thin-feed")
    images = F.greatest(F.coalesce("gallery_image_count", F.lit(0)), F.coalesce(F.size("json_ld.images"), F.lit(0)))
    first_word = F.lower(F.split_part("brand", F.lit(" "), F.lit(1)))
    counted = thin.agg(
        F.count("*").alias("thin"),
        F.count_if(images <= 1).alias("one_image"),
        F.count_if(F.size("specs") <= 2).alias("placeholder_specs"),
        F.count_if(F.length(F.coalesce("description", F.lit(""))) < P.THIN_DESCRIPTION_CHARS).alias("short_description"),
        F.count_if(F.col("name").rlike(P.jvm(P.REPORT_TRUNCATED_NAME))).alias("truncated_name"),
        F.count_if(F.col("brand").isNotNull() & ~F.contains(F.lower("name"), first_word)).alias("brand_not_in_name"),
        F.count_if(F.col("slug").rlike(r"-[0-9]+\z")).alias("dedupe_slug"),
        F.count_if(F.col("gtin").isNull()).alias("no_gtin"),
    )
    shares = {f"{c}_share": _share(F.col(c), F.col("thin")) for c in ("brand_not_in_name", "dedupe_slug", "truncated_name", "no_gtin")}
    return counted.withColumns(shares)


def _thin_by(rows: DataFrame, key: str) -> DataFrame:
    return (
        rows.groupBy(key)
        .agg(F.count_if(F.col("segment") == "thin-feed").alias("thin_feed"), F.count("*").alias("n"))
        .where(F.col("thin_feed") > 0)
        .withColumn("share", _share(F.col("thin_feed"), F.col("n")))
        .orderBy(F.desc("thin_feed"), key)
    )


def thin_by_category(products: DataFrame) -> DataFrame:
    return _thin_by(audited(products).withColumn("name", level_name(1)), "name")


def thin_by_brand(products: DataFrame, n: int = 12) -> DataFrame:
    return _thin_by(audited(products).withColumn("brand", F.coalesce("brand", F.lit("Unknown"))), "brand").limit(n)


def thin_samples(products: DataFrame, n: int = 8) -> DataFrame:
    return worst_listings(products, n, "thin-feed")
