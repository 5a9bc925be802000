"""The registered queries: each operator applied to the tables of `plans.bridge`."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, crawl, extract, history, lens, match, pricing, search
from ..operators.rules import RULES
from ..schemas import PRICE_FEED
from ..session import shared_folder
from ..sources import files, tables
from ..sources.tables import write_version
from ..streaming import imports
from ..streaming.history import keep_price_changes, kept_changes
from . import bridge, reports

Query = Callable[[SparkSession, str], DataFrame]

PRODUCT = ["id", "name", "slug", "brand", "sku", "gtin", "category_path"]
SNAPSHOT = PRODUCT + ["gallery_image_count", "json_ld", "specs", "description"]


def checked(spark: SparkSession, d: str, keep: list[str] = PRODUCT, now: str = bridge.NOW) -> DataFrame:
    """Listings with score, segment and light findings, computed afresh."""
    return audit.hits(bridge.listings(spark, d), now, texts=False, keep=keep)


def scored(spark: SparkSession, d: str, keep: list[str] = PRODUCT) -> DataFrame:
    """Listings with score and segment alone."""
    return audit.scores(bridge.listings(spark, d), bridge.NOW, keep=keep)


def audit_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The audited products and their findings as an audit job leaves them: one table in the shared folder, written anew
    for each report that reads both. Joined within one plan, the rules would run once for either side."""
    path = write_version(checked(spark, d), f"{shared_folder(spark)}/audited-{uuid.uuid4().hex}", 1)
    table = spark.read.parquet(path)
    return table.drop("hits"), audit.findings_of(table)


def _rule(rule_id: str) -> Query:
    rule = [r for r in RULES if r.id == rule_id]

    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = audit.hits(bridge.listings(spark, d), bridge.NOW, rules=rule, keep=["id"])
        return audit.findings_of(hits).select("product_id", "severity", "message", "evidence")

    return run


def _detail(s: SparkSession, d: str, part: str, id: int = 7) -> DataFrame:
    """One part of a listing's detail page. Only the listing itself is audited for it."""
    one = audit.hits(bridge.listings(s, d).where(F.col("id") == id), bridge.NOW, keep=PRODUCT)
    changes = history.price_changes(bridge.table(s, d, "price_feed").where(F.col("product_id") == id))
    return reports.listing_detail(one.drop("hits"), audit.findings_of(one), changes, bridge.table(s, d, "observations"), id)[part]


def audit_queries() -> dict[str, Query]:
    out: dict[str, Query] = {"rule_" + r.id.replace("-", "_"): _rule(r.id) for r in RULES}
    full = lambda s, d: audit.hits(bridge.listings(s, d), bridge.NOW, keep=["id"])
    out["audit_findings"] = lambda s, d: audit.findings_of(full(s, d))
    out["audit_scores"] = lambda s, d: scored(s, d).select("id", "score")
    out["segment_signals"] = lambda s, d: bridge.listings(s, d).select("id", *[c.alias(n) for n, c in audit.segment_signals().items()])
    out["segments"] = lambda s, d: scored(s, d).select("id", "segment")
    out["audit_tallies"] = lambda s, d: audit.tallies(checked(s, d))
    out["gtin_check"] = lambda s, d: bridge.table(s, d, "facts").where("gtin IS NOT NULL").select(F.col("k").alias("id"), "gtin", T.valid_gtin(F.col("gtin")).alias("valid"))
    # Reports on one of the two tables compute it in their own plan.
    products = scored
    findings = lambda s, d: audit.findings_of(checked(s, d))
    out["overview_totals"] = lambda s, d: reports.totals(products(s, d))
    out["overview_totals_of_segment"] = lambda s, d: reports.totals(products(s, d), "thin-feed")
    out["finding_totals"] = lambda s, d: reports.finding_totals(findings(s, d))
    out["finding_totals_of_segment"] = lambda s, d: (lambda p, f: reports.finding_totals(f, p, "thin-feed"))(*audit_tables(s, d))
    out["affected_per_rule"] = lambda s, d: reports.affected_per_rule(findings(s, d))
    out["affected_per_rule_of_segment"] = lambda s, d: (lambda p, f: reports.affected_per_rule(f, p, "thin-feed"))(*audit_tables(s, d))
    out["rule_shares_of_segment"] = lambda s, d: (lambda p, f: reports.rule_shares(f, p, "thin-feed"))(*audit_tables(s, d))
    out["score_histogram"] = lambda s, d: reports.score_histogram(products(s, d))
    out["labelled_histogram"] = lambda s, d: reports.labelled_histogram(products(s, d))
    out["worst_listings"] = lambda s, d: reports.worst_listings(products(s, d))
    out["segment_rollup"] = lambda s, d: reports.segment_rollup(products(s, d))
    out["rule_shares"] = lambda s, d: (lambda p, f: reports.rule_shares(f, p))(*audit_tables(s, d))
    shown = ["id", "name", "brand", "score", "segment"]
    out["listing_search_text"] = lambda s, d: reports.search_listings(products(s, d), text="WATCH").select(*shown)

    def indexed(s: SparkSession, d: str) -> DataFrame:
        """Three needles against one index: a word, a piece of SKUs, and one that is too short for the index."""
        folder = f"{shared_folder(s)}/search-{uuid.uuid4().hex}"
        table = s.read.parquet(write_version(scored(s, d), folder, 1))
        search.write_index(table, folder)
        found = [search.search(reports.audited(table), folder, needle).select(F.lit(needle).alias("needle"), *shown) for needle in ("WATCH", "ku12", "5%", " x")]
        return reduce(DataFrame.unionByName, found)

    out["listing_search_indexed"] = indexed
    out["listing_search_category"] = lambda s, d: reports.search_listings(products(s, d), category="PROMO", segment="standard").select(*shown)
    out["listing_search_finding"] = lambda s, d: (lambda p, f: reports.search_listings(p, f, rule="name-truncated", severity="medium").select(*shown))(*audit_tables(s, d))
    out["listing_severity_counts"] = lambda s, d: (lambda p, f: reports.severity_counts(p.select("id", "score"), f))(*audit_tables(s, d))
    out["listing_page"] = lambda s, d: reports.page_of(products(s, d).select("id", "name", "score"), 3)
    out["listing_page_after"] = lambda s, d: reports.page_after(audit_tables(s, d)[0].select("id", "name", "score"), 30, 100)
    out["listing_page_count"] = lambda s, d: reports.page_count(reports.search_listings(products(s, d), segment="thin-feed"))
    out["category_names"] = lambda s, d: reports.category_names(products(s, d))
    out["findings_with_fix"] = lambda s, d: reports.findings_with_fix(audit.findings_of(full(s, d)).drop("position"))
    out["listing_detail_product"] = lambda s, d: _detail(s, d, "product").select("id", "name", "slug", "score", "segment")
    out["listing_detail_findings"] = lambda s, d: _detail(s, d, "findings").select("rule_id", "severity", "title", "fix", "place")
    out["listing_detail_history"] = lambda s, d: _detail(s, d, "history").select("id", *_money("price"), "availability", _time("captured_at"))
    out["listing_detail_observations"] = lambda s, d: _detail(s, d, "observations").select("id", "retailer", "status")
    out["category_scorecard"] = lambda s, d: reports.category_scorecard(*audit_tables(s, d))
    out["category_scorecard_children"] = lambda s, d: reports.category_scorecard(*audit_tables(s, d), parent="PROMO")
    out["rules_by_category"] = lambda s, d: reports.rules_by_category(*audit_tables(s, d))
    out["template_wide_rules"] = lambda s, d: reports.template_wide_rules(*audit_tables(s, d), share=0.6)
    out["top_issues"] = lambda s, d: reports.top_issues(*audit_tables(s, d))
    out["segment_quality"] = lambda s, d: reports.segment_quality(products(s, d))
    out["thin_signals"] = lambda s, d: reports.thin_signals(scored(s, d, SNAPSHOT))
    out["thin_by_category"] = lambda s, d: reports.thin_by_category(products(s, d))
    out["thin_by_brand"] = lambda s, d: reports.thin_by_brand(products(s, d))
    out["thin_samples"] = lambda s, d: reports.thin_samples(products(s, d))
    return out


def _money(*columns: str):
    return [F.col(c).cast("double").alias(c) for c in columns]


def _time(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


def lens_queries() -> dict[str, Query]:
    t = bridge.table
    needed = ["id", "retailer", "price", "match", "status", "captured_at"]
    latest = lambda s, d: lens.latest_observations(t(s, d, "observations"), needed)
    rows = lambda s, d: lens.lens(latest(s, d), t(s, d, "products"))
    offer = lambda c: [F.col(f"{c}.price").cast("double").alias("price"), f"{c}.retailer", f"{c}.url", f"{c}.match"]
    out: dict[str, Query] = {}
    out["latest_observations"] = lambda s, d: latest(s, d).select("product_id", "url", "id", "retailer", *_money("price"), "match", "status", _time("captured_at"))
    out["observation_ranks"] = lambda s, d: lens.ranked_observations(latest(s, d), t(s, d, "products")).select("product_id", "id", F.col("rank").cast("bigint").alias("rank"), *_money("difference"))
    out["retailers_checked"] = lambda s, d: lens.retailers_checked(latest(s, d)).select("product_id", F.array_join("retailers", "|").alias("retailers"))
    out["cheapest_comparable"] = lambda s, d: rows(s, d).where("cheapest IS NOT NULL").select("product_id", *offer("cheapest"))
    out["nearest_offers"] = lambda s, d: rows(s, d).where("nearest IS NOT NULL").select("product_id", *offer("nearest"))
    out["price_gaps"] = lambda s, d: rows(s, d).select("product_id", *_money("own_price", "gap"), "gap_pct")
    out["price_lens"] = lambda s, d: lens.ordered(rows(s, d)).select(
        "product_id", "name", "slug", *_money("own_price", "own_was_price"), "own_condition_label", "observations", "failed",
        F.col("cheapest.retailer").alias("cheapest_retailer"), F.col("cheapest.price").cast("double").alias("cheapest_price"), *_money("gap"), "gap_pct",
    )
    out["lens_summary"] = lambda s, d: lens.summary(rows(s, d)).withColumn("last_fetched", F.date_format("last_fetched", "yyyy-MM-dd HH:mm:ss"))
    out["refusing_retailers"] = lambda s, d: lens.refusing_retailers(latest(s, d))
    out["price_changes"] = lambda s, d: history.price_changes(t(s, d, "price_feed")).select("product_id", "id", *_money("price"), "availability", _time("captured_at"))
    out["price_changes_streamed"] = _streamed_changes
    out["last_observations_per_product"] = lambda s, d: reports.last_per_product(t(s, d, "observations"), 5).select("product_id", "id", F.col("recency").cast("int").alias("recency"))
    out["last_changes_per_product"] = lambda s, d: reports.last_per_product(history.price_changes(t(s, d, "price_feed")), 3).select("product_id", "id", F.col("recency").cast("int").alias("recency"))
    return out


def _streamed_changes(spark: SparkSession, d: str) -> DataFrame:
    """The price feed arriving in four deliveries of several files, each taken in before the next one comes."""
    feed = bridge.table(spark, d, "price_feed").select("product_id", "price", "availability", "captured_at", "id")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for part in (F.year("captured_at") < 1994, F.year("captured_at").between(1994, 1995), F.year("captured_at").between(1996, 1997), F.year("captured_at") > 1997):
        feed.where(part).write.mode("append").parquet(f"{folder}/feed")
        keep_price_changes(spark.readStream.schema(PRICE_FEED).parquet(f"{folder}/feed"), folder)
    return kept_changes(spark, folder).select("product_id", "id", *_money("price"), "availability", _time("captured_at"))


def pricing_queries() -> dict[str, Query]:
    t = bridge.table
    out: dict[str, Query] = {}
    own_names = lambda s, d: bridge.items(s, d).join(t(s, d, "products").where("gtin IS NOT NULL").select("gtin", F.col("name").alias("own_name")), "gtin")
    out["variant_match"] = lambda s, d: own_names(s, d).select("item_id", match.assess_match(F.col("own_name"), F.col("title")).alias("m")).select("item_id", "m.*")
    checks = lambda s, d: pricing.check_mapped_pages(t(s, d, "mappings"), extract.page_offers(t(s, d, "fetched").join(t(s, d, "mappings").select("url"), "url", "left_semi").select("url", "status", "note", "html")))
    out["mapped_page_check"] = lambda s, d: checks(s, d).select("product_id", "url", "title", *_money("price"), "currency", "condition", "availability", "seller_type", "status", "note")
    judged = lambda s, d: pricing.judge_items(t(s, d, "products"), bridge.items(s, d))
    out["marketplace_candidates"] = lambda s, d: judged(s, d).select("product_id", "item_id", "shipping", "landed", "reason", "match", "business")
    best = lambda s, d: pricing.best_offers(judged(s, d))
    out["marketplace_best_offers"] = lambda s, d: best(s, d).where("best IS NOT NULL").select(
        "product_id", "items", "comparable", "best.item_id", "best.landed", "best.match", "best.business",
        F.col("cheaper_individual.landed").alias("individual"), F.col("cheaper_lesser.landed").alias("lesser"), F.col("cheaper_lesser.match").alias("lesser_match"),
    )
    out["marketplace_skipped"] = lambda s, d: best(s, d).select("product_id", "skipped")
    out["marketplace_check"] = lambda s, d: pricing.check_marketplace(t(s, d, "products"), bridge.items(s, d)).select(
        "product_id", "status", "item_id", *_money("price", "item_price", "shipping_cost"), "availability", "seller", "seller_type", "match", "note"
    )
    parses = lambda s, d, *fields: files.parsed_rows(t(s, d, "parse_docs").select("value"), fields=fields)
    odd = lambda s, d: files.parsed_rows(t(s, d, "parse_docs_odd").select("value", "product_id", "s"))
    out["parsed_prices"] = lambda s, d: odd(s, d).select(
        "product_id", "s", "parser", F.coalesce("row_number", F.lit(-1)).alias("row_number"), "row.i", "row.sku", "row.url", "row.price", "row.delivery_cost", "row.stock", "row.match",
        F.coalesce(F.array_join("row.ignored", ";"), F.lit("-")).alias("ignored"), F.array_join("violations", ",").alias("violations"),
    )
    out["accepted_parses"] = lambda s, d: files.accepted(odd(s, d)).select("parser", "row.i", "row.url", "row.price", "row.confidence", F.array_join("row.ignored", ";").alias("ignored"))
    out["rejected_parses"] = lambda s, d: files.rejected(odd(s, d)).select("product_id", "s", F.coalesce("row_number", F.lit(-1)).alias("row_number"), F.array_join("violations", ",").alias("violations"))

    def streamed(s: SparkSession, d: str) -> DataFrame:
        """The import's bodies arriving as files in two deliveries, first entries and then second ones."""
        folder = f"{shared_folder(s)}/imports-{uuid.uuid4().hex}"
        docs = t(s, d, "parse_docs_again").withColumn("second", F.contains("value", F.lit('"i":9')) & F.contains("value", F.lit('"price":7,"old"')))
        for second in (False, True):
            docs.where(F.col("second") == second).select("value").write.mode("append").option("lineSep", "\n").option("compression", "lz4").text(f"{folder}/in")
            # A line is a body here; whole files are read by `files.stream_bodies`.
            bodies = s.readStream.text(f"{folder}/in")
            imports.import_stream(bodies, t(s, d, "products"), t(s, d, "captures_again"), t(s, d, "parsed_before"), "parsed", folder).awaitTermination()
        return imports.stored(s, folder).select("product_id", "url", *_money("price"), "match", "status", _time("captured_at"))

    out["import_streamed"] = streamed
    both = lambda s, d: pricing.import_documents(t(s, d, "parse_docs_again"), t(s, d, "products"), t(s, d, "captures_again"), t(s, d, "parsed_before"), "parsed", f"{shared_folder(s)}/parses-{uuid.uuid4().hex}")
    imported = lambda s, d: both(s, d)[0]
    out["import_rejects"] = lambda s, d: both(s, d)[1].select("product_id", "s", F.coalesce("row_number", F.lit(-1)).alias("row_number"), F.array_join("violations", ",").alias("violations"))
    out["import_parses"] = lambda s, d: imported(s, d).where("outcome = 'stored'").select(
        "product_id", "url", "title", *_money("price", "item_price", "shipping_cost", "was_price"), "currency", "availability", "match", "match_note", "status", "note", _time("captured_at")
    )
    pages = lambda s, d: pricing.import_pages(t(s, d, "parse_docs_mended"), t(s, d, "products"), t(s, d, "captures_again"), t(s, d, "parsed_before"), "parsed", f"{shared_folder(s)}/parses-{uuid.uuid4().hex}")
    out["import_captures"] = lambda s, d: pages(s, d).select("capture_id", "url", _time("fetched_at"), "title", F.variant_get("meta", "$.parser", "string").alias("parser"), F.variant_get("meta", "$.match", "string").alias("match"))
    out["import_matches"] = lambda s, d: tables.propagate_match(
        t(s, d, "mappings"), imported(s, d).where("outcome = 'stored'").select("product_id", "url", "match", "match_note", "captured_at", F.col("capture_id").alias("id")), ["product_id", "url"]
    ).select("product_id", "url", "match", "match_note")
    reading = lambda s, d: t(s, d, "readings").selectExpr(
        "url", "model", "error",
        """CASE WHEN has_row THEN named_struct('product_title', CASE WHEN s % 4 = 0 THEN NULL ELSE 'Read ' || CAST(product_id AS STRING) END, 'price', CASE WHEN has_price THEN CAST(50 + s AS DOUBLE) END,
           'delivery_cost', CASE WHEN s % 2 = 0 THEN 2.5D END, 'stock', 'in_stock', 'match', seen, 'match_note', CASE WHEN s % 3 = 0 THEN 'other size' END, 'confidence', 0.5D, 'price_evidence', CASE WHEN s % 7 = 0 THEN '' ELSE 'tag' END) END AS row""",
    )
    run = lambda s, d: pricing.extract_run(t(s, d, "mappings"), t(s, d, "captures_again"), reading(s, d), "reader")
    out["extract_run"] = lambda s, d: run(s, d).select("product_id", "url", "title", *_money("price", "item_price", "shipping_cost"), "currency", "availability", "match", "match_note", "status", "note", _time("captured_at"))
    out["extract_run_matches"] = lambda s, d: pricing.extract_run_matches(t(s, d, "mappings"), run(s, d)).select("product_id", "url", "match", "match_note")
    out["import_outcomes"] = lambda s, d: pricing.outcomes(*both(s, d))
    out["landed_prices"] = lambda s, d: parses(s, d, "url", "price", "delivery_cost").select("row.url", pricing.landed_price(F.col("row.price"), F.col("row.delivery_cost")).alias("landed"), pricing.parse_status(F.col("row.price"), F.lit(None).cast("string")).alias("status"))
    out["worst_match"] = lambda s, d: match.worsened(t(s, d, "mappings"), parses(s, d, "url", "match").select(F.col("row.url").alias("url"), F.col("row.match").alias("seen")))
    asked = lambda: F.array(*map(F.lit, ("product_title", "stock", "match", "confidence", "ignored")))
    out["parse_violations"] = lambda s, d: parses(s, d, "url").select("row.url", F.array_join(F.array_intersect(asked(), "violations"), ",").alias("violations")).where("violations <> ''")
    lines = lambda s, d: files.parse_mappings(t(s, d, "mapping_lines"))
    out["mapping_lines"] = lambda s, d: lines(s, d)[0]
    out["mapping_rejects"] = lambda s, d: lines(s, d)[1]
    out["resolved_keys"] = lambda s, d: pricing.resolve_keys(lines(s, d)[0], t(s, d, "products"))[0].select("key", "url", "product_id")
    out["unresolved_keys"] = lambda s, d: pricing.resolve_keys(lines(s, d)[0], t(s, d, "products"))[1].select("key", "url")
    out["check_targets"] = lambda s, d: pricing.check_targets(t(s, d, "products"), t(s, d, "mappings")).select("id", "sku")
    out["check_targets_with_gtin"] = lambda s, d: pricing.check_targets(t(s, d, "products"), t(s, d, "mappings"), with_gtin=True, limit=50).select("id", "sku")
    out["targets_by_sku"] = lambda s, d: pricing.targets_by_sku(t(s, d, "products_again"), t(s, d, "sku_list"))[0].select("pos", "sku", "id")
    out["missing_skus"] = lambda s, d: pricing.targets_by_sku(t(s, d, "products_again"), t(s, d, "sku_list"))[1].select("pos", "sku")
    out["urls_to_capture"] = lambda s, d: pricing.urls_to_capture(t(s, d, "mappings"), t(s, d, "captures"))
    keyed = lambda s, d: t(s, d, "fetched").where("html IS NOT NULL").select("url", "product_id", pricing.parse_key("v1", "reader", F.col("url"), F.lit("own"), F.col("html")).alias("parse_key"))
    out["parse_keys"] = lambda s, d: keyed(s, d).select("url", "parse_key")
    out["parses_to_do"] = lambda s, d: pricing.parses_to_do(keyed(s, d), keyed(s, d).where("product_id % 2 = 0")).select("url")
    out["capture_keys"] = lambda s, d: t(s, d, "captures").select("url", files.capture_key(F.col("url")).alias("capture_key"))
    out["captures_found"] = lambda s, d: files.captures_for(t(s, d, "mappings"), t(s, d, "captures").withColumn("capture_key", files.capture_key(F.col("url")))).select("url", "title", _time("fetched_at"))
    out["url_list"] = lambda s, d: files.parse_url_list(t(s, d, "url_lines"))
    return out


def crawl_queries() -> dict[str, Query]:
    t = bridge.table
    out: dict[str, Query] = {}
    entries = lambda s, d: crawl.sitemap_entries(t(s, d, "sitemaps"))
    out["sitemap_entries"] = lambda s, d: entries(s, d).select("pos", "entry", "url", _time("lastmod"))
    out["child_sitemaps"] = lambda s, d: crawl.child_sitemaps(t(s, d, "sitemaps")).select("pos", "url")
    out["sitemap_products"] = lambda s, d: crawl.product_entries(entries(s, d)).select("url", "pos", "entry")
    out["sitemap_products_with_children"] = lambda s, d: crawl.product_entries(entries(s, d), crawl.sitemap_entries(t(s, d, "child_maps"))).select("url", "pos", "entry", _time("lastmod"))
    frontier = lambda s, d: crawl.product_entries(entries(s, d))
    out["crawl_order"] = lambda s, d: crawl.crawl_order(frontier(s, d), t(s, d, "fetch_log"), 400).select("url", "pos")
    out["crawl_order_known"] = lambda s, d: crawl.crawl_order(frontier(s, d), t(s, d, "fetch_log"), known_only=True).select("url", _time("last_fetched"))
    described = lambda c: F.array_join(F.transform(c, lambda r: F.concat(F.when(r["allow"], "+").otherwise("-"), r["pattern"])), " ")
    out["robots_rules"] = lambda s, d: crawl.robots_rules(crawl.newest_robots(t(s, d, "robots"))).select("host", F.col("group").cast("int").alias("grp"), F.array_join("agents", ",").alias("agents"), described("rules").alias("rules"), "delay")
    out["robots_admission"] = lambda s, d: crawl.admit(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url"), t(s, d, "robots"), "shelfbot/1.0 (test)").select("page_id", "allowed", "delay")
    log = lambda s, d: t(s, d, "fetch_log")
    out["fetch_status"] = lambda s, d: log(s, d).select("seq", crawl.fetch_status(F.col("http_status")).alias("status"))
    out["stop_at_refusal_of_run"] = lambda s, d: crawl.with_stop(log(s, d), "run_id").select("seq", "skipped")
    out["stop_at_refusal_of_host"] = lambda s, d: crawl.with_stop(log(s, d), "host").select("seq", "skipped")
    runs = lambda s, d: crawl.run_summary(log(s, d))
    out["run_summary"] = lambda s, d: runs(s, d).select("run_id", _time("started_at"), _time("finished_at"), "urls_planned", "pages_fetched", "pages_failed")
    out["latest_run"] = lambda s, d: reports.latest_run(runs(s, d)).select("run_id", "urls_planned", "pages_fetched", "pages_failed")
    out["host_probe_summary"] = lambda s, d: crawl.host_probe_summary(log(s, d))
    out["spacing_plan"] = lambda s, d: crawl.spacing_plan(t(s, d, "requests"), piece=1000).select("host", "seq", "planned_offset")
    return out


def table_queries() -> dict[str, Query]:
    t = bridge.table
    out: dict[str, Query] = {}
    out["product_scan"] = lambda s, d: tables.scan(s, f"{d}/part.parquet", "p_partkey", "p_name", "p_brand")
    out["upsert_products"] = lambda s, d: tables.upsert_products(t(s, d, "stored_products"), t(s, d, "crawled")).select("id", "url", *_money("price"), "name", _time("first_seen_at"), _time("last_crawled_at"))

    def audited_twice(s: SparkSession, d: str) -> DataFrame:
        """Everything audited long ago, and one category audited again now: the committed version of the products."""
        folder = f"{shared_folder(s)}/audits-{uuid.uuid4().hex}"
        before = checked(s, d, PRODUCT, "2019-06-01 00:00:00")
        marks = F.lit("2019-06-01 00:00:00").cast("timestamp").alias("audited_at"), F.filter("hits", lambda h: h.isNotNull()).alias("findings")
        write_version(before.select("id", "score", "segment", *marks), folder, 1)
        tables.reaudit(s, folder, checked(s, d, PRODUCT).where(reports.in_category("PROMO")), F.lit(bridge.NOW).cast("timestamp"))
        return tables.read_version(s, folder, tables.latest_version(s, folder))

    out["replace_findings"] = lambda s, d: tables.findings_in(audited_twice(s, d)).select("product_id", "rule_id", "severity")
    out["apply_audit"] = lambda s, d: audited_twice(s, d).select("id", "score", "segment", _time("audited_at"))

    def merged(s: SparkSession, d: str) -> DataFrame:
        stored = tables.save_bucketed(t(s, d, "stored_products"), f"stored_products_{uuid.uuid4().hex}", ["url"], 16)
        return tables.merge_products(stored, t(s, d, "crawled"))

    out["merge_products"] = lambda s, d: merged(s, d).select("id", "url", *_money("price"), "name", _time("first_seen_at"), _time("last_crawled_at"))
    incoming = lambda s, d: t(s, d, "pairs").selectExpr(
        "product_id", "'https://r' || CAST(s AS STRING) || '.example/i/' || CAST(product_id AS STRING) || CASE WHEN s % 10 = 1 THEN '?new' ELSE '' END AS url",
        "'Renamed ' || CAST(s AS STRING) AS retailer", "'near' AS match", "CAST(NULL AS STRING) AS match_note", "s AS line",
    )
    out["upsert_mappings"] = lambda s, d: tables.upsert_mappings(t(s, d, "mappings").where("match <> 'exact'"), incoming(s, d))

    def appended(s: SparkSession, d: str) -> DataFrame:
        path = f"{shared_folder(s)}/observations-{uuid.uuid4().hex}"
        tables.append(t(s, d, "observations"), path)
        tables.append(pricing.check_marketplace(t(s, d, "products"), bridge.items(s, d)).select("product_id", "source", "retailer", "price", "status"), path)
        return s.read.option("mergeSchema", True).parquet(path).groupBy("source", "status").agg(F.count("*").alias("n"))

    out["append_observations"] = appended
    out["propagate_match"] = lambda s, d: tables.propagate_match(
        t(s, d, "mappings"), t(s, d, "observations").withColumn("match_note", F.lit("page")).where("url IS NOT NULL"), ["product_id", "url"]
    ).select("product_id", "url", "match", "match_note")
    values = lambda s, d: files.parsed_rows(t(s, d, "parse_docs").select("value"), fields=("stock", "match")).select(F.col("row.stock").alias("availability"), F.col("row.match").alias("match"))
    out["invalid_values"] = lambda s, d: tables.invalid_values(values(s, d), ["availability", "match"])
    out["duplicate_keys"] = lambda s, d: tables.duplicate_keys(t(s, d, "observations"), "product_id", "url")
    out["orphans"] = lambda s, d: tables.orphans(t(s, d, "fetch_log"), "url", t(s, d, "products"), "url").select("seq", "url")
    return out


def extract_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    found = lambda s, d: extract.extract_listings(bridge.product_pages(s, d))
    out["page_head_fields"] = lambda s, d: found(s, d).select("id", "slug", "title_tag", "meta_description", "canonical", "og_image", "robots_meta")
    out["page_headings"] = lambda s, d: found(s, d).select("id", "h1", "h1_count")
    out["page_category_trail"] = lambda s, d: found(s, d).select("id", F.array_join("breadcrumbs", "|").alias("trail"))
    out["page_specs"] = lambda s, d: found(s, d).select("id", F.posexplode("specs").alias("pos", "x")).select("id", "pos", "x.label", "x.value")
    out["page_variants"] = lambda s, d: found(s, d).select(F.col("id").alias("page"), F.posexplode("condition_variants").alias("pos", "x")).select("page", "pos", "x.*")
    out["page_prices"] = lambda s, d: found(s, d).select("id", "visible_price", "visible_was_price", "out_of_stock_notice")
    out["page_condition_and_description"] = lambda s, d: found(s, d).select("id", "condition_label", "condition_notes", "description")
    out["page_images"] = lambda s, d: found(s, d).select("id", "gallery_image_count", "images_missing_alt")
    out["page_product_nodes"] = lambda s, d: found(s, d).select("id", "json_ld_product_count", "json_ld.name", "json_ld.sku", "json_ld.gtin", "json_ld.brand", "json_ld.description", F.coalesce(F.array_join("json_ld.images", " "), F.lit("-")).alias("images"))
    out["page_node_offers"] = lambda s, d: found(s, d).where("json_ld.offer IS NOT NULL").select("id", "json_ld.offer.*")
    out["page_product_columns"] = lambda s, d: extract.product_columns(found(s, d)).drop("url", "was_price").withColumn("price", F.col("price").cast("double"))
    out["page_audit"] = lambda s, d: audit.hits(found(s, d), bridge.NOW, texts=False, keep=["id"]).select(
        "id", "segment", "score", F.array_join(F.transform(F.filter("hits", lambda h: h.isNotNull()), lambda h: h["rule_id"]), ",").alias("rules")
    )
    raw = lambda s, d: s.read.parquet(f"{d}/pages.parquet")
    out["raw_page_headings"] = lambda s, d: extract.extract_listings(raw(s, d)).select("page_id", "slug", "title_tag", "h1_count", "json_ld_product_count", "gallery_image_count")
    out["page_cheapest_offers"] = lambda s, d: extract.page_offers(bridge.table(s, d, "fetched").where("html IS NOT NULL").select("url", "html")).select("url", "product_count", "offer.title", "offer.price", "offer.currency", "offer.condition", "offer.availability")

    def challenges(s: SparkSession, d: str) -> DataFrame:
        pages = bridge.table(s, d, "fetched").where("html IS NOT NULL").withColumn("body", F.col("html"))
        return extract.page_offers(pages).select("url", extract.is_challenge(F.col("body"), F.col("product_count")).alias("challenge"))

    out["challenge_pages"] = challenges
    facts = lambda s, d: bridge.table(s, d, "facts")
    out["clean_text"] = lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.clean(F.col("text")).alias("text"))
    out["price_texts"] = lambda s, d: facts(s, d).selectExpr("k AS id", "'From £' || CAST(k AS STRING) || ',' || lpad(CAST(k % 1000 AS STRING), 3, '0') || CASE k % 3 WHEN 0 THEN '.5 each' WHEN 1 THEN '.257' ELSE '' END AS t").select("id", T.price_from_text(F.col("t")).alias("price"))
    out["slugs"] = lambda s, d: facts(s, d).select(F.col("k").alias("id"), T.slug_of(F.concat("url", F.when(F.col("k") % 2 == 0, "/?x=1#y").otherwise(""))).alias("slug"))
    odd = lambda s, d: bridge.table(s, d, "odd_urls")
    out["url_paths"] = lambda s, d: odd(s, d).select("id", T.url_path(F.col("url")).alias("path"), T.slug_of(F.col("url")).alias("slug"), (T.resolved_path(F.col("ref"), F.col("url")) == T.url_path(F.col("url"))).alias("same"))
    out["vocabularies"] = lambda s, d: facts(s, d).select(
        F.col("k").alias("id"), T.condition_from_label(F.col("condition_label")).alias("from_label"),
        T.condition_of(F.concat("offer_condition", F.lit("Condition"))).alias("condition"), T.availability_of(F.replace("offer_availability", F.lit("_"), F.lit(""))).alias("availability"),
    )
    return out


def all_queries() -> dict[str, Query]:
    return {**lens_queries(), **audit_queries(), **pricing_queries(), **extract_queries(), **crawl_queries(), **table_queries()}
