import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcheck.operators import search
from shelfcheck.plans import reports
from shelfcheck.session import shared_folder
from shelfcheck.sources import tables


def times(spark, text):
    return spark.sql(text)


def test_upsert_keeps_id_and_first_seen(spark):
    stored = spark.sql("SELECT * FROM VALUES (1L, 'a', 5, TIMESTAMP '2026-01-01 00:00:00', TIMESTAMP '2026-02-01 00:00:00'), (2L, 'b', 6, TIMESTAMP '2026-01-01 00:00:00', TIMESTAMP '2026-02-01 00:00:00') AS s(id, url, price, first_seen_at, last_crawled_at)")
    crawled = spark.sql("SELECT * FROM VALUES (CAST(NULL AS BIGINT), 'a', CAST(NULL AS INT), TIMESTAMP '2026-03-01 00:00:00', TIMESTAMP '2026-03-01 00:00:00'), (CAST(NULL AS BIGINT), 'c', 9, TIMESTAMP '2026-03-01 00:00:00', TIMESTAMP '2026-03-01 00:00:00') AS s(id, url, price, first_seen_at, last_crawled_at)")
    rows = {r["url"]: r for r in tables.upsert_products(stored, crawled).collect()}
    # The newest capture replaces all captured columns, missing ones included.
    assert rows["a"]["id"] == 1 and rows["a"]["price"] is None and rows["a"]["first_seen_at"].month == 1 and rows["a"]["last_crawled_at"].month == 3
    assert rows["b"]["price"] == 6 and rows["c"]["id"] is not None and len(rows) == 3


@pytest.mark.parametrize("swapped", [False, True])
def test_upsert_settles_ties_and_numbers_new_products(spark, swapped):
    kind = "id bigint, url string, price int, first_seen_at timestamp, last_crawled_at timestamp"
    import datetime

    at = datetime.datetime(2025, 1, 1)
    stored = spark.createDataFrame([(7, "a", 5, at, at)], kind)
    rows = [(None, "a", 3, at, at), (None, "a", 7, at, at), (None, "n1", 1, at, at), (None, "n2", 1, at, at), (40, "n3", 1, at, at)]
    crawled = spark.createDataFrame(rows[::-1] if swapped else rows, kind).repartition(3)
    got = {r["url"]: (r["id"], r["price"]) for r in tables.upsert_products(stored, crawled).collect()}
    assert {r["url"]: (r["id"], r["price"]) for r in tables.merge_products(stored, crawled).collect()} == got
    # At equal times the crawled capture wins; new ids follow the greatest one known.
    assert got["a"] == (7, 7) and got["n3"] == (40, 1) and sorted([got["n1"][0], got["n2"][0]]) == [41, 42] and len(got) == 4


def test_merge_shuffles_the_crawl_alone(spark):
    import datetime
    import random
    import uuid

    rng, day = random.Random(3), datetime.timedelta(days=1)
    at = lambda: rng.choice([datetime.datetime(2025, 1, 1) + day * rng.randrange(6), None])
    kind = "id bigint, url string, price int, first_seen_at timestamp, last_crawled_at timestamp"
    stored = spark.createDataFrame([(i + 1, f"u{i}", i, datetime.datetime(2025, 1, 1) + day * rng.randrange(6), at()) for i in range(60)], kind)
    crawled = spark.createDataFrame([(rng.choice([None, None, 200 + i]), f"u{rng.randrange(90)}", i, datetime.datetime(2025, 1, 1) + day * rng.randrange(6), at()) for i in range(80)], kind)
    table = tables.save_bucketed(stored, f"stored_{uuid.uuid4().hex}", ["url"], 4)
    key = lambda r: r["url"]
    want = sorted(tables.upsert_products(stored, crawled).collect(), key=key)
    joined = tables.merge_products(table, crawled)
    assert [(r["url"], r["price"], r["first_seen_at"], r["last_crawled_at"], r["id"]) for r in sorted(joined.collect(), key=key)] == [(r["url"], r["price"], r["first_seen_at"], r["last_crawled_at"], r["id"]) for r in want]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = tables.merge_products(table, crawled)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)
    join = plan[plan.index("SortMergeJoin") :].split("SortMergeJoin")[1].splitlines()
    depth = next(len(x) - len(x.lstrip(" :+-")) for x in join[1:])
    sides = [k for k, x in enumerate(join) if k and len(x) - len(x.lstrip(" :+-")) == depth][:2]
    left, right = join[sides[0] : sides[1]], join[sides[1] :]
    assert not any("Exchange" in x for x in left) and any("Bucketed: true" in x for x in left) and any("Exchange" in x for x in right)


def test_reaudit_is_seen_whole_or_not_at_all(spark, tmp_path):
    hit = "array<struct<rule_id:string,severity:string>>"
    folder = str(tmp_path / "audits")
    assert tables.latest_version(spark, folder) is None
    at = F.lit("2026-01-02 00:00:00").cast("timestamp")
    rows = [(1, 90, "a", [("x", "low")]), (2, 80, "b", [("y", "high")]), (3, None, None, None)]
    before = spark.createDataFrame(rows, f"id bigint, score int, segment string, findings {hit}").withColumn("audited_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    tables.write_version(before, folder, 1)
    checked = spark.createDataFrame([(1, 70, "c", [None, ("z", "high"), ("w", "low")]), (3, 100, "d", [None])], f"id bigint, score int, segment string, hits {hit}")

    def now():
        df = tables.read_version(spark, folder, tables.latest_version(spark, folder))
        return sorted((r["id"], r["score"], r["audited_at"] and r["audited_at"].day) for r in df.collect()), sorted(map(tuple, tables.findings_in(df).collect()))

    old = ([(1, 90, 1), (2, 80, 1), (3, None, 1)], [(1, "x", "low"), (2, "y", "high")])
    assert now() == old
    # An attempt that dies while it writes leaves readers with what was there.
    broken = checked.withColumn("score", F.when(F.col("id") == 3, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="stop"):
        tables.reaudit(spark, folder, broken, at)
    (tmp_path / "audits" / "version=2").mkdir(exist_ok=True)
    assert now() == old
    assert tables.reaudit(spark, folder, checked, at) == 2
    assert now() == ([(1, 70, 2), (2, 80, 1), (3, 100, 2)], [(1, "w", "low"), (1, "z", "high"), (2, "y", "high")])


@settings(max_examples=15, deadline=None)
@given(st.text("abAB%é ", min_size=0, max_size=6))
def test_indexed_search_equals_the_scan(indexed, needle):
    products, folder = indexed
    want = sorted(r["id"] for r in products.where(search.holds(needle)).collect())
    assert sorted(r["id"] for r in search.search(products, folder, needle).collect()) == want


def test_search_reads_few_postings(spark, indexed, monkeypatch):
    products, folder = indexed
    plan = search.candidates(spark, folder, "abA")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram,aba)" in plan or "In(gram" in plan
    monkeypatch.setattr(search, "BY_ID", 2)
    assert search.search(products, folder, "ab ").count() == products.where(search.holds("ab ")).count() > 2


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    import random

    rng, folder = random.Random(2), str(tmp_path_factory.mktemp("index"))
    text = lambda: rng.choice([None, "", "".join(rng.choices("abAB%éÉ ", k=rng.randrange(12)))])
    products = spark.createDataFrame([(i, text(), text(), text()) for i in range(400)], "id bigint, name string, brand string, sku string")
    search.write_index(products, folder)
    return products, folder


def test_findings_and_scores(spark):
    stored = spark.createDataFrame([(1, "x"), (2, "y")], "product_id bigint, rule_id string")
    fresh = spark.createDataFrame([(1, "z")], "product_id bigint, rule_id string")
    again = spark.createDataFrame([(1,), (3,)], "product_id bigint")
    assert sorted(map(tuple, tables.replace_findings(stored, fresh, again).collect())) == [(1, "z"), (2, "y")]
    products = spark.createDataFrame([(1, 50, "standard", "then"), (2, 60, None, None)], "id bigint, score int, segment string, audited_at string")
    checked = spark.createDataFrame([(1, 70, "no-copy")], "id bigint, score int, segment string")
    assert sorted(map(tuple, tables.apply_audit(products, checked, F.lit("now")).collect())) == [(1, 70, "no-copy", "now"), (2, 60, None, None)]


def test_mappings(spark):
    stored = spark.createDataFrame([(1, "u", "R", "exact", "n"), (1, "v", "R", "near", None)], "product_id bigint, url string, retailer string, match string, match_note string")
    incoming = spark.createDataFrame([(1, "u", "S", "near", None, 1), (1, "u", "T", "near", None, 2), (2, "u", "S", "exact", None, 3)], "product_id bigint, url string, retailer string, match string, match_note string, line int")
    rows = {(r["product_id"], r["url"]): r for r in tables.upsert_mappings(stored, incoming).collect()}
    assert rows[1, "u"]["retailer"] == "T" and rows[1, "u"]["match_note"] is None and not rows[1, "u"]["is_new"] and rows[2, "u"]["is_new"] and rows[1, "v"]["match"] == "near"
    seen = spark.sql("SELECT 'u' url, 'uncertain' match, CAST(NULL AS STRING) match_note, current_timestamp() captured_at, 1 id")
    got = {r["url"]: (r["match"], r["match_note"]) for r in tables.propagate_match(stored, seen, ["url"]).collect()}
    assert got == {"u": ("uncertain", None), "v": ("near", None)}


def test_versions_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, "same"), (1, "exact"), (2, None)], "id int, match string")
    tables.write_version(df, str(tmp_path), 1)
    with pytest.raises(Exception):
        tables.write_version(df, str(tmp_path), 1)
    assert tables.read_version(spark, str(tmp_path), 1).count() == 3
    assert [tuple(r) for r in tables.invalid_values(df, ["match"]).collect()] == [("match", "same", 1)]
    assert [tuple(r) for r in tables.duplicate_keys(df, "id").collect()] == [(1, 2)]
    assert tables.orphans(df, "id", spark.createDataFrame([(1,)], "id int")).count() == 1
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


PRODUCTS = "id bigint, name string, slug string, brand string, sku string, gtin string, category_path string, score int, segment string"


@pytest.fixture(scope="module")
def catalogue(spark):
    products = spark.createDataFrame(
        [
            (1, "Red 100% lamp", "red-1", "Acme Works", "S1", "g", "Light > Lamps > Desk", 0, "standard"),
            (2, "Blue lamp", "blue", None, "S2", None, "Light", 100, "thin-feed"),
            (3, "Cut with", "cut-22", "Zeta", None, None, None, 95, "thin-feed"),
            (4, "Other", "other", "Acme Works", None, None, "Lighting > Lamps", 55, "no-copy"),
            (5, "New", "new", "Acme Works", None, None, "Light > Lamps", None, None),
        ],
        PRODUCTS,
    )
    findings = spark.createDataFrame(
        [(1, "price-mismatch", "high"), (1, "gtin-missing", "medium"), (2, "gtin-missing", "medium"), (3, "gtin-missing", "medium"), (4, "gtin-missing", "medium"), (5, "h1-count", "medium"), (1, "unknown-rule", "low")],
        "product_id bigint, rule_id string, severity string",
    )
    return products, findings


def test_overview(catalogue):
    products, findings = catalogue
    assert tuple(reports.totals(products).collect()[0]) == (4, 63)
    assert tuple(reports.finding_totals(findings).collect()[0]) == (7, 1, 1)
    assert tuple(reports.finding_totals(findings, products, "thin-feed").collect()[0]) == (2, 0, 0)
    assert tuple(reports.finding_totals(findings.where("false")).collect()[0]) == (0, 0, 0)
    bars = reports.labelled_histogram(products).collect()
    assert [b["n"] for b in bars] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 2] and bars[9]["label"] == "90–100" and bars[0]["label"] == "0–9"
    assert [r["id"] for r in reports.worst_listings(products, 2).collect()] == [1, 4]
    assert [(r["segment"], r["n"], r["share"]) for r in reports.segment_rollup(products).collect()] == [("thin-feed", 2, 0.5), ("no-copy", 1, 0.25), ("standard", 1, 0.25)]
    shares = reports.rule_shares(findings, products).collect()
    assert [r["place"] for r in shares] == [1, 2, 3]
    thin = reports.rule_shares(findings, products, "thin-feed").collect()
    assert [(r["rule_id"], r["affected"], r["share"]) for r in thin] == [("gtin-missing", 2, 1.0)]
    assert [(r["rule_id"], r["affected"]) for r in reports.affected_per_rule(findings, products, "no-copy").collect()] == [("gtin-missing", 1)]
    assert [(r["rule_id"], r["affected"]) for r in shares] == [("price-mismatch", 1), ("gtin-missing", 4), ("h1-count", 1)]


def test_empty_catalogue(catalogue):
    products, findings = (t.where("false") for t in catalogue)
    assert all(r["n"] == 0 and r["share"] == 0 for r in reports.segment_rollup(products).collect())
    assert reports.page_count(products).collect()[0]["pages"] == 1
    assert reports.rule_shares(findings, products).count() == 0


def test_search(catalogue):
    products, findings = catalogue
    found = lambda **k: sorted(r["id"] for r in reports.search_listings(products, findings, **k).collect())
    assert found() == [1, 2, 3, 4] and found(text="LAMP") == [1, 2] and found(text="100%") == [1] and found(text="a_e") == [] and found(text="s2") == [2]
    # A category holds what is nested under it, not what merely starts alike.
    assert found(category="Light") == [1, 2] and found(segment="thin-feed", category="Light") == [2] and found(segment="no such") == [1, 2, 3, 4]
    assert found(rule="gtin-missing", severity="medium") == [1, 2, 3, 4] and found(severity="high") == [1]
    counts = {r["id"]: (r["high"], r["medium"], r["low"]) for r in reports.severity_counts(products, findings).collect()}
    assert counts[1] == (1, 1, 1) and counts[2] == (0, 1, 0)
    rows = reports.search_listings(products)
    assert [r["id"] for r in reports.page_of(rows, 2, 2).collect()] == [3, 2] == [r["id"] for r in reports.page_after(rows, 55, 4, 2).collect()]


def test_categories(catalogue):
    products, findings = catalogue
    cards = {r["name"]: r for r in reports.category_scorecard(products, findings).collect()}
    assert (cards["Light"]["n"], cards["Light"]["with_high"], cards["Light"]["thin_share"], cards["Uncategorised"]["n"]) == (2, 1, 0.5, 1)
    inner = {r["name"]: r["n"] for r in reports.category_scorecard(products, findings, "Light").collect()}
    assert inner == {"Lamps": 1, "Uncategorised": 1}
    assert [r["rule_id"] for r in reports.template_wide_rules(products, findings).collect()] == ["gtin-missing"]
    issues = [(r["name"], r["rule_id"], r["affected"]) for r in reports.top_issues(products, findings).collect()]
    # Findings of a product that is not yet audited count, against the audited listings of its category.
    assert issues == [("Light", "h1-count", 1), ("Light", "price-mismatch", 1)]
    assert [r["name"] for r in reports.category_names(products).collect()] == ["Light", "Lighting"]


def test_listing_detail(catalogue, spark):
    products, findings = catalogue
    history = spark.sql("SELECT 1L AS product_id, id, TIMESTAMP '2025-01-01 00:00:00' + id * INTERVAL '1' DAY AS captured_at FROM range(40)")
    parts = reports.listing_detail(products, findings, history, history, 1)
    assert [r["id"] for r in parts["product"].collect()] == [1]
    assert [(r["rule_id"], r["place"]) for r in parts["findings"].collect()] == [("price-mismatch", 1), ("gtin-missing", 2), ("unknown-rule", 3)]
    assert [r["id"] for r in parts["history"].collect()] == list(range(39, 19, -1)) and parts["observations"].count() == 30


def test_feed_quality(catalogue, spark):
    products, _ = catalogue
    snapshot = products.select(
        "*", F.when(F.col("id") == 2, 1).alias("gallery_image_count"), F.lit(None).cast("struct<images:array<string>>").alias("json_ld"),
        F.when(F.col("id") == 2, F.array(F.lit("a"))).alias("specs"), F.when(F.col("id") == 2, F.lit("x" * 100)).alias("description"),
    )
    r = reports.thin_signals(snapshot).collect()[0]
    assert (r["thin"], r["one_image"], r["placeholder_specs"], r["short_description"], r["truncated_name"], r["brand_not_in_name"], r["dedupe_slug"], r["no_gtin"]) == (2, 2, 1, 1, 1, 1, 1, 2)
    assert r["no_gtin_share"] == 1.0
    assert [(x["brand"], x["thin_feed"], x["n"]) for x in reports.thin_by_brand(products).collect()] == [("Unknown", 1, 1), ("Zeta", 1, 1)]
    assert [(x["name"], x["share"]) for x in reports.thin_by_category(products).collect()] == [("Light", 0.5), ("Uncategorised", 1.0)]
