"""Ordering operators: whatever the skew, the pieces and the partitions, results equal a plain Python model."""

import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcheck.operators import lens
from shelfcheck.operators.history import price_changes
from shelfcheck.operators.ranking import number_rows, with_previous
from shelfcheck.streaming import history as stream
from shelfcheck.streaming.history import keep_price_changes, kept_changes

FEED = "product_id bigint, id bigint, price decimal(10,2), availability string, captured_at timestamp"


def model(rows):
    kept, last = [], {}
    for p, i, price, availability, at in sorted(rows, key=lambda r: (r[0], r[4], r[1])):
        if price is None:
            continue
        if p not in last or last[p] != (price, availability):
            kept.append((p, i))
            last[p] = (price, availability)
    return sorted(kept)


def feed_rows(seed, n=400):
    import datetime

    r = random.Random(seed)
    start = datetime.datetime(2026, 1, 1)
    # A third of the rows belong to one product, and some share a time.
    return [
        (1 if r.random() < 0.34 else r.randrange(2, 20), i, r.choice([None, Decimal("5.00"), Decimal("6.00")]), r.choice([None, "in_stock", "out_of_stock"]), start + datetime.timedelta(hours=r.randrange(120)))
        for i in range(n)
    ]


@pytest.mark.parametrize("partitions", [1, 8])
def test_price_changes(spark, partitions):
    rows = feed_rows(partitions)
    df = spark.createDataFrame(rows, FEED).repartition(partitions)
    assert sorted((r["product_id"], r["id"]) for r in price_changes(df).collect()) == model(rows)
    daily = price_changes(df, F.date_trunc("day", "captured_at"))
    assert sorted((r["product_id"], r["id"]) for r in daily.collect()) == model(rows)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from([None, "1.00", "2.00"]), st.sampled_from([None, "a"]), st.integers(0, 60)), min_size=1, max_size=25))
def test_price_changes_property(spark, items):
    import datetime

    rows = [(p, i, price and Decimal(price), a, datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)) for i, (p, price, a, h) in enumerate(items)]
    got = price_changes(spark.createDataFrame(rows, FEED)).collect()
    assert sorted((r["product_id"], r["id"]) for r in got) == model(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(feed_rows(3), key=lambda r: r[4])
    for n in range(4):
        part = rows[n * 100 : (n + 1) * 100]
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep_price_changes(source, str(tmp_path / "out"))
    kept = kept_changes(spark, str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "checkpoint-feed" / "commits").glob("[0-9]*"))) == 4
    assert sorted((r["product_id"], r["id"]) for r in kept.collect()) == model(rows)
    # Started again with nothing new, it keeps nothing more.
    keep_price_changes(source, str(tmp_path / "out"))
    assert kept_changes(spark, str(tmp_path / "out")).count() == len(model(rows))


def test_batch_run_again_writes_once(spark, tmp_path):
    """A batch that failed between its two parts, or after them, is run again with the same number."""
    rows, folder = feed_rows(8, 60), str(tmp_path)
    batch = spark.createDataFrame(rows, FEED)
    stream.inner_changes(batch).write.parquet(f"{folder}/inner/number=0")
    stream._kept(batch, 0, folder)
    first = {part: sorted(map(tuple, spark.read.parquet(f"{folder}/{part}/number=0").collect()), key=str) for part in ("inner", "edges")}
    files = sorted(p.name for p in tmp_path.glob("*/number=0/*.parquet"))
    stream._kept(batch, 0, folder)
    assert sorted(p.name for p in tmp_path.glob("*/number=0/*.parquet")) == files
    assert {part: sorted(map(tuple, spark.read.parquet(f"{folder}/{part}/number=0").collect()), key=str) for part in first} == first
    stream.merge_edges(spark, folder).awaitTermination()
    stream.merge_edges(spark, folder).awaitTermination()
    assert sorted((r["product_id"], r["id"]) for r in kept_changes(spark, folder).collect()) == model(rows)


def test_state_holds_groups_of_products(spark, tmp_path):
    """An entry of the state serves many products; numbers that a float can't hold and a missing product stay as they are."""
    import datetime

    start, big, folder = datetime.datetime(2026, 1, 1), 2**53, str(tmp_path)
    rows = [
        (None if p == 0 else big + p, big + 1 + n * 100 + p, Decimal(["5.00", "5.00", "6.10"][n] if p % 3 else "7.25"), [None, "in_stock"][p % 2], start + datetime.timedelta(days=n, microseconds=p))
        for n in range(3) for p in range(60) if p % 7 != n
    ]
    for n in range(3):
        stream._kept(spark.createDataFrame([r for r in rows if r[4].day == n + 1], FEED), n, folder)
        query = stream.merge_edges(spark, folder, groups=4)
        query.awaitTermination()
        assert 1 <= query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    expected = {i for _, i in model([(big if p is None else p, *rest) for p, *rest in rows])}
    got = kept_changes(spark, folder).collect()
    assert {tuple(r) for r in got} == {(p, price, a, at, i) for p, i, price, a, at in rows if i in expected} and len(got) == len(expected)


def test_product_of_all_rows_reaches_the_state_as_one_row(spark):
    """A million rows of one product in one batch: cut into pieces, and one row of it needs the state."""
    batch = spark.range(1_000_000).selectExpr("7L AS product_id", "CAST(id DIV 10 % 3 AS DECIMAL(10,2)) AS price", "'in_stock' AS availability", "TIMESTAMP '2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS captured_at", "id")
    assert stream.edges(batch).collect() == [(7, Decimal("0.00"), "in_stock", batch.first()["captured_at"], 0, Decimal("0.00"), "in_stock")]
    assert stream.inner_changes(batch).count() == 99_999


def test_number_rows(spark):
    r = random.Random(5)
    rows = [(r.choice("aab"), r.randrange(4), r.randrange(3), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x int, y int, id int").repartition(5)
    got = number_rows(df, ["k"], [F.col("x"), F.col("y")], [F.col("id")], "n").collect()
    want = {}
    for k in "ab":
        for n, row in enumerate(sorted((x, y, i) for kk, x, y, i in rows if kk == k), 1):
            want[row[2]] = n
    assert {g["id"]: g["n"] for g in got} == want and len(got) == 300


def test_ranking_reads_the_observations_once(spark):
    seen = spark.createDataFrame([(i, i % 3, f"u{i % 7}", f"r{i % 2}", None, "exact", "ok", None) for i in range(40)], OBSERVATION)
    products = spark.createDataFrame([(i, "n", "s", None, None, None) for i in range(3)], "id bigint, name string, slug string, price decimal(10,2), was_price decimal(10,2), condition_label string")
    ranked = lens.ranked_observations(lens.latest_observations(seen), products)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and ranked.count() == 21


def test_with_previous_keeps_every_row(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("at"), "id")
    got = with_previous(df, "k", F.floor(F.col("at") / 7), ["at", "id"], ["id"], "p").collect()
    assert all((g["p"]["id"] if g["p"] else None) == (g["id"] - 1 if g["id"] else None) for g in got) and len(got) == 100


OBSERVATION = "id bigint, product_id bigint, url string, retailer string, price decimal(10,2), match string, status string, captured_at timestamp"


def observe(spark):
    return spark.sql("""SELECT CAST(id AS BIGINT) id, CAST(p AS BIGINT) product_id, url, retailer, CAST(price AS DECIMAL(10,2)) price, match, status, TIMESTAMP '2026-01-01 00:00:00' + d * INTERVAL '1' DAY AS captured_at FROM VALUES
      (1, 1, 'a', 'Zed', 10, 'exact', 'ok', 1), (2, 1, 'a', 'Zed', 12, 'exact', 'ok', 2), (3, 1, 'b', 'Ada', 8, 'near', 'ok', 1), (4, 1, 'c', 'Moe', NULL, 'exact', 'blocked', 1),
      (5, 1, NULL, 'Bob', 12, NULL, 'ok', 1), (6, 1, NULL, 'Bob', 12, NULL, 'ok', 1),
      (7, 2, 'a', 'Zed', 5, 'near', 'ok', 1), (8, 2, 'd', 'Ada', NULL, 'exact', 'disallowed', 1), (9, 3, 'e', 'Zed', 0, 'exact', 'ok', 1), (10, 4, 'f', 'Zed', 9, 'exact', 'no_price', 1)
      AS o(id, p, url, retailer, price, match, status, d)""")


def test_lens(spark):
    products = spark.sql("SELECT * FROM VALUES (1L, 'One', 'one', 9.00BD, 10.00BD, NULL), (2L, 'Two', 'two', 4.00BD, NULL, 'Used'), (3L, 'Three', 'three', 7.00BD, NULL, NULL), (4L, 'Four', 'four', NULL, NULL, NULL) AS p(id, name, slug, price, was_price, condition_label)")
    latest = lens.latest_observations(observe(spark))
    assert sorted(r["id"] for r in latest.collect()) == [2, 3, 4, 6, 7, 8, 9, 10]
    rows = {r["product_id"]: r for r in lens.lens(latest, products).collect()}
    # A missing match counts as comparable, a near one never; equal prices fall to the first retailer.
    assert rows[1]["cheapest"]["retailer"] == "Bob" and float(rows[1]["gap"]) == -3 and rows[1]["gap_pct"] == -25.0 and rows[1]["nearest"] is None
    assert rows[2]["cheapest"] is None and rows[2]["nearest"]["retailer"] == "Zed" and rows[2]["gap_pct"] is None
    assert rows[3]["gap_pct"] is None and rows[4]["cheapest"] is None
    assert [r["product_id"] for r in lens.ordered(lens.lens(latest, products)).collect()] == [1, 2, 3, 4]
    summary = lens.summary(lens.lens(latest, products)).collect()[0]
    assert (summary["compared"], summary["own_cheapest"], summary["own_dearer"], summary["median_gap_pct"], summary["failed_checks"], summary["own_cheapest_share"]) == (1, 1, 0, -25.0, 3, 100)
    assert sorted(r["retailer"] for r in lens.refusing_retailers(latest).collect()) == ["Ada", "Moe"]
    named = {r["product_id"]: r["retailers"] for r in lens.retailers_checked(latest).collect()}
    assert named[1] == ["Ada", "Bob", "Zed", "Moe"]
    ranks = {r["id"]: (r["rank"], r["difference"]) for r in lens.ranked_observations(latest, products).collect()}
    assert [i for i in sorted(ranks, key=lambda i: ranks[i][0]) if i in (2, 3, 4, 6)] == [3, 6, 2, 4] and float(ranks[3][1]) == 1 and ranks[4][1] is None


def test_previous_reads_one_shuffle(spark, capfd):
    df = spark.createDataFrame(feed_rows(1, 20), FEED)
    price_changes(df).explain("simple")
    plan = capfd.readouterr().out
    # The rest, the first rows and the carried ones share it.
    assert plan.count("Scan ExistingRDD") <= 3


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 1e-9, 5e300])), min_size=1, max_size=40))
def test_upper_median_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert lens.upper_median(df, "v").collect()[0][0] == sorted(values)[len(values) // 2]


def test_unpriced_rows_are_cut_by_retailer(spark):
    """A product whose checks all failed is still ranked, in retailer order."""
    rows = [(i, 1, f"u{i}", f"shop{i % 7}", None, None, "error") for i in range(70)]
    latest = spark.createDataFrame(rows, "id bigint, product_id bigint, url string, retailer string, price decimal(10,2), match string, status string").repartition(5)
    products = spark.sql("SELECT 1L AS id, 'n' AS name, 's' AS slug, 9.00BD AS price, CAST(NULL AS DECIMAL(10,2)) AS was_price, CAST(NULL AS STRING) AS condition_label")
    ranks = {r["id"]: r["rank"] for r in lens.ranked_observations(latest, products).collect()}
    assert sorted(ranks, key=ranks.get) == [r[0] for r in sorted(rows, key=lambda r: (r[3], r[2]))]


def test_upper_median(spark):
    df = spark.createDataFrame([(float(x), 0) for x in (1, 2, 3, 4)], "gap_pct double, failed int").withColumn("last_fetched", F.current_timestamp())
    assert lens.summary(df).collect()[0]["median_gap_pct"] == 3.0


@pytest.mark.parametrize("values", [[], [None, None], [5.0], [1.0] * 900 + [2.0] * 100, [i * i % 977 for i in range(1000)], [0.01] + [5000 + i / 1000 for i in range(2000)] + [1e12]])
def test_upper_median_in_rounds(spark, values):
    """Cells hold about equally many distinct values, whatever lies far out."""
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    assert lens.upper_median(df, "v", few=20, cells=4).collect()[0][0] == (known[len(known) // 2] if known else None)


def test_upper_median_of_many_values_in_one_old_cell(spark):
    df = spark.range(100_001).selectExpr("CASE WHEN id = 0 THEN 0.01 WHEN id = 1 THEN 1e15 ELSE 5000 + id * 1e-6 END AS v")
    assert lens.upper_median(df, "v", few=2000).collect()[0][0] == 5000 + 50_001 * 1e-6
    plan = lens.upper_median(df, "v", few=2000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 2 and "Range" not in plan  # the values are a written table
