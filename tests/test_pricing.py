import hashlib
import json

import pytest
from pyspark.sql import functions as F

from shelfcheck.operators import match, pricing
from shelfcheck.operators.match import assess_match, worst_match
from shelfcheck.schemas import PARSED_ROW
from shelfcheck.sources import files

# Each rule of the verdict on both sides of its edge, in the order in which the rules are tried.
PAIRS = [
    ("Kite kettle teal", "Teal kettle by Kite", "exact", None),
    ("Kite kettle teal", "Kite kettle, olive", "near", "other colour, olive instead of teal"),
    ("Kite kettle teal/cream", "Kite kettle cream", "exact", None),
    ("Kite kettle teal", "Kite kettle", "uncertain", "offer leaves the colour open"),
    ("Kite kettle", "Kite kettle teal", "exact", None),
    ("Rook drive 4TB", "Rook drive 4 tb", "near", "other capacity, 4 tb instead of 4tb"),
    ("Rook drive 4TB", "Rook drive", "exact", None),
    ("Rook drive 4TB 8GB", "Rook drive 8GB", "exact", None),
    ("Rook drive 500GB navy", "Rook drive 250GB coral", "near", "other colour, coral instead of navy"),
    ("Mop", "Mop twin pack", "near", "sold as a set"),
    ("Mop twin pack", "Mop bundle", "exact", None),
    ("Mop", "Mop 6-pack", "near", "sold as a set"),
    ("Mop indigo", "Mop bundled", "near", "sold as a set"),
    (None, "Mop", "exact", None),
    ("Mop", None, "exact", None),
]


def test_variant_match(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(PAIRS)], "i int, own string, theirs string")
    got = df.select("i", assess_match(F.col("own"), F.col("theirs")).alias("m")).orderBy("i").collect()
    assert [(r["m"]["match"], r["m"]["note"]) for r in got] == [(m, n) for _, _, m, n in PAIRS]


def test_worst_match(spark):
    df = spark.createDataFrame([("exact", "near"), ("near", "exact"), ("uncertain", "uncertain"), ("exact", None)], "a string, b string")
    assert [r[0] for r in df.select(worst_match(F.col("a"), F.col("b"))).collect()] == ["near", "near", "uncertain", "exact"]


ITEM = "gtin string, item_id string, title string, condition_id string, price_value string, shipping_options array<struct<type:string,cost:string>>, seller string, account_type string, country string, feedback_percentage string, feedback_score int"
PRODUCT = "id bigint, gtin string, name string, price decimal(10,2), condition string"


def item(gtin, key, price, title="Heron blender", postage=(), kind="BUSINESS", condition="NEW", country="GB", rated=("88.1", 12)):
    return (str(gtin), key, title, condition, price, [("FIXED", p) for p in postage], "shop-" + key, kind, country, *rated)


# Product 10 + n has GTIN n; own price 200, so offers below 60 landed are implausible.
OFFERS = {
    1: [item(1, "a", "150", postage=["9", "8.5"]), item(1, "b", "158", kind="INDIVIDUAL"), item(1, "c", "158.6")],
    2: [item(2, "a", "120", "Heron blender pack of 2"), item(2, "b", "59.99"), item(2, "c", "60", kind=None, rated=(None, None))],
    3: [item(3, "a", "140", "Heron blender cover"), item(3, "b", "141", "Heron blender untested"), item(3, "c", "142", country="FR"), item(3, "d", "1"), item(3, "e", "143", "Heron blender mount")],
    4: [item(4, "a", "70", "Heron blender bundle", kind="INDIVIDUAL"), item(4, "b", "75", "Heron blender bundle")],
    5: [item(5, "a", "80", condition="USED"), item(5, "b", "90"), item(5, "c", "free")],
    6: [item(6, "a", "100", country=None, postage=["by weight"]), item(6, "b", "100", country="")],
    7: [],
}


@pytest.fixture(scope="module")
def checked(spark):
    from decimal import Decimal

    products = [(10 + n, str(n), "Heron blender", Decimal("200.00"), {5: "used", 6: "unknown"}.get(n, "new")) for n in OFFERS]
    products.append((99, None, "Without a code", Decimal("5.00"), "new"))
    items = [x for offers in OFFERS.values() for x in offers]
    out = pricing.check_marketplace(spark.createDataFrame(products, PRODUCT), spark.createDataFrame(items, ITEM).repartition(5))
    return {r["product_id"]: r for r in out.collect()}


def test_best_offer_of_a_match_is_a_shop(checked):
    """Shops come before private sellers, postage counts, and a cheaper private offer is told."""
    r = checked[11]
    assert (r["item_id"], float(r["price"]), float(r["item_price"]), float(r["shipping_cost"]), r["seller_type"], r["match"]) == ("a", 158.5, 150, 8.5, "business", "exact")
    assert r["note"] == "chosen from 3/3 | rated 88.1% by 12 | private offer for £158.00"


def test_exact_match_beats_a_cheaper_variant(checked):
    r = checked[12]
    # 60 is 0.3 of the own price and still plausible; an offer without an account type is no shop.
    assert (r["item_id"], r["seller_type"], r["status"]) == ("c", "unknown", "ok")
    assert r["note"] == "chosen from 2/3 | left out: implausible price"
    only = checked[14]
    assert (only["item_id"], only["match"], only["note"]) == ("b", "near", "chosen from 2/2 | rated 88.1% by 12 | private offer for £70.00")


def test_cheaper_variant_is_told(spark):
    from decimal import Decimal

    own = spark.createDataFrame([(1, "1", "Heron blender", Decimal("200.00"), "new")], PRODUCT)
    offers = [item(1, "a", "180"), item(1, "b", "170", "Heron blender 3 pack"), item(1, "c", "190", "Heron blender 3 pack")]
    note = pricing.check_marketplace(own, spark.createDataFrame(offers, ITEM)).collect()[0]["note"]
    assert note == "chosen from 3/3 | rated 88.1% by 12 | near variant for £170.00: sold as a set"


def test_what_is_left_out(checked):
    assert (checked[13]["status"], checked[13]["note"]) == ("not_found", "0 of 5 offers fit; implausible price, add-on: cover, defect in the title, sent from abroad, add-on: mount")
    assert (checked[15]["item_id"], checked[15]["note"].split(" | ")[0]) == ("a", "chosen from 1/1")
    assert (checked[16]["item_id"], float(checked[16]["price"])) == ("a", 100)
    assert (checked[17]["status"], checked[17]["note"]) == ("not_found", "nothing offered under this GTIN")
    assert 99 not in checked


def test_title_words_of_the_own_name_are_no_add_on(spark):
    df = spark.createDataFrame([("Rail mount stand", "Wall mount"), ("Rail mount", "Wall MOUNT"), ("Lamp", "Lamp"), ("Lamp, no power", "Lamp"), (None, "Lamp")], "t string, o string")
    assert [r[0] for r in df.select(pricing.title_exclusion(F.col("t"), F.col("o"))).collect()] == ["add-on: stand", None, None, "defect in the title", None]


def test_postage(spark):
    kind = "o array<struct<type:string,cost:string>>"
    df = spark.createDataFrame([([("X", "7"), ("X", "6.2")],), ([("X", "7"), ("X", None)],), ([],), (None,)], kind)
    assert [r[0] for r in df.select(pricing.cheapest_postage(F.col("o"))).collect()] == [6.2, 0.0, 0.0, 0.0]


def test_targets_are_one_per_sku(spark):
    products = spark.createDataFrame([(5, "k"), (3, "k"), (4, "m"), (9, None)], "id bigint, sku string")
    found, missing = pricing.targets_by_sku(products, spark.createDataFrame([(2, "k"), (1, "m"), (3, "z"), (4, "k")], "pos int, sku string"))
    assert [(r["pos"], r["id"]) for r in found.collect()] == [(1, 4), (2, 3), (4, 3)]
    assert [r["sku"] for r in missing.collect()] == ["z"]


def test_keys(spark):
    products = spark.createDataFrame([(2, "u2", "s2", "k"), (1, "u1", "k", None), (3, "u3", None, None)], "id bigint, url string, sku string, gtin string")
    rows = spark.createDataFrame([("k",), ("u2",), ("s2",), ("nope",)], "key string")
    found, lost = pricing.resolve_keys(rows, products)
    # A SKU outranks a GTIN.
    assert {r["key"]: r["product_id"] for r in found.collect()} == {"k": 1, "u2": 2, "s2": 2}
    assert [r["key"] for r in lost.collect()] == ["nope"]


def test_mapping_lines(spark):
    text = ["# note", "", "Product_Key,retailer,url,match,note", "k1,Shop,https://x,near,a note, with commas", " k2 , Shop , https://y ", "k3,Shop,https://z,,", "k4,Shop,https://z,maybe,", "only,two", " ,Shop,https://z"]
    good, bad = files.parse_mappings(spark.createDataFrame([(t,) for t in text], "value string"))
    assert {r["key"]: (r["match"], r["match_note"], r["url"]) for r in good.collect()} == {"k1": ("near", "a note,with commas", "https://x"), "k2": ("exact", None, "https://y"), "k3": ("exact", None, "https://z")}
    assert sorted(r["value"] for r in bad.collect()) == [",Shop,https://z", "k4,Shop,https://z,maybe,", "only,two"] or bad.count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# c\nhttps://a\n\n  https://b  \n")
    assert [r["url"] for r in files.parse_url_list(files.read_lines(spark, str(tmp_path / "urls.txt"))).collect()] == ["https://a", "https://b"]
    (tmp_path / "p.json").write_text('{"parser": "hand",\n "rows": [{"i": 1, "sku": "S", "price": 2.5, "ignored": ["x"]},\n {"i": 2, "price": null}]}')
    (tmp_path / "q.json").write_text('{"parser": "hand", "rows": [')
    rows = files.read_parsed_prices(spark, str(tmp_path / "[pq].json")).collect()
    told = sorted((r["path"][-6:], r["row_number"], r["parser"], r["row"] and r["row"]["price"], "document" in r["violations"]) for r in rows if r["row"])
    assert told == [("p.json", 0, "hand", 2.5, False), ("p.json", 1, "hand", None, False)]
    assert [(r["path"][-6:], r["violations"]) for r in rows if not r["row"]] == [("q.json", ["document"])]


def test_import_stores_a_fetch_once(spark):
    """Rows repeated in a file, several fetches of a page, unknown products and pages; then the same file again."""
    rows = [
        {"i": 2, "sku": "T", "retailer": "Q", "url": "p1", "price": 31.5, "delivery_cost": 4, "confidence": 0.25, "match": "near", "stock": "preorder", "delivery_note": "by van", "ignored": ["deposit"]},
        {"i": 1, "sku": "T", "retailer": "Q", "url": "p1", "price": 30, "confidence": 1, "match": "exact", "stock": "in_stock", "page_title": "From the file", "ignored": []},
        {"i": 3, "sku": "?", "url": "p1"},
        {"i": 4, "sku": "T", "url": "unseen"},
        {"i": 5, "sku": "T", "retailer": "Q", "url": "p2", "price": None, "confidence": 0.125, "stock_note": "ask us", "ignored": []},
        {"i": 6, "sku": "T", "retailer": "Q", "url": "p2", "price": 8, "confidence": 0.125, "ignored": []},
    ]
    parsed = files.parsed_rows(spark.createDataFrame([(json.dumps({"parser": "eye", "rows": rows}),)], "value string"))
    products = spark.createDataFrame([(8, "T"), (6, "T"), (1, None)], "id bigint, sku string")
    captures = spark.sql("""SELECT * FROM VALUES ('p1', TIMESTAMP '2025-05-01 08:00:00', 'earlier'), ('p1', TIMESTAMP '2025-05-02 08:00:00', '  later  page '),
      ('p2', TIMESTAMP '2025-05-03 08:00:00', NULL) AS c(url, fetched_at, title)""")
    none = spark.createDataFrame([], "source string, url string, captured_at timestamp")
    first = pricing.import_parses(parsed, products, captures, none, "s").cache()
    assert sorted((r["url"], r["outcome"]) for r in first.collect()) == [("p1", "already stored"), ("p1", "no product"), ("p1", "stored"), ("p2", "already stored"), ("p2", "stored"), ("unseen", "no capture")]
    stored = {r["url"]: r for r in first.where("outcome = 'stored'").collect()}
    assert (stored["p1"]["product_id"], float(stored["p1"]["price"]), stored["p1"]["status"], stored["p1"]["captured_at"].day, stored["p1"]["currency"]) == (6, 30, "ok", 2, "GBP")
    assert (stored["p2"]["price"], stored["p2"]["status"], stored["p2"]["note"]) == (None, "no_price", "read by eye, certainty 0.13; availability: ask us")
    pages = {r["url"]: r for r in pricing.import_captures(first).withColumn("parser", F.variant_get("meta", "$.parser", "string")).collect()}
    assert (pages["p1"]["title"], pages["p1"]["capture_id"], pages["p1"]["parser"]) == ("later page", stored["p1"]["capture_id"], "eye") and len(pages) == 2
    again = pricing.import_parses(parsed, products, captures, first.where("outcome = 'stored'"), "s")
    assert sorted(r["outcome"] for r in again.collect()) == ["already stored"] * 4 + ["no capture", "no product"]


def test_contract_of_parsed_rows(spark):
    sound = {"product_title": "t", "price": 1, "price_evidence": None, "was_price": 2.5, "delivery_cost": None, "delivery_note": "n", "stock": "unknown", "match": "near", "match_note": None, "confidence": 0, "ignored": ["a"]}
    changes = [{}, {"price": "1"}, {"price": ...}, {"confidence": 1.01}, {"confidence": -1, "stock": "few"}, {"ignored": None}, {"ignored": [1]}, {"ignored": []}, {"match": None}, {"product_title": 5}, {"was_price": [1]}]
    rows = [{k: v for k, v in {**sound, **c}.items() if v is not ...} for c in changes]
    bodies = [json.dumps({"parser": "p", "rows": rows}), "not json", '{"parser": "p"}', '{"rows": {}}', '{"rows": []}', "[1]", None]
    rows = files.parsed_rows(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, value string"))
    good, bad = files.accepted(rows), files.rejected(rows)
    assert sorted((r["row"]["product_title"], r["row"]["price"], r["row"]["ignored"]) for r in good.collect()) == [("t", 1.0, []), ("t", 1.0, ["a"])]
    told = {(r["id"], r["row_number"]): r["violations"] for r in bad.collect()}
    assert {k[1]: v for k, v in told.items() if k[0] == 0} == {
        1: ["price"], 2: ["price"], 3: ["confidence"], 4: ["confidence", "stock"], 5: ["ignored"], 6: ["ignored"], 8: ["match"], 9: ["product_title"], 10: ["was_price"],
    }
    assert sorted(k for k in told if k[0]) == [(1, None), (2, None), (3, None), (5, None), (6, None)] and all(v == ["document"] for k, v in told.items() if k[0])


def test_import_loses_nothing(spark, tmp_path):
    """Bodies that can't be read and rows of wrong types come out as rejects, the others are stored; the rejects are no rows of the import."""
    sound = {"sku": "T", "retailer": "Q", "url": "p1", "product_title": None, "price": 3, "price_evidence": None, "was_price": None, "delivery_cost": None, "delivery_note": None, "stock": "in_stock", "match": "exact", "match_note": None, "confidence": 0.5, "ignored": []}
    changes = [{"price": "x"}, {"delivery_cost": True}, {"sku": 5}, {"stock": "few"}, {"match": "same"}, {"confidence": 1.5}, {"ignored": None}, {"page_title": 7}, {"url": None}, {}]
    bodies = [json.dumps({"parser": "p", "rows": [{"i": i, **sound, **c} for i, c in enumerate(changes)]}), '{"parser": "p", "rows": [{"i"', '{"rows": 5}', "", None]
    captures = spark.sql("SELECT 'p1' AS url, TIMESTAMP '2025-05-01 08:00:00' AS fetched_at, 't' AS title")
    none = spark.createDataFrame([], "source string, url string, captured_at timestamp")
    docs = spark.createDataFrame(list(enumerate(bodies)), "id int, value string")
    imported, broken = pricing.import_documents(docs, spark.createDataFrame([(6, "T")], "id bigint, sku string"), captures, none, "s", str(tmp_path / "parses"))
    assert [(r["outcome"], float(r["price"])) for r in imported.collect()] == [("stored", 3.0)]
    told = {(r["id"], r["row_number"]): r["violations"] for r in broken.collect()}
    assert told == {(0, i): [next(iter(c))] for i, c in enumerate(changes[:-1])} | {(k, None): ["document"] for k in (1, 2, 3, 4)}
    assert {r["outcome"]: r["n"] for r in pricing.outcomes(imported, broken).collect()} == {"stored": 1, "rejected": 13}


def test_import_captures_every_named_page(spark, tmp_path):
    """A page is captured whatever a row says of it; rows that name no product or page, and bodies that can't be read, capture none."""
    sound = {"sku": "T", "retailer": "Q", "product_title": None, "price": 3, "price_evidence": None, "was_price": None, "delivery_cost": None, "delivery_note": None, "stock": "in_stock", "match": "exact", "match_note": None, "confidence": 0.5, "ignored": []}
    changes = [{}, {"price": "x"}, {"stock": "few"}, {"match": "same"}, {"confidence": 1.5}, {"ignored": None}, {"delivery_cost": True, "retailer": 7}, {"sku": 5}, {"url": 7}, {"sku": "none"}]
    rows = [{"i": i, **sound, "url": f"p{i}", **c} for i, c in enumerate(changes)] + [{"i": 20, **sound, "url": "p0", "match": "near"}, {"i": 21, **sound, "url": "old"}, 5, None, [{"sku": "T", "url": "p8"}]]
    docs = spark.createDataFrame(list(enumerate([json.dumps({"parser": "p", "rows": rows}), '{"parser": "p", "rows": [{"i"', '{"rows": 5}', None])), "id int, value string")
    captures = spark.createDataFrame([(f"p{i}",) for i in range(10)] + [("old",), ("7",)], "url string").selectExpr("url", "TIMESTAMP '2025-05-01 08:00:00' AS fetched_at", "'t' AS title")
    known = spark.sql("SELECT 's' AS source, 'old' AS url, TIMESTAMP '2025-05-01 08:00:00' AS captured_at")
    found = pricing.import_pages(docs, spark.createDataFrame([(6, "T"), (7, "5")], "id bigint, sku string"), captures, known, "s", str(tmp_path / "parses"))
    got = found.select("url", "title", F.variant_get("meta", "$.parser", "string").alias("parser"), F.variant_get("meta", "$.match", "string").alias("match")).collect()
    assert sorted(map(tuple, got)) == [(f"p{i}", "t", "p", "same" if i == 3 else "exact") for i in range(7)]


def test_import_keeps_bodies_of_rejects_alone(spark, tmp_path):
    body = lambda price: json.dumps({"parser": "p", "rows": [{"sku": "T", "retailer": "Q", "url": "p1", "product_title": None, "price": price, "price_evidence": None, "was_price": None, "delivery_cost": None, "delivery_note": None, "stock": "in_stock", "match": "exact", "match_note": None, "confidence": 0.5, "ignored": []}]})
    docs = spark.createDataFrame([(1, body(3)), (2, body("x")), (3, "{")], "id int, value string")
    kept = pricing.kept_rows(docs, str(tmp_path / "rows"))
    assert {(r["sound"], r["id"], r["value"]) for r in kept.collect()} == {(True, None, None), (False, 2, body("x")), (False, 3, "{")}
    assert not list((tmp_path / "rows").glob("sound=*"))  # rows of either kind are not sorted apart


def test_extract_run(spark):
    row = "struct<product_title:string,price:double,delivery_cost:double,stock:string,match:string,match_note:string,confidence:double,price_evidence:string>"
    mappings = spark.createDataFrame([(1, "R", "u1", "exact", "mine"), (2, "R", "u1", "near", None), (3, "R", "u2", "exact", None), (4, "R", "u3", "uncertain", ""), (5, "R", "u4", "exact", None)], "product_id bigint, retailer string, url string, match string, match_note string")
    captures = spark.sql("SELECT * FROM VALUES ('u1', TIMESTAMP '2025-01-02 00:00:00', 'T1'), ('u1', TIMESTAMP '2025-01-01 00:00:00', 'T0'), ('u2', TIMESTAMP '2025-01-02 00:00:00', 'T2'), ('u3', TIMESTAMP '2025-01-02 00:00:00', 'T3') AS c(url, fetched_at, title)")
    parses = spark.createDataFrame([("u1", "m", None, ("P", 9.0, 1.5, "in_stock", "uncertain", "theirs", 0.5, "e")), ("u2", "m", "timed out", None), ("u3", "m", None, (None, None, None, "unknown", "exact", None, 0.0, None))], f"url string, model string, error string, row {row}")
    out = {r["product_id"]: r for r in pricing.extract_run(mappings, captures, parses, "s").collect()}
    assert sorted(out) == [1, 2, 3, 4]
    assert (float(out[1]["price"]), out[1]["match"], out[1]["match_note"], out[1]["status"], out[1]["note"]) == (10.5, "uncertain", "mine; theirs", "ok", "read by m, certainty 0.50; price from e")
    assert (out[2]["match"], out[2]["match_note"]) == ("near", "theirs")
    assert (out[3]["status"], out[3]["note"], out[3]["title"], out[3]["price"], out[3]["match"]) == ("error", "timed out", "T2", None, "exact")
    assert (out[4]["status"], out[4]["match"], out[4]["match_note"], out[4]["title"]) == ("no_price", "uncertain", None, "T3")
    kept = {r["product_id"]: (r["match"], r["match_note"]) for r in pricing.extract_run_matches(mappings, spark.createDataFrame([("u1", "uncertain"), ("u1", "near"), ("u2", "exact")], "url string, match string")).collect()}
    assert kept == {1: ("near", "mine"), 2: ("near", None), 3: ("exact", None), 4: ("uncertain", ""), 5: ("exact", None)}


def test_keys_of_captures_and_parses(spark):
    df = spark.createDataFrame([("https://x", "name", "text"), ("https://x", None, "text")], "u string, n string, t string")
    rows = df.select(files.capture_key(F.col("u")), pricing.parse_key("v", "m", F.col("u"), F.col("n"), F.col("t"))).collect()
    assert rows[0][0] == hashlib.sha256(b"https://x").hexdigest()[:24]
    assert rows[0][1] == hashlib.sha256(b"v\nm\nhttps://x\nname\ntext").hexdigest()[:24] != rows[1][1]


def test_capture_files(spark, tmp_path):
    """Only wanted files are opened, in blocks of few names; files of any content but none come out."""
    name = lambda u: hashlib.sha256(u.encode()).hexdigest()[:24] + ".json"
    page = {"url": "u0", "source": "parallel", "fetchedAt": "2026-01-02T03:04:05.000Z", "extractId": "x1", "request": {"objective": "o", "maxAgeSeconds": 600}}
    done = page | {"result": {"url": "u0", "title": "Caf\u00e9", "publish_date": None, "excerpts": ["a", "b"], "full_content": "long text"}}
    failed = page | {"error": {"url": "u1", "error_type": "fetch_error", "http_status_code": 403, "content": None}}
    odd = page | {"fetchedAt": 7, "extractId": None, "result": {"title": 5, "excerpts": [], "full_content": ["x"]}, "error": "none"}
    bodies = {"u0": json.dumps(done, ensure_ascii=False).encode(), "u1": json.dumps(failed).encode(), "u2": json.dumps(odd).encode(), "u3": b'{"url":', "u4": b"", "u5": b"[1]", "u6": b'{"extractId": "\xff"}'}
    for u, body in bodies.items():
        (tmp_path / name(u)).write_bytes(body)
    for i in range(30):
        (tmp_path / name(f"other{i}")).write_bytes(b"{}" + b" " * 10_000)
    (tmp_path / "notes.txt").write_text("no capture")
    urls = spark.createDataFrame([(u, 1) for u in [*bodies, "u0", "never fetched", None]], "url string, content int")
    for block in (3, 10_000):
        rows = files.read_captures(urls, str(tmp_path), block).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss")).collect()
        got = {r["url"]: tuple(r)[1:] for r in rows}
        assert len(rows) == 6 and got == {
            "u0": ("2026-01-02 03:04:05", "x1", "Caf\u00e9", None, ["a", "b"], "long text", None, None, False),
            "u1": ("2026-01-02 03:04:05", "x1", None, None, None, None, "fetch_error", 403, False),
            "u2": (None, None, None, None, None, None, None, None, False),
            **{u: (None,) * 8 + (True,) for u in ("u3", "u5")},
            "u6": (None, "\ufffd", None, None, None, None, None, None, False),
        }
    assert files.read_captures(urls.where("url = 'never fetched'"), str(tmp_path)).count() == 0
    read = files.contents_of(files.capture_files(spark, str(tmp_path)), [name("u0"), name("u3")])
    assert len(read.collect()) == 2
    plan = read._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    metrics = plan.metrics()
    assert (metrics.apply("numFiles").value(), metrics.apply("filesSize").value()) == (2, len(bodies["u0"]) + len(bodies["u3"]))


def test_import_of_arriving_files(spark, tmp_path, monkeypatch):
    """Files come in three deliveries, one of which fails between its two writes and is run again; nothing is stored twice."""
    from shelfcheck.streaming import imports

    row = {"sku": "T", "retailer": "Q", "product_title": None, "price": 3, "price_evidence": None, "was_price": None, "delivery_cost": None, "delivery_note": None, "stock": "in_stock", "match": "exact", "match_note": None, "confidence": 0.5, "ignored": []}
    body = lambda *urls: json.dumps({"parser": "p", "rows": [{"i": i, "url": u, **row} for i, u in enumerate(urls)]}, indent=1)
    captures = spark.sql("SELECT * FROM VALUES ('p1', TIMESTAMP '2025-05-01 08:00:00', 't'), ('p2', TIMESTAMP '2025-05-01 08:00:00', 't'), ('p3', TIMESTAMP '2025-05-01 08:00:00', 't'), ('old', TIMESTAMP '2025-05-01 08:00:00', 't') AS c(url, fetched_at, title)")
    known = spark.sql("SELECT 's' AS source, 'old' AS url, TIMESTAMP '2025-05-01 08:00:00' AS captured_at")
    products, (inbox, folder) = spark.createDataFrame([(6, "T")], "id bigint, sku string"), (tmp_path / "in", str(tmp_path / "out"))
    inbox.mkdir()

    def run():
        query = imports.import_stream(files.stream_bodies(spark, str(inbox)), products, captures, known, "s", folder)
        query.awaitTermination()

    def kept():
        return sorted((r["url"], r["number"]) for r in imports.stored(spark, folder).collect())

    (inbox / "a.json").write_text(body("p1", "old", "p1"))
    run()
    assert kept() == [("p1", 0)]
    (inbox / "b.json").write_text(body("p1", "p2"))
    (inbox / "c.json").write_text('{"rows": [')
    with monkeypatch.context() as m:  # the batch dies after its rejects
        m.setattr(imports, "import_documents", lambda *a, **k: (pricing.import_documents(*a, **k)[0].withColumn("url", F.raise_error(F.lit("lost"))), pricing.import_documents(*a, **k)[1]))
        with pytest.raises(Exception):
            run()
    run()
    run()
    assert kept() == [("p1", 0), ("p2", 1)]
    assert [(r["number"], r["path"][-6:], r["violations"]) for r in imports.rejects(spark, folder).collect()] == [(1, "c.json", ["document"])]
    # A batch that ended is run again with the same number: nothing changes.
    again = spark.createDataFrame([(body("p2", "p3"), "x")], "value string, path string")
    imports.import_batch(again, 1, products, captures, known, "s", folder)
    assert kept() == [("p1", 0), ("p2", 1)]


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_worst_match_broadcasts_neither_side(spark):
    mappings = spark.createDataFrame([("u1", "exact"), ("u1", "near"), ("u2", "uncertain"), (None, "exact")], "url string, match string")
    seen = spark.createDataFrame([("u1", "uncertain"), ("u1", None), ("u2", "exact"), (None, "near")], "url string, seen string")
    found = match.worsened(mappings, seen)
    assert "Broadcast" not in _plan(found)
    assert sorted((r["url"], r["match"]) for r in found.collect()) == [("u1", "exact"), ("u1", "near"), ("u1", "near"), ("u1", "uncertain"), ("u2", "uncertain")]


def test_bodies_are_parsed_once_and_rows_read_as_json(spark):
    """Typed rows equal what `from_json` makes of them, odd values and rows that are no objects included."""
    values = [None, True, 0, -7, 1.5, 5.0, 1e300, 12345678901, 10**29, "x", "", "5", "NaN", "-INF", "INF", [], ["a", 1, None, {"b": [1.5]}], {"a": 1.0}]
    rows = [{"i": 1, "url": "u", "price": 2, **{f: v}} for f in ("i", "sku", "price", "ignored", "match") for v in values]
    rows += [5, "x", None, [], [{"i": 1, "sku": "a"}], {}, [None]]
    bodies = spark.createDataFrame([(json.dumps({"parser": "p", "rows": rows}),), ("no json",), ('{"rows": 5}',)], "value string")
    found = files.parsed_rows(bodies)
    assert _plan(found).count("parseJson(") == 1
    assert "$.price" not in _plan(found)  # a row's fields are taken out of it together
    raw = bodies.select(F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$.rows", "array<variant>")).alias("n", "raw"))
    plain = {r["n"]: repr(r["row"]) for r in raw.select("n", F.from_json(F.to_json("raw"), PARSED_ROW).alias("row")).collect()}
    assert {r["row_number"]: repr(r["row"]) for r in found.where("row_number IS NOT NULL").collect()} == plain and len(plain) == len(rows)
    some = files.parsed_rows(bodies, fields=("url", "price"))
    assert some.schema["row"].dataType.names == ["url", "price"] and "page_title" not in _plan(some.select("row"))
    of = lambda r: r["row"] and (r["row"]["url"], r["row"]["price"])
    told = lambda df: sorted((repr(r["row_number"]), repr(of(r)), r["violations"]) for r in df.collect())
    assert told(some) == told(found)


def test_import_broadcasts_nothing_and_shuffles_rows_twice(spark):
    """Rows go by SKU and by url; the order within a url needs no further exchange."""
    row = {"sku": "T", "retailer": "Q", "url": "p1", "price": 3, "ignored": []}
    bodies = spark.createDataFrame([(json.dumps({"parser": "p", "rows": [{"i": i, **row, **c} for i, c in enumerate([{}, {}, {"url": "p2"}, {"url": None}, {"sku": None}, {"url": "p3"}])]}),)], "value string")
    captures = spark.sql("SELECT * FROM VALUES ('p1', TIMESTAMP '2025-05-01 08:00:00', 't'), ('p2', TIMESTAMP '2025-05-01 08:00:00', 't'), ('p2', TIMESTAMP '2025-04-01 08:00:00', 'o'), (NULL, NULL, 'n') AS c(url, fetched_at, title)")
    known = spark.sql("SELECT * FROM VALUES ('s', 'p2', TIMESTAMP '2025-05-01 08:00:00'), ('s', 'p1', TIMESTAMP '2024-05-01 08:00:00'), ('s', NULL, NULL) AS k(source, url, captured_at)")
    parsed = files.parsed_rows(bodies).select("parser", "row")
    found = pricing.import_parses(parsed, spark.createDataFrame([(6, "T")], "id bigint, sku string"), captures, known, "s")
    plan = _plan(found)
    assert "Broadcast" not in plan and "hashpartitioning(url" in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(url" in x and "CASE" in x] and plan[plan.index("Window") : plan.index("SortMergeJoin")].count("Exchange") == 0
    assert sorted(r["outcome"] for r in found.collect()) == ["already stored", "already stored", "no capture", "no capture", "no product", "stored"]
