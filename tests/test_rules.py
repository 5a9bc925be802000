import pytest
from pages import NODE, SPECS, URL, node, page, with_offer
from pyspark.sql import functions as F

from shelfcheck.functions import text as T
from shelfcheck.operators import audit, extract
from shelfcheck.operators.rules import RULES, Rule

NOW = "2026-09-21 00:00:00"
RESTORED = dict(ld=with_offer(price="41.20", itemCondition="https://schema.org/RefurbishedCondition"), price="£44.00", chip="Refurbished, grade B", notes="Scratch on the foot.")
ROWS = [("Brand", "Borealis"), ("Arm", "two joints"), ("Base", "clamp"), ("Bulb", "E14"), ("Flex", "1.8 m")]


def graded(a="£52.75", b="£44.00", c="£41.20", best="£60.00"):
    return [("grade-c", f"Grade C {c}", False), ("open-box", f"Box opened {best}", False), ("grade-b", f"Grade B {b}", True), ("grade-a", f"Grade A {a}", False), ("spare", "With spare bulb £1.00", False)]


def named(name, **more):
    return dict(ld=node(name=name), **more)


def at(slug):
    return f"https://shop.example/product/{slug}"


def words(n):
    """A text of n characters."""
    return ("lamp oil " * n)[: n - 1] + "x"


WEARABLE = ROWS + [("Links", "NFC, Bluetooth")]
# name -> (page options, url, rules that must fire, rules that must not)
CASES = {
    "sound": ({}, URL, None, None),
    "dearer on the page": (dict(price="£59.92"), URL, ["price-mismatch"], ["jsonld-price-is-other-variant"]),
    "within a penny": (dict(price="£59.90"), URL, [], ["price-mismatch"]),
    "no price on the page": (dict(price=""), URL, [], ["price-mismatch"]),
    "price of another grade": ({**RESTORED, "tabs": graded()}, URL, ["jsonld-price-is-other-variant"], ["price-mismatch", "grade-price-inversion", "condition-mismatch"]),
    "price of the chosen grade": ({**RESTORED, "price": "£47.00", "tabs": graded(b="£41.20", c="£39.00")}, URL, ["jsonld-price-is-other-variant"], ["price-mismatch"]),
    "price of no grade": ({**RESTORED, "tabs": graded(c="£41.22")}, URL, ["price-mismatch"], ["jsonld-price-is-other-variant"]),
    "worse grade dearer": ({**RESTORED, "tabs": graded(a="£43.99")}, URL, ["grade-price-inversion"], []),
    "grades equally dear": ({**RESTORED, "tabs": graded(a="£44.00")}, URL, [], ["grade-price-inversion"]),
    "worse grade dearer but gone": ({**RESTORED, "tabs": graded(b="£70.00 Out of stock")}, URL, [], ["grade-price-inversion"]),
    "better grade without a price": ({**RESTORED, "tabs": graded(a="", best="")}, URL, [], ["grade-price-inversion"]),
    "label new, markup restored": ({**RESTORED, "chip": "New", "notes": None}, URL, ["condition-mismatch"], ["refurb-condition-unexplained"]),
    "label says nothing": ({**RESTORED, "chip": "Nice"}, URL, [], ["condition-mismatch"]),
    "opened box counts as restored": (dict(chip="Open box item", notes="Seal broken.", specs=ROWS), URL, ["refurb-accessories-unstated"], ["condition-mismatch", "refurb-condition-unexplained"]),
    "markup of another grade": ({**RESTORED, "chip": "New", "tabs": graded()}, URL, ["jsonld-price-is-other-variant"], ["condition-mismatch"]),
    "restored, not explained": ({**RESTORED, "notes": None, "specs": ROWS}, URL, ["refurb-condition-unexplained", "refurb-accessories-unstated"], ["box-contents-unstated"]),
    "slug of another grade": (RESTORED, at("lamp-refurbished-fair"), ["slug-condition-mismatch"], []),
    "slug of this grade": (RESTORED, at("lamp-grade-b"), [], ["slug-condition-mismatch"]),
    "slug good in very good": ({**RESTORED, "chip": "Refurbished, very good"}, at("lamp-condition-good"), ["slug-condition-mismatch"], []),
    "slug very good": ({**RESTORED, "chip": "Refurbished, very good"}, at("lamp-condition-very-good"), [], ["slug-condition-mismatch"]),
    "grade word in a name": (RESTORED, at("good-night-lamp"), [], ["slug-condition-mismatch"]),
    "expired yesterday": (dict(ld=with_offer(priceValidUntil="2026-09-20")), URL, ["price-valid-until-expired"], []),
    "expires tonight": (dict(ld=with_offer(priceValidUntil="2026-09-21T00:00:01")), URL, [], ["price-valid-until-expired"]),
    "expired in its own zone": (dict(ld=with_offer(priceValidUntil="2026-09-21T01:59:00+02:00")), URL, ["price-valid-until-expired"], []),
    "unreadable date": (dict(ld=with_offer(priceValidUntil="next week")), URL, [], ["price-valid-until-expired"]),
    "no description": (dict(description=" ", ld=node(description="")), URL, ["description-missing"], ["description-short"]),
    "description in the markup": (dict(description="", ld=node(description=words(300))), URL, [], ["description-missing", "description-short"]),
    "299 characters": (dict(description=words(299)), URL, ["description-short"], ["description-missing"]),
    "300 characters": (dict(description=words(300)), URL, [], ["description-short"]),
    "no rows": (dict(specs=[]), URL, ["specs-missing"], ["specs-thin"]),
    "four rows": (dict(specs=ROWS[:4]), URL, ["specs-thin"], ["specs-missing"]),
    "five rows": (dict(specs=ROWS), URL, [], ["specs-thin"]),
    "two pictures": (dict(thumbs=2, ld=node(image=["only.jpg"])), URL, ["images-few"], []),
    "more in the markup": (dict(thumbs=1), URL, [], ["images-few"]),
    "plug": (named("Borealis desk heater", specs=ROWS), URL, ["plug-type-unstated"], []),
    "plug stated": (named("Borealis desk heater", specs=ROWS + [("Lead", "EU plug")]), URL, [], ["plug-type-unstated"]),
    "goes with a powered thing": (named("Filter for Borealis heater", specs=ROWS), URL, [], ["plug-type-unstated"]),
    "word inside a word": (named("Borealis preheaters", specs=ROWS), URL, [], ["plug-type-unstated"]),
    "word after a letter beyond ASCII": (named("Hochhausé heater", specs=ROWS), URL, ["plug-type-unstated"], []),
    "contents": (dict(specs=ROWS), URL, ["box-contents-unstated"], ["refurb-accessories-unstated"]),
    "contents in the text": (dict(specs=ROWS, description=words(300) + " Supplied with a bulb."), URL, [], ["box-contents-unstated"]),
    "code": (named("BL40-X Lamp"), URL, ["name-leads-with-code"], []),
    "five signs are no code": (named("BL40X Lamp"), URL, [], ["name-leads-with-code"]),
    "letters are no code": (named("BOREALIS Lamp 40"), URL, [], ["name-leads-with-code"]),
    "digits are no code": (named("123456 Lamp"), URL, [], ["name-leads-with-code"]),
    "wearable": (named("Pixel Watch, 41 mm, jade", specs=WEARABLE), URL, ["watch-connectivity-unstated"], []),
    "wearable stated in the name": (named("Pixel Watch, 41 mm, GPS", specs=WEARABLE), URL, [], ["watch-connectivity-unstated"]),
    "wearable stated in a row": (named("Pixel Watch, 41 mm", specs=WEARABLE + [("Network", "4G")]), URL, [], ["watch-connectivity-unstated"]),
    "wearable hinted at": (named("Pixel Watch, 41 mm", specs=WEARABLE + [("Note", "for LTE plans")]), URL, ["watch-connectivity-unstated"], []),
    "band": (named("Strap for Pixel Watch", specs=WEARABLE), URL, [], ["watch-connectivity-unstated"]),
    **{f"cut off: {n}": (named(n), URL, ["name-truncated"], []) for n in ["Lamp for", "Lamp &", "Lamp, brass –", "Lamp or", "Lamp (brass", "Lamp , brass"]},
    **{f"complete: {n}": (named(n), URL, [], ["name-truncated"]) for n in ["Lamp (brass)", "Lamp fore", "Lamp, brass", "Lamp 4-by-4"]},
    "no markup": (dict(ld=None), URL, ["jsonld-missing"], ["jsonld-offer-missing", "brand-missing", "gtin-missing", "jsonld-image-missing"]),
    "no offer": (dict(ld=node(offers=...)), URL, ["jsonld-offer-missing"], ["jsonld-no-return-policy", "jsonld-no-shipping-details"]),
    "no picture in the markup": (dict(ld=node(image="")), URL, ["jsonld-image-missing"], ["images-few"]),
    "no brand": (dict(ld=node(brand={"name": " "})), URL, ["brand-missing"], []),
    "no gtin": (dict(ld=node(gtin13="")), URL, ["gtin-missing"], ["gtin-invalid"]),
    "gtin of eight": (dict(ld=node(gtin13=..., gtin8="73513537")), URL, [], ["gtin-missing", "gtin-invalid"]),
    "gtin with a wrong digit": (dict(ld=node(gtin13="5901234123458")), URL, ["gtin-invalid"], ["gtin-missing"]),
    "policies": (dict(ld=with_offer(hasMerchantReturnPolicy="https://shop.example/returns", shippingDetails={"cost": 0})), URL, [], ["jsonld-no-return-policy", "jsonld-no-shipping-details"]),
    "empty policies": (dict(ld=with_offer(hasMerchantReturnPolicy="", shippingDetails=False)), URL, ["jsonld-no-return-policy", "jsonld-no-shipping-details"], []),
    "hidden": (dict(robots="max-snippet:5, NoIndex"), URL, ["noindex-in-sitemap"], []),
    "shown": (dict(robots="follow"), URL, [], ["noindex-in-sitemap"]),
    "no canonical": (dict(canonical=""), URL, ["canonical-mismatch"], []),
    "canonical elsewhere": (dict(canonical="/product/borealis-desk-lamp-41"), URL, ["canonical-mismatch"], []),
    "canonical broken": (dict(canonical="https://shop.example:x/product"), URL, ["canonical-mismatch"], []),
    "canonical relative": (dict(canonical="./a/../borealis-desk-lamp-40?from=menu"), URL, [], ["canonical-mismatch"]),
    "canonical of another host": (dict(canonical="//mirror.example/product/borealis-desk-lamp-40/"), URL, [], ["canonical-mismatch"]),
    "canonical encoded": (dict(canonical=at("l%C3%A4mp%20one")), at("lämp one"), [], ["canonical-mismatch"]),
    "canonical not encoded": (dict(canonical=at("lämp one")), at("l%C3%A4mp%20one"), [], ["canonical-mismatch"]),
    "canonical with back-slashes": (dict(canonical="https:\\\\shop.example\\product\\borealis-desk-lamp-40".replace("https:\\\\", "https://")), URL, [], ["canonical-mismatch"]),
    "two headings": (dict(headings=2), URL, ["h1-count"], []),
    "no heading": (dict(headings=0), URL, ["h1-count"], []),
    "no summary": (dict(meta=None), URL, ["meta-description-missing"], ["meta-description-long"]),
    "161 characters of summary": (dict(meta=words(161)), URL, ["meta-description-long"], ["meta-description-missing"]),
    "160 signs of summary": (dict(meta="🪔" * 160), URL, [], ["meta-description-long"]),
    "71 characters of title": (dict(title=words(71)), URL, ["title-tag-long"], []),
    "70 characters of title": (dict(title=words(70)), URL, [], ["title-tag-long"]),
    "slug counter": ({}, at("borealis-lamp-7"), ["slug-dedupe-suffix"], []),
    "number of the name": (named("Borealis Lamp 7"), at("borealis-lamp-7"), [], ["slug-dedupe-suffix"]),
    "decimal of the name": (named("Borealis Lamp 3.5"), at("borealis-lamp-35"), [], ["slug-dedupe-suffix"]),
    "four digits are no counter": ({}, at("borealis-lamp-1975"), [], ["slug-dedupe-suffix"]),
    "pictures without text": (dict(blank_alts=1), URL, ["image-alt-missing"], []),
}


@pytest.fixture(scope="module")
def audited(spark):
    rows = [(i, name, url, page(**options)) for i, (name, (options, url, _, _)) in enumerate(CASES.items())]
    pages = spark.createDataFrame(rows, "id int, case string, url string, html string").repartition(4)
    return {r["case"]: r for r in audit.audit(extract.extract_listings(pages), NOW).collect()}


def ids(audited, case):
    return [f["rule_id"] for f in audited[case]["findings"]]


@pytest.mark.parametrize("case", [c for c in CASES if c != "sound"])
def test_rule(audited, case):
    _, _, fire, silent = CASES[case]
    assert set(fire) <= set(ids(audited, case)) and not set(silent) & set(ids(audited, case))


def test_sound_page_and_score(audited):
    assert ids(audited, "sound") == ["jsonld-no-return-policy", "jsonld-no-shipping-details"]
    assert audited["sound"]["score"] == 94 and audited["sound"]["segment"] == "standard"


def test_every_rule_is_covered():
    fired = {r for _, _, fire, _ in CASES.values() for r in fire or []} | {"jsonld-no-return-policy", "jsonld-no-shipping-details"}
    assert fired == {r.id for r in RULES} and len(RULES) == 34


def test_messages(audited):
    text = {f["rule_id"]: f for f in audited["worse grade dearer"]["findings"]}
    assert text["grade-price-inversion"]["message"] == "Grade B costs £44.00, above Grade A at £43.99"
    assert {f["rule_id"]: f["evidence"] for f in audited["wearable hinted at"]["findings"]}["watch-connectivity-unstated"] == "Note: for LTE plans"


def test_selected_may_be_unknown(spark):
    """A variant that doesn't say whether it is chosen counts as another one."""
    listing = extract.extract_listings(spark.createDataFrame([(1, URL, page(**{**RESTORED, "tabs": graded()}))], "id int, url string, html string"))
    unknown = listing.withColumn("condition_variants", F.transform("condition_variants", lambda v: v.withField("selected", F.lit(None).cast("boolean"))))
    assert "jsonld-price-is-other-variant" in [f["rule_id"] for f in audit.audit(unknown, NOW).collect()[0]["findings"]]


def test_dates_do_not_follow_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    rows = [(i, URL, page(ld=with_offer(priceValidUntil=d))) for i, d in enumerate(["2026-09-20T23:30:00", "2026-09-21T00:30:00", "2026-09", "2026"])]
    listings = extract.extract_listings(spark.createDataFrame(rows, "id int, url string, html string"))
    try:
        found = []
        for zone in ("Asia/Tokyo", "America/Lima"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.append({r["id"]: "price-valid-until-expired" in [f["rule_id"] for f in r["findings"]] for r in audit.audit(listings, NOW).collect()})
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1] == {0: True, 1: False, 2: True, 3: True}


def test_score_has_a_floor_and_rules_can_be_added(spark):
    bad = spark.createDataFrame([(1, URL, "<p>nothing</p>")], "id int, url string, html string")
    extra = RULES + [Rule("no-og-image", "low", "seo", "t", "w", "f", lambda: F.col("og_image").isNull(), lambda: F.lit("no preview image"))]
    row = audit.audit(extract.extract_listings(bad), NOW, extra).collect()[0]
    assert row["findings"][-1]["rule_id"] == "no-og-image" and row["score"] == 100 - sum({"high": 15, "medium": 7, "low": 3}[f["severity"]] for f in row["findings"])
    harsh = [Rule(f"r{i}", "high", "seo", "t", "w", "f", lambda: F.lit(True), lambda: F.lit("m")) for i in range(8)]
    assert audit.hits(extract.extract_listings(bad), NOW, harsh).collect()[0]["score"] == 0


def test_older_records_lack_fields(spark):
    listing = extract.extract_listings(spark.createDataFrame([(1, URL, page())], "id int, url string, html string"))
    old = listing
    for c in ("specs", "condition_variants", "gallery_image_count"):
        old = old.withColumn(c, F.lit(None).cast(listing.schema[c].dataType))
    row = audit.audit(old, NOW).collect()[0]
    found = [f["rule_id"] for f in row["findings"]]
    assert "specs-missing" in found and "images-few" not in found


def test_segments(spark):
    thin = dict(specs=[("Brand", "B"), ("EAN", "1")], description="Lamp, black.", thumbs=1, ld=node(description="Lamp, black.", image=["a"]))
    cases = [thin, {**thin, "description": "x" * 400}, dict(specs=[], description="", thumbs=8, ld=node(description="")), {}]
    rows = [(i, URL, page(**c)) for i, c in enumerate(cases)]
    got = audit.audit(extract.extract_listings(spark.createDataFrame(rows, "id int, url string, html string")), NOW).orderBy("id").collect()
    assert [r["segment"] for r in got] == ["thin-feed", "standard", "no-copy", "standard"]


def test_column_helpers(spark):
    df = spark.createDataFrame(
        [
            ("approx. 2,345.678 each", "5901234123457", "like NEW", "schema:NewCondition", "BackOrder"), ("0", "73513537", "Preowned, used", "UsedCondition", "OnlineOnly"),
            ("free", "614141000036", "Pre-Owned", "DamagedCondition", "SoldOut"), (None, "00614141000036", None, None, None), ("£ 9.9", "5901234-123 457", "refurb new", "Refurbished", "InStoreOnly"),
            ("12 of 13", "590123412345", "Boxed", "fine", "PreSale"),
        ],
        "price string, gtin string, label string, condition string, availability string",
    )
    rows = df.select(T.price_from_text(F.col("price")), T.valid_gtin(F.col("gtin")), T.condition_from_label(F.col("label")), T.condition_of(F.col("condition")), T.availability_of(F.col("availability"))).collect()
    assert [tuple(r) for r in rows] == [
        (2345.67, True, "new", "new", "preorder"),
        (0.0, True, "used", "used", "in_stock"),
        (None, True, "used", "used", "out_of_stock"),
        (None, True, "unknown", "unknown", "unknown"),
        (9.9, True, "refurbished", "refurbished", "unknown"),
        (12.0, False, "unknown", "unknown", "preorder"),
    ]


def test_numbers(spark):
    values = ["12", " 1.5 ", "1e3", "", "n/a", "12d", "Infinity", "NaN", "-3", ".5", "1,2"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(T.number(F.col("v"))).collect()]
    assert got == [12.0, 1.5, 1000.0, None, None, None, None, None, -3.0, 0.5, None]
