"""The rule registry: each rule is a condition and texts, written as native columns over one listing.

Add a rule by adding an entry; `operators.audit` runs whatever the registry holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

Build = Callable[[], Column]


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    title: str
    why: str
    fix: str
    when: Build
    message: Build
    evidence: Build | None = None


def prepare(listings: DataFrame) -> DataFrame:
    """Add the helper columns the rules share. Records of an older shape may lack specs, variants or counts."""
    ld = F.col("json_ld")
    listings = listings.withColumns(
        {
            "r_name": F.coalesce(ld["name"], F.col("h1"), F.lit("")),
            "r_description": F.coalesce(F.col("description"), ld["description"], F.lit("")),
            "r_specs": F.coalesce(F.col("specs"), F.array().cast("array<struct<label:string,value:string>>")),
            "r_variants": F.coalesce(
                F.col("condition_variants"),
                F.array().cast("array<struct<id:string,label:string,price:double,out_of_stock:boolean,selected:boolean>>"),
            ),
            "r_ld_images": F.when(ld.isNotNull(), F.coalesce(F.size(ld["images"]), F.lit(0))).otherwise(0),
            "r_label_condition": T.condition_from_label(F.col("condition_label")),
        }
    )
    visible = F.when(F.col("r_label_condition") != "unknown", F.col("r_label_condition")).otherwise(
        F.coalesce(ld["offer"]["condition"], F.lit("unknown"))
    )
    slug = F.col("slug")
    word = F.coalesce(
        *[F.when(F.concat(F.lit("-"), slug, F.lit("-")).contains(f"-{w}-"), F.lit(w)) for w in P.CONDITION_WORDS]
    )
    ranked = F.array_sort(
        F.transform(
            F.filter(
                F.col("r_variants"),
                lambda v: v["price"].isNotNull()
                & ~F.coalesce(v["out_of_stock"], F.lit(False))
                & v["id"].isin(list(P.GRADE_RANK)),
            ),
            lambda v, i: F.struct(
                F.coalesce(*[F.when(v["id"] == g, F.lit(r)) for g, r in P.GRADE_RANK.items()]).alias("rank"),
                i.alias("pos"),
                v["label"].alias("label"),
                v["price"].alias("price"),
            ),
        )
    )
    return listings.withColumns(
        {
            "r_refurbished": visible == "refurbished",
            "r_ld_price": ld["offer"]["price"],
            "r_text": F.concat_ws(
                "\n",
                "r_name",
                "r_description",
                F.array_join(F.transform("r_specs", lambda s: F.concat(s["label"], F.lit(": "), s["value"])), "\n"),
            ),
            "r_slug_word": F.when(slug.rlike(P.jvm(P.SLUG_ABOUT_CONDITION, False)), word),
            "r_ranked": ranked,
            "r_own_path": F.regexp_replace(T.url_path(F.col("url")), r"/\z", ""),
            "r_canonical_path": F.regexp_replace(T.resolved_path(F.col("canonical"), F.col("url")), r"/\z", ""),
        }
    ).withColumns(
        {
            "r_box_stated": T.has(F.col("r_text"), P.BOX_CONTENTS_STATED, any_of=P.BOX_CONTENTS_TEXTS),
            "r_other_variant": F.try_element_at(
                F.filter("r_variants", lambda v: T.same_price(v["price"], F.col("r_ld_price"))), F.lit(1)
            ),
            "r_inversion": F.try_element_at(
                F.flatten(
                    F.transform(
                        "r_ranked",
                        lambda better, i: F.transform(
                            F.filter(
                                F.slice(F.col("r_ranked"), i + 2, F.size("r_ranked")),
                                lambda worse: worse["price"] > better["price"],
                            ),
                            lambda worse: F.struct(better.alias("better"), worse.alias("worse")),
                        ),
                    )
                ),
                F.lit(1),
            ),
        }
    )


def _c(name: str) -> Column:
    return F.col(name)


def _ld() -> Column:
    return F.col("json_ld")


def _offer() -> Column:
    return F.col("json_ld.offer")


def _prices_differ() -> Column:
    return ~T.same_price(_c("r_ld_price"), _c("visible_price"))


def _another_variant_has_price() -> Column:
    return F.exists("r_variants", lambda v: ~F.coalesce(v["selected"], F.lit(False)) & T.same_price(v["price"], F.col("r_ld_price")))


def _label_lacks_word() -> Column:
    label = F.regexp_replace(F.lower("condition_label"), "[^a-z0-9]+", "-")
    label = F.when(_c("r_slug_word") == "good", F.regexp_replace(label, "^(.*?)very-good", "$1")).otherwise(label)
    return ~F.contains(F.concat(F.lit("-"), label, F.lit("-")), F.concat(F.lit("-"), _c("r_slug_word"), F.lit("-")))


def _valid_until() -> Column:
    return T.instant(_offer()["price_valid_until"])


def _image_count() -> Column:
    return F.when(_c("gallery_image_count").isNotNull(), F.greatest("gallery_image_count", "r_ld_images"))


def _first_word() -> Column:
    return F.element_at(F.split("r_name", P.WS + "+"), 1)


def _watch_hint() -> Column:
    return F.try_element_at(F.filter("r_specs", lambda s: T.has(s["value"], P.CONNECTIVITY_HINT, False)), F.lit(1))


def _watch_variant_stated() -> Column:
    return F.exists(
        "r_specs", lambda s: T.has(s["label"], P.CONNECTIVITY_SPEC_LABEL) & T.has(s["value"], P.CONNECTIVITY_SPEC_VALUE)
    )


def _dangling() -> Column:
    return F.regexp_extract("r_name", P.jvm(P.NAME_DANGLING_END), 0)


def _slug_counter() -> Column:
    return F.regexp_extract("slug", r"-(\d{1,3})\z", 1)


def _number_in_name(number: Column) -> Column:
    plain = F.regexp_replace("r_name", r"(\d)[.,](?=\d)", "$1")
    return F.array_contains(F.split(plain, "[^0-9]+"), number)


def _path_differs() -> Column:
    return ~_c("r_own_path").eqNullSafe(_c("r_canonical_path"))


def _canonical_given() -> Column:
    return F.coalesce(_c("canonical"), F.lit("")) != ""


def say(*parts: str | Column) -> Build:
    return lambda: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


RULES: list[Rule] = [
    Rule(
        "price-mismatch", "high", "accuracy", "Marked-up price is not the price on the page",
        "Search results quote the marked-up price; offers that disagree with the page get rejected and mislead shoppers.",
        "Fill the marked-up offer from the same value the page renders.",
        lambda: _prices_differ() & ~F.exists("r_variants", lambda v: F.coalesce(T.same_price(v["price"], F.col("r_ld_price")), F.lit(False))),
        lambda: F.concat(F.lit("markup price "), T.pounds(_c("r_ld_price")), F.lit(", page price "), T.pounds(_c("visible_price"))),
    ),
    Rule(
        "jsonld-price-is-other-variant", "medium", "accuracy", "Markup advertises another condition's price",
        "A shopper drawn by one price lands on another, which also counts as a landing page price error.",
        "Open the page on the advertised condition or publish one offer for each.",
        lambda: _prices_differ() & _c("r_other_variant").isNotNull(),
        lambda: F.concat(
            F.lit("markup price "), T.pounds(_c("r_ld_price")), F.lit(" belongs to "), _c("r_other_variant.label"),
            F.lit("; page shows "), F.coalesce(_c("condition_label"), F.lit("another variant")), F.lit(" at "), T.pounds(_c("visible_price")),
        ),
    ),
    Rule(
        "grade-price-inversion", "medium", "pricing", "Worse grade is dearer than a better one",
        "Prices that leapfrog grades look like errors and undermine the grading.",
        "Keep every grade at or below the price of the grade above it.",
        lambda: _c("r_inversion").isNotNull(),
        lambda: F.concat(
            _c("r_inversion.worse.label"), F.lit(" costs "), T.pounds(_c("r_inversion.worse.price")), F.lit(", above "),
            _c("r_inversion.better.label"), F.lit(" at "), T.pounds(_c("r_inversion.better.price")),
        ),
    ),
    Rule(
        "condition-mismatch", "high", "accuracy", "Markup condition is not the visible condition",
        "Refurbished stock marked as new, or the reverse, is treated as misrepresentation.",
        "Derive the marked-up condition from the selected variant.",
        lambda: (_offer()["condition"] != "unknown")
        & (_c("r_label_condition") != "unknown")
        & (_offer()["condition"] != _c("r_label_condition"))
        & ~F.lower("condition_label").contains("open box")
        & ~F.coalesce(_another_variant_has_price(), F.lit(False)),
        lambda: F.concat(F.lit("markup condition "), _offer()["condition"], F.lit(", page label "), _c("condition_label")),
    ),
    Rule(
        "slug-condition-mismatch", "medium", "accuracy", "URL names another grade than the page",
        "The URL is seen before the page; two different grades are two different promises.",
        "Leave grades out of slugs or redirect to a matching one.",
        lambda: _c("r_slug_word").isNotNull() & (F.coalesce(_c("condition_label"), F.lit("")) != "") & _label_lacks_word(),
        lambda: F.concat(F.lit("slug says "), F.replace(_c("r_slug_word"), F.lit("-"), F.lit(" ")), F.lit(", page label "), _c("condition_label")),
        lambda: _c("slug"),
    ),
    Rule(
        "refurb-condition-unexplained", "high", "accuracy", "Refurbished item without condition notes",
        "Buyers of refurbished goods complain most about unexpected wear.",
        "Show condition notes for each refurbished variant.",
        lambda: _c("r_refurbished") & (F.coalesce(_c("condition_notes"), F.lit("")) == ""),
        say("refurbished, no condition notes shown"),
    ),
    Rule(
        "price-valid-until-expired", "medium", "accuracy", "Offer validity has passed",
        "Expired offers are ignored by search engines.",
        "Move the validity date forward at each publication.",
        lambda: _valid_until() < F.col("r_now"),
        lambda: F.concat(F.lit("offer expired on "), _offer()["price_valid_until"]),
    ),
    Rule(
        "description-missing", "high", "content", "No description",
        "A page without copy neither sells nor ranks.",
        "Write one, or use the maker's summary.",
        lambda: _c("r_description") == "",
        say("no description on the page or in the markup"),
    ),
    Rule(
        "description-short", "medium", "content", "Short description",
        "Unanswered questions come back as support requests and returns.",
        "Extend it to at least 300 characters.",
        lambda: (F.length("r_description") > 0) & (F.length("r_description") < P.DESCRIPTION_MIN_CHARS),
        lambda: F.concat(F.lit("description has "), F.length("r_description"), F.lit(" characters")),
    ),
    Rule(
        "specs-missing", "high", "content", "No specifications",
        "Shoppers who cannot compare specifications leave to compare them elsewhere.",
        "Fill the table from the supplier's or maker's data.",
        lambda: F.size("r_specs") == 0,
        say("specification table is empty"),
    ),
    Rule(
        "specs-thin", "medium", "content", "Few specifications",
        "A few rows seldom cover size, compatibility, connection and power.",
        "Give at least five meaningful rows.",
        lambda: (F.size("r_specs") > 0) & (F.size("r_specs") < P.SPECS_MIN_ROWS),
        lambda: F.concat(F.size("r_specs"), F.lit(" specification rows")),
        lambda: F.array_join(F.transform("r_specs", lambda s: s["label"]), ", "),
    ),
    Rule(
        "images-few", "medium", "content", "Few images",
        "More angles mean fewer surprised buyers.",
        "Show at least three images.",
        lambda: _image_count() < P.IMAGES_MIN,
        lambda: F.concat(_image_count(), F.lit(" images")),
    ),
    Rule(
        "plug-type-unstated", "medium", "content", "Plug type not stated",
        "A foreign plug that was not mentioned is a common complaint.",
        "State the plug in the specifications or the description.",
        lambda: T.has(_c("r_name"), P.MAINS_POWERED) & ~T.has(_c("r_name"), P.ACCESSORY_NAME) & ~T.has(_c("r_text"), P.PLUG_STATED),
        say("mains powered by its name, plug not mentioned"),
        lambda: _c("r_name"),
    ),
    Rule(
        "refurb-accessories-unstated", "medium", "content", "Refurbished item without contents list",
        "Missing accessories are a recurring complaint about refurbished goods.",
        "List what is in the box.",
        lambda: _c("r_refurbished") & ~_c("r_box_stated"),
        say("refurbished, contents of the box not stated"),
    ),
    Rule(
        "box-contents-unstated", "low", "content", "No contents list",
        "What is in the box is among the first things buyers ask.",
        "List what is in the box.",
        lambda: ~_c("r_refurbished") & ~_c("r_box_stated"),
        say("contents of the box not stated"),
    ),
    Rule(
        "name-leads-with-code", "low", "content", "Name starts with a part number",
        "Names are cut in lists; a code in front hides what the thing is.",
        "Put brand and product first.",
        lambda: _first_word().rlike(r"^[A-Z0-9][A-Z0-9-]{5,}\z") & _first_word().rlike("[0-9]") & _first_word().rlike("[A-Z]"),
        lambda: F.concat(F.lit("name starts with "), _first_word()),
        lambda: _c("r_name"),
    ),
    Rule(
        "watch-connectivity-unstated", "medium", "content", "Watch variant not stated",
        "The Bluetooth and the LTE model share a name but not a price, so neither shopper nor comparison can tell them apart.",
        "Name the variant in the title and in a specification row.",
        lambda: T.has(_c("r_name"), P.DUAL_CONNECTIVITY_WATCH)
        & ~T.has(_c("r_name"), P.WATCH_ACCESSORY)
        & ~T.has(_c("r_name"), P.CONNECTIVITY_IN_NAME)
        & ~_watch_variant_stated(),
        lambda: F.when(_watch_hint().isNotNull(), F.concat(F.lit("variant only hinted at under "), _watch_hint()["label"])).otherwise(
            F.lit("variant not stated in name or specifications")
        ),
        lambda: F.when(_watch_hint().isNotNull(), F.concat(_watch_hint()["label"], F.lit(": "), _watch_hint()["value"])).otherwise(_c("r_name")),
    ),
    Rule(
        "name-truncated", "medium", "content", "Name cut off or damaged",
        "The name heads every list; a broken one hides the product.",
        "Repair the feed mapping and import again.",
        lambda: (_dangling() != "") | T.has(_c("r_name"), P.NAME_MALFORMED),
        lambda: F.when(_dangling() != "", F.concat(F.lit("name ends in "), _dangling())).otherwise(
            F.lit("name has a blank before a comma or an open bracket")
        ),
        lambda: _c("r_name"),
    ),
    Rule(
        "jsonld-missing", "high", "structured-data", "No product markup",
        "Without it a page earns no rich results.",
        "Publish a product block with name, image, brand, GTIN and offer.",
        lambda: _ld().isNull(),
        say("no product markup"),
    ),
    Rule(
        "jsonld-offer-missing", "medium", "structured-data", "Product markup without an offer",
        "Price and stock vanish from results, and sold out looks like withdrawn.",
        "Keep the offer and mark it out of stock.",
        lambda: _ld().isNotNull() & _offer().isNull(),
        lambda: F.when(_c("out_of_stock_notice"), F.lit("out of stock and no offer in the markup")).otherwise(F.lit("no offer in the markup")),
    ),
    Rule(
        "jsonld-image-missing", "medium", "structured-data", "Product markup without an image",
        "Product results require an image.",
        "List the gallery images in the markup.",
        lambda: _ld().isNotNull() & (_c("r_ld_images") == 0),
        say("no image in the markup"),
    ),
    Rule(
        "brand-missing", "medium", "structured-data", "Product markup without a brand",
        "Filters and catalogue matching rely on the brand.",
        "Fill in the brand name.",
        lambda: _ld().isNotNull() & (F.coalesce(_ld()["brand"], F.lit("")) == ""),
        say("no brand in the markup"),
    ),
    Rule(
        "gtin-missing", "medium", "structured-data", "No GTIN",
        "The GTIN ties the listing to the same product elsewhere, price comparison included.",
        "Publish the EAN from the supplier's offer.",
        lambda: _ld().isNotNull() & (F.coalesce(_ld()["gtin"], F.lit("")) == ""),
        say("no GTIN in the markup"),
    ),
    Rule(
        "gtin-invalid", "medium", "structured-data", "GTIN check digit is wrong",
        "Invalid codes are rejected and never match.",
        "Enter the barcode again; a digit is wrong or missing.",
        lambda: (_ld()["gtin"] != "") & ~T.valid_gtin(_ld()["gtin"]),
        lambda: F.concat(F.lit("invalid GTIN "), _ld()["gtin"]),
    ),
    Rule(
        "jsonld-no-return-policy", "low", "structured-data", "Offer without return policy",
        "Free returns can be shown in results only if marked up.",
        "Add the return policy to each offer.",
        lambda: _offer().isNotNull() & ~F.coalesce(_offer()["has_return_policy"], F.lit(False)),
        say("offer has no return policy"),
    ),
    Rule(
        "jsonld-no-shipping-details", "low", "structured-data", "Offer without shipping details",
        "Free delivery can be shown in results only if marked up.",
        "Add shipping details to each offer.",
        lambda: _offer().isNotNull() & ~F.coalesce(_offer()["has_shipping_details"], F.lit(False)),
        say("offer has no shipping details"),
    ),
    Rule(
        "noindex-in-sitemap", "high", "seo", "Listed in the sitemap but not indexable",
        "The sitemap invites what the page forbids, so it is not found.",
        "Drop the directive or the sitemap entry.",
        lambda: F.lower("robots_meta").contains("noindex"),
        lambda: F.concat(F.lit("robots directive "), _c("robots_meta")),
    ),
    Rule(
        "canonical-mismatch", "medium", "seo", "Canonical URL missing or different",
        "Ranking is split when the canonical URL is not the page itself.",
        "Point each page's canonical URL at itself.",
        lambda: ~_canonical_given() | _path_differs(),
        lambda: F.when(~_canonical_given(), F.lit("no canonical URL"))
        .when(_c("r_canonical_path").isNull(), F.lit("canonical URL is malformed"))
        .otherwise(F.lit("canonical URL has another path")),
        lambda: F.when(_canonical_given(), _c("canonical")),
    ),
    Rule(
        "h1-count", "medium", "seo", "Not exactly one main heading",
        "None or several main headings blur the subject.",
        "Keep one, with the product name.",
        lambda: ~F.col("h1_count").eqNullSafe(F.lit(1)),
        lambda: F.concat(F.coalesce(_c("h1_count").cast("string"), F.lit("unknown number of")), F.lit(" main headings")),
    ),
    Rule(
        "meta-description-missing", "medium", "seo", "No meta description",
        "Search engines will pick some text from the page instead.",
        "Write a summary of 120 to 160 characters.",
        lambda: F.coalesce(_c("meta_description"), F.lit("")) == "",
        say("no meta description"),
    ),
    Rule(
        "meta-description-long", "low", "seo", "Long meta description",
        "Only some 160 characters are shown.",
        "Write a summary that names product, benefit and delivery.",
        lambda: F.length("meta_description") > P.META_DESCRIPTION_MAX_CHARS,
        lambda: F.concat(F.lit("meta description has "), F.length("meta_description"), F.lit(" characters")),
    ),
    Rule(
        "title-tag-long", "low", "seo", "Long title tag",
        "Long titles lose their end, often the variant.",
        "Shorten the name or drop the suffix.",
        lambda: F.length("title_tag") > P.TITLE_TAG_MAX_CHARS,
        lambda: F.concat(F.lit("title tag has "), F.length("title_tag"), F.lit(" characters")),
        lambda: _c("title_tag"),
    ),
    Rule(
        "slug-dedupe-suffix", "low", "seo", "URL ends in a counter",
        "A counter says the slug was taken: a double import or a cut name.",
        "Build slugs from distinguishing attributes and merge duplicates before import.",
        lambda: (_slug_counter() != "") & ~_number_in_name(_slug_counter()),
        lambda: F.concat(F.lit("slug ends in "), _slug_counter(), F.lit(", which the name does not contain")),
        lambda: _c("slug"),
    ),
    Rule(
        "image-alt-missing", "low", "seo", "Images without alternative text",
        "Alternative text is needed for accessibility and image search.",
        "Default it to the product name and the angle.",
        lambda: _c("images_missing_alt") > 0,
        lambda: F.concat(_c("images_missing_alt"), F.lit(" images without alternative text")),
    ),
]


def rule_dimension(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """Static table of the registry."""
    rows = [(i, r.id, r.title, r.severity, r.category, r.why, r.fix) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "position int, rule_id string, title string, severity string, category string, why string, fix string")
