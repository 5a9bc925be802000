"""Product pages to typed records. One Arrow-batched scan of the markup, then native columns; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import page_scan
from ..functions import patterns as P
from ..functions import text as T

_TEXTUAL = "^(STRING|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"

# --- structured data ----------------------------------------------------------------


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text_of(v: Column) -> Column:
    """Trimmed text of a variant that is a string or a number; NULL otherwise and when blank."""
    return T.let(v, lambda x: F.when(_kind(x).rlike(_TEXTUAL), T.non_blank(F.try_variant_get(x, "$", "string"))))


def _list_of(v: Column) -> Column:
    """A variant as an array: an array's elements, a single value as the only one, none when missing."""
    none = F.array().cast("array<variant>")
    return T.let(
        v,
        lambda x: F.when(F.startswith(_kind(x), F.lit("ARRAY")), F.coalesce(F.try_variant_get(x, "$", "array<variant>"), none))
        .when(_kind(x) != "VOID", F.array(x))
        .otherwise(none),
    )


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(_kind(v), F.lit("OBJECT")), F.lit(False))


def _given(v: Column) -> Column:
    """Present and neither null, false, zero nor empty."""

    def filled(x: Column) -> Column:
        text = F.try_variant_get(x, "$", "string")
        empty = (
            F.when(_kind(x) == "VOID", True)
            .when(_kind(x) == "STRING", text == "")
            .when(_kind(x) == "BOOLEAN", text == "false")
            .when(_kind(x).rlike(_TEXTUAL), text.try_cast("double") == 0)
            .otherwise(False)
        )
        return x.isNotNull() & ~empty

    return F.coalesce(T.let(v, filled), F.lit(False))


def _present(v: Column) -> Column:
    return T.let(v, lambda x: F.when(_kind(x) != "VOID", x))


def is_product(node: Column) -> Column:
    kinds = _list_of(_at(node, "$['@type']"))
    return F.exists(kinds, lambda t: F.coalesce((_kind(t) == "STRING") & (F.try_variant_get(t, "$", "string") == "Product"), F.lit(False)))


def _offer_price(o: Column) -> Column:
    raw = F.coalesce(_present(_at(o, "$.price")), _present(_at(o, "$.lowPrice")), _present(_at(o, "$.priceSpecification.price")))
    return T.number(_text_of(raw))


_OFFER = ("currency", "availability", "condition", "price_valid_until", "has_return_policy", "has_shipping_details")


def cheapest_offer(node: Column) -> Column:
    """The node's offer with the lowest price, unpriced ones last, the first of equals; NULL without offers."""
    unpriced = F.lit(float("inf"))
    read = lambda o, i: F.struct(
        F.coalesce(_offer_price(o), unpriced).alias("price"),
        i.alias("pos"),
        F.coalesce(_text_of(_at(o, "$.priceCurrency")), _text_of(_at(o, "$.priceSpecification.priceCurrency"))).alias("currency"),
        T.availability_of(_text_of(_at(o, "$.availability"))).alias("availability"),
        T.condition_of(_text_of(_at(o, "$.itemCondition"))).alias("condition"),
        _text_of(_at(o, "$.priceValidUntil")).alias("price_valid_until"),
        _given(_at(o, "$.hasMerchantReturnPolicy")).alias("has_return_policy"),
        _given(_at(o, "$.shippingDetails")).alias("has_shipping_details"),
    )
    offers = F.filter(_list_of(_at(node, "$.offers")), _is_object)
    return T.let(
        F.array_min(F.transform(offers, read)),
        lambda best: F.when(
            best.isNotNull(), F.struct(F.nullif(best["price"], unpriced).alias("price"), *[best[f].alias(f) for f in _OFFER])
        ),
    )


def product_node(node: Column) -> Column:
    images = F.filter(
        F.transform(
            _list_of(_at(node, "$.image")),
            lambda i: F.when(_kind(i) == "STRING", F.try_variant_get(i, "$", "string")).otherwise(_text_of(_at(i, "$.url"))),
        ),
        lambda s: s != "",
    )
    brand = T.let(_at(node, "$.brand"), lambda b: F.when(_kind(b) == "STRING", _text_of(b)).otherwise(_text_of(_at(b, "$.name"))))
    gtin = F.coalesce(*[_text_of(_at(node, f"$.{k}")) for k in ("gtin13", "gtin", "gtin14", "gtin12", "gtin8")])
    return F.struct(
        _text_of(_at(node, "$.name")).alias("name"),
        _text_of(_at(node, "$.sku")).alias("sku"),
        gtin.alias("gtin"),
        _text_of(_at(node, "$.mpn")).alias("mpn"),
        brand.alias("brand"),
        _text_of(_at(node, "$.description")).alias("description"),
        images.alias("images"),
        cheapest_offer(node).alias("offer"),
    )


def with_scan(pages: DataFrame) -> DataFrame:
    """Pages (url, html, …) without html, plus `elements` and `products`: the scanned markup and its Product nodes."""
    scanned = pages.withColumn("scan", page_scan.scan_pages("html"))
    nodes = F.transform("scan.nodes", lambda n: F.try_parse_json(n))
    rest = [c for c in pages.columns if c != "html"]
    return scanned.select(*rest, F.col("scan.elements").alias("elements"), F.filter(nodes, is_product).alias("products"))


# --- the listing record -----------------------------------------------------------------


def _all(test) -> Column:
    return F.filter("elements", test)


def _first(test) -> Column:
    return F.try_element_at(_all(test), F.lit(1))


def _hook(name: str) -> Column:
    return F.coalesce(_first(lambda e: e["hook"] == name)["text"], F.lit(""))


def _in(container: str, *tags: str):
    return lambda e: F.array_contains(e["inside"], container) & e["tag"].isin(*tags)



def _category_trail() -> Column:
    trail = F.regexp_replace(T.clean(_hook("pdp-category-trail")), r"(?i)^Category:\s*", "")
    named = F.filter(F.transform(F.split(trail, ">"), lambda c: T.clean(c)), lambda c: c.isNotNull())
    crumbs = F.filter(
        F.transform(F.filter(_all(_in("breadcrumb-trail", "a", "span", "li")), lambda e: e["leaf"]), lambda e: T.clean(e["text"])),
        lambda c: c.isNotNull() & ~c.rlike(P.TRAIL_SEPARATOR),
    )
    inner = F.slice(crumbs, F.lit(2), F.greatest(F.size(crumbs) - 2, F.lit(0)))
    return F.when(F.coalesce(trail, F.lit("")) != "", named).otherwise(inner)


def _specs() -> Column:
    values = _all(_in("pdp-specs", "dd"))
    rows = F.transform(
        _all(_in("pdp-specs", "dt")),
        lambda dt: F.struct(
            F.regexp_replace(F.coalesce(T.clean(dt["text"]), F.lit("")), r":\z", "").alias("label"),
            F.coalesce(
                T.clean(
                    F.try_element_at(
                        F.filter(values, lambda dd: (dd["parent"] == dt["parent"]) & (dd["nth"] == dt["nth"] + 1)), F.lit(1)
                    )["text"]
                ),
                F.lit(""),
            ).alias("value"),
        ),
    )
    return F.filter(rows, lambda r: r["label"] != "")


def _variants() -> Column:
    def variant(e: Column) -> Column:
        text = F.coalesce(T.clean(e["text"]), F.lit(""))
        bare = F.regexp_replace(text, f"^(.*?){P.PAGE_AMOUNT}", "$1")
        bare = F.regexp_replace(bare, "(?i)^(.*?)out of stock", "$1")
        return F.struct(
            F.regexp_replace(e["hook"], "^" + P.HOOK_PREFIX_TAB, "").alias("id"),
            F.coalesce(T.clean(bare), F.lit("")).alias("label"),
            T.price_from_text(F.regexp_extract(text, f"({P.PAGE_AMOUNT})", 1)).alias("price"),
            text.rlike("(?i)out of stock").alias("out_of_stock"),
            e["selected"].alias("selected"),
        )

    return F.transform(_all(lambda e: F.startswith(e["hook"], F.lit(P.HOOK_PREFIX_TAB))), variant)


def _head(tag: str, key: str) -> Column:
    return T.clean(_first(lambda e: (e["tag"] == tag) & (e["key"] == key))["value"])


def extract_listings(pages: DataFrame) -> DataFrame:
    """Pages (url, html) to the nested listing record of `schemas.LISTING`; other page columns are kept."""
    scanned = with_scan(pages)
    kept = [c for c in scanned.columns if c not in ("url", "elements", "products")]
    headings = lambda e: e["tag"] == "h1"
    thumbs = F.size(_all(lambda e: e["hook"] == "image-gallery-thumb"))
    gallery = _all(_in("image-gallery", "img"))
    first_product = F.try_element_at("products", F.lit(1))
    described = T.clean(_hook("pdp-description"))
    rows = scanned.withColumn("node", first_product)
    return rows.select(
        *kept,
        "url",
        T.slug_of(F.col("url")).alias("slug"),
        T.clean(_first(lambda e: e["tag"] == "title")["text"]).alias("title_tag"),
        _head("meta", "description").alias("meta_description"),
        _head("link", "canonical").alias("canonical"),
        _head("meta", "og:image").alias("og_image"),
        _head("meta", "robots").alias("robots_meta"),
        F.when(F.col("node").isNotNull(), product_node(F.col("node"))).alias("json_ld"),
        F.size("products").alias("json_ld_product_count"),
        T.clean(_first(headings)["text"]).alias("h1"),
        F.size(_all(headings)).alias("h1_count"),
        _category_trail().alias("breadcrumbs"),
        F.coalesce(T.price_from_text(_hook("condition-price")), T.price_from_text(_hook("pdp-price-block"))).alias("visible_price"),
        T.price_from_text(_first(lambda e: e["struck"] & F.array_contains(e["inside"], "pdp-price-block"))["text"]).alias("visible_was_price"),
        F.exists("elements", lambda e: F.coalesce(e["hook"] == "back-in-stock-form", F.lit(False))).alias("out_of_stock_notice"),
        F.coalesce(T.clean(_hook("sticky-atc-condition-chip")), T.clean(_hook("condition-trust-badge-top"))).alias("condition_label"),
        T.clean(_hook("condition-details-notes")).alias("condition_notes"),
        _variants().alias("condition_variants"),
        F.regexp_replace(described, r"(?i)^Description\s+", "").alias("description"),
        _specs().alias("specs"),
        F.when(thumbs > 0, thumbs).otherwise(F.size(gallery)).alias("gallery_image_count"),
        F.size(F.filter(gallery, lambda e: T.clean(e["value"]).isNull())).alias("images_missing_alt"),
    )


def _named(best: Column, field: str) -> Column:
    """A text field of an offer, or the number that stands in its place."""
    return F.coalesce(best[field], F.try_variant_get(F.try_parse_json(best[field + "_number"]), "$", "string"))


def page_offers(pages: DataFrame) -> DataFrame:
    """Pages plus `offer`: the cheapest priced offer over all Product nodes, NULL when none has a price; and `has_body`."""
    read = pages.withColumn("has_body", F.coalesce(F.col("html") != "", F.lit(False))).withColumn("found", page_scan.page_offers("html"))
    numbered = F.transform("found.offers", lambda o, i: F.struct(T.number(o["price"]).alias("price"), i.alias("pos"), o.alias("fields")))
    cheapest = F.array_min(F.filter(numbered, lambda o: o["price"] < float("inf")))
    best, fields = F.col("best"), F.col("best.fields")
    # Only the offer that is chosen has its words looked up.
    offer = F.struct(
        best["price"].alias("price"), best["pos"].alias("pos"), _named(fields, "title").alias("title"), _named(fields, "currency").alias("currency"),
        T.condition_of(fields["condition"]).alias("condition"), T.availability_of(fields["availability"]).alias("availability"),
    )
    rest = [c for c in read.columns if c not in ("html", "found")]
    return read.select(*rest, F.col("found.product_count").alias("product_count"), cheapest.alias("best")).select(
        *rest, "product_count", F.when(best.isNotNull(), offer).alias("offer")
    )


def is_challenge(html: Column, product_count: Column) -> Column:
    """A bot challenge served as a normal page."""
    return F.coalesce(html.rlike("(?i)" + P.CHALLENGE), F.lit(False)) & (product_count == 0)


def product_columns(listings: DataFrame) -> DataFrame:
    """The flat product columns of a listing record."""
    ld = F.col("json_ld")
    labelled = T.condition_from_label(F.col("condition_label"))
    return listings.select(
        "url",
        "slug",
        ld["sku"].alias("sku"),
        ld["gtin"].alias("gtin"),
        F.coalesce(ld["name"], F.col("h1")).alias("name"),
        ld["brand"].alias("brand"),
        F.nullif(F.array_join("breadcrumbs", " > "), F.lit("")).alias("category_path"),
        F.when(labelled != "unknown", labelled).otherwise(F.coalesce(ld["offer"]["condition"], F.lit("unknown"))).alias("condition"),
        "condition_label",
        T.money(F.coalesce(F.col("visible_price"), ld["offer"]["price"])).alias("price"),
        T.money(F.col("visible_was_price")).alias("was_price"),
        ld["offer"]["currency"].alias("currency"),
        F.coalesce(ld["offer"]["availability"], F.when(F.col("out_of_stock_notice"), "out_of_stock").otherwise("unknown")).alias("availability"),
    )
