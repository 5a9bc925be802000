"""Column helpers for text, money, URLs and the schema.org vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean(c: Column) -> Column:
    """Collapse whitespace, trim; empty becomes NULL."""
    return F.nullif(F.trim(F.regexp_replace(c, P.WS + "+", " ")), F.lit(""))


def clean_edges(c: Column) -> Column:
    """Whitespace removed at both ends."""
    return F.btrim(c, F.lit(P.WS_CHARS))


def non_blank(c: Column) -> Column:
    return F.nullif(clean_edges(c), F.lit(""))


def price_from_text(c: Column) -> Column:
    """First number (at most two decimals) once thousands commas are dropped; NULL when there is none."""
    digits = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(\d+(?:\.\d{1,2})?)", 1)
    return digits.try_cast("double")


def number(c: Column) -> Column:
    """A numeric text as a finite double; anything else, blanks included, is NULL."""
    t = clean_edges(c)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), t.try_cast("double"))


def money(c: Column) -> Column:
    return c.try_cast("decimal(10,2)")


def pounds(c: Column) -> Column:
    return F.format_string("£%.2f", c.cast("double"))


def same_price(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 0.01


def has(c: Column, pattern: str, ignore_case: bool = True, any_of: list[str] | None = None) -> Column:
    """Whether the pattern occurs. `any_of` lists lower-case texts of which every match holds one:
    plain searches for them are far cheaper than the pattern on long texts and rule most out."""
    found = c.rlike(P.jvm(pattern, ignore_case))
    return found if any_of is None else _has_any(F.lower(c), *any_of) & found


# --- URLs --------------------------------------------------------------------

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_HOST_OK = r"^(?:[^/?#@]*@)?(?:[^\s#%/:<>?@\[\\\]^|]+|\[[0-9A-Fa-f:.]+\])(?::\d*)?\z"


# What a URL parser encodes in a path: controls, blank, quote, angle brackets, back-tick, braces, caret and all beyond ASCII.
_UNSAFE = r"[^\x21\x23-\x3B\x3D\x3F-\x5D\x5F\x61-\x7A\x7C\x7E]"
_SAFE_RUN = r"[\x21\x23-\x3B\x3D\x3F-\x5D\x5F\x61-\x7A\x7C\x7E]+"


def tidy_url(url: Column) -> Column:
    """The URL as parsers read it: edges and line breaks dropped, back-slashes before the query are slashes."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    mended = lambda u: F.concat(F.replace(_drop_query(u), F.lit("\\"), F.lit("/")), F.regexp_extract(u, r"([?#][\s\S]*)", 1))
    return let(bare, lambda u: F.when(F.contains(u, F.lit("\\")), mended(u)).otherwise(u))


def encoded_path(path: Column) -> Column:
    """Percent-encode what a URL's path can't hold; what is encoded already stays as it is."""
    encoded = lambda x: F.when(x.rlike(_UNSAFE), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x)
    pieces = lambda p: F.regexp_extract_all(p, F.lit(f"({_SAFE_RUN}|{_UNSAFE})"), F.lit(1))
    return let(path, lambda p: F.when(p.rlike(_UNSAFE), F.array_join(F.transform(pieces(p), encoded), "")).otherwise(p))


def instant(text: Column) -> Column:
    """An ISO date or time as a timestamp; without a zone it is UTC, whatever the session's zone."""
    day = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^([+-]?\d{4,6})\z", "$1-01-01"), r"^([+-]?\d{4,6}-\d{1,2})\z", "$1-01"), r"^([+-]?\d{4,6}-\d{1,2}-\d{1,2})\z", "$1T00:00:00")
    zoned = lambda t: F.when(t.rlike(r"[T ].*([zZ]|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)\z"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(text.rlike(r"^[+-]?\d{4}"), let(day(text), zoned).try_cast("timestamp"))


def _drop_query(c: Column) -> Column:
    return F.regexp_replace(c, r"[?#][\s\S]*", "")


def _without_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments."""

    def resolved(p: Column) -> Column:
        parts = F.split(p, "/")
        kept = F.aggregate(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        ends_open = p.rlike(r"/\.\.?\z")
        return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(ends_open & (F.size(k) > 0), F.lit("/")).otherwise(F.lit(""))))

    return let(path, lambda p: F.when(p.rlike(r"/\.\.?(/|\z)"), resolved(p)).otherwise(p))


def _host_of(tidy: Column) -> Column:
    authority = F.regexp_extract(tidy, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return let(authority, lambda a: F.when(a.rlike(_HOST_OK), F.lower(F.regexp_replace(a, r"^[^@]*@", ""))))


def _path_of(tidy: Column) -> Column:
    rest = F.regexp_replace(_drop_query(tidy), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.when(_host_of(tidy).isNotNull(), encoded_path(_without_dots(F.coalesce(F.nullif(rest, F.lit("")), F.lit("/")))))


def url_host(url: Column) -> Column:
    """Host (with port) of an absolute URL, lower case; NULL when the URL has none or it is malformed."""
    return _host_of(tidy_url(url))


def url_path(url: Column) -> Column:
    """Percent-encoded path of an absolute URL; `/` when it has none, NULL when the URL is malformed."""
    return let(tidy_url(url), _path_of)


def url_path_and_query(url: Column) -> Column:
    query = F.regexp_extract(F.regexp_replace(url, r"#[\s\S]*", ""), r"(\?[\s\S]+)", 1)
    return F.concat(url_path(url), query)


def resolved_path(ref: Column, base: Column) -> Column:
    """Path that `ref` has when resolved against the absolute URL `base`; NULL when it is no valid URL."""

    def resolved(r: Column) -> Column:
        bare, folder = _drop_query(r), F.regexp_replace(url_path(base), r"[^/]*\z", "")
        relative = F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(folder, bare))
        absolute = F.when(r.rlike(r"^//"), F.concat(F.lit("https:"), r)).otherwise(r)
        return (
            F.when(r.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"), let(absolute, _path_of))
            .when(r.rlike(_ABSOLUTE), F.regexp_replace(bare, _ABSOLUTE, ""))
            .when(bare == "", url_path(base))
            .otherwise(encoded_path(_without_dots(relative)))
        )

    return let(tidy_url(ref), resolved)


def slug_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url_path(url), "^/product/", ""), r"/\z", "")


# --- vocabularies --------------------------------------------------------------


def _has_any(v: Column, *words: str) -> Column:
    hit = v.contains(words[0])
    for w in words[1:]:
        hit = hit | v.contains(w)
    return hit


def condition_of(c: Column) -> Column:
    """schema.org item condition text to new / refurbished / used / unknown."""
    v = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(_has_any(v, "refurbished"), "refurbished")
        .when(_has_any(v, "used", "damaged"), "used")
        .when(_has_any(v, "new"), "new")
        .otherwise("unknown")
    )


def availability_of(c: Column) -> Column:
    """schema.org availability text to in_stock / out_of_stock / preorder / unknown."""
    v = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(_has_any(v, "outofstock", "soldout", "discontinued"), "out_of_stock")
        .when(_has_any(v, "preorder", "presale", "backorder"), "preorder")
        .when(_has_any(v, "instock", "limitedavailability", "onlineonly"), "in_stock")
        .otherwise("unknown")
    )


def condition_from_label(c: Column) -> Column:
    """Condition named by the label the page shows."""
    v = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(_has_any(v, "refurb", "open box"), "refurbished")
        .when(_has_any(v, "used", "pre-owned"), "used")
        .when(_has_any(v, "new"), "new")
        .otherwise("unknown")
    )


def valid_gtin(c: Column) -> Column:
    """GS1 check digit over 8, 12, 13 or 14 digits; blanks and hyphens are ignored."""
    digits = F.regexp_replace(c, f"{P.WS}|-", "")
    body = F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 1))
    total = F.aggregate(
        F.transform(
            F.split(body, ""),
            lambda d, i: d.try_cast("int") * F.when(i % 2 == 0, 3).otherwise(1),
        ),
        F.lit(0),
        lambda acc, x: acc + F.coalesce(x, F.lit(0)),
    )
    ok_shape = digits.rlike(r"^([0-9]{8}|[0-9]{12}|[0-9]{13}|[0-9]{14})\z")
    return F.when(ok_shape, (F.lit(10) - total % 10) % 10 == F.right(digits, F.lit(1)).try_cast("int")).otherwise(F.lit(False))
