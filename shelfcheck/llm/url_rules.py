"""URL filtering: a list of host and path rules, and pattern rules behind an index of rare tokens.

A list rule fits its host and all subdomains if the URL's path starts with the rule's; the longest that fits decides.
URLs that no list rule fits are judged by pattern rules. Each pattern rule carries the literal tokens that a URL must
hold for it to match (it may have none). It is filed under the one that occurs in the fewest URLs of the table; a URL's
tokens fetch the rules filed under them, and only those rules' regular expressions are run, on the lower-cased URL.
Rules without a token are run on every URL.

Tokens are runs of a-z and 0-9 of the lower-cased URL. Token counts cover the whole table, but only tokens that some
rule names are counted, so the index grows with the rules alone. Null URLs, and URLs without `://`, have an empty host
and path and fit no list rule; a null URL matches no pattern and is allowed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("$", r"\Z"))


class ListRule(NamedTuple):
    verdict: str
    rule: str  # host and path, as `example.com/en/`


class PatternRule(NamedTuple):
    tokens: tuple[str, ...]  # every URL that matches holds all of them as whole tokens
    pattern: str  # of the syntax that Python's re and RE2 share; `$` is the end of the URL


# The list.
LIST = (
    ListRule(ALLOW, "com/"),
    ListRule(BLOCK, "example.com/en/"),
    ListRule(ALLOW, "www.example.com/en/"),
    ListRule(BLOCK, "net/es/"),
    ListRule(BLOCK, "net/fr/"),
)


def _word(*words: str) -> list[PatternRule]:
    """A whole path segment."""
    return [PatternRule((w,), rf"://[^/?#]*/([^?#]*/)?{w}(/|[?#]|$)") for w in words]


def _label(*words: str) -> list[PatternRule]:
    """A whole label of the host."""
    return [PatternRule((w,), rf"://([^/?#]*[.@])?{w}\.") for w in words]


def _parameter(*names: str) -> list[PatternRule]:
    """A query parameter that carries a session or a redirect."""
    return [PatternRule((n,), rf"[?&]{n}=[^&#]") for n in names]


#: Pages that are advertising, tracking, account or cart machinery, or endless calendars and searches.
PATTERNS: tuple[PatternRule, ...] = (
    *_word("ads", "adserver", "banner", "banners", "sponsored", "affiliate", "casino", "poker", "betting", "porn", "xxx", "escort", "warez", "torrent", "torrents"),
    *_word("login", "logout", "signin", "signup", "register", "cart", "checkout", "basket", "wishlist", "search", "calendar", "print", "feed", "trackback"),
    *_label("ads", "ad", "adserver", "track", "tracker", "tracking", "click", "clicks", "stats", "pixel", "casino", "poker", "porn", "xxx"),
    *_parameter("sessionid", "phpsessid", "jsessionid", "sid", "replytocom", "redirect", "returnurl", "share", "affid", "clickid"),
    PatternRule(("php", "viewtopic"), r"/viewtopic\.php\?[^#]*\bp=[0-9]+"),
    PatternRule(("php", "index"), r"/index\.php\?[^#]*option=com_(mailto|user)"),
    PatternRule(("wp", "login"), r"/wp-login\.php"),
    PatternRule(("wp", "admin"), r"/wp-admin(/|$)"),
    PatternRule(("cgi", "bin"), r"/cgi-bin/"),
    PatternRule(("feed", "utm"), r"[?&]utm_source=feed(&|#|$)"),
    PatternRule(("ref", "page"), r"[?&]page=[0-9]+&ref=[^&#]+"),
    PatternRule((), r"://[0-9]{1,3}(\.[0-9]{1,3}){3}([:/?#]|$)"),
    PatternRule((), r"(/[^/?#]+)/[^?#]*//"),
    PatternRule((), r"[?&][^=&#]{100,}"),
    PatternRule((), r"\.(exe|zip|rar|iso|apk|dmg|mp[34]|avi|jpe?g|gif|png)([?#]|$)"),
)

_TOKEN = re.compile("[a-z0-9]+").findall


def host(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: Sequence[ListRule] = LIST) -> Column:
    """Struct (rule, verdict) of the longest list rule that fits, else null. Rules of equal length fit different URLs."""
    cases = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r.rule)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases if cases is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def token_counts(urls: DataFrame, url: str, rules: Sequence[PatternRule]) -> dict[str, int]:
    """In how many URLs each token that the rules name occurs: at most one number per such token is collected."""
    named = sorted({t for r in rules for t in r.tokens})
    if not named:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url)), F.lit("[a-z0-9]+"), 0))
    found = urls.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, named)))).alias("token")).groupBy("token").count()
    return dict.fromkeys(named, 0) | {r["token"]: r["count"] for r in found.collect()}


def index(rules: Sequence[PatternRule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """(rule numbers by the token they are filed under, rules without a token)."""
    filed: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            filed.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return filed, always


def matched(url: Column, rules: Sequence[PatternRule], counts: dict[str, int]) -> Column:
    """Number of the first pattern rule that matches, else null."""
    filed, always = index(rules, counts)
    patterns = [r.pattern for r in rules]

    def run(urls: pa.Array) -> pa.Array:
        tried = [compiled(p) for p in patterns]
        out: list[int | None] = []
        for u in urls.to_pylist():
            if u is None:
                out.append(None)
                continue
            u = u.lower()
            candidates = {*always, *(i for t in {*_TOKEN(u)} & filed.keys() for i in filed[t])}
            out.append(next((i for i in sorted(candidates) if tried[i].search(u)), None))
        return pa.array(out, pa.int32())

    return F.arrow_udf(run, "int")(url)


def judged(pages: DataFrame, url: str = "url", rules: Sequence[ListRule] = LIST, patterns: Sequence[PatternRule] = PATTERNS) -> DataFrame:
    """`pages` with a struct column `url_verdict`: host, path, rule (of the list, else null), pattern (number of the
    matching pattern rule; null if a list rule decides or none matches) and verdict. A column of that name is replaced."""
    col = F.col(f"`{url}`")
    counts = token_counts(pages, f"`{url}`", patterns)
    fit = listed(host(col), path(col), rules)
    fitting = F.when(fit.isNull(), col)  # the others are not looked at
    pattern = matched(fitting, patterns, counts)
    verdict = F.coalesce(fit["verdict"], F.when(pattern.isNotNull(), BLOCK).otherwise(ALLOW))
    return pages.withColumn("url_verdict", F.struct(host(col).alias("host"), path(col).alias("path"), fit["rule"].alias("rule"), pattern.alias("pattern"), verdict.alias("verdict")))
