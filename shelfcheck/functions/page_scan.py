"""The one step that needs Python: walk a page's markup and report the elements the page reader asks for.

Everything after it (fields, prices, structured data) is native columns in `operators.extract`.
"""

from __future__ import annotations

import json
import re
import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from math import inf

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .patterns import HOOK_PREFIX_TAB, HOOKS, WS_CHARS

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# A start tag on the left ends an open tag on the right, unless one of the fences lies between.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"ul", "ol", "dl", "table", "select", "body"}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
NAMED = {"description", "robots"}
CONTAINERS = {"breadcrumb-trail", "pdp-specs", "pdp-price-block", "image-gallery"}
WITHIN = {"a": "breadcrumb-trail", "span": "breadcrumb-trail", "li": "breadcrumb-trail", "dt": "pdp-specs", "dd": "pdp-specs", "img": "image-gallery"}

ELEMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("tag", "hook", "key", "value", "text")]
    + [
        T.StructField("inside", T.ArrayType(T.StringType())),
        T.StructField("parent", T.IntegerType()),
        T.StructField("nth", T.IntegerType()),
        T.StructField("leaf", T.BooleanType()),
        T.StructField("selected", T.BooleanType()),
        T.StructField("struck", T.BooleanType()),
    ]
)
SCAN = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT)), T.StructField("nodes", T.ArrayType(T.StringType()))])

# The scan travels to the workers by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ARROW_SCAN = to_arrow_type(SCAN)


# Elements whose content is text up to their end tag, with character references.
RAW_TEXT = {"title", "textarea"}

# Tags as nearly all pages write them: values in double quotes, no references. The standard parser reads all others.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[ ][a-zA-Z][a-zA-Z-]*="[^"<>&]*")*)(/?)>""")
_PLAIN_ATTRIBUTE = re.compile(r"""[ ]([a-zA-Z][a-zA-Z-]*)="([^"<>&]*)["]""")
_START_OPEN = re.compile("<[a-zA-Z]")


class _Open:
    __slots__ = ("tag", "number", "children", "record", "text_from", "hook")

    def __init__(self, tag, number, record, hook):
        self.tag, self.number, self.children, self.record, self.hook = tag, number, 0, record, hook
        self.text_from = None  # where its text begins among the page's, if it is wanted


class PageScan(HTMLParser):
    """One pass with constant work per tag: the places of open elements are kept per tag name."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", 0, None, None)]
        self.places = {}  # tag to the places of its open elements, in order
        self.inside = []  # hooks of the open containers
        self.count = self.wanted_open = 0
        self.headings = 0
        self.seen = set()
        self.texts = []
        self.elements = []
        self.blocks = []

    def goahead(self, end):
        """The standard parser's loop with a short way for plain tags. Where that would stop, before what isn't ended, it takes over."""
        page, at = self.rawdata, 0
        while True:
            if self.cdata_elem:
                stop = self.interesting.search(page, at)
                if not stop:
                    break
                if at < stop.start():
                    self.handle_data(page[at : stop.start()])
                at = stop.start()
                after = self.parse_endtag(at)
            else:
                begin = page.find("<", at)
                if begin < 0:
                    break
                if at < begin and self.wanted_open:
                    self.handle_data(unescape(page[at:begin]))
                at = begin
                plain = _PLAIN_TAG.match(page, at)
                after = self._plain_tag(plain) if plain else self._other_markup(page, at)
            if after < 0:
                break
            at = after
        self.rawdata = page[at:]
        super().goahead(end)

    def _plain_tag(self, plain):
        ends, tag, given, closed = plain.groups()
        tag = tag.lower()
        if ends:
            if given or closed:
                return self.parse_endtag(plain.start())
            self.handle_endtag(tag)
            return plain.end()
        attrs = [(name.lower(), value) for name, value in _PLAIN_ATTRIBUTE.findall(given)] if given else []
        if closed:
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return plain.end()

    def _other_markup(self, page, at):
        """Where the markup at a `<` ends, -1 if it doesn't."""
        if _START_OPEN.match(page, at):
            return self.parse_starttag(at)
        if page.startswith("</", at):
            return self.parse_endtag(at)
        if page.startswith("<!--", at):
            return self.parse_comment(at)
        if page.startswith("<?", at):
            return self.parse_pi(at)
        if page.startswith("<!", at):
            return self.parse_html_declaration(at)
        if at + 1 == len(page):
            return -1
        self.handle_data("<")
        return at + 1

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED_END or tag in ENDS_PARAGRAPH:
            self._imply_ends(tag)
        a = dict(attrs[::-1]) if attrs else {}  # of a repeated attribute the first counts
        hook = a.get("data-testid")
        parent = self.open[-1]
        parent.children += 1
        if parent.record is not None:
            parent.record["leaf"] = False
        self.count += 1
        struck = "class" in a and "line-through" in (a["class"] or "").split()
        record = None
        wanted = (
            tag in ("title", "h1", "meta", "link")
            or (hook is not None and (hook in HOOKS or hook.startswith(HOOK_PREFIX_TAB)))
            or WITHIN.get(tag) in self.inside
            or (struck and "pdp-price-block" in self.inside)
        )
        if wanted:
            record = {
                "tag": tag, "hook": hook, "key": a.get("name") if a.get("name") in NAMED else a.get("property") or a.get("rel"),
                "value": a.get("content") or a.get("href") or a.get("alt"), "text": None, "inside": list(self.inside),
                "parent": parent.number, "nth": parent.children, "leaf": True,
                "selected": "true" in (a.get("aria-checked"), a.get("aria-selected")), "struck": struck,
            }
            self.elements.append(record)
        if tag in VOID:
            return
        first = hook in CONTAINERS and hook not in self.seen
        if first:
            self.seen.add(hook)
            self.inside.append(hook)
        element = _Open(tag, self.count, record, hook if first else None)
        # Of headings only the first one's text is used; the others are counted.
        self.headings += tag == "h1"
        if (record is not None and (tag != "h1" or hook or self.headings == 1)) or (tag == "script" and a.get("type") == "application/ld+json"):
            element.text_from = len(self.texts)
            self.wanted_open += 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(element)
        if tag in RAW_TEXT:
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag):
        places = self.places.get(tag)
        if places:
            self._close_to(places[-1])

    def handle_data(self, data):
        if self.wanted_open:
            self.texts.append(unescape(data) if self.open[-1].tag in RAW_TEXT else data)

    def finish(self):
        self.close()
        self._close_to(1)

    def _imply_ends(self, tag):
        ended = [p for t in IMPLIED_END.get(tag) or ("p",) if (p := self.places.get(t))]
        if not ended:
            return
        fence = max((p[-1] for t in FENCES if (p := self.places.get(t))), default=0)
        beyond = [p[bisect_right(p, fence)] for p in ended if p[-1] > fence]
        if beyond:
            self._close_to(min(beyond))

    def _close_to(self, place):
        while len(self.open) > place:
            element = self.open.pop()
            self.places[element.tag].pop()
            if element.hook:
                self.inside.remove(element.hook)
            if element.text_from is None:
                continue
            self.wanted_open -= 1
            text = "".join(self.texts[element.text_from :])
            if element.record is not None:
                element.record["text"] = text
            else:
                self.blocks.append(text)
        if not self.wanted_open:
            self.texts.clear()


def _whole(text: str):
    number = float(text)
    return int(number) if number.is_integer() and abs(number) < 1e15 else number


def _refuse(text: str):
    raise ValueError(text)


def _objects(block: str, decoder: json.JSONDecoder) -> list[dict]:
    """Every object of a structured-data block, through arrays and graphs; a ValueError when it is malformed."""
    out = []

    def collect(value):
        if isinstance(value, list):
            for v in value:
                collect(v)
        elif isinstance(value, dict):
            out.append(value)
            collect(value.get("@graph"))

    text = block.strip(" \t\n\r")
    value, end = decoder.raw_decode(text)
    if end < len(text):
        raise ValueError("more than one value")
    collect(value)
    return out


def _without_graph(node: dict) -> dict:
    return {k: v for k, v in node.items() if k != "@graph"}


def object_nodes(block: str) -> list[str]:
    """Every object of a structured-data block, through arrays and graphs, as JSON text; none when it is malformed."""
    decoder = json.JSONDecoder(parse_float=_whole, parse_constant=_refuse)
    try:
        return [json.dumps(_without_graph(o), ensure_ascii=False) for o in _objects(block, decoder)]
    except (ValueError, RecursionError):
        return []


def scan(html: str | None) -> dict:
    page = PageScan()
    page.feed(html or "")
    page.finish()
    return {"elements": page.elements, "nodes": [n for b in page.blocks for n in object_nodes(b)]}


#: Pages of which the elements are held as Python objects at a time; what is kept of a batch beyond them is Arrow.
PAGES_AT_ONCE = 64


def in_parts(read: Callable[[str | None], object], html: pa.Array, kind: pa.DataType) -> pa.Array:
    """`read` of each page as an Arrow array, made part by part."""
    parts = [html[i : i + PAGES_AT_ONCE] for i in range(0, len(html), PAGES_AT_ONCE)]
    return pa.concat_arrays([pa.array([], kind), *(pa.array([read(h.as_py()) for h in part], kind) for part in parts)])


@F.arrow_udf(SCAN)
def _scan_pages(html: pa.Array) -> pa.Array:
    return in_parts(scan, html, _ARROW_SCAN)


# Declared nondeterministic so that filters on what is read from a page are not pushed below the scan,
# which would run it twice.
scan_pages = _scan_pages.asNondeterministic()


_OPENING = re.compile(r"<!--|<script(?![\w-])", re.I)
_STOP = re.compile(r"""[>"']""")
_END = re.compile(r"</script(?![\w-])", re.I)
_STRUCTURED = re.compile(r"""(?:^|\s)type\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json(?=\s|$))""", re.I)

# What follows `<script` as nearly all pages write it.
_PLAIN_REST = ' type="application/ld+json">'


def blocks(html: str) -> Iterator[str]:
    """The bodies of a page's structured-data scripts, in one pass that never goes back.

    A comment ends at its `-->`, a start tag at the first `>` outside of quotes, a script at the first end tag of a
    script, whatever stands in it. What isn't ended takes the rest of the page with it, as in a browser.
    """
    at = 0
    while opening := _OPENING.search(html, at):
        at = opening.end()
        if opening[0] == "<!--":
            at = html.find("-->", at)
            if at < 0:
                return
            continue
        if html.startswith(_PLAIN_REST, at):
            begin = at + len(_PLAIN_REST)
            end = _END.search(html, begin)
            if not end:
                return
            yield html[begin : end.start()]
            at = end.end()
            continue
        begin = at
        while (stop := _STOP.search(html, at)) and stop[0] != ">":
            at = html.find(stop[0], stop.end()) + 1
            if not at:
                return
        if not stop:
            return
        end = _END.search(html, stop.end())
        if not end:
            return
        if _STRUCTURED.search(html[begin : stop.start()]):
            yield html[stop.end() : end.start()]
        at = end.end()


def nodes(html: str | None) -> list[str]:
    """The objects of a page's structured data, without reading the rest of its markup."""
    if not html or "ld+json" not in html:
        return []
    return [n for body in blocks(html) for n in object_nodes(body)]


#: A page's priced offers in the order they stand in, over all its Product nodes; and how many such nodes it has.
#: Where a name or a currency is a number that Spark writes in its own way, it stands as JSON in the field beside it.
OFFERS = T.StructType(
    [
        T.StructField("product_count", T.IntegerType()),
        T.StructField("offers", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("price", "title", "title_number", "currency", "currency_number", "availability", "condition")]))),
    ]
)
_ARROW_OFFERS = to_arrow_type(OFFERS)
_LONG = 2**63
MOST_DIGITS = MOST_LEVELS = 1000


def _is_product(node: dict) -> bool:
    kind = node.get("@type")
    return kind == "Product" or (isinstance(kind, list) and "Product" in kind)


def _text(value) -> str | None:
    """Trimmed text of a string or a number; None for all else and for blanks."""
    kind = type(value)
    if kind is str:
        return value.strip(WS_CHARS) or None
    return str(value) if kind is int or kind is float else None


def _named(field: str, value) -> dict:
    text = _text(value)
    if text is None:
        return {}
    own_way = type(value) is float or (type(value) is int and not -_LONG <= value < _LONG)
    return {field + "_number" if own_way else field: text}


def _offer_fields(offer: dict, title: dict) -> dict | None:
    """What is asked of an offer; None when it states no price."""
    inner = offer.get("priceSpecification")
    if type(inner) is not dict:
        inner = {}
    price = offer.get("price")
    if price is None:
        price = offer.get("lowPrice")
        if price is None:
            price = inner.get("price")
    price = _text(price)
    if price is None:
        return None
    currency = _named("currency", offer.get("priceCurrency")) or _named("currency", inner.get("priceCurrency"))
    return {"price": price, "availability": _text(offer.get("availability")), "condition": _text(offer.get("itemCondition")), **title, **currency}


def _is_read_by_spark(node: dict) -> bool:
    level = [_without_graph(node)]
    for _ in range(MOST_LEVELS):
        values = [v for c in level for v in (c.values() if type(c) is dict else c)]
        if any(v in (inf, -inf) or abs(v) >= 10**MOST_DIGITS for v in values if type(v) in (int, float)):
            return False
        level = [v for v in values if type(v) in (dict, list)]
    return not level


def offers_reader() -> Callable[[str | None], dict]:
    """A reader of a page's offers. Product nodes are those that Spark's JSON reader takes, as in the whole-page scan: it
    refuses numbers beyond all doubles, longer ones than `MOST_DIGITS` and values more than `MOST_LEVELS` deep."""
    beyond = []

    def number(text):
        value = _whole(text)
        if value in (inf, -inf):
            beyond.append(text)
        return value

    def integer(text):
        if len(text) > MOST_DIGITS:
            beyond.append(text)
        return int(text)

    decoder = json.JSONDecoder(parse_float=number, parse_int=integer, parse_constant=_refuse)

    def products(block):
        beyond.clear()
        try:
            found = [o for o in _objects(block, decoder) if _is_product(o)]
        except (ValueError, RecursionError):
            return []
        if found and (beyond or block.count("{") + block.count("[") > MOST_LEVELS):
            return [o for o in found if _is_read_by_spark(o)]
        return found

    def read(html):
        count, priced = 0, []
        if html and "ld+json" in html:
            for block in blocks(html):
                for node in products(block):
                    count += 1
                    offers = node.get("offers")
                    if offers:
                        title = _named("title", node.get("name"))
                        fields = [_offer_fields(o, title) for o in (offers if type(offers) is list else [offers]) if type(o) is dict]
                        priced += [f for f in fields if f]
        return {"product_count": count, "offers": priced}

    return read


@F.arrow_udf(OFFERS)
def _page_offers(html: pa.Array) -> pa.Array:
    return in_parts(offers_reader(), html, _ARROW_OFFERS)


page_offers = _page_offers.asNondeterministic()
