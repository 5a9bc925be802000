"""Thresholds, word lists and patterns the audit and the matcher are defined by."""

import re

# --- fixed values -----------------------------------------------------------

SEVERITY_WEIGHT = {"high": 15, "medium": 7, "low": 3}

DESCRIPTION_MIN_CHARS = 300
SPECS_MIN_ROWS = 5
IMAGES_MIN = 3
META_DESCRIPTION_MAX_CHARS = 160
TITLE_TAG_MAX_CHARS = 70

# Product names that imply a mains plug.
MAINS_POWERED = r"\b(chargers?|charging (dock|station|stand)|power adapter|hair ?dryer|airwrap|airstrait|supersonic|straighteners?|vacuum|purifier|heater|soundbar|monitor|television|tv|projector|printer|consoles?|desktop|imac|mac mini|mac studio|macbook|laptop|chromebook|air fryer|coffee machine|kettle|blender|toothbrush|shaver|trimmer|epilator|router|mesh wi-?fi)\b"
# Names of things that go with a powered product.
ACCESSORY_NAME = r"\b(case|cover|cable|controller|headset|stand|mount|bag|sleeve|protector|skin|strap|filter|replacement|memory|keyboard|mouse|ssd|transceiver|for (the )?(ps5|playstation|xbox|nintendo|switch|iphone|ipad|macbook|samsung|dyson))\b"
# Text that states the plug type.
PLUG_STATED = r"\b((uk|eu|european|us|3[- ]?pin|2[- ]?pin|type[- ]?[cg])[- ]?(mains )?(plug|adapt[eo]r|charger|power)|plug type|(uk|eu|us|international) (version|model|spec|stock|import))\b"
# Text that states the box contents.
BOX_CONTENTS_STATED = r"\b(in the box|box contents?|what'?s (included|in the box)|package contents?|included accessories|accessories included|comes with|supplied with|includes?:)"
# Each match of the above holds one of these.
BOX_CONTENTS_TEXTS = ["in the box", "box content", "includ", "package content", "comes with", "supplied with"]
# Names that stop mid-phrase, or are damaged.
NAME_DANGLING_END = r"([,&–—-]|\b(that|with|and|for|of|the|to|in|from|or|by))$"
NAME_MALFORMED = r"\s,|\([^)]*$"
# The report's own, slightly different, cut-off test.
REPORT_TRUNCATED_NAME = r"([,&–-]|\b(that|with|and|for|of|the|to|in|x|from|or|by))\s*$"
# Watches sold both as Bluetooth and as LTE models.
DUAL_CONNECTIVITY_WATCH = r"\b(galaxy watch ?(\d|fe)|apple watch (series|se)|pixel watch)\b"
WATCH_ACCESSORY = r"\b(bands?|straps?|case|protector|charger|stand|dock)\b"
CONNECTIVITY_IN_NAME = r"\b(LTE|4G|5G|cellular|bluetooth|BT|wi-?fi|GPS)\b"
CONNECTIVITY_SPEC_LABEL = r"cellular|lte|4g|5g|\bsim\b|network|variant|version|model"
CONNECTIVITY_SPEC_VALUE = r"(LTE|4G|5G|cellular|bluetooth|\bBT\b|wi-?fi|^(yes|no)$)"
CONNECTIVITY_HINT = r"\b(BT|LTE|4G|cellular)\b"
# Grade words a slug may carry, most specific first.
CONDITION_WORDS = ["pristine", "excellent", "very-good", "good", "fair", "grade-a", "grade-b", "grade-c"]
SLUG_ABOUT_CONDITION = r"(^|-)(refurbished|condition|grade)(-|$)"
# Condition tabs, best first.
GRADE_RANK = {"new": 0, "open-box": 1, "grade-a": 2, "grade-b": 3, "grade-c": 4}
# Spec labels that carry no product information.
GENERIC_SPEC = r"^(brand|ean|gtin|upc|mpn|sku|model|product code)$"
THIN_DESCRIPTION_CHARS = 100

SEVERITIES = ["high", "medium", "low"]
SEGMENT_IDS = ["thin-feed", "no-copy", "standard"]
MATCHES = ["exact", "uncertain", "near"]  # best first
CONDITIONS = ["new", "refurbished", "used", "unknown"]
AVAILABILITIES = ["in_stock", "out_of_stock", "preorder", "unknown"]
STATUSES = ["ok", "no_price", "blocked", "disallowed", "not_found", "error"]
PAGE_SIZE = 25
TEMPLATE_WIDE_SHARE = 0.9

# Variant words of a listing title.
COLOUR = r"\b(black|white|blue|red|green|pink|purple|grey|gray|silver|gold|yellow|orange|navy|midnight|graphite|titanium|starlight|lavender|lilac|mint|olive|sand|sandstone|squad|camo|teal|indigo|cream|beige|bronze|rose|coral|violet|jet ?black|space ?gr[ae]y|whitestone|aqua|powder ?grey)\b"
CAPACITY = r"\b(\d+(?:\.\d+)?)\s?(gb|tb)\b"
BUNDLE = r"\b(bundle|bundled|combo pack|\+ ?(game|controller|headset|case|charger|gift card|voucher)|with (game|controller|headset|case|charger|gift card|voucher)|\d+[- ]pack|pack of \d+|twin pack|x ?\d+ units)\b"

# Marketplace listings that are not the product.
FAULTY_TITLE = r"\b(faulty|spares?|parts only|for parts|not working|broken|cracked|damaged|defective|untested|read description|no power)\b"
ACCESSORY_TITLE = r"\b(case|cover|cable|charger|adapter|adaptor|protector|skin|strap|stand|mount|dock|box only|empty box|manual only|remote only|controller only|replacement|compatible with|for use with)\b"
MIN_PRICE_RATIO = 0.3
ADMISSIBLE_CONDITIONS = {
    "new": ["NEW"],
    "refurbished": ["CERTIFIED_REFURBISHED", "EXCELLENT_REFURBISHED", "VERY_GOOD_REFURBISHED", "GOOD_REFURBISHED", "SELLER_REFURBISHED"],
    "used": ["USED"],
}

# A bot challenge answered with HTTP 200.
CHALLENGE = r"access denied|pardon our interruption|just a moment|are you a human|verify you are human|captcha|request unsuccessful|incapsula|unusual traffic|bot detection"

# Page hooks (data-testid values) the page reader looks for.
HOOK_PREFIX_TAB = "condition-tab-"
HOOKS = [
    "breadcrumb-trail", "pdp-category-trail", "pdp-specs", "pdp-price-block", "image-gallery", "image-gallery-thumb",
    "condition-price", "back-in-stock-form", "sticky-atc-condition-chip", "condition-trust-badge-top",
    "condition-details-notes", "pdp-description",
]

# Amounts on a page, and what stands between the names of a category trail.
PAGE_AMOUNT = r"£[\s\xa0]?[\d,]+(?:\.\d{1,2})?"
TRAIL_SEPARATOR = r"^[>/›·]\z"
# Sitemap elements.
SITEMAP_LOCATION = r"<loc>\s*([^<\s]+)\s*</loc>"
SITEMAP_CHANGED = r"<lastmod>\s*([^<\s]+)\s*</lastmod>"

# --- end of fixed values ----------------------------------------------------

# Whitespace as browsers define it, spelled out so that no-break spaces count.
WS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# The same characters one by one, for trimming.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_WORD = "[A-Za-z0-9_]"
_STARTS = f"(?<!{_WORD})"
_ENDS = f"(?!{_WORD})"
_EDGE = f"(?:(?<={_WORD}){_ENDS}|{_STARTS}(?={_WORD}))"


def jvm(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for Java's engine: ASCII word edges, browser whitespace, `$` only at the very end.

    A one-sided look-around is enough where every alternative beside the edge is a word character;
    patterns with a literal plus sign get the two-sided form.
    """
    mixed = r"\+" in pattern

    def edge(m: re.Match) -> str:
        if mixed:
            return _EDGE
        return _STARTS if re.match(r"[\w(]", pattern[m.end() : m.end() + 1]) else _ENDS

    text = re.sub(r"\\b", edge, pattern)
    text = text.replace(r"\s", WS).replace("$", r"\z")
    return ("(?i)" if ignore_case else "") + text
