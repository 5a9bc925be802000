"""DuckDB SQL that states, over the flat source columns, what each registered query must return."""

from __future__ import annotations

from ..functions import patterns as P
from ..operators.audit import SEGMENTS
from ..operators.rules import RULES
from . import bridge
from .bridge import NOW, SPEC_ROWS, TABS, duck, with_clause


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(c: str, pattern: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({c}, {q(flags + pattern)})"


def gbp(cents: str) -> str:
    return f"'£' || printf('%.2f', ({cents}) / 100.0)"


def label_condition(c: str) -> str:
    v = f"lower(coalesce({c}, ''))"
    return (
        f"(CASE WHEN {v} LIKE '%refurb%' OR {v} LIKE '%open box%' THEN 'refurbished' WHEN {v} LIKE '%used%' OR {v} LIKE '%pre-owned%' THEN 'used'"
        f" WHEN {v} LIKE '%new%' THEN 'new' ELSE 'unknown' END)"
    )


_specs = "[" + ", ".join(f"struct_pack(label := {lab}, value := {val})" for lab, val in SPEC_ROWS) + "]"
_tab_cents = {i: f"({c})" for i, _, c, _, _ in TABS}
_tab_label = {i: lab for i, lab, _, _, _ in TABS}
_tab_oos = {i: f"({o})" for i, _, _, o, _ in TABS}
_tab_selected = {i: f"({s})" for i, _, _, _, s in TABS}

FACTS = f"""
SELECT g.*, CASE WHEN has_offer THEN ld_cents END AS offer_cents,
       ({_specs})[1:CAST(ns AS INT)] AS spec_list,
       {label_condition('condition_label')} AS lab_cond,
       (CASE WHEN {label_condition('condition_label')} <> 'unknown' THEN {label_condition('condition_label')}
             WHEN has_offer THEN offer_condition ELSE 'unknown' END) = 'refurbished' AS refurb
FROM (SELECT f.*, coalesce(CASE WHEN has_ld THEN ld_name END, h1, '') AS name,
             coalesce(description, CASE WHEN has_ld THEN ld_description END, '') AS descr,
             CASE WHEN specs_absent THEN 0 ELSE n_specs END AS ns,
             (has_tabs AND NOT variants_absent) AS tabs,
             CASE WHEN has_ld THEN ld_images ELSE 0 END AS n_ld_images
      FROM facts f) g
"""
BASE = """
SELECT b.*, name || chr(10) || descr || chr(10) || array_to_string(list_transform(spec_list, lambda s: s.label || ': ' || s.value), chr(10)) AS whole,
       CASE WHEN canonical LIKE 'http://[%' THEN NULL
            WHEN canonical LIKE 'http%' THEN regexp_replace(regexp_replace(regexp_replace(canonical, '[?#].*', ''), '^https?://[^/]*', ''), '/$', '')
            WHEN canonical LIKE '/%' THEN regexp_replace(canonical, '/$', '') ELSE '/product/' || canonical END AS canonical_path
FROM labelled b
"""


def _in_tabs(cents: str, which: list[str] | None = None, extra: dict[str, str] | None = None) -> str:
    tests = []
    for i in which or _tab_cents:
        test = f"coalesce({_tab_cents[i]} = {cents}, FALSE)"
        if extra:
            test = f"({test} AND {extra[i]})"
        tests.append(test)
    return "(tabs AND (" + " OR ".join(tests) + "))"


def _inversion() -> tuple[str, str]:
    graded = ["new", "grade-a", "grade-b", "grade-c"]
    ok = lambda i: f"NOT {_tab_oos[i]} AND {_tab_cents[i]} IS NOT NULL"
    arms, any_ = [], []
    for x, better in enumerate(graded):
        for worse in graded[x + 1 :]:
            cond = f"(tabs AND {ok(better)} AND {ok(worse)} AND {_tab_cents[worse]} > {_tab_cents[better]})"
            any_.append(cond)
            arms.append(
                f"WHEN {cond} THEN {q(_tab_label[worse])} || ' costs ' || {gbp(_tab_cents[worse])} || ', above ' || {q(_tab_label[better])} || ' at ' || {gbp(_tab_cents[better])}"
            )
    return "(" + " OR ".join(f"coalesce({c}, FALSE)" for c in any_) + ")", "CASE " + " ".join(arms) + " END"


def _slug_word() -> str:
    arms = " ".join(f"WHEN '-' || slug || '-' LIKE '%-{w}-%' THEN '{w}'" for w in P.CONDITION_WORDS)
    return f"(CASE WHEN {rx('slug', P.SLUG_ABOUT_CONDITION, '')} THEN CASE {arms} END END)"


def _rules() -> dict[str, tuple[str, str, str]]:
    """rule id -> condition, message, evidence."""
    differ = "offer_cents IS NOT NULL AND visible_cents IS NOT NULL AND offer_cents <> visible_cents"
    first_tab = "CASE " + " ".join(f"WHEN {_tab_cents[i]} = offer_cents THEN {q(_tab_label[i])}" for i in _tab_cents) + " END"
    inverted, inversion_text = _inversion()
    word = _slug_word()
    dashed = "('-' || regexp_replace(lower(condition_label), '[^a-z0-9]+', '-', 'g') || '-')"
    first = "regexp_split_to_array(name, '\\s+')[1]"
    dangling = f"regexp_extract(name, {q('(?i)' + P.NAME_DANGLING_END)}, 0)"
    spec_ok = f"len(list_filter(spec_list, lambda s: {rx('s.label', P.CONNECTIVITY_SPEC_LABEL)} AND {rx('s.value', P.CONNECTIVITY_SPEC_VALUE)})) > 0"
    hints = f"list_filter(spec_list, lambda s: {rx('s.value', P.CONNECTIVITY_HINT, '')})"
    counter = "regexp_extract(slug, '-([0-9]{1,3})$', 1)"
    digits_of_name = "regexp_replace(name, '([0-9])[.,]([0-9])', '\\1\\2', 'g')"
    boxed = rx("whole", P.BOX_CONTENTS_STATED)
    images = "CASE WHEN gallery_image_count IS NOT NULL THEN greatest(gallery_image_count, n_ld_images) END"
    expired = f"(valid_until LIKE '2020%' OR valid_until LIKE '2026%') AND try_cast(replace(valid_until, 'Z', '') AS TIMESTAMP) < TIMESTAMP '{NOW}'"
    grouped_gtin = "regexp_replace(gtin, '[\\s-]', '', 'g')"
    body = f"CAST(left({grouped_gtin}, 12) AS BIGINT)"
    weighted = " + ".join(f"{1 if i % 2 == 0 else 3} * CAST(substr({grouped_gtin}, {i + 1}, 1) AS INT)" for i in range(12))
    gtin_bad = f"(CASE WHEN length({grouped_gtin}) = 13 THEN (10 - ({weighted}) % 10) % 10 <> CAST(right({grouped_gtin}, 1) AS INT) ELSE TRUE END)"
    none = "CAST(NULL AS VARCHAR)"
    return {
        "price-mismatch": (f"{differ} AND NOT {_in_tabs('offer_cents')}", f"'markup price ' || {gbp('offer_cents')} || ', page price ' || {gbp('visible_cents')}", none),
        "jsonld-price-is-other-variant": (
            f"{differ} AND {_in_tabs('offer_cents')}",
            f"'markup price ' || {gbp('offer_cents')} || ' belongs to ' || ({first_tab}) || '; page shows ' || coalesce(condition_label, 'another variant') || ' at ' || {gbp('visible_cents')}",
            none,
        ),
        "grade-price-inversion": (inverted, inversion_text, none),
        "condition-mismatch": (
            "has_offer AND offer_condition <> 'unknown' AND lab_cond <> 'unknown' AND offer_condition <> lab_cond AND lower(condition_label) NOT LIKE '%open box%'"
            f" AND NOT {_in_tabs('offer_cents', extra={i: 'NOT ' + s for i, s in _tab_selected.items()})}",
            "'markup condition ' || offer_condition || ', page label ' || condition_label",
            none,
        ),
        "slug-condition-mismatch": (
            f"{word} IS NOT NULL AND coalesce(condition_label, '') <> '' AND NOT contains(CASE WHEN {word} = 'good' THEN replace({dashed}, 'very-good', '') ELSE {dashed} END, '-' || {word} || '-')",
            f"'slug says ' || replace({word}, '-', ' ') || ', page label ' || condition_label",
            "slug",
        ),
        "refurb-condition-unexplained": ("refurb AND condition_notes IS NULL", "'refurbished, no condition notes shown'", none),
        "price-valid-until-expired": (f"has_offer AND {expired}", "'offer expired on ' || valid_until", none),
        "description-missing": ("descr = ''", "'no description on the page or in the markup'", none),
        "description-short": ("length(descr) > 0 AND length(descr) < 300", "'description has ' || length(descr) || ' characters'", none),
        "specs-missing": ("ns = 0", "'specification table is empty'", none),
        "specs-thin": ("ns BETWEEN 1 AND 4", "ns || ' specification rows'", "array_to_string(list_transform(spec_list, lambda s: s.label), ', ')"),
        "images-few": (f"({images}) < 3", f"({images}) || ' images'", none),
        "plug-type-unstated": (
            f"{rx('name', P.MAINS_POWERED)} AND NOT {rx('name', P.ACCESSORY_NAME)} AND NOT {rx('whole', P.PLUG_STATED)}",
            "'mains powered by its name, plug not mentioned'",
            "name",
        ),
        "refurb-accessories-unstated": (f"refurb AND NOT {boxed}", "'refurbished, contents of the box not stated'", none),
        "box-contents-unstated": (f"NOT refurb AND NOT {boxed}", "'contents of the box not stated'", none),
        "name-leads-with-code": (
            f"regexp_matches({first}, '^[A-Z0-9][A-Z0-9-]{{5,}}$') AND regexp_matches({first}, '[0-9]') AND regexp_matches({first}, '[A-Z]')",
            f"'name starts with ' || {first}",
            "name",
        ),
        "watch-connectivity-unstated": (
            f"{rx('name', P.DUAL_CONNECTIVITY_WATCH)} AND NOT {rx('name', P.WATCH_ACCESSORY)} AND NOT {rx('name', P.CONNECTIVITY_IN_NAME)} AND NOT ({spec_ok})",
            f"CASE WHEN len({hints}) > 0 THEN 'variant only hinted at under ' || ({hints})[1].label ELSE 'variant not stated in name or specifications' END",
            f"CASE WHEN len({hints}) > 0 THEN ({hints})[1].label || ': ' || ({hints})[1].value ELSE name END",
        ),
        "name-truncated": (
            f"{dangling} <> '' OR {rx('name', P.NAME_MALFORMED, '')}",
            f"CASE WHEN {dangling} <> '' THEN 'name ends in ' || {dangling} ELSE 'name has a blank before a comma or an open bracket' END",
            "name",
        ),
        "jsonld-missing": ("NOT has_ld", "'no product markup'", none),
        "jsonld-offer-missing": ("has_ld AND NOT has_offer", "CASE WHEN out_of_stock_notice THEN 'out of stock and no offer in the markup' ELSE 'no offer in the markup' END", none),
        "jsonld-image-missing": ("has_ld AND n_ld_images = 0", "'no image in the markup'", none),
        "brand-missing": ("has_ld AND brand IS NULL", "'no brand in the markup'", none),
        "gtin-missing": ("has_ld AND gtin IS NULL", "'no GTIN in the markup'", none),
        "gtin-invalid": (f"has_ld AND gtin IS NOT NULL AND {gtin_bad}", "'invalid GTIN ' || gtin", none),
        "jsonld-no-return-policy": ("has_offer AND NOT has_return_policy", "'offer has no return policy'", none),
        "jsonld-no-shipping-details": ("has_offer AND NOT has_shipping_details", "'offer has no shipping details'", none),
        "noindex-in-sitemap": ("robots_meta ILIKE '%noindex%'", "'robots directive ' || robots_meta", none),
        "canonical-mismatch": (
            "canonical IS NULL OR canonical_path IS NULL OR canonical_path <> '/product/' || slug",
            "CASE WHEN canonical IS NULL THEN 'no canonical URL' WHEN canonical_path IS NULL THEN 'canonical URL is malformed' ELSE 'canonical URL has another path' END",
            "canonical",
        ),
        "h1-count": ("h1_count <> 1", "h1_count || ' main headings'", none),
        "meta-description-missing": ("meta_description IS NULL", "'no meta description'", none),
        "meta-description-long": ("length(meta_description) > 160", "'meta description has ' || length(meta_description) || ' characters'", none),
        "title-tag-long": ("length(title_tag) > 70", "'title tag has ' || length(title_tag) || ' characters'", "title_tag"),
        "slug-dedupe-suffix": (
            f"{counter} <> '' AND NOT list_contains(regexp_split_to_array({digits_of_name}, '[^0-9]+'), {counter})",
            f"'slug ends in ' || {counter} || ', which the name does not contain'",
            "slug",
        ),
        "image-alt-missing": ("images_missing_alt > 0", "images_missing_alt || ' images without alternative text'", none),
    }


RULE_SQL = _rules()


def rule_select(rule_id: str) -> str:
    cond, message, evidence = RULE_SQL[rule_id]
    position, rule = next((i, r) for i, r in enumerate(RULES) if r.id == rule_id)
    return (
        f"SELECT k AS product_id, {position} AS position, '{rule_id}' AS rule_id, '{rule.severity}' AS severity, CAST({message} AS VARCHAR) AS message,"
        f" CAST({evidence} AS VARCHAR) AS evidence FROM base WHERE {cond}"
    )


LABELLED = {"labelled": FACTS, "base": BASE}
FINDINGS = {**LABELLED, "findings": " UNION ALL ".join(f"({rule_select(r.id)})" for r in RULES)}
_generic = f"len(list_filter(spec_list, lambda s: NOT {rx('s.label', P.GENERIC_SPEC)})) = 0"
_signals = {
    "generic_specs_only": f"(ns <= 2 AND {_generic})",
    "short_description": "(length(descr) < 100)",
    "single_image": "(greatest(coalesce(gallery_image_count, 0), n_ld_images) <= 1)",
    "no_specs": "(ns = 0)",
    "no_description": "(descr = '')",
}
AUDITED = {
    **FINDINGS,
    "scores": "SELECT product_id, greatest(0, 100 - sum(CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 7 ELSE 3 END)) AS score FROM findings GROUP BY product_id",
    "audited": f"""
SELECT k AS id, full_name AS name, slug, brand, sku, gtin, category_path, CAST(coalesce(score, 100) AS INT) AS score,
       CASE WHEN {_signals['generic_specs_only']} AND {_signals['short_description']} AND {_signals['single_image']} THEN 'thin-feed'
            WHEN ns = 0 AND descr = '' THEN 'no-copy' ELSE 'standard' END AS segment,
       gallery_image_count, n_ld_images, specs_absent, n_specs, description, has_ld
FROM base LEFT JOIN scores ON product_id = k""",
}
_dim = "(VALUES " + ", ".join(f"({i}, '{r.id}', {q(r.title)}, '{r.severity}', '{r.category}', {q(r.fix)})" for i, r in enumerate(RULES)) + ") AS dim(pos, rule_id, title, severity, category, fix)"
_sev = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


def ask(names: list[str], select: str, views: dict[str, str] | None = None) -> str:
    return duck(with_clause(names, views) + "\n" + select)


def _mean(c: str = "score") -> str:
    return f"CAST(round(avg({c})) AS INT)"


def _top(level: int) -> str:
    return f"coalesce(nullif(split_part(category_path, ' > ', {level}), ''), 'Uncategorised')"


def audit_queries() -> dict[str, str]:
    out = {}
    for r in RULES:
        out["rule_" + r.id.replace("-", "_")] = ask(["facts"], f"SELECT product_id, severity, message, evidence FROM ({rule_select(r.id)})", LABELLED)
    a = lambda s: ask(["facts"], s, AUDITED)
    out["audit_findings"] = ask(["facts"], "SELECT * FROM findings", FINDINGS)
    out["audit_scores"] = a("SELECT id, score FROM audited")
    out["segment_signals"] = ask(["facts"], "SELECT k AS id, " + ", ".join(f"{s} AS {n}" for n, s in _signals.items()) + " FROM base", LABELLED)
    out["segments"] = a("SELECT id, segment FROM audited")
    out["audit_tallies"] = a(
        "SELECT 'rule' AS kind, rule_id AS name, count(*) AS n, CAST(NULL AS INT) AS mean_score FROM findings GROUP BY rule_id"
        " UNION ALL SELECT 'segment', segment, count(*), NULL FROM audited GROUP BY segment"
        f" UNION ALL SELECT 'listings', 'all', count(*), {_mean()} FROM audited"
    )
    grouped = "regexp_replace(gtin, '[\\s-]', '', 'g')"
    weighted = " + ".join(f"{1 if i % 2 == 0 else 3} * CAST(substr(g, {i + 1}, 1) AS INT)" for i in range(12))
    out["gtin_check"] = ask(
        ["facts"],
        f"SELECT k AS id, gtin, CASE WHEN length(g) = 13 THEN (10 - ({weighted}) % 10) % 10 = CAST(right(g, 1) AS INT) ELSE FALSE END AS valid"
        f" FROM (SELECT k, gtin, {grouped} AS g FROM facts WHERE gtin IS NOT NULL)",
    )
    # Reports
    out["overview_totals"] = a(f"SELECT count(*) AS listings, {_mean()} AS mean_score FROM audited")
    out["overview_totals_of_segment"] = a(f"SELECT count(*) AS listings, {_mean()} AS mean_score FROM audited WHERE segment = 'thin-feed'")
    totals = "SELECT count(*) AS findings, count(*) FILTER (severity = 'high') AS high, count(DISTINCT product_id) FILTER (severity = 'high') AS listings_with_high FROM findings"
    out["finding_totals"] = a(totals)
    out["finding_totals_of_segment"] = a(totals + " WHERE product_id IN (SELECT id FROM audited WHERE segment = 'thin-feed')")
    out["affected_per_rule"] = a("SELECT rule_id, count(DISTINCT product_id) AS affected FROM findings GROUP BY rule_id")
    bucket = "CAST(least(floor(score / 10), 9) AS INT)"
    thin_ids = "product_id IN (SELECT id FROM audited WHERE segment = 'thin-feed')"
    out["affected_per_rule_of_segment"] = a(f"SELECT rule_id, count(DISTINCT product_id) AS affected FROM findings WHERE {thin_ids} GROUP BY rule_id")
    out["score_histogram"] = a(f"SELECT {bucket} AS bucket, count(*) AS n FROM audited GROUP BY 1")
    out["labelled_histogram"] = a(
        "SELECT CAST(b AS INT) AS bucket, (b * 10) || '–' || (CASE WHEN b = 9 THEN 100 ELSE b * 10 + 9 END) AS label,"
        f" (SELECT count(*) FROM audited WHERE {bucket} = b) AS n FROM range(10) t(b)"
    )
    out["worst_listings"] = a("SELECT id, name, slug, brand, score FROM audited ORDER BY score, id LIMIT 8")
    seg = "(VALUES " + ", ".join(f"('{s}', {q(lab)})" for s, lab, _ in SEGMENTS) + ") AS d(segment, label)"
    out["segment_rollup"] = a(
        f"SELECT d.segment AS segment, d.label AS label, count(id) AS n, {_mean()} AS mean_score, CAST(count(id) AS DOUBLE) / (SELECT count(*) FROM audited) AS share"
        f" FROM {seg} LEFT JOIN audited a ON a.segment = d.segment GROUP BY d.segment, d.label"
    )
    shares = (
        "SELECT *, row_number() OVER (ORDER BY {order}, affected DESC, rule_id) AS place FROM (SELECT rule_id, title, dim.severity AS severity, category, affected,"
        " CAST(affected AS DOUBLE) / (SELECT count(*) FROM audited WHERE {listings}) AS share"
        " FROM {dim} JOIN (SELECT rule_id, count(DISTINCT product_id) AS affected FROM findings WHERE {findings} GROUP BY rule_id) USING (rule_id))"
    )
    out["rule_shares"] = a(shares.format(order=_sev, listings="TRUE", dim=_dim, findings="TRUE"))
    out["rule_shares_of_segment"] = a(shares.format(order=_sev, listings="segment = 'thin-feed'", dim=_dim, findings=thin_ids))
    found = "SELECT id, name, brand, score, segment FROM audited WHERE "
    out["listing_search_text"] = a(found + "name ILIKE '%WATCH%' OR brand ILIKE '%WATCH%' OR sku ILIKE '%WATCH%'")
    sought = " UNION ALL ".join(
        f"SELECT '{text}' AS needle, f.* FROM ({found} (contains(lower(name), '{text.lower()}') OR contains(lower(brand), '{text.lower()}') OR contains(lower(sku), '{text.lower()}'))) f" for text in ("WATCH", "ku12", "5%", " x")
    )
    out["listing_search_indexed"] = a(sought)
    out["listing_search_category"] = a(found + "(category_path = 'PROMO' OR category_path LIKE 'PROMO > %') AND segment = 'standard'")
    out["listing_search_finding"] = a(found + "id IN (SELECT product_id FROM findings WHERE rule_id = 'name-truncated' AND severity = 'medium')")
    counts = ", ".join(f"(SELECT count(*) FROM findings f WHERE f.product_id = a.id AND f.severity = '{s}') AS {s}" for s in P.SEVERITIES)
    out["listing_severity_counts"] = a(f"SELECT id, score, {counts} FROM audited a")
    out["listing_page"] = a("SELECT id, name, score FROM audited ORDER BY score, id LIMIT 25 OFFSET 50")
    out["listing_page_after"] = a("SELECT id, name, score FROM audited WHERE score > 30 OR (score = 30 AND id > 100) ORDER BY score, id LIMIT 25")
    out["listing_page_count"] = a("SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS INT) AS pages FROM audited WHERE segment = 'thin-feed'")
    out["category_names"] = a("SELECT split_part(category_path, ' > ', 1) AS name, count(*) AS n FROM audited WHERE category_path IS NOT NULL GROUP BY 1 HAVING split_part(category_path, ' > ', 1) <> ''")
    fixes = f"SELECT product_id, rule_id, f.severity AS severity, message, evidence, title, fix, row_number() OVER (PARTITION BY product_id ORDER BY {_sev.replace('severity', 'f.severity')}, pos) AS place FROM findings f LEFT JOIN {_dim} USING (rule_id)"
    out["findings_with_fix"] = a(fixes)
    out["listing_detail_product"] = a("SELECT id, name, slug, score, segment FROM audited WHERE id = 7")
    out["listing_detail_findings"] = a(f"SELECT rule_id, severity, title, fix, place FROM ({fixes}) WHERE product_id = 7")

    def card(level: int, scope: str) -> str:
        return (
            f"SELECT {_top(level)} AS name, count(*) AS n, {_mean()} AS mean_score, count(*) FILTER (segment = 'thin-feed') AS thin_feed,"
            " count(*) FILTER (segment = 'no-copy') AS no_copy,"
            " count(*) FILTER (id IN (SELECT product_id FROM findings WHERE severity = 'high')) AS with_high,"
            " CAST(count(*) FILTER (segment IN ('thin-feed', 'no-copy')) AS DOUBLE) / count(*) AS thin_share"
            f" FROM audited WHERE {scope} GROUP BY 1"
        )

    inside = "(category_path = 'PROMO' OR category_path LIKE 'PROMO > %')"
    out["category_scorecard"] = a(card(1, "TRUE"))
    out["category_scorecard_children"] = a(card(2, inside))
    by_category = f"SELECT {_top(1)} AS name, rule_id, count(DISTINCT id) AS affected FROM findings JOIN audited ON id = product_id GROUP BY 1, 2"
    out["rules_by_category"] = a(by_category)
    wide = "SELECT rule_id, count(DISTINCT product_id) AS affected, CAST(count(DISTINCT product_id) AS DOUBLE) / (SELECT count(*) FROM audited) AS share FROM findings GROUP BY rule_id HAVING share >= {}"
    out["template_wide_rules"] = a(wide.format(0.6))
    out["top_issues"] = a(
        f"SELECT name, place, rule_id, title, affected, CAST(affected AS DOUBLE) / n AS share FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY affected DESC, rule_id) AS place"
        f" FROM ({by_category}) JOIN {_dim} USING (rule_id) WHERE rule_id NOT IN (SELECT rule_id FROM ({wide.format(0.9)})))"
        f" JOIN (SELECT {_top(1)} AS name, count(*) AS n FROM audited GROUP BY 1) USING (name) WHERE place <= 3"
    )
    out["segment_quality"] = a(f"SELECT segment, count(*) AS n, {_mean()} AS mean_score, count(gtin) AS with_gtin FROM audited GROUP BY segment")
    brandless = "brand IS NOT NULL AND position(lower(split_part(brand, ' ', 1)) IN lower(name)) = 0"
    counter = "regexp_matches(slug, '-[0-9]+$')"
    cut = rx("name", P.REPORT_TRUNCATED_NAME)
    share = lambda c: f"CAST(count(*) FILTER ({c}) AS DOUBLE) / count(*)"
    out["thin_signals"] = a(
        "SELECT count(*) AS thin, count(*) FILTER (greatest(coalesce(gallery_image_count, 0), n_ld_images) <= 1) AS one_image,"
        " count(*) FILTER (NOT specs_absent AND n_specs <= 2) AS placeholder_specs, count(*) FILTER (length(coalesce(description, '')) < 100) AS short_description,"
        f" count(*) FILTER ({cut}) AS truncated_name, count(*) FILTER ({brandless}) AS brand_not_in_name, count(*) FILTER ({counter}) AS dedupe_slug, count(*) FILTER (gtin IS NULL) AS no_gtin,"
        f" {share(brandless)} AS brand_not_in_name_share, {share(counter)} AS dedupe_slug_share, {share(cut)} AS truncated_name_share, {share('gtin IS NULL')} AS no_gtin_share"
        " FROM audited WHERE segment = 'thin-feed'"
    )
    thin = "count(*) FILTER (segment = 'thin-feed')"
    out["thin_by_category"] = a(f"SELECT {_top(1)} AS name, {thin} AS thin_feed, count(*) AS n, CAST({thin} AS DOUBLE) / count(*) AS share FROM audited GROUP BY 1 HAVING {thin} > 0")
    out["thin_by_brand"] = a(
        f"SELECT coalesce(brand, 'Unknown') AS brand, {thin} AS thin_feed, count(*) AS n, CAST({thin} AS DOUBLE) / count(*) AS share FROM audited GROUP BY 1 HAVING {thin} > 0 ORDER BY 2 DESC, 1 LIMIT 12"
    )
    out["thin_samples"] = a("SELECT id, name, slug, brand, score FROM audited WHERE segment = 'thin-feed' ORDER BY score, id LIMIT 8")
    return out



_LATEST = """SELECT o.* FROM (SELECT *, row_number() OVER (PARTITION BY product_id, url ORDER BY captured_at DESC, id DESC) AS rn FROM observations) o WHERE rn = 1"""
_RANKED = """SELECT l.*, row_number() OVER (PARTITION BY product_id ORDER BY price ASC NULLS LAST, retailer, coalesce(url, ''), id) AS rank FROM latest l"""
_BEST = """
SELECT product_id, price, retailer, url, match FROM
 (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY rank) AS first FROM ranked WHERE status = 'ok' AND price IS NOT NULL AND {}) WHERE first = 1"""
_LENS = {
    "latest": _LATEST,
    "ranked": _RANKED,
    "cheapest": _BEST.format("(match IS NULL OR match <> 'near')"),
    "nearest": _BEST.format("TRUE"),
    "lens": """
SELECT p.id AS product_id, p.name, p.slug, p.price AS own_price, p.was_price AS own_was_price, p.condition_label AS own_condition_label,
       x.observations, x.failed, x.last_fetched, c.retailer AS cheapest_retailer, CAST(c.price AS DOUBLE) AS cheapest_price,
       CAST(p.price - c.price AS DOUBLE) AS gap, CAST(p.price - c.price AS DOUBLE) / CAST(c.price AS DOUBLE) * 100 AS gap_pct
FROM (SELECT product_id, count(*) AS observations, count(*) FILTER (status <> 'ok') AS failed, max(captured_at) AS last_fetched FROM latest GROUP BY product_id) x
JOIN products p ON p.id = x.product_id LEFT JOIN cheapest c ON c.product_id = p.id""",
}


def _at(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


_CHANGES = """
SELECT product_id, id, price, availability, captured_at FROM (SELECT *, lag(price) OVER w AS p, lag(availability) OVER w AS a, row_number() OVER w AS rn
 FROM price_feed WHERE price IS NOT NULL WINDOW w AS (PARTITION BY product_id ORDER BY captured_at, id))
WHERE rn = 1 OR p <> price OR a IS DISTINCT FROM availability"""


def lens_queries() -> dict[str, str]:
    a = lambda s: ask(["observations", "products"], s, _LENS)
    out = {}
    out["latest_observations"] = a(f"SELECT product_id, url, id, retailer, CAST(price AS DOUBLE) AS price, match, status, {_at('captured_at')} AS captured_at FROM latest")
    out["observation_ranks"] = a(
        "SELECT product_id, r.id AS id, rank, CASE WHEN status = 'ok' THEN CAST(p.price - r.price AS DOUBLE) END AS difference FROM ranked r JOIN products p ON p.id = product_id"
    )
    out["retailers_checked"] = a(
        "SELECT product_id, string_agg(retailer, '|' ORDER BY price ASC NULLS LAST, retailer) AS retailers FROM (SELECT product_id, retailer, min(price) AS price FROM latest GROUP BY 1, 2) GROUP BY product_id"
    )
    out["cheapest_comparable"] = a("SELECT product_id, CAST(price AS DOUBLE) AS price, retailer, url, match FROM cheapest")
    out["nearest_offers"] = a("SELECT product_id, CAST(price AS DOUBLE) AS price, retailer, url, match FROM nearest WHERE product_id NOT IN (SELECT product_id FROM cheapest)")
    out["price_gaps"] = a("SELECT product_id, CAST(own_price AS DOUBLE) AS own_price, gap, gap_pct FROM lens")
    out["price_lens"] = a(
        "SELECT product_id, name, slug, CAST(own_price AS DOUBLE) AS own_price, CAST(own_was_price AS DOUBLE) AS own_was_price, own_condition_label, observations, failed, cheapest_retailer, cheapest_price, gap, gap_pct FROM lens"
    )
    out["lens_summary"] = a(
        "SELECT count(gap_pct) AS compared, count(*) FILTER (gap_pct <= 0) AS own_cheapest, count(*) FILTER (gap_pct > 0) AS own_dearer,"
        " (SELECT gap_pct FROM lens WHERE gap_pct IS NOT NULL ORDER BY gap_pct OFFSET (SELECT count(gap_pct) // 2 FROM lens) LIMIT 1) AS median_gap_pct,"
        f" CAST(sum(failed) AS BIGINT) AS failed_checks, {_at('max(last_fetched)')} AS last_fetched,"
        " CAST(round(100.0 * count(*) FILTER (gap_pct <= 0) / count(gap_pct)) AS INT) AS own_cheapest_share FROM lens"
    )
    out["refusing_retailers"] = a("SELECT DISTINCT retailer FROM latest WHERE status IN ('blocked', 'disallowed')")
    changes = f"SELECT product_id, id, CAST(price AS DOUBLE) AS price, availability, {_at('captured_at')} AS captured_at FROM changes"
    out["price_changes"] = ask(["price_feed"], changes, {"changes": _CHANGES})
    out["price_changes_streamed"] = out["price_changes"]
    last = "SELECT product_id, id, recency FROM (SELECT product_id, id, CAST(row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, id DESC) AS INT) AS recency FROM {}) WHERE recency <= {}"
    out["last_observations_per_product"] = ask(["observations"], last.format("observations", 5))
    out["last_changes_per_product"] = ask(["price_feed"], last.format("changes", 3), {"changes": _CHANGES})
    out["listing_detail_history"] = ask(["price_feed"], f"SELECT id, CAST(price AS DOUBLE) AS price, availability, {_at('captured_at')} AS captured_at FROM changes WHERE product_id = 7 ORDER BY changes.captured_at DESC, id DESC LIMIT 20", {"changes": _CHANGES})
    out["listing_detail_observations"] = ask(["observations"], "SELECT id, retailer, status FROM observations WHERE product_id = 7 ORDER BY captured_at DESC, id DESC LIMIT 30")
    return out


def _found(c: str, pattern: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({c}, {q('(?i)' + pattern)}), lambda w: regexp_replace(lower(w), '\\s+', ' ', 'g')))"


def _verdict(own: str, theirs: str) -> tuple[str, str]:
    oc, tc, os_, ts = _found(own, P.COLOUR), _found(theirs, P.COLOUR), _found(own, P.CAPACITY), _found(theirs, P.CAPACITY)
    apart = lambda x, y: f"(len({x}) > 0 AND len({y}) > 0 AND NOT list_has_any({x}, {y}))"
    bundle = f"({rx(theirs, P.BUNDLE)} AND NOT {rx(own, P.BUNDLE)})"
    unsure = f"(len({oc}) > 0 AND len({tc}) = 0)"
    says = lambda what, x, y: f"'other {what}, ' || array_to_string({y}, '+') || ' instead of ' || array_to_string({x}, '+')"
    return (
        f"CASE WHEN {apart(oc, tc)} OR {apart(os_, ts)} OR {bundle} THEN 'near' WHEN {unsure} THEN 'uncertain' ELSE 'exact' END",
        f"CASE WHEN {apart(oc, tc)} THEN {says('colour', oc, tc)} WHEN {apart(os_, ts)} THEN {says('capacity', os_, ts)} WHEN {bundle} THEN 'sold as a set' WHEN {unsure} THEN 'offer leaves the colour open' END",
    )


_match, _note = _verdict("own_name", "title")
_first_accessory = f"list_filter(list_transform(regexp_extract_all(title, {q('(?i)' + P.ACCESSORY_TITLE)}), lambda w: lower(w)), lambda w: NOT contains(lower(own_name), w))[1]"
_JUDGED = {
    "priced": """
SELECT p.id AS product_id, p.name AS own_name, p.price AS own_price, i.*, try_cast(price_value AS DOUBLE) AS item_price,
       coalesce(least(CASE WHEN postage1 IS NOT NULL THEN coalesce(try_cast(postage1 AS DOUBLE), 0) END, try_cast(postage2 AS DOUBLE)), 0) AS shipping,
       coalesce(account_type = 'BUSINESS', FALSE) AS business
FROM items i JOIN products p ON p.gtin = i.gtin
WHERE condition_id = CASE p.condition WHEN 'refurbished' THEN 'GOOD_REFURBISHED' WHEN 'used' THEN 'USED' ELSE 'NEW' END""",
    "reasoned": f"""
SELECT *, item_price + shipping AS landed,
       CASE WHEN item_price IS NULL THEN 'unpriced' WHEN {rx('title', P.FAULTY_TITLE)} THEN 'defect in the title'
            WHEN {_first_accessory} IS NOT NULL THEN 'add-on: ' || {_first_accessory} WHEN country <> 'GB' THEN 'sent from abroad'
            WHEN item_price + shipping < CAST(own_price AS DOUBLE) * 0.3 THEN 'implausible price' END AS reason
FROM priced""",
    "judged": f"SELECT *, CASE WHEN reason IS NULL THEN {_match} END AS match, CASE WHEN reason IS NULL THEN {_note} END AS match_note FROM reasoned",
    "sorted": """
SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE match WHEN 'exact' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END, business DESC, landed, item_id) AS place
FROM judged WHERE reason IS NULL""",
    "top": "SELECT * FROM sorted WHERE place = 1",
    "individuals": """SELECT product_id, landed FROM (SELECT s.product_id, s.landed, row_number() OVER (PARTITION BY s.product_id ORDER BY s.place) AS n
 FROM sorted s JOIN top t USING (product_id) WHERE t.business AND NOT s.business AND s.match = t.match AND s.landed < t.landed) WHERE n = 1""",
    "lessers": """SELECT product_id, landed, match, match_note FROM (SELECT s.product_id, s.landed, s.match, s.match_note, row_number() OVER (PARTITION BY s.product_id ORDER BY s.place) AS n
 FROM sorted s JOIN top t USING (product_id) WHERE t.match = 'exact' AND s.match <> 'exact' AND s.landed < t.landed) WHERE n = 1""",
    "reasons": """SELECT product_id, reason, n, item_price AS p1, item_id AS i1 FROM (SELECT *, count(*) OVER (PARTITION BY product_id, reason) AS n,
 row_number() OVER (PARTITION BY product_id, reason ORDER BY item_price, item_id) AS f FROM judged WHERE reason IS NOT NULL AND reason <> 'unpriced') WHERE f = 1""",
    "counted": "SELECT product_id, count(*) AS items, count(*) FILTER (reason IS NULL) AS comparable FROM judged GROUP BY product_id",
    "skips": "SELECT product_id, string_agg(CASE WHEN n > 1 THEN reason || ' ×' || n ELSE reason END, ', ' ORDER BY p1, i1) AS skipped FROM reasons GROUP BY product_id",
}


def pricing_queries() -> dict[str, str]:
    out = {}
    out["variant_match"] = ask(
        ["items", "products"], f"SELECT item_id, {_match} AS match, {_note} AS note FROM (SELECT item_id, title, p.name AS own_name FROM items i JOIN products p ON p.gtin = i.gtin)"
    )
    out["mapped_page_check"] = ask(
        ["mappings", "fetched"],
        """SELECT m.product_id AS product_id, m.url AS url,
  CASE s % 9 WHEN 6 THEN 'T' || m.product_id WHEN 7 THEN 'Deep ' || s END AS title,
  CAST(CASE s % 9 WHEN 6 THEN 900 + m.product_id % 89 WHEN 7 THEN 1500 + s END AS DOUBLE) AS price,
  CASE s % 9 WHEN 6 THEN 'EUR' WHEN 7 THEN 'GBP' END AS currency, CASE s % 9 WHEN 6 THEN 'unknown' WHEN 7 THEN 'refurbished' END AS condition,
  CASE s % 9 WHEN 6 THEN 'out_of_stock' WHEN 7 THEN 'unknown' END AS availability, CASE WHEN s % 9 IN (6, 7) THEN 'retailer' END AS seller_type,
  CASE WHEN s % 9 IN (6, 7) THEN 'ok' WHEN html = '' THEN 'error' WHEN s % 9 IN (4, 5, 8) THEN 'no_price' ELSE f.status END AS status,
  CASE WHEN s % 9 IN (6, 7) OR html = '' THEN NULL WHEN s % 9 IN (4, 5, 8) THEN 'markup holds no offer' ELSE f.note END AS note
FROM mappings m JOIN fetched f ON f.url = m.url""",
    )
    j = lambda s: ask(["items", "products"], s, _JUDGED)
    out["marketplace_candidates"] = j("SELECT product_id, item_id, shipping, landed, reason, match, business FROM judged")
    joined = " FROM top t JOIN counted c USING (product_id) LEFT JOIN individuals i USING (product_id) LEFT JOIN lessers l USING (product_id)"
    out["marketplace_best_offers"] = j(
        "SELECT product_id, items, comparable, item_id, t.landed AS landed, t.match AS match, business, i.landed AS individual, l.landed AS lesser, l.match AS lesser_match" + joined
    )
    out["marketplace_skipped"] = j("SELECT product_id, coalesce(skipped, '') AS skipped FROM counted LEFT JOIN skips USING (product_id)")
    money = lambda c: f"CAST(CAST({c} AS DECIMAL(10,2)) AS DOUBLE)"
    amount = lambda c: f"'£' || printf('%.2f', {c})"
    out["marketplace_check"] = j(
        f"""SELECT p.id AS product_id, CASE WHEN t.item_id IS NULL THEN 'not_found' ELSE 'ok' END AS status, t.item_id AS item_id, {money('t.landed')} AS price,
  {money('t.item_price')} AS item_price, {money('t.shipping')} AS shipping_cost, CASE WHEN t.item_id IS NOT NULL THEN 'in_stock' END AS availability, t.seller AS seller,
  CASE WHEN t.item_id IS NOT NULL THEN coalesce(lower(account_type), 'unknown') END AS seller_type, t.match AS match,
  CASE WHEN t.item_id IS NOT NULL THEN concat_ws(' | ', 'chosen from ' || comparable || '/' || items, 'left out: ' || skipped, 'rated ' || t.feedback_percentage || '% by ' || coalesce(CAST(t.feedback_score AS VARCHAR), 'unknown number'),
         'private offer for ' || {amount('i.landed')}, l.match || ' variant for ' || {amount('l.landed')} || ': ' || coalesce(l.match_note, 'no details'))
       WHEN items IS NULL THEN 'nothing offered under this GTIN' ELSE '0 of ' || items || ' offers fit; ' || coalesce(skipped, '') END AS note
FROM products p LEFT JOIN counted c ON c.product_id = p.id LEFT JOIN top t ON t.product_id = p.id LEFT JOIN skips k ON k.product_id = p.id
LEFT JOIN individuals i ON i.product_id = p.id LEFT JOIN lessers l ON l.product_id = p.id WHERE p.gtin IS NOT NULL"""
    )
    url = "'https://r' || s || '.example/i/' || product_id"
    price = "CASE WHEN s % 5 <> 0 THEN 100 + product_id % 50 + 0.25 END"
    delivery = "CASE s % 3 WHEN 1 THEN 0 WHEN 2 THEN 3.5 END"
    stock = "CASE WHEN s % 13 = 5 THEN 'few' WHEN s % 2 = 0 THEN 'in_stock' ELSE 'unknown' END"
    seen = "CASE WHEN s % 17 = 6 THEN 'same' WHEN flag = 'A' THEN 'uncertain' WHEN flag = 'N' THEN 'near' ELSE 'exact' END"
    confidence = "CASE WHEN s % 19 = 1 THEN '1.50' ELSE '0.75' END"
    d = lambda c: f"CAST({c} AS DOUBLE)"
    # Rows that keep an import's contract, and first entries of which the body is sound; after an unsound one the second is stored.
    kept = "s % 13 <> 5 AND s % 17 <> 6 AND s % 19 <> 1 AND s % 6 <> 1"
    whole = "s % 23 NOT IN (0, 5, 7, 11, 13)"
    able = "s % 7 <> 3 AND s % 9 > 1 AND s % 9 <> 8"
    stored = f"{able} AND {kept} AND ({whole} OR s % 3 = 1)"
    first_price = price
    price = f"CASE WHEN {whole} THEN ({first_price}) ELSE 7 END"
    title = "CASE WHEN s % 4 = 0 THEN 'Page ' ELSE 'Item ' END || product_id"
    told = (
        f"'read by hand, certainty ' || {confidence} || (CASE WHEN n = 1 THEN '' ELSE '; price from seen ' || n END) || (CASE WHEN s % 3 = 1 THEN '; postage: free' ELSE '' END)"
        " || (CASE WHEN s % 6 = 0 THEN '; not used: a / b' ELSE '' END)"
    )
    # A second entry of a URL comes later in its file, so the first is stored.
    out["import_parses"] = ask(
        ["pairs"],
        f"""SELECT product_id, {url} AS url, {title} AS title, {d(f'({price}) + coalesce({delivery}, 0)')} AS price,
  {d(price)} AS item_price, {d(delivery)} AS shipping_cost, {d("CASE WHEN s % 3 = 0 THEN 199.99 END")} AS was_price, 'GBP' AS currency, {stock} AS availability, {seen} AS match,
  CASE WHEN flag = 'N' THEN 'other colour' END AS match_note, CASE WHEN s % 5 = 0 AND {whole} THEN 'no_price' ELSE 'ok' END AS status, {told} AS note, {_at('last_at')} AS captured_at
FROM pairs WHERE {stored}""",
    )
    out["import_streamed"] = ask(
        ["pairs"],
        f"SELECT product_id, {url} AS url, {d(f'({price}) + coalesce({delivery}, 0)')} AS price, {seen} AS match, CASE WHEN s % 5 = 0 AND {whole} THEN 'no_price' ELSE 'ok' END AS status, {_at('last_at')} AS captured_at FROM pairs WHERE {stored}",
    )
    micros = "CAST(epoch_us(CAST(last_at AS TIMESTAMP)) AS VARCHAR)"
    key_of = f"substr(sha256({url} || chr(10) || {micros}), 1, 24)"
    out["import_captures"] = ask(["pairs"], f"SELECT {key_of} AS capture_id, {url} AS url, {_at('last_at')} AS fetched_at, 'Page ' || product_id AS title, 'hand' AS parser, {seen} AS match FROM pairs WHERE {able}")
    out["import_matches"] = ask(
        ["pairs"],
        f"""SELECT product_id, {url} AS url, CASE WHEN {stored} THEN {seen} WHEN flag = 'A' THEN 'exact' WHEN flag = 'N' THEN 'near' ELSE 'uncertain' END AS match,
  CASE WHEN {stored} THEN CASE WHEN flag = 'N' THEN 'other colour' END WHEN n > 1 THEN 'seen ' || n || ' times' END AS match_note FROM pairs""",
    )
    out["import_outcomes"] = ask(
        ["pairs"],
        f"SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT ({kept}) OR NOT (again OR {whole}) THEN 'rejected' WHEN s % 7 = 3 THEN 'no product' WHEN s % 9 <= 1 THEN 'no capture'"
        f" WHEN s % 9 = 8 OR (again AND {whole}) THEN 'already stored' ELSE 'stored' END AS outcome FROM (SELECT s, FALSE AS again FROM pairs UNION ALL SELECT s, TRUE FROM pairs WHERE s % 3 = 1)) GROUP BY 1",
    )
    wrong = [
        ("confidence", "s % 19 = 1"), ("delivery_cost", "s % 23 = 11 AND NOT again"), ("ignored", "s % 6 = 1"), ("match", "s % 17 = 6"), ("price", "s % 23 = 5 AND NOT again"),
        ("sku", "s % 23 = 13 AND NOT again"), ("stock", "s % 13 = 5"),
    ]
    unread = "(s % 23 IN (0, 7) AND NOT again)"
    out["import_rejects"] = ask(
        ["pairs"],
        f"SELECT product_id, s, CASE WHEN {unread} THEN -1 ELSE 0 END AS row_number, CASE WHEN {unread} THEN 'document' ELSE concat_ws(',', "
        + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in wrong)
        + f") END AS violations FROM (SELECT product_id, s, FALSE AS again FROM pairs UNION ALL SELECT product_id, s, TRUE FROM pairs WHERE s % 3 = 1) WHERE NOT ({kept}) OR NOT (again OR {whole})",
    )
    price = first_price
    mapped = "CASE flag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'near' ELSE 'uncertain' END"
    page = "CASE WHEN s % 3 = 0 THEN 'near' ELSE 'exact' END"
    has_row = "(s % 5 <> 4 AND s % 8 <> 0)"
    worst = f"CASE WHEN {has_row} AND {page} = 'near' THEN 'near' ELSE {mapped} END"
    cost = "CASE WHEN s % 2 = 0 THEN 2.5 END"
    asked = f"CASE WHEN {has_row} AND s % 8 <> 1 THEN 50 + s END"
    out["extract_run"] = ask(
        ["pairs"],
        f"""SELECT product_id, {url} AS url, CASE WHEN {has_row} AND s % 4 <> 0 THEN 'Read ' || product_id ELSE 'Page ' || product_id END AS title, {d(f'({asked}) + coalesce({cost}, 0)')} AS price, {d(asked)} AS item_price,
  {d(f'CASE WHEN {has_row} THEN {cost} END')} AS shipping_cost, 'GBP' AS currency, CASE WHEN {has_row} THEN 'in_stock' ELSE 'unknown' END AS availability, {worst} AS match,
  nullif(concat_ws('; ', CASE WHEN n > 1 THEN 'seen ' || n || ' times' END, CASE WHEN {has_row} AND s % 3 = 0 THEN 'other size' END), '') AS match_note,
  CASE WHEN s % 5 <> 4 AND s % 8 = 0 THEN 'error' WHEN {asked} IS NULL THEN 'no_price' ELSE 'ok' END AS status,
  nullif(concat_ws('; ', CASE WHEN s % 5 <> 4 AND s % 8 = 0 THEN 'HTTP 500' END, CASE WHEN {has_row} THEN 'read by reader-1, certainty 0.50' END, CASE WHEN {has_row} AND s % 7 <> 0 THEN 'price from tag' END), '') AS note, {_at('last_at')} AS captured_at
FROM pairs WHERE s % 9 > 1""",
    )
    out["extract_run_matches"] = ask(["pairs"], f"SELECT product_id, {url} AS url, CASE WHEN s % 9 > 1 THEN {worst} ELSE {mapped} END AS match, CASE WHEN n > 1 THEN 'seen ' || n || ' times' END AS match_note FROM pairs")
    sound = "s % 11 > 5 AND s % 4 <> 0 AND s % 13 <> 5 AND s % 17 <> 6 AND s % 19 <> 1 AND s % 6 <> 1"
    out["accepted_parses"] = ask(["pairs"], f"SELECT 'hand' AS parser, CAST(s AS INT) AS i, {url} AS url, CAST({price} AS DOUBLE) AS price, 0.75::DOUBLE AS confidence, CASE s % 6 WHEN 0 THEN 'a;b' ELSE '' END AS ignored FROM pairs WHERE {sound}")
    terms = [
        ("confidence", "s % 11 = 4 OR s % 19 = 1"), ("delivery_cost", "s % 11 = 5"), ("ignored", "s % 11 = 3 OR s % 6 = 1"), ("match", "s % 17 = 6"), ("price", "s % 11 = 1"),
        ("product_title", "s % 4 = 0"), ("stock", "s % 13 = 5"),
    ]
    out["rejected_parses"] = ask(
        ["pairs"],
        "SELECT product_id, s, CASE WHEN s % 11 IN (0, 2) THEN -1 ELSE 0 END AS row_number, CASE WHEN s % 11 IN (0, 2) THEN 'document' ELSE concat_ws(',', "
        + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in terms) + f") END AS violations FROM pairs WHERE NOT ({sound})",
    )
    said = lambda test, c: f"CASE WHEN s % 11 NOT IN ({test}) THEN {c} END"
    out["parsed_prices"] = ask(
        ["pairs"],
        f"SELECT product_id, s, {said('0', "'hand'")} AS parser, CASE WHEN s % 11 IN (0, 2) THEN -1 ELSE 0 END AS row_number, CAST({said('0, 2', 's')} AS INT) AS i,"
        f" {said('0, 2', "(CASE WHEN s % 7 = 3 THEN 'NONE' ELSE 'SKU' END) || product_id")} AS sku, {said('0, 2', url)} AS url, CAST({said('0, 1, 2', price)} AS DOUBLE) AS price,"
        f" CAST({said('0, 2, 5', delivery)} AS DOUBLE) AS delivery_cost, {said('0, 2', stock)} AS stock, {said('0, 2', seen)} AS match,"
        " CASE WHEN s % 11 IN (0, 2) THEN '-' WHEN s % 11 = 3 THEN 'a;1' WHEN s % 6 = 0 THEN 'a;b' WHEN s % 6 = 1 THEN '-' ELSE '' END AS ignored, CASE WHEN s % 11 IN (0, 2) THEN 'document' ELSE concat_ws(',', "
        + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in terms)
        + ") END AS violations FROM pairs",
    )
    out["landed_prices"] = ask(["pairs"], f"SELECT {url} AS url, {d(f'({price}) + coalesce({delivery}, 0)')} AS landed, CASE WHEN s % 5 = 0 THEN 'no_price' ELSE 'ok' END AS status FROM pairs")
    order = lambda c: f"CASE {c} WHEN 'exact' THEN 0 WHEN 'uncertain' THEN 1 WHEN 'near' THEN 2 END"
    out["worst_match"] = ask(
        ["pairs"],
        f"SELECT url, CASE WHEN {order('seen')} > {order('mapped')} THEN seen ELSE mapped END AS match FROM (SELECT {url} AS url, {seen} AS seen, CASE flag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'near' ELSE 'uncertain' END AS mapped FROM pairs)",
    )
    out["parse_violations"] = ask(
        ["pairs"],
        "SELECT url, violations FROM (SELECT " + url + " AS url, concat_ws(',', CASE WHEN s % 4 = 0 THEN 'product_title' END, CASE WHEN s % 13 = 5 THEN 'stock' END, CASE WHEN s % 17 = 6 THEN 'match' END,"
        " CASE WHEN s % 19 = 1 THEN 'confidence' END, CASE WHEN s % 6 = 1 THEN 'ignored' END) AS violations FROM pairs) WHERE violations <> ''",
    )
    key = "CASE s % 4 WHEN 0 THEN 'SKU' || product_id WHEN 1 THEN 'G' || lpad(CAST(product_id AS VARCHAR), 12, '0') WHEN 2 THEN 'https://shop.example/product/p' || product_id ELSE 'UNKNOWN' || product_id END"
    good = (
        f"SELECT {key} AS key, 'Shop ' || s AS retailer, {url} AS url, CASE WHEN t IN (5, 6) THEN 'exact' WHEN flag = 'A' THEN 'exact' WHEN flag = 'N' THEN 'near' ELSE 'uncertain' END AS match,"
        " CASE WHEN t = 5 THEN NULL WHEN t = 6 THEN 'note,with,commas' ELSE 'seen ' || n || ' times' END AS match_note, product_id, s FROM (SELECT *, (product_id + s) % 40 AS t FROM pairs) WHERE t >= 5"
    )
    out["mapping_lines"] = ask(["pairs"], f"SELECT key, retailer, url, match, match_note FROM ({good})")
    out["mapping_rejects"] = ask(
        ["pairs"],
        f"SELECT CASE WHEN (product_id + s) % 40 = 4 THEN 'lonely' || product_id || ',shop' ELSE {key} || ',Shop ' || s || ',' || {url} || ',maybe,unknown flag' END AS value FROM pairs WHERE (product_id + s) % 40 IN (3, 4)",
    )
    named = "(s % 4 IN (0, 2) OR (s % 4 = 1 AND product_id % 7 <> 1))"
    out["resolved_keys"] = ask(["pairs"], f"SELECT key, url, product_id FROM ({good}) WHERE {named}")
    out["unresolved_keys"] = ask(["pairs"], f"SELECT key, url FROM ({good}) WHERE NOT {named}")
    out["check_targets"] = ask(["products", "pairs"], "SELECT id, sku FROM products WHERE id IN (SELECT product_id FROM pairs)")
    out["check_targets_with_gtin"] = ask(["products", "pairs"], "SELECT id, sku FROM products WHERE id IN (SELECT product_id FROM pairs) OR gtin IS NOT NULL ORDER BY id LIMIT 50")
    out["targets_by_sku"] = ask(["products_again", "sku_list"], "SELECT pos, sku_list.sku AS sku, (SELECT min(id) FROM products_again p WHERE p.sku = sku_list.sku) AS id FROM sku_list WHERE sku IN (SELECT sku FROM products_again)")
    out["missing_skus"] = ask(["products", "sku_list"], "SELECT pos, sku FROM sku_list WHERE sku NOT IN (SELECT sku FROM products)")
    out["urls_to_capture"] = ask(["pairs"], f"SELECT {url} AS url FROM pairs WHERE s % 9 <= 1")
    out["parse_keys"] = ask(["fetched"], "SELECT url, substr(sha256('v1' || chr(10) || 'reader' || chr(10) || url || chr(10) || 'own' || chr(10) || html), 1, 24) AS parse_key FROM fetched WHERE html IS NOT NULL")
    out["parses_to_do"] = ask(["fetched"], "SELECT url FROM fetched WHERE html IS NOT NULL AND product_id % 2 = 1")
    out["capture_keys"] = ask(["captures"], "SELECT url, substr(sha256(url), 1, 24) AS capture_key FROM captures")
    out["captures_found"] = ask(["captures"], f"SELECT url, title, {_at('fetched_at')} AS fetched_at FROM captures")
    out["url_list"] = ask(["url_lines"], "SELECT trim(value) AS url FROM url_lines WHERE trim(value) <> '' AND trim(value) NOT LIKE '#%'")
    return out


def crawl_queries() -> dict[str, str]:
    out = {}
    first = "'https://shop.example/product/p' || p_partkey || (CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '?a=1&b=2' END)"
    stamp = "CASE p_partkey % 4 WHEN 0 THEN '2026-09-21 16:04:30' WHEN 1 THEN '2026-09-20 00:00:00' WHEN 3 THEN '2026-01-04 23:02:03' END"
    entries = (
        f"SELECT p_partkey AS pos, 0 AS entry, {first} AS url, {stamp} AS lastmod FROM part"
        " UNION ALL SELECT p_partkey, 1, 'https://shop.example/product/dup' || (p_partkey // 3), NULL FROM part"
        " UNION ALL SELECT p_partkey, 3, 'https://shop.example/blog/' || p_partkey, NULL FROM part"
    )
    out["sitemap_entries"] = entries
    out["child_sitemaps"] = "SELECT p_partkey AS pos, 'https://shop.example/s' || p_partkey || '.xml' AS url FROM part WHERE p_partkey % 50 = 0"
    kept = f"SELECT url, pos, entry FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos, entry) AS n FROM ({entries}) WHERE url LIKE '%/product/%') WHERE n = 1"
    out["sitemap_products"] = kept
    child = (
        "SELECT 0 AS level, * FROM (" + entries + ") UNION ALL SELECT 1, p_partkey, 0, 'https://shop.example/product/p' || (p_partkey + 2), '2001-01-01 00:00:00' FROM part WHERE p_partkey % 50 = 0"
        " UNION ALL SELECT 1, p_partkey, 1, 'https://shop.example/product/child' || p_partkey, NULL FROM part WHERE p_partkey % 50 = 0"
        " UNION ALL SELECT 1, p_partkey, 2, 'https://shop.example/product/child0', NULL FROM part WHERE p_partkey % 50 = 0"
    )
    out["sitemap_products_with_children"] = f"SELECT url, pos, entry, lastmod FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY level, pos, entry) AS n FROM ({child}) WHERE url LIKE '%/product/%') WHERE n = 1"
    fetched = "(SELECT url, max(fetched_at) AS last_fetched FROM fetch_log GROUP BY url)"
    out["crawl_order"] = ask(["fetch_log"], f"SELECT url, pos FROM ({kept}) LEFT JOIN {fetched} USING (url) ORDER BY last_fetched ASC NULLS FIRST, pos, entry LIMIT 400")
    out["crawl_order_known"] = ask(["fetch_log"], f"SELECT url, {_at('last_fetched')} AS last_fetched FROM ({kept}) JOIN {fetched} USING (url)")
    kind = "length(host) % 4"
    out["robots_rules"] = ask(
        ["robots_now"],
        f"""SELECT host, 1 AS grp, CASE {kind} WHEN 1 THEN 'otherbot,shelf' WHEN 3 THEN 'strangebot' ELSE '*' END AS agents,
  CASE {kind} WHEN 0 THEN '+/ -/en/6 -/*?utm_' WHEN 1 THEN '-/fr +/fr' WHEN 2 THEN '-/*.html$' ELSE '-/' END AS rules,
  CAST(CASE {kind} WHEN 0 THEN 3 WHEN 2 THEN 0.5 END AS DOUBLE) AS delay FROM robots_now
UNION ALL SELECT host, 2, '*', '-/', NULL FROM robots_now WHERE {kind} = 1""",
    )
    out["robots_admission"] = ask(
        ["robots_now"],
        f"""SELECT page_id, CASE WHEN http_status = 404 THEN TRUE WHEN http_status = 503 THEN FALSE
  WHEN {kind} = 0 THEN NOT (path LIKE '%?utm\\_%' ESCAPE '\\' OR path LIKE '/en/6%') WHEN {kind} = 2 THEN path NOT LIKE '%.html' ELSE TRUE END AS allowed,
  CAST(CASE WHEN http_status <> 200 THEN NULL WHEN {kind} = 0 THEN 3 WHEN {kind} = 2 THEN 0.5 END AS DOUBLE) AS delay
FROM (SELECT page_id, lower(regexp_extract(url, '://([^/]+)', 1)) AS host, regexp_replace(regexp_replace(url, '#.*', ''), '^[a-z]+://[^/]*', '') AS path FROM pages) JOIN robots_now USING (host)""",
    )
    status = "CASE WHEN http_status BETWEEN 200 AND 299 THEN 'ok' WHEN http_status IN (404, 410) THEN 'not_found' WHEN http_status IN (401, 403, 429) THEN 'blocked' ELSE 'error' END"
    log = {"log": f"SELECT *, {status} AS status, CASE WHEN http_status = 200 AND challenge AND NOT has_product THEN 'challenge' ELSE {status} END AS outcome FROM fetch_log"}
    for per in ("run_id", "host"):
        log[f"by_{per}"] = f"SELECT *, coalesce(sum(CASE WHEN status = 'blocked' THEN 1 ELSE 0 END) OVER (PARTITION BY {per} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS skipped FROM log"
    log["runs"] = (
        "SELECT run_id, min(fetched_at) AS started_at, max(fetched_at) FILTER (NOT skipped) AS finished_at, count(*) AS urls_planned, count(*) FILTER (NOT skipped AND status = 'ok') AS pages_fetched,"
        " count(*) FILTER (NOT skipped AND status <> 'ok') AS pages_failed FROM by_run_id GROUP BY run_id"
    )
    a = lambda s: ask(["fetch_log"], s, log)
    out["fetch_status"] = a("SELECT seq, status FROM log")
    out["stop_at_refusal_of_run"] = a("SELECT seq, skipped FROM by_run_id")
    out["stop_at_refusal_of_host"] = a("SELECT seq, skipped FROM by_host")
    out["run_summary"] = a(f"SELECT run_id, {_at('started_at')} AS started_at, {_at('finished_at')} AS finished_at, urls_planned, pages_fetched, pages_failed FROM runs")
    out["latest_run"] = a("SELECT run_id, urls_planned, pages_fetched, pages_failed FROM runs ORDER BY started_at DESC LIMIT 1")
    out["host_probe_summary"] = a(
        "SELECT host, count(*) AS attempted, count(*) FILTER (status = 'ok' AND has_product) AS with_product, CAST(round(100.0 * count(*) FILTER (status = 'ok' AND has_product) / count(*)) AS INT) AS product_percent,"
        + ", ".join(f" count(*) FILTER (outcome = '{s}') AS n_{s}" for s in ("ok", "challenge", "not_found", "blocked", "error"))
        + ", count(*) FILTER (status = 'blocked') > 0 AS stopped FROM by_host WHERE NOT skipped GROUP BY host"
    )
    out["spacing_plan"] = ask(["requests"], "SELECT host, seq, (row_number() OVER (PARTITION BY host ORDER BY seq) - 1) * greatest(2.0::DOUBLE, coalesce(delay, 0.0::DOUBLE)) AS planned_offset FROM requests")
    return out


def table_queries() -> dict[str, str]:
    out = {}
    out["product_scan"] = "SELECT p_partkey, p_name, p_brand FROM part"
    newer = "c.url IS NULL OR s.last_crawled_at > c.last_crawled_at"
    out["upsert_products"] = ask(
        ["stored_products", "crawled"],
        f"""SELECT coalesce(id, (SELECT greatest((SELECT max(id) FROM stored_products), coalesce((SELECT max(id) FROM crawled), 0))) + row_number() OVER (PARTITION BY id IS NULL ORDER BY md5(url), url)) AS id, url, price, name, first_seen_at, last_crawled_at
FROM (SELECT coalesce(s.id, c.id) AS id, coalesce(s.url, c.url) AS url, CAST(CASE WHEN {newer} THEN s.price ELSE c.price END AS DOUBLE) AS price,
  CASE WHEN {newer} THEN s.name ELSE c.name END AS name, {_at('least(s.first_seen_at, c.first_seen_at)')} AS first_seen_at,
  {_at('greatest(s.last_crawled_at, c.last_crawled_at)')} AS last_crawled_at FROM stored_products s FULL JOIN crawled c ON c.url = s.url)""",
    )
    out["merge_products"] = out["upsert_products"]
    promo = "(category_path = 'PROMO' OR category_path LIKE 'PROMO > %')"
    # Long ago no offer had expired yet; nothing else depends on the time.
    late = "rule_id = 'price-valid-until-expired' AND product_id NOT IN (SELECT k FROM facts WHERE " + promo + ")"
    out["replace_findings"] = ask(["facts"], f"SELECT product_id, rule_id, severity FROM findings WHERE NOT ({late})", FINDINGS)
    out["apply_audit"] = ask(
        ["facts"],
        f"SELECT id, CAST(greatest(0, 100 - coalesce(lost, 0)) AS INT) AS score, segment, CASE WHEN {promo} THEN '{NOW}' ELSE '2019-06-01 00:00:00' END AS audited_at FROM audited"
        f" LEFT JOIN (SELECT product_id, sum(CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN 7 ELSE 3 END) AS lost FROM findings WHERE NOT ({late}) GROUP BY 1) ON product_id = id",
        AUDITED,
    )
    out["upsert_mappings"] = ask(
        ["mappings", "pairs"],
        """SELECT coalesce(i.product_id, m.product_id) AS product_id, coalesce(i.url, m.url) AS url, coalesce(i.retailer, m.retailer) AS retailer,
  CASE WHEN i.url IS NULL THEN m.match ELSE 'near' END AS match, CASE WHEN i.url IS NULL THEN m.match_note END AS match_note, m.url IS NULL AS is_new
FROM (SELECT * FROM mappings WHERE match <> 'exact') m
FULL JOIN (SELECT product_id, 'Renamed ' || s AS retailer, 'https://r' || s || '.example/i/' || product_id || (CASE WHEN s % 10 = 1 THEN '?new' ELSE '' END) AS url FROM pairs) i ON i.url = m.url AND i.product_id = m.product_id""",
    )
    out["append_observations"] = ask(
        ["observations", "items", "products"],
        "SELECT source, status, count(*) AS n FROM (SELECT source, status FROM observations UNION ALL SELECT 'marketplace', CASE WHEN id IN (SELECT product_id FROM top) THEN 'ok' ELSE 'not_found' END FROM products WHERE gtin IS NOT NULL) GROUP BY 1, 2",
        _JUDGED,
    )
    out["propagate_match"] = ask(
        ["mappings", "observations"],
        """SELECT m.product_id AS product_id, m.url AS url, CASE WHEN o.url IS NULL THEN m.match ELSE o.match END AS match, CASE WHEN o.url IS NULL THEN m.match_note ELSE 'page' END AS match_note
FROM mappings m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY product_id, url ORDER BY captured_at DESC, id DESC) AS n FROM observations WHERE url IS NOT NULL) o ON o.product_id = m.product_id AND o.url = m.url AND n = 1""",
    )
    out["invalid_values"] = ask(["pairs"], "SELECT 'availability' AS \"column\", 'few' AS value, count(*) AS n FROM pairs WHERE s % 13 = 5 HAVING count(*) > 0 UNION ALL SELECT 'match', 'same', count(*) FROM pairs WHERE s % 17 = 6 HAVING count(*) > 0")
    out["duplicate_keys"] = ask(["observations"], "SELECT product_id, url, count(*) AS n FROM observations GROUP BY 1, 2 HAVING count(*) > 1")
    out["orphans"] = ask(["fetch_log", "products"], "SELECT seq, url FROM fetch_log WHERE url NOT IN (SELECT url FROM products)")
    return out


def _tidy(c: str) -> str:
    return f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


def _plain(c: str) -> str:
    return f"regexp_replace({c}, '[^A-Za-z0-9 .,]+', ' ', 'g')"


def extract_queries() -> dict[str, str]:
    a = lambda s, views=None: ask(["facts"], s, views)
    out = {}
    out["page_head_fields"] = a(f"SELECT k AS id, slug, {_tidy('title_tag')} AS title_tag, {_tidy('meta_description')} AS meta_description, canonical, og_image, robots_meta FROM facts")
    out["page_headings"] = a(f"SELECT k AS id, CASE WHEN h1_count > 0 THEN {_tidy('full_name')} END AS h1, CAST(h1_count AS INT) AS h1_count FROM facts")
    out["page_category_trail"] = a("SELECT k AS id, replace(coalesce(category_path, ''), ' > ', '|') AS trail FROM facts")
    out["page_specs"] = a(
        f"SELECT k AS id, CAST(i - 1 AS INT) AS pos, spec_list[i].label AS label, {_tidy('spec_list[i].value')} AS value FROM (SELECT k, spec_list, unnest(range(1, len(spec_list) + 1)) AS i FROM labelled)", LABELLED
    )
    tabs = " UNION ALL ".join(
        f"SELECT k AS page, {n} AS pos, '{i}' AS id, '{lab}' AS label, ({c}) / 100.0::DOUBLE AS price, ({oos}) AS out_of_stock, {sel} AS selected FROM facts WHERE has_tabs AND NOT variants_absent"
        for n, (i, lab, c, oos, sel) in enumerate(TABS)
    )
    out["page_variants"] = a(tabs)
    out["page_prices"] = a(
        "SELECT k AS id, visible_cents / 100.0::DOUBLE AS visible_price, CASE WHEN visible_cents IS NOT NULL THEN was_cents / 100.0::DOUBLE END AS visible_was_price, out_of_stock_notice FROM facts"
    )
    out["page_condition_and_description"] = a(f"SELECT k AS id, condition_label, condition_notes, {_tidy(_plain('description'))} AS description FROM facts")
    shown = "coalesce(gallery_image_count, 0)"
    out["page_images"] = a(f"SELECT k AS id, CAST(CASE WHEN k % 4 > 0 THEN k % 4 ELSE {shown} END AS INT) AS gallery_image_count, CAST(least(images_missing_alt, {shown}) AS INT) AS images_missing_alt FROM facts")
    link = "'https://cdn.example/' || k || '-' || i || '.jpg'"
    sku = "CASE WHEN k % 4 = 0 THEN CAST(k AS VARCHAR) ELSE 'SKU' || k END"
    gtin = "coalesce(CASE WHEN k % 3 = 0 AND gtin IS NULL THEN NULL ELSE gtin END, NULL)"
    out["page_product_nodes"] = a(
        f"""SELECT k AS id, CASE WHEN has_ld THEN 1 ELSE 0 END AS json_ld_product_count, CASE WHEN has_ld THEN {_tidy('ld_name')} END AS name, CASE WHEN has_ld THEN {sku} END AS sku,
  CASE WHEN has_ld THEN {gtin} END AS gtin, CASE WHEN has_ld THEN brand END AS brand, CASE WHEN has_ld THEN nullif(trim({_plain('ld_description')}), '') END AS description,
  CASE WHEN has_ld THEN array_to_string(list_transform(range(1, ld_images + 1), lambda i: {link}), ' ') ELSE '-' END AS images FROM facts"""
    )
    out["page_node_offers"] = a(
        "SELECT k AS id, ld_cents / 100.0::DOUBLE AS price, 'GBP' AS currency, offer_availability AS availability, offer_condition AS condition, valid_until AS price_valid_until, has_return_policy, has_shipping_details FROM facts WHERE has_offer"
    )
    # What a page shows of its facts: the audit of the page is the audit of these.
    page_facts = f"""SELECT * REPLACE (CASE WHEN k % 4 > 0 THEN k % 4 ELSE {shown} END AS gallery_image_count, least(images_missing_alt, {shown}) AS images_missing_alt,
  {_tidy(_plain('description'))} AS description, nullif(trim({_plain('ld_description')}), '') AS ld_description, {_tidy('title_tag')} AS title_tag, {_tidy('meta_description')} AS meta_description,
  CASE WHEN h1_count > 0 THEN {_tidy('full_name')} END AS h1, {_tidy('ld_name')} AS ld_name) FROM facts"""
    of_pages = {"page_facts": page_facts, **AUDITED, "labelled": FACTS.replace("FROM facts f", "FROM page_facts f")}
    out["page_audit"] = a(
        "SELECT id, segment, score, coalesce((SELECT string_agg(rule_id, ',' ORDER BY position) FROM findings WHERE product_id = id), '') AS rules FROM audited", of_pages
    )
    cond = label_condition("condition_label")
    out["page_product_columns"] = a(
        f"""SELECT slug, CASE WHEN has_ld THEN {sku} END AS sku, CASE WHEN has_ld THEN gtin END AS gtin,
  coalesce(CASE WHEN has_ld THEN {_tidy('ld_name')} END, CASE WHEN h1_count > 0 THEN {_tidy('full_name')} END) AS name, CASE WHEN has_ld THEN brand END AS brand, category_path,
  CASE WHEN {cond} <> 'unknown' THEN {cond} WHEN has_offer THEN offer_condition ELSE 'unknown' END AS condition, condition_label,
  coalesce(visible_cents, CASE WHEN has_offer THEN ld_cents END) / 100.0::DOUBLE AS price, CASE WHEN has_offer THEN 'GBP' END AS currency,
  CASE WHEN has_offer THEN offer_availability WHEN out_of_stock_notice THEN 'out_of_stock' ELSE 'unknown' END AS availability FROM facts"""
    )
    path = "regexp_replace(regexp_replace(url, '[?#].*', ''), '^[a-z]+://[^/]*', '')"
    title = "regexp_extract(html, '<title>(.*?)</title>', 1, 's')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        title = f"replace({title}, '{entity}', '{char}')"
    out["raw_page_headings"] = (
        f"SELECT page_id, regexp_replace({path}, '/$', '') AS slug, nullif(trim(regexp_replace({title}, '[\\s ]+', ' ', 'g')), '') AS title_tag,"
        " CAST(len(regexp_extract_all(html, '<h1[ >]')) AS INT) AS h1_count, 0 AS json_ld_product_count, 0 AS gallery_image_count FROM pages"
    )
    out["page_cheapest_offers"] = ask(
        ["fetched"],
        """SELECT url, CASE s % 9 WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 1 ELSE 0 END AS product_count, CASE s % 9 WHEN 6 THEN 'T' || product_id WHEN 7 THEN 'Deep ' || s END AS title,
  CAST(CASE s % 9 WHEN 6 THEN 900 + product_id % 89 WHEN 7 THEN 1500 + s END AS DOUBLE) AS price, CASE s % 9 WHEN 6 THEN 'EUR' WHEN 7 THEN 'GBP' END AS currency,
  CASE s % 9 WHEN 6 THEN 'unknown' WHEN 7 THEN 'refurbished' END AS condition, CASE s % 9 WHEN 6 THEN 'out_of_stock' WHEN 7 THEN 'unknown' END AS availability FROM fetched WHERE html IS NOT NULL""",
    )
    out["challenge_pages"] = ask(["fetched"], "SELECT url, s % 9 = 4 AS challenge FROM fetched WHERE html IS NOT NULL")
    out["clean_text"] = "SELECT doc_id, nullif(trim(regexp_replace(text, '[\\s\\x0B\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g')), '') AS text FROM documents"
    out["price_texts"] = a("SELECT k AS id, CAST(k || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || CASE k % 3 WHEN 0 THEN '.5' WHEN 1 THEN '.25' ELSE '' END AS DOUBLE) AS price FROM facts")
    out["slugs"] = a("SELECT k AS id, slug FROM facts")
    out["url_paths"] = ask(["odd_urls"], "SELECT id, path, substr(path, 10) AS slug, TRUE AS same FROM odd_urls")
    out["vocabularies"] = a(f"SELECT k AS id, {cond} AS from_label, offer_condition AS condition, offer_availability AS availability FROM facts")
    return out


def all_sql() -> dict[str, str]:
    return {**lens_queries(), **audit_queries(), **pricing_queries(), **extract_queries(), **crawl_queries(), **table_queries()}
