"""Our tables derived from the benchmark tables, as SQL that Spark and DuckDB read alike.

This is data preparation only: the operators take the resulting DataFrames as they would take real ones.
Modulo rules create the cases (missing values, wrong digits, drifted records) that the source tables lack.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]

NOW = "2026-09-21 00:00:00"


def _gtin_check(body: str) -> str:
    """Check digit of a 12-digit number, weights 3 and 1 from the right."""
    digits = [f"(CAST(floor({body} / {10**i}) AS BIGINT) % 10)" for i in range(12)]
    total = " + ".join(f"{3 if i % 2 == 0 else 1} * {d}" for i, d in enumerate(digits))
    return f"((10 - ({total}) % 10) % 10)"


SQL: dict[str, str] = {}

# One row per part with a document attached; `k` is the part key. Both sides grow, so the join is never a broadcast.
SQL["facts0"] = f"""
SELECT /*+ MERGE(d) */ p.k AS k, p.p_brand, p.p_size, p.p_type,
       CAST(round(p.p_retailprice * 100) AS BIGINT) AS own_cents,
       d.text AS doc_text,
       (CASE WHEN p.k % 19 = 0 THEN 'XK-' || lpad(CAST(p.k AS STRING), 5, '0') || ' ' ELSE '' END)
       || p.p_name
       || (CASE p.k % 23
            WHEN 0 THEN ' monitor' WHEN 1 THEN ' laptop charger' WHEN 2 THEN ' Galaxy Watch8 40mm'
            WHEN 3 THEN ' kettle' WHEN 4 THEN ' with' WHEN 5 THEN ',' WHEN 6 THEN ' 128GB black'
            WHEN 7 THEN ' case for iPhone' WHEN 8 THEN ' (boxed' WHEN 9 THEN ' ,dual' WHEN 10 THEN ' Galaxy Watch8 LTE'
            WHEN 11 THEN ' 2 TB white' WHEN 12 THEN ' Pixel Watch 45 mm' WHEN 13 THEN ' Pixel Watch band'
            WHEN 14 THEN ' size ' || CAST(p.k % 50 AS STRING) WHEN 15 THEN ' 6.7 in -' WHEN 16 THEN ' soundbar'
            WHEN 17 THEN ' Series x' WHEN 18 THEN ' tv' ELSE '' END) AS full_name,
       400600000000 + p.k AS gtin_body,
       {_gtin_check('(400600000000 + p.k)')} AS gtin_digit,
       (CASE p.k % 10 WHEN 4 THEN 'Refurbished – Excellent' WHEN 5 THEN 'Refurbished – Very Good'
            WHEN 6 THEN 'Refurbished – Good' WHEN 7 THEN 'Open Box' WHEN 8 THEN 'Used, pre-owned'
            WHEN 9 THEN NULL ELSE 'Brand New' END) AS condition_label,
       (CASE p.k % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 ELSE 6 END) AS n_specs,
       (p.k % 53 = 7) AS specs_absent,
       (p.k % 59 = 7) AS variants_absent,
       (p.k % 17 <> 3) AS has_ld,
       (p.k % 17 <> 3 AND p.k % 29 <> 5) AS has_offer,
       (p.k % 4 = 2) AS has_tabs
FROM (SELECT q.*, q.p_partkey AS k, q.p_partkey % (SELECT max(doc_id) + 1 FROM {{documents}}) AS doc_key FROM {{part}} q) p
JOIN {{documents}} d ON d.doc_id = p.doc_key
"""

SQL["facts"] = """
SELECT f.*,
       'https://shop.example/product/' || slug AS url,
       (CASE WHEN k % 31 = 0 THEN NULL ELSE full_name END) AS ld_name,
       (CASE WHEN k % 37 = 0 THEN NULL ELSE full_name END) AS h1,
       'SKU' || CAST(k AS STRING) AS sku,
       (CASE WHEN k % 7 = 1 THEN NULL WHEN k % 41 = 2 THEN '12345'
             WHEN k % 5 = 0 THEN CAST(gtin_body AS STRING) || CAST((gtin_digit + 1) % 10 AS STRING)
             WHEN k % 11 = 4 THEN '4006-' || substring(CAST(gtin_body AS STRING), 5, 8) || ' ' || CAST(gtin_digit AS STRING)
             ELSE CAST(gtin_body AS STRING) || CAST(gtin_digit AS STRING) END) AS gtin,
       (CASE WHEN k % 8 = 0 THEN NULL WHEN k % 4 = 1 THEN p_brand || ' Works' ELSE p_brand END) AS brand,
       (CASE WHEN k % 13 = 0 THEN NULL WHEN k % 13 = 1 THEN p_type
             ELSE p_type || ' > Size ' || CAST(p_size % 10 AS STRING) || (CASE WHEN k % 3 = 0 THEN ' > Rest' ELSE '' END) END) AS category_path,
       (CASE WHEN k % 6 = 0 THEN NULL WHEN n_specs <= 2 AND k % 4 <> 3 THEN 'Plain ' || full_name ELSE doc_text END) AS description,
       (CASE WHEN k % 12 = 0 THEN doc_text WHEN k % 12 = 6 THEN NULL ELSE 'Plain ' || full_name END) AS ld_description,
       (CASE WHEN n_specs <= 2 AND k % 4 <> 3 THEN k % 2 ELSE k % 5 END) AS ld_images,
       (CASE WHEN k % 47 = 9 THEN NULL WHEN n_specs <= 2 THEN k % 3 ELSE k % 6 END) AS gallery_image_count,
       (k % 3) AS images_missing_alt,
       (CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 2 THEN own_cents - 1000 WHEN k % 6 = 3 THEN own_cents + 333 ELSE own_cents END) AS ld_cents,
       (CASE WHEN k % 16 = 5 THEN NULL ELSE own_cents END) AS visible_cents,
       (CASE WHEN k % 4 = 0 THEN own_cents + 5000 ELSE NULL END) AS was_cents,
       (CASE k % 5 WHEN 0 THEN 'out_of_stock' WHEN 1 THEN 'preorder' WHEN 2 THEN 'unknown' ELSE 'in_stock' END) AS offer_availability,
       (CASE WHEN k % 7 = 0 THEN 'refurbished' WHEN k % 7 = 1 THEN 'used' WHEN k % 7 = 2 THEN 'unknown'
             WHEN k % 10 IN (4, 5, 6) THEN 'refurbished' ELSE 'new' END) AS offer_condition,
       (CASE k % 5 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2099-12-31' WHEN 2 THEN NULL WHEN 3 THEN 'soon' ELSE '2026-09-20T23:59:59Z' END) AS valid_until,
       (k % 3 = 1) AS has_return_policy, (k % 4 = 1) AS has_shipping_details,
       (k % 5 = 0) AS out_of_stock_notice,
       (CASE WHEN k % 3 = 0 THEN NULL ELSE 'Light marks on the lid.' END) AS condition_notes,
       (CASE WHEN k % 4 = 0 THEN full_name || ' | a shop of many things with a rather long site name at the end' ELSE full_name || ' | Shop' END) AS title_tag,
       (CASE WHEN k % 6 = 1 THEN NULL WHEN k % 6 = 2 THEN repeat('Long summary of ' || full_name || '. ', 8) ELSE 'About ' || full_name END) AS meta_description,
       (CASE k % 12 WHEN 0 THEN NULL WHEN 1 THEN 'https://shop.example/product/other' WHEN 2 THEN '/product/' || slug
             WHEN 3 THEN slug WHEN 4 THEN 'http://[bad' WHEN 5 THEN 'https://shop.example/product/' || slug || '/?ref=1'
             WHEN 6 THEN '/elsewhere' ELSE 'https://shop.example/product/' || slug END) AS canonical,
       (CASE WHEN k % 4 = 1 THEN 'https://cdn.example/' || CAST(k AS STRING) || '.jpg' ELSE NULL END) AS og_image,
       (CASE k % 43 WHEN 0 THEN 'NoIndex, follow' WHEN 1 THEN 'index' ELSE NULL END) AS robots_meta,
       (CASE WHEN k % 37 = 0 THEN 0 WHEN k % 11 = 1 THEN 2 ELSE 1 END) AS h1_count
FROM (SELECT g.*,
             'p' || CAST(k AS STRING) || '-' || replace(replace(replace(lower(full_name), ' ', '-'), ',', ''), '(', '')
             || (CASE WHEN k % 13 = 3 THEN '-refurbished-very-good' WHEN k % 13 = 4 THEN '-good-condition' ELSE '' END)
             || (CASE WHEN k % 3 = 1 THEN '-' || CAST(k % 50 AS STRING) ELSE '' END) AS slug
      FROM facts0 g) f
"""

# Price observations: one per line item. Order ties are settled by `id`.
SQL["observations"] = """
SELECT l_orderkey * 100000000 + l_suppkey * 10 + l_linenumber AS id,
       l_partkey AS product_id,
       (CASE WHEN l_suppkey % 10 = 3 THEN 'marketplace' ELSE 'url' END) AS source,
       'Supplier#' || lpad(CAST(l_suppkey AS STRING), 9, '0') AS retailer,
       (CASE WHEN abs(l_tax) < 0.001 THEN NULL ELSE 'https://r' || CAST(l_suppkey AS STRING) || '.example/i/' || CAST(l_partkey AS STRING) END) AS url,
       CAST((CASE WHEN status = 'ok' THEN landed_cents / 100.0 ELSE NULL END) AS DECIMAL(10,2)) AS price,
       CAST((CASE WHEN status = 'ok' THEN item_cents / 100.0 ELSE NULL END) AS DECIMAL(10,2)) AS item_price,
       CAST((CASE WHEN status = 'ok' THEN (landed_cents - item_cents) / 100.0 ELSE NULL END) AS DECIMAL(10,2)) AS shipping_cost,
       (CASE WHEN l_linestatus = 'O' THEN 'in_stock' ELSE 'unknown' END) AS availability,
       (CASE WHEN l_partkey % 29 = 3 THEN 'near' WHEN l_returnflag = 'A' THEN 'exact' WHEN l_returnflag = 'N' THEN 'near'
             WHEN l_linenumber = 7 THEN NULL ELSE 'uncertain' END) AS match,
       status,
       (CASE WHEN status = 'ok' THEN NULL ELSE 'check failed: ' || status END) AS note,
       l_shipdate AS captured_at
FROM (SELECT *,
             item_cents + CAST(round(l_tax * 100) AS BIGINT) * 99 AS landed_cents,
             (CASE WHEN l_partkey % 20 = 0 THEN 'blocked'
                   WHEN l_linestatus = 'O' THEN 'ok'
                   WHEN l_linenumber < 3 THEN 'blocked'
                   WHEN l_linenumber = 3 THEN 'disallowed'
                   WHEN l_linenumber = 4 THEN 'not_found'
                   WHEN l_linenumber = 5 THEN 'error'
                   ELSE 'no_price' END) AS status
      FROM (SELECT *, CAST(floor((90000 + (l_partkey % 1000) * 10) * (98 + 4 * CAST(round(l_discount * 100) AS BIGINT)) / 100) AS BIGINT) AS item_cents
            FROM {lineitem}) a) b
"""

# Plain product table.
SQL["products"] = """
SELECT p_partkey AS id, 'https://shop.example/product/p' || CAST(p_partkey AS STRING) AS url,
       'p' || CAST(p_partkey AS STRING) AS slug,
       'SKU' || CAST(p_partkey AS STRING) AS sku,
       (CASE WHEN p_partkey % 7 = 1 THEN NULL ELSE 'G' || lpad(CAST(p_partkey AS STRING), 12, '0') END) AS gtin,
       p_name AS name,
       (CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_brand END) AS brand,
       (CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END) AS category_path,
       (CASE p_partkey % 5 WHEN 0 THEN 'refurbished' WHEN 1 THEN 'used' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL ELSE 'new' END) AS condition,
       (CASE WHEN p_partkey % 5 = 0 THEN 'Refurbished' ELSE NULL END) AS condition_label,
       CAST((CASE WHEN p_partkey % 33 = 0 THEN NULL ELSE p_retailprice END) AS DECIMAL(10,2)) AS price,
       CAST((CASE WHEN p_partkey % 4 = 0 THEN p_retailprice + 50 ELSE NULL END) AS DECIMAL(10,2)) AS was_price
FROM {part}
"""

# URLs as pages carry them: encoded, raw and broken in the same place. `path` is what a URL parser makes of each.
SQL["odd_urls"] = """
SELECT p_partkey AS id, 'https://shop.example' || given AS url, parsed AS path, (CASE p_partkey % 9 WHEN 8 THEN parsed ELSE given END) AS ref
FROM (SELECT p_partkey,
        (CASE p_partkey % 9 WHEN 0 THEN '/product/café' WHEN 1 THEN '/product/caf%C3%A9' WHEN 2 THEN '/product/two words' WHEN 3 THEN chr(92) || 'product' || chr(92) || 'x'
              WHEN 4 THEN '/product/{@lb}a{@rb}' WHEN 5 THEN '/product/./y/../ü"q"' WHEN 6 THEN '/product/p%20' || CAST(p_partkey AS STRING) || '?q= #f'
              WHEN 7 THEN '/product/€<' || CAST(p_partkey AS STRING) || '>' ELSE '/product/plain-' || CAST(p_partkey AS STRING) END) AS given,
        (CASE p_partkey % 9 WHEN 0 THEN '/product/caf%C3%A9' WHEN 1 THEN '/product/caf%C3%A9' WHEN 2 THEN '/product/two%20words' WHEN 3 THEN '/product/x'
              WHEN 4 THEN '/product/%7Ba%7D' WHEN 5 THEN '/product/%C3%BC%22q%22' WHEN 6 THEN '/product/p%20' || CAST(p_partkey AS STRING)
              WHEN 7 THEN '/product/%E2%82%AC%3C' || CAST(p_partkey AS STRING) || '%3E' ELSE '/product/plain-' || CAST(p_partkey AS STRING) END) AS parsed
      FROM {part}) u
"""

# Shared SKUs: some products stand three times, under other ids.
SQL["products_again"] = """
SELECT id, sku, name FROM products
UNION ALL SELECT id + 1000000000, sku, name || ' again' FROM products WHERE id % 3 = 0
UNION ALL SELECT -id, sku, name || ' before' FROM products WHERE id % 5 = 1
"""

# Own price over time: few distinct prices, so that repeats occur.
SQL["price_feed"] = """
SELECT l_orderkey * 100000000 + l_suppkey * 10 + l_linenumber AS id,
       l_partkey AS product_id,
       CAST((CASE WHEN CAST(l_quantity AS BIGINT) % 13 = 0 THEN NULL
                  ELSE 100 + floor(abs(l_discount) * 100 / 4) * 10 END) AS DECIMAL(10,2)) AS price,
       (CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'O' THEN 'in_stock' ELSE 'out_of_stock' END) AS availability,
       l_shipdate AS captured_at
FROM {lineitem}
"""

# Hand mappings: one per (part, supplier) pair that ever met.
SQL["pairs"] = """
SELECT l_partkey AS product_id, l_suppkey AS s, max(l_returnflag) AS flag, max(l_shipdate) AS last_at,
       count(*) AS n, min(l_linenumber) AS line
FROM {lineitem} GROUP BY l_partkey, l_suppkey
"""
SQL["mapping_lines"] = """
SELECT (CASE WHEN (product_id + s) % 40 = 0 THEN '# a comment'
             WHEN (product_id + s) % 40 = 1 THEN '   '
             WHEN (product_id + s) % 40 = 2 THEN 'Product_Key,retailer,url,match,note'
             WHEN (product_id + s) % 40 = 3 THEN body || ',maybe,unknown flag'
             WHEN (product_id + s) % 40 = 4 THEN 'lonely' || CAST(product_id AS STRING) || ',shop'
             WHEN (product_id + s) % 40 = 5 THEN body
             WHEN (product_id + s) % 40 = 6 THEN body || ',,note, with, commas'
             ELSE '  ' || body || ' , ' || flag_name || ', seen ' || CAST(n AS STRING) || ' times ' END) AS value
FROM (SELECT *, (CASE WHEN s % 4 = 0 THEN 'SKU' || CAST(product_id AS STRING)
                      WHEN s % 4 = 1 THEN 'G' || lpad(CAST(product_id AS STRING), 12, '0')
                      WHEN s % 4 = 2 THEN 'https://shop.example/product/p' || CAST(product_id AS STRING)
                      ELSE 'UNKNOWN' || CAST(product_id AS STRING) END)
                || ',Shop ' || CAST(s AS STRING) || ',https://r' || CAST(s AS STRING) || '.example/i/' || CAST(product_id AS STRING) AS body,
             (CASE flag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'near' ELSE 'uncertain' END) AS flag_name
      FROM pairs) x
"""
SQL["mappings"] = """
SELECT product_id, 'Shop ' || CAST(s AS STRING) AS retailer,
       'https://r' || CAST(s AS STRING) || '.example/i/' || CAST(product_id AS STRING) AS url,
       (CASE flag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'near' ELSE 'uncertain' END) AS match,
       (CASE WHEN n > 1 THEN 'seen ' || CAST(n AS STRING) || ' times' ELSE NULL END) AS match_note
FROM pairs
"""
# What was fetched for each mapped URL. Two thirds carry product markup.
SQL["fetched"] = """
SELECT 'https://r' || CAST(s AS STRING) || '.example/i/' || CAST(product_id AS STRING) AS url,
       (CASE s % 9 WHEN 0 THEN 'blocked' WHEN 1 THEN 'not_found' WHEN 2 THEN 'error' WHEN 3 THEN 'disallowed' ELSE 'ok' END) AS status,
       (CASE s % 9 WHEN 0 THEN 'refused' WHEN 2 THEN 'timeout' ELSE NULL END) AS note,
       (CASE WHEN s % 9 IN (0, 1, 2, 3) THEN NULL
             WHEN s % 9 = 5 AND product_id % 4 = 0 THEN ''
             WHEN s % 9 = 4 THEN '<html><body>Just a moment...</body></html>'
             WHEN s % 9 = 5 THEN '<html><script type="application/ld+json">{@lb}"@type":"WebPage"{@rb}</script></html>'
             WHEN s % 9 = 6 THEN '<script type="application/ld+json">{@lb}"@type":"Product","name":"T' || CAST(product_id AS STRING)
                  || '","offers":[{@lb}"price":"' || CAST(1000 + product_id % 97 AS STRING) || '.50","priceCurrency":"GBP"{@rb},{@lb}"price":'
                  || CAST(900 + product_id % 89 AS STRING) || ',"priceCurrency":"EUR","availability":"https://schema.org/OutOfStock"{@rb},{@lb}"price":"n/a"{@rb}]{@rb}</script>'
             WHEN s % 9 = 7 THEN '<script type="application/ld+json">[{@lb}"@type":["Thing","Product"],"name":"Dear","offers":{@lb}"lowPrice":'
                  || CAST(2000 + s AS STRING) || '{@rb}{@rb},{@lb}"@graph":[{@lb}"@type":"Product","name":"Deep ' || CAST(s AS STRING)
                  || '","offers":{@lb}"priceSpecification":{@lb}"price":"' || CAST(1500 + s AS STRING)
                  || '","priceCurrency":"GBP"{@rb},"itemCondition":"https://schema.org/RefurbishedCondition"{@rb}{@rb}]{@rb}]</script>'
             ELSE '<script type="application/ld+json">{@lb}"@type":"Product","name":"No offer"{@rb}</script><p>captcha</p>' END) AS html,
       product_id, s
FROM pairs
"""

# Parsed prices: one JSON document per pair.
SQL["parse_docs"] = """
SELECT '{@lb}"parser":"hand","rules":"own price only","rows":[{@lb}"i":' || CAST(s AS STRING)
       || ',"sku":"' || (CASE WHEN s % 7 = 3 THEN 'NONE' ELSE 'SKU' END) || CAST(product_id AS STRING)
       || '","retailer":"Shop ' || CAST(s AS STRING) || '","url":"https://r' || CAST(s AS STRING) || '.example/i/' || CAST(product_id AS STRING)
       || '","page_title":"Page ' || CAST(product_id AS STRING) || '","product_title":' || (CASE WHEN s % 4 = 0 THEN 'null' ELSE '"Item ' || CAST(product_id AS STRING) || '"' END)
       || ',"price":' || (CASE WHEN s % 5 = 0 THEN 'null' ELSE CAST(100 + product_id % 50 AS STRING) || '.25' END)
       || ',"price_evidence":' || (CASE WHEN n = 1 THEN 'null' ELSE '"seen ' || CAST(n AS STRING) || '"' END)
       || ',"was_price":' || (CASE WHEN s % 3 = 0 THEN '199.99' ELSE 'null' END)
       || ',"delivery_cost":' || (CASE s % 3 WHEN 0 THEN 'null' WHEN 1 THEN '0' ELSE '3.5' END)
       || ',"delivery_note":' || (CASE WHEN s % 3 = 1 THEN '"free"' ELSE 'null' END)
       || ',"stock":"' || (CASE WHEN s % 13 = 5 THEN 'few' WHEN s % 2 = 0 THEN 'in_stock' ELSE 'unknown' END)
       || '","stock_note":null,"match":"' || (CASE WHEN s % 17 = 6 THEN 'same' WHEN flag = 'A' THEN 'uncertain' WHEN flag = 'N' THEN 'near' ELSE 'exact' END)
       || '","match_note":' || (CASE WHEN flag = 'N' THEN '"other colour"' ELSE 'null' END)
       || ',"confidence":' || (CASE WHEN s % 19 = 1 THEN '1.5' ELSE '0.75' END)
       || ',"ignored":' || (CASE WHEN s % 6 = 0 THEN '["a","b"]' WHEN s % 6 = 1 THEN 'null' ELSE '[]' END) || '{@rb}]{@rb}' AS value,
       product_id, s, flag, n, last_at
FROM pairs
"""
# The same for an import: some bodies can't be read or hold values of a wrong type, and some URLs have a second entry.
SQL["parse_docs_again"] = """
SELECT (CASE s % 23 WHEN 0 THEN substring(value, 1, 40) WHEN 5 THEN replace(value, '"price":', '"price":"x","old":')
             WHEN 7 THEN '{@lb}"parser":"hand","rows":5{@rb}' WHEN 11 THEN replace(value, '"delivery_cost":', '"delivery_cost":true,"old":')
             WHEN 13 THEN replace(value, '"sku":', '"sku":8,"old":') ELSE value END) AS value, product_id, s FROM parse_docs
UNION ALL SELECT replace(replace(value, '"i":', '"i":9'), '"price":', '"price":7,"old":'), product_id, s FROM parse_docs WHERE s % 3 = 1
"""
# The same and, of the bodies that came broken, the whole ones that followed.
SQL["parse_docs_mended"] = """
SELECT value, product_id, s FROM parse_docs_again
UNION ALL SELECT value, product_id, s FROM parse_docs WHERE s % 23 IN (0, 5, 7, 11, 13)
"""
# Bodies and rows that break the contract.
SQL["parse_docs_odd"] = """
SELECT (CASE s % 11 WHEN 0 THEN substring(value, 1, 40) WHEN 1 THEN replace(value, '"price":', '"price":"x","old":')
             WHEN 2 THEN '{@lb}"parser":"hand","rows":5{@rb}' WHEN 3 THEN replace(value, '"ignored":', '"ignored":["a",1],"old":')
             WHEN 4 THEN replace(value, '"confidence":', '"certainty":') WHEN 5 THEN replace(value, '"delivery_cost":', '"delivery_cost":true,"old":')
             ELSE value END) AS value, product_id, s
FROM parse_docs
"""
# What a reader made of each captured page.
SQL["readings"] = """
SELECT 'https://r' || CAST(s AS STRING) || '.example/i/' || CAST(product_id AS STRING) AS url, 'reader-1' AS model,
       (CASE WHEN s % 8 = 0 THEN 'HTTP 500' ELSE NULL END) AS error, s % 8 <> 0 AND s % 8 <> 1 AS has_price, s % 8 <> 0 AS has_row,
       (CASE WHEN s % 3 = 0 THEN 'near' ELSE 'exact' END) AS seen, product_id, s
FROM pairs WHERE s % 5 <> 4
"""
# Several fetches of one page: the newest counts.
SQL["captures_again"] = """
SELECT url, fetched_at, title FROM captures
UNION ALL SELECT url, CAST('1990-01-01 00:00:00' AS TIMESTAMP), 'Old ' || title FROM captures
"""
SQL["captures"] = """
SELECT 'https://r' || CAST(s AS STRING) || '.example/i/' || CAST(product_id AS STRING) AS url, last_at AS fetched_at,
       'Page ' || CAST(product_id AS STRING) AS title
FROM pairs WHERE s % 9 > 1
"""
SQL["parsed_before"] = """
SELECT 'parsed' AS source, 'https://r' || CAST(s AS STRING) || '.example/i/' || CAST(product_id AS STRING) AS url, last_at AS captured_at
FROM pairs WHERE s % 9 = 8
"""
SQL["crawled"] = """
SELECT (CASE WHEN l_partkey % 10 = 0 THEN l_partkey + 1000000000 ELSE NULL END) AS id,
       'https://shop.example/product/' || (CASE WHEN l_partkey % 10 = 0 THEN 'new' WHEN l_partkey % 10 = 7 THEN 'fresh' ELSE 'p' END) || CAST(l_partkey AS STRING) AS url,
       CAST(100 + max(l_linenumber) AS DECIMAL(10,2)) AS price, max(l_returnflag) AS name,
       min(l_shipdate) AS first_seen_at,
       CAST((CASE WHEN l_partkey % 4 = 1 THEN CAST('1997-01-01 00:00:00' AS TIMESTAMP) ELSE max(l_shipdate) END) AS TIMESTAMP) AS last_crawled_at
FROM {lineitem} GROUP BY l_partkey
"""
SQL["stored_products"] = """
SELECT p_partkey AS id, 'https://shop.example/product/p' || CAST(p_partkey AS STRING) AS url,
       CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_name AS name,
       CAST('1996-06-01 00:00:00' AS TIMESTAMP) AS first_seen_at,
       CAST((CASE WHEN p_partkey % 3 = 0 THEN '2002-01-01 00:00:00' ELSE '1997-01-01 00:00:00' END) AS TIMESTAMP) AS last_crawled_at
FROM {part}
"""
SQL["sku_list"] = """
SELECT s_suppkey AS pos, 'SKU' || CAST(s_suppkey * 37 AS STRING) AS sku FROM {supplier}
"""
SQL["url_lines"] = """
SELECT (CASE WHEN event_id % 7 = 0 THEN '# note ' || CAST(event_id AS STRING) WHEN event_id % 7 = 1 THEN '  '
             ELSE '  https://shop.example/product/p' || CAST(event_id AS STRING) || ' ' END) AS value
FROM {events}
"""
SQL["requests"] = """
SELECT 'h' || CAST(user_id AS STRING) || '.example' AS host, event_id AS seq,
       (CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id % 5 AS DOUBLE) END) AS delay
FROM {events}
"""

# Marketplace items: one per line item, matched on GTIN.
SQL["items"] = """
SELECT 'v' || CAST(l_orderkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS item_id,
       (CASE WHEN l_partkey % 7 = 1 THEN NULL ELSE 'G' || lpad(CAST(l_partkey AS STRING), 12, '0') END) AS gtin,
       (CASE l_linenumber
          WHEN 1 THEN p_name WHEN 2 THEN p_name || ' black' WHEN 3 THEN replace(p_name, 'blue', 'red') || ' new'
          WHEN 4 THEN (CASE WHEN l_suppkey % 3 = 0 THEN p_name || ' faulty' ELSE p_name || ' 64GB' END)
          WHEN 5 THEN (CASE WHEN l_suppkey % 2 = 0 THEN 'Case for ' || p_name ELSE p_name || ' boxed' END)
          WHEN 6 THEN p_name || ' bundle' ELSE 'widget ' || CAST(l_suppkey AS STRING) END) AS title,
       (CASE l_suppkey % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'USED' WHEN 2 THEN 'GOOD_REFURBISHED' ELSE 'NEW' END) AS condition_id,
       (CASE WHEN l_quantity = 1 THEN 'n/a' WHEN l_quantity = 2 THEN NULL
             WHEN l_quantity = 3 THEN '12.00'
             ELSE CAST(CAST(floor((90000 + (l_partkey % 1000) * 10) * (80 + l_quantity) / 10000) AS BIGINT) AS STRING)
                  || '.' || lpad(CAST(l_orderkey % 100 AS STRING), 2, '0') END) AS price_value,
       (CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 5 = 1 THEN '4.99' WHEN l_suppkey % 5 = 2 THEN '2.50' ELSE 'free' END) AS postage1,
       (CASE WHEN l_linenumber % 2 = 0 THEN '3.75' ELSE NULL END) AS postage2,
       'seller' || CAST(l_suppkey AS STRING) AS seller,
       (CASE l_suppkey % 3 WHEN 0 THEN 'BUSINESS' WHEN 1 THEN 'INDIVIDUAL' ELSE NULL END) AS account_type,
       (CASE WHEN l_suppkey % 11 = 0 THEN 'DE' WHEN l_suppkey % 11 = 1 THEN NULL ELSE 'GB' END) AS country,
       (CASE WHEN l_suppkey % 2 = 0 THEN '99.5' ELSE NULL END) AS feedback_percentage,
       (CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey * 3 END) AS feedback_score
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
"""

# Crawl log: one fetch per event.
SQL["fetch_log"] = """
SELECT substring(CAST(ts AS STRING), 1, 10) AS run_id,
       'h' || CAST(user_id AS STRING) || '.example' AS host,
       'https://shop.example/product/p' || CAST(event_id % 4001 AS STRING) AS url,
       event_id AS seq,
       CAST((CASE event_type
              WHEN 'purchase' THEN (CASE WHEN value < 10 THEN 404 ELSE 410 END)
              WHEN 'error' THEN (CASE WHEN value < 5 THEN 500 WHEN value < 20 THEN 429 ELSE 403 END)
              WHEN 'signup' THEN (CASE WHEN value < 1 THEN NULL ELSE 204 END)
              ELSE 200 END) AS INT) AS http_status,
       (event_type = 'view') AS has_product, (event_type = 'click' AND value < 5) AS challenge,
       ts AS fetched_at
FROM {events}
"""

# Sitemap bodies: one per part.
SQL["sitemaps"] = """
SELECT 'shop.example' AS host, p_partkey AS pos,
       '<?xml version="1.0"?><urlset>' || chr(10)
       || '<url><loc> https://shop.example/product/p' || CAST(p_partkey AS STRING) || (CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '?a=1&amp;b=2' END) || ' </loc><lastmod>'
       || (CASE p_partkey % 4 WHEN 0 THEN '2026-09-21T16:04:30Z' WHEN 1 THEN '2026-09-20' WHEN 2 THEN 'yesterday' ELSE '2026-01-05T01:02:03+02:00' END) || '</lastmod></url>'
       || '<url><loc>https://shop.example/product/dup' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) || '</loc></url>' || chr(10)
       || '<url><lastmod>2020-01-01</lastmod></url>'
       || '<url><loc>https://shop.example/blog/' || CAST(p_partkey AS STRING) || '</loc></url>'
       || '</urlset>'
       || (CASE WHEN p_partkey % 50 = 0 THEN '<sitemap><loc>https://shop.example/s' || CAST(p_partkey AS STRING) || '.xml</loc></sitemap><sitemap></sitemap>' ELSE '' END) AS body
FROM {part}
"""

# Bodies of the child sitemaps: pages listed by the parent as well, and others.
SQL["child_maps"] = """
SELECT 'shop.example' AS host, p_partkey AS pos,
       '<urlset><url><loc>https://shop.example/product/p' || CAST(p_partkey + 2 AS STRING) || '</loc><lastmod>2001-01-01</lastmod></url>'
       || '<url><loc>https://shop.example/product/child' || CAST(p_partkey AS STRING) || '</loc></url>'
       || '<url><loc>https://shop.example/product/child0</loc></url></urlset>' AS body
FROM {part} WHERE p_partkey % 50 = 0
"""

# Robots bodies: two fetches per host of the page table, of which the newer counts.
SQL["robots"] = """
SELECT host, http_status, body, CAST('2026-09-20 12:00:00' AS TIMESTAMP) AS fetched_at FROM robots_now
UNION ALL SELECT host, CAST((CASE WHEN length(host) % 3 = 0 THEN 500 ELSE 200 END) AS INT), 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'Crawl-delay: 99',
       CAST('2026-09-19 12:00:00' AS TIMESTAMP) FROM robots_now
"""
SQL["robots_now"] = """
SELECT host, n_pages,
       CAST((CASE WHEN length(host) % 7 = 0 THEN 404 WHEN length(host) % 7 = 1 THEN 503 ELSE 200 END) AS INT) AS http_status,
       (CASE length(host) % 4
          WHEN 0 THEN 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || 'Disallow: /en/6 # sixes' || chr(10) || 'Disallow: /*?utm_' || chr(10) || 'Crawl-delay: 3'
          WHEN 1 THEN 'junk line' || chr(10) || 'User-Agent: otherbot' || chr(10) || 'USER-AGENT: shelf' || chr(10) || 'Disallow: /fr' || chr(10) || 'Allow: /fr' || chr(10) || 'Crawl-delay: -1' || chr(13) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /'
          WHEN 2 THEN 'Disallow: /orphan' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow:' || chr(10) || 'Disallow: /*.html$' || chr(10) || 'Crawl-delay: 0.5'
          ELSE 'User-agent: strangebot' || chr(10) || 'Disallow: /' END) AS body
FROM (SELECT lower(regexp_extract(url, '://([^/]+)', 1)) AS host, count(*) AS n_pages FROM {pages} GROUP BY 1) h
"""


def _needs(sql: str) -> list[str]:
    return [n for n in SQL if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql, re.I)]


def with_clause(names: list[str], views: dict[str, str] | None = None) -> str:
    """`WITH` text holding the named tables, everything they need, and further named `views`, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _needs(SQL[name]):
            if need not in ordered:
                visit(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({SQL[n]})" for n in ordered] + [f"{n} AS ({s})" for n, s in (views or {}).items()]
    return "WITH " + ",\n".join(parts)


def duck(text: str) -> str:
    """The DuckDB form: source tables are views of the same name."""
    for t in SOURCES:
        text = text.replace("{" + t + "}", t)
    return text.replace("{@lb}", "{").replace("{@rb}", "}")


def table(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """One of the tables above as a Spark DataFrame; `given` source tables replace the files."""
    text = with_clause([name]) + f"\nSELECT * FROM {name}"
    used = [t for t in SOURCES if "{" + t + "}" in text]
    text = text.replace("{@lb}", "{{").replace("{@rb}", "}}")
    return spark.sql(text, **{t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


# Each line: id, label, cents, out of stock, selected.
TABS = [
    ("new", "Brand New", "own_cents + 2000", "k % 8 = 2", "coalesce(condition_label = 'Brand New', FALSE)"),
    ("grade-a", "Refurbished – Excellent", "own_cents", "FALSE", "coalesce(condition_label = 'Refurbished – Excellent', FALSE)"),
    ("grade-b", "Refurbished – Good", "CASE WHEN k % 3 = 0 THEN own_cents + 700 ELSE own_cents - 500 END", "k % 5 = 0", "coalesce(condition_label = 'Refurbished – Good', FALSE)"),
    ("grade-c", "Refurbished – Fair", "CASE WHEN k % 7 = 1 THEN NULL ELSE own_cents - 1000 END", "FALSE", "FALSE"),
    ("bundle", "With bag", "own_cents + 5", "FALSE", "FALSE"),
]
# Specification rows in order: label, value.
SPEC_ROWS = [
    ("'Brand'", "p_brand"),
    ("CASE WHEN k % 4 = 3 THEN 'Colour' ELSE 'EAN' END", "CAST(gtin_body AS STRING)"),
    ("'Size'", "CAST(p_size AS STRING) || ' cm'"),
    (
        "CASE k % 4 WHEN 0 THEN 'Plug Type' WHEN 1 THEN 'Connectivity' WHEN 2 THEN 'Model' ELSE 'In the box' END",
        "CASE k % 4 WHEN 0 THEN 'UK 3-pin plug' WHEN 1 THEN 'Bluetooth 5.3, Wi-Fi' WHEN 2 THEN 'SM-L305 (LTE)' ELSE 'Unit, manual' END",
    ),
    ("'Extras'", "CASE WHEN k % 2 = 0 THEN 'BT remote' ELSE 'none' END"),
    ("CASE WHEN k % 5 = 0 THEN 'Cellular' ELSE 'Weight' END", "CASE WHEN k % 5 = 0 THEN 'No' ELSE '1 kg' END"),
]


def plain_text(c: str) -> str:
    """Text reduced to letters, digits and simple marks, so that it needs no escaping in markup."""
    # One class of ASCII letters and digits: Java's engine is some nine times as quick with it as with their three ranges.
    return f"regexp_replace({c}, '[^\\\\p{{Alnum}} .,]+', ' ')"


def _page_price(cents: str) -> str:
    whole = f"CAST(floor(({cents}) / 100) AS BIGINT)"
    grouped = f"CASE WHEN {whole} >= 1000 THEN CAST(CAST(floor({whole} / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST({whole} % 1000 AS STRING), 3, '0') ELSE CAST({whole} AS STRING) END"
    return f"('£' || {grouped} || '.' || lpad(CAST(({cents}) % 100 AS STRING), 2, '0'))"


def _page_html() -> str:
    """Markup of a product page that carries one row of `facts`, in the many shapes such pages take."""
    amount = "CAST(CAST(ld_cents AS DOUBLE) / 100 AS STRING)"
    text = lambda key, value: f"coalesce(',\"{key}\":\"' || {value} || '\"', '')"
    link = "'https://cdn.example/' || CAST(k AS STRING) || '-' || CAST(i AS STRING) || '.jpg'"
    images = (
        "CASE ld_images WHEN 0 THEN (CASE WHEN k % 2 = 0 THEN '' ELSE ',\"image\":[]' END)"
        " WHEN 1 THEN ',\"image\":\"https://cdn.example/' || CAST(k AS STRING) || '-1.jpg\"'"
        f" ELSE ',\"image\":[' || array_join(transform(slice(sequence(1, 5), 1, CAST(ld_images AS INT)), i -> CASE WHEN i % 2 = 0 THEN '{{\"url\":\"' || {link} || '\"}}' ELSE '\"' || {link} || '\"' END), ',') || ']' END"
    )
    price = (
        f"CASE WHEN ld_cents IS NULL THEN '' WHEN k % 4 = 2 THEN ',\"lowPrice\":' || {amount}"
        f" WHEN k % 4 = 3 THEN ',\"priceSpecification\":{{\"price\":\"' || {amount} || '\"}}' ELSE ',\"price\":\"' || {amount} || '\"' END"
    )
    availability = (
        "CASE offer_availability WHEN 'in_stock' THEN ',\"availability\":\"https://schema.org/InStock\"'"
        " WHEN 'out_of_stock' THEN (CASE WHEN k % 2 = 0 THEN ',\"availability\":\"SoldOut\"' ELSE ',\"availability\":\"https://schema.org/Discontinued\"' END)"
        " WHEN 'preorder' THEN ',\"availability\":\"http://schema.org/BackOrder\"' ELSE '' END"
    )
    condition = (
        "CASE offer_condition WHEN 'refurbished' THEN ',\"itemCondition\":\"https://schema.org/RefurbishedCondition\"'"
        " WHEN 'used' THEN (CASE WHEN k % 2 = 0 THEN ',\"itemCondition\":\"DamagedCondition\"' ELSE ',\"itemCondition\":\"UsedCondition\"' END)"
        " WHEN 'new' THEN ',\"itemCondition\":\"https://schema.org/NewCondition\"' ELSE ',\"itemCondition\":null' END"
    )
    flags = (
        "CASE WHEN has_return_policy THEN ',\"hasMerchantReturnPolicy\":{\"days\":30}' ELSE ',\"hasMerchantReturnPolicy\":null' END"
        " || CASE WHEN has_shipping_details THEN ',\"shippingDetails\":[{\"rate\":0}]' WHEN k % 2 = 0 THEN ',\"shippingDetails\":false' ELSE '' END"
    )
    offer = f"'{{\"priceCurrency\":\"GBP\"' || {price} || {availability} || {condition} || {text('priceValidUntil', 'valid_until')} || {flags} || '}}'"
    offers = f"CASE WHEN NOT has_offer THEN '' WHEN k % 4 = 1 THEN ',\"offers\":[{{\"price\":\"99999\"}},' || {offer} || ',{{\"price\":\"call\"}}]' ELSE ',\"offers\":' || {offer} END"
    # An unpriced offer sorts after the dear one of the list, so these pages name a price.
    sku = "CASE WHEN k % 4 = 0 THEN ',\"sku\":' || CAST(k AS STRING) ELSE ',\"sku\":\"SKU' || CAST(k AS STRING) || '\"' END"
    gtin = (
        "coalesce(CASE k % 3 WHEN 0 THEN ',\"gtin8\":\"999\",\"gtin13\":\"' WHEN 1 THEN ',\"gtin\":\" ' ELSE ',\"gtin13\":\" \",\"gtin12\":\"' END || gtin || '\"', '')"
    )
    brand = "coalesce(CASE WHEN k % 2 = 0 THEN ',\"brand\":\"' || brand || '\"' ELSE ',\"brand\":{\"@type\":\"Brand\",\"name\":\"' || brand || '\"}' END, '')"
    kind = "CASE WHEN k % 2 = 0 THEN '\"Product\"' ELSE '[\"Thing\",\"Product\"]' END"
    node = f"'{{\"@type\":' || {kind} || {text('name', 'ld_name')} || {sku} || {gtin} || {brand} || {text('description', plain_text('ld_description'))} || {images} || {offers} || '}}'"
    block = (
        f"CASE WHEN NOT has_ld THEN '<script type=\"application/ld+json\">{{\"@type\":\"WebPage\"}}</script>' ELSE '<script type=\"application/ld+json\">' || CASE k % 3 WHEN 0 THEN {node}"
        f" WHEN 1 THEN '{{\"@context\":\"x\",\"@graph\":[{{\"@type\":\"WebPage\"}},' || {node} || ']}}' ELSE '[[' || {node} || ']]' END || '</script>' END"
    )
    broken = "CASE WHEN k % 5 = 0 THEN '<script type=\"application/ld+json\">{\"@type\":\"Product\",}</script>' ELSE '' END"
    crumbs = (
        "CASE WHEN k % 2 = 0 THEN coalesce('<p data-testid=\"pdp-category-trail\">Category: ' || replace(category_path, '>', '&gt;') || '</p>', '')"
        " ELSE '<nav data-testid=\"breadcrumb-trail\"><a>Home</a>' || coalesce(array_join(transform(split(category_path, ' > '), c -> '<span>/</span><li><a> ' || c || ' </a>'), ''), '') || '<span>' || full_name || '</span></nav>' END"
    )
    shown = "coalesce(gallery_image_count, 0)"
    gallery = (
        "'<div data-testid=\"image-gallery\">' || repeat('<img src=\"/a.jpg\" alt=\" \">', CAST(least(images_missing_alt, " + shown + ") AS INT))"
        " || repeat('<img src=\"/b.jpg\" alt=\"ok\"/>', CAST(" + shown + " - least(images_missing_alt, " + shown + ") AS INT))"
        " || repeat('<button data-testid=\"image-gallery-thumb\"></button>', CAST(k % 4 AS INT)) || '</div>'"
    )
    block_price = (
        f"CASE WHEN visible_cents IS NULL THEN '' ELSE '<div data-testid=\"pdp-price-block\">' || CASE WHEN k % 3 = 0 THEN '<b>' ELSE '<b data-testid=\"condition-price\">' END || {_page_price('visible_cents')} || '</b>'"
        f" || coalesce('<s class=\"old line-through\">' || {_page_price('was_cents')} || '</s>', '') || '</div>' END"
    )
    tabs = " || ".join(
        f"'<button aria-checked=\"' || CASE WHEN {sel} THEN 'true' ELSE 'false' END || '\" data-testid=\"condition-tab-{i}\">{lab}' || coalesce({_page_price(c)}, '') || CASE WHEN {oos} THEN 'Out of stock' ELSE '' END || '</button>'"
        for i, lab, c, oos, sel in ((i, lab, f"({c})", oos, sel) for i, lab, c, oos, sel in TABS)
    )
    spec = lambda lab, val: f"CASE WHEN k % 2 = 0 THEN '<dt>' || {lab} || ':<dd> ' || {val} ELSE '<div><dt> ' || {lab} || '</dt><dd>' || {val} || '</dd></div>' END"
    specs = f"array_join(slice(array({', '.join(spec(lab, val) for lab, val in SPEC_ROWS)}), 1, CAST(CASE WHEN specs_absent THEN 0 ELSE n_specs END AS INT)), '')"
    label = "coalesce(CASE WHEN k % 2 = 0 THEN '<span data-testid=\"sticky-atc-condition-chip\">' ELSE '<i data-testid=\"condition-trust-badge-top\">' END || condition_label || CASE WHEN k % 2 = 0 THEN '</span>' ELSE '</i>' END, '')"
    parts = [
        "'<!doctype html><html><head><title>' || title_tag || chr(10) || '</title>'",
        "coalesce('<meta name=\"description\" content=\"' || meta_description || '\">', '')",
        "coalesce('<link rel=\"canonical\" href=\"' || canonical || '\">', '')",
        "coalesce('<meta property=\"og:image\" content=\"' || og_image || '\"/>', '')",
        "coalesce('<meta name=\"robots\" content=\"' || robots_meta || '\">', '')",
        broken, block, "'</head><body>'", crumbs, gallery,
        "repeat('<h1>' || full_name || ' </h1>', CAST(h1_count AS INT))",
        block_price,
        "CASE WHEN out_of_stock_notice THEN '<form data-testid=\"back-in-stock-form\"><input></form>' ELSE '' END",
        f"CASE WHEN has_tabs AND NOT variants_absent THEN {tabs} ELSE '' END",
        label,
        "coalesce('<div><p data-testid=\"condition-details-notes\">' || condition_notes || '</div>', '')",
        f"coalesce('<div data-testid=\"pdp-description\"><p>' || CASE WHEN k % 2 = 1 THEN 'Description &nbsp; ' ELSE '' END || {plain_text('description')} || '</div>', '')",
        f"'<dl data-testid=\"pdp-specs\">' || {specs} || '</dl>'",
        "'<section data-testid=\"reviews\"><dl><dt>Plug<dd>European plug</dl><img src=\"/r.jpg\"><s class=\"line-through\">£1</s></section></body></html>'",
    ]
    return " || ".join(f"({p})" for p in parts)


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url, html): a product page for each part."""
    return table(spark, sf_dir, "facts").selectExpr("k AS id", "url", f"{_page_html()} AS html")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marketplace items with their postage options as an array."""
    option = lambda c: f"CASE WHEN {c} IS NOT NULL THEN named_struct('type', 'FIXED', 'cost', {c}) END"
    return table(spark, sf_dir, "items").selectExpr(
        "*", f"filter(array({option('postage1')}, {option('postage2')}), o -> o IS NOT NULL) AS shipping_options"
    ).drop("postage1", "postage2")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested listing records (schemas.LISTING) with `id`, `name`, `brand` and the other product columns."""
    f = table(spark, sf_dir, "facts")
    pounds = lambda c: f"CAST({c} AS DOUBLE) / 100"
    images = "transform(slice(sequence(1, 5), 1, CAST(ld_images AS INT)), i -> 'https://cdn.example/' || CAST(k AS STRING) || '-' || CAST(i AS STRING) || '.jpg')"
    offer = (
        f"named_struct('price', {pounds('ld_cents')}, 'currency', 'GBP', 'availability', offer_availability, 'condition', offer_condition,"
        " 'price_valid_until', valid_until, 'has_return_policy', has_return_policy, 'has_shipping_details', has_shipping_details)"
    )
    ld = (
        "CASE WHEN has_ld THEN named_struct('name', ld_name, 'sku', sku, 'gtin', gtin, 'mpn', CAST(NULL AS STRING), 'brand', brand,"
        f" 'description', ld_description, 'images', {images}, 'offer', CASE WHEN has_offer THEN {offer} END) END"
    )
    tabs = ", ".join(
        f"named_struct('id', '{i}', 'label', '{lab}', 'price', {pounds('(' + c + ')')}, 'out_of_stock', {oos}, 'selected', {sel})"
        for i, lab, c, oos, sel in TABS
    )
    specs = ", ".join(f"named_struct('label', {lab}, 'value', {val})" for lab, val in SPEC_ROWS)
    return f.selectExpr(
        "k AS id", "url", "slug", "title_tag", "meta_description", "canonical", "og_image", "robots_meta",
        f"{ld} AS json_ld",
        "CASE WHEN has_ld THEN 1 ELSE 0 END AS json_ld_product_count", "h1", "CAST(h1_count AS INT) AS h1_count",
        "split(coalesce(category_path, ''), ' > ') AS breadcrumbs",
        f"{pounds('visible_cents')} AS visible_price", f"{pounds('was_cents')} AS visible_was_price",
        "out_of_stock_notice", "condition_label", "condition_notes",
        f"CASE WHEN variants_absent THEN NULL WHEN has_tabs THEN array({tabs}) ELSE array() END AS condition_variants",
        "description",
        f"CASE WHEN specs_absent THEN NULL ELSE slice(array({specs}), 1, CAST(n_specs AS INT)) END AS specs",
        "CAST(gallery_image_count AS INT) AS gallery_image_count", "CAST(images_missing_alt AS INT) AS images_missing_alt",
        "full_name AS name", "brand", "category_path", "sku", "gtin", "CAST(own_cents / 100.0 AS DECIMAL(10,2)) AS price",
        "offer_availability AS availability",
    )
