"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Mapping

WORDS = r"[^\x20\x09-\x0D]+"


def quality(covered: Mapping[int, float], in_lines: float, least_words: int, window: int, most_percent: int) -> str:
    """Counts of every text's words, lines and n-grams by grouping, without hashes."""
    lengths = sorted({*covered, window})
    grams = "\n".join(
        f""", gram{n} as (select doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') as gram
            from (select doc_id, ws, unnest(range(1, len(ws) - {n} + 2)) as i from words where len(ws) >= {n}))
        , shared{n} as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as times from gram{n}) where times > 1)
        , covered{n} as (select doc_id, sum(len(w)) as chars, count(*) as n from (
            select distinct s.doc_id, s.i + k as p, ws[s.i + k] as w from (select doc_id, i, unnest(range({n})) as k from shared{n}) s join words using (doc_id)) group by doc_id)"""
        for n in lengths
    )
    within = " and ".join(f"coalesce(covered{n}.chars, 0) <= {share} * word_chars" for n, share in covered.items())
    joins = " ".join(f"left join covered{n} using (doc_id)" for n in lengths)
    return rf"""
        with words as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORDS}') as ws from documents)
        , base as (select doc_id, len(ws)::bigint as n_words, len(array_to_string(ws, ''))::bigint as word_chars,
            len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols from words)
        , lines as (select doc_id, sum(times - 1)::bigint as n_dup_lines, sum((times - 1) * chars) as chars from (
            select doc_id, line, count(*) as times, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars
            from (select doc_id, unnest(string_split(text, chr(10))) as line from words) where regexp_matches(line, '{WORDS}') group by doc_id, line) group by doc_id)
        {grams}
        , measured as (select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
            coalesce(covered{window}.n, 0)::bigint as n_repeat_words,
            n_words < {least_words} or 100 * coalesce(covered{window}.n, 0) > {most_percent} * n_words as base_failed,
            coalesce(lines.chars, 0) <= {in_lines} * word_chars and {within} as passed
            from base left join lines using (doc_id) {joins})
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and passed as kept from measured"""


def url_rules(rules, patterns) -> str:
    """Every list rule and every pattern rule tried on every URL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    listed = ", ".join(f"({text(r.rule)}, {text(r.rule.partition('/')[0])}, {text('/' + r.rule.partition('/')[2])}, {text(r.verdict)})" for r in rules)
    matches = " or ".join(f"regexp_matches(lower(url), {text(p.pattern)})" for p in patterns)
    return rf"""
        with urls as (select page_id, url,
            coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
            coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages)
        , rules(rule, rule_host, rule_path, verdict) as (values {listed})
        , fit as (select page_id, arg_max(rule, len(rule)) as rule, arg_max(verdict, len(rule)) as verdict from urls join rules
            on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
        select page_id, host, path, rule, coalesce(verdict, case when {matches} then 'block' else 'allow' end) as verdict
        from urls left join fit using (page_id)"""


WARC = """
    with pages_ as (select page_id, encode(coalesce(html, '')) as payload from pages)
    , copies as (select payload, max(page_id) as response from pages_ group by payload)
    , hashed as (select p.page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as h, c.response from pages_ p join copies c using (payload))
    select page_id, payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::integer >> (5 * (3 - i % 4)))::integer & 31), 1)), '') as payload_digest,
        case when page_id = response then 'response' else 'revisit' end as record_type,
        case when page_id <> response then response end as refers_to
    from hashed"""


#: CRC-32 of a list of bytes, by a table of 256 values made from the polynomial.
_CRC_TABLE = "crc(t) as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)))"


def _crc(octets: str) -> str:
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"


def _tree(name: str, leaves: str, group: str) -> str:
    """Nodes of every level, and for each one that has a level above the digests of its run before and after it."""
    return f"""
        {name}_nodes as (select {group} as grp, 0 as level, number, leaf as digest, size from {leaves}
            union all select grp, level + 1, number // 8, sha256(string_agg(digest, '' order by number)), (size + 7) // 8
                from {name}_nodes where size > 1 group by grp, level, number // 8, size)
        , {name}_steps as (select a.grp, a.level, a.number, coalesce(string_agg(b.digest, '' order by b.number) filter (b.number < a.number), '') || '|' ||
                coalesce(string_agg(b.digest, '' order by b.number) filter (b.number > a.number), '') as step
            from {name}_nodes a join {name}_nodes b on a.grp is not distinct from b.grp and a.level = b.level and a.number // 8 = b.number // 8
            where a.size > 1 group by a.grp, a.level, a.number)
        , {name}_paths as (select l.grp, l.number, list(step order by s.level) filter (step is not null) as path from
            (select grp, number from {name}_nodes where level = 0) l left join {name}_steps s on l.grp is not distinct from s.grp and s.number = l.number // (8 ** s.level)::bigint group by l.grp, l.number)
        , {name}_roots as (select grp, digest from {name}_nodes where size = 1)"""


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::varchar)) || ':' || {column}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""
    with recursive {_CRC_TABLE}
    , made as (select doc_id, lang, {_leaf("text")} as leaf, case when {_crc("list_transform(range(len(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, (i + 1)::integer, 1))::bigint)")} % 3 = 0
        then {_leaf(_LOWERED.format("text"))} end as tampered from documents, crc)
    , leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as number, count(*) over (partition by lang) as size from made)
    , {_tree("low", "leaves", "lang")}
    , tops as (select grp as lang, digest as leaf, row_number() over (order by grp nulls first) - 1 as number, count(*) over () as size from low_roots)
    , {_tree("high", "tops", "0")}
    , found as (select doc_id, l.leaf, coalesce(tampered, l.leaf) as start, t.leaf as subroot, r.digest as root,
            list_concat(coalesce(lp.path, []), coalesce(hp.path, [])) as path
        from leaves l join low_paths lp on l.lang is not distinct from lp.grp and l.number = lp.number
        join tops t on l.lang is not distinct from t.lang join high_paths hp on t.number = hp.number, high_roots r)
    , folded as (select *, list_reduce(path, lambda node, w: sha256(split_part(w, '|', 1) || node || split_part(w, '|', 2)), start) as folded_root from found)
    select doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) as proof_sha256, folded_root, folded_root = root as verified from folded"""

SPELLING = f"""
    with recursive {_CRC_TABLE}
    , runs as (select doc_id, {_LOWERED.format("run")} as run, count(*) as k from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by all)
    , keyed as (select run, k, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as octets from runs where len(run) >= 7)
    , hashed as (select run, k, {_crc("list_transform(range(len(octets) // 2), lambda i: ('0x' || substr(octets, (2 * i + 1)::integer, 2))::bigint)")} as h from keyed, crc)
    , slipped as (select case when h % 31 = 0 then substr(run, 1, (h % len(run))::integer) || substr(run, (h % len(run))::integer + 2) else run end as word, k from hashed)
    , words as materialized (select word, sum(k)::bigint as n from slipped where len(word) >= 7 group by word having sum(k) >= 2)
    , places as (select word, unnest(range(1, len(word) + 1)) as i from words)
    , gaps as materialized (select distinct word, substr(word, 1, (i - 1)::integer) || substr(word, (i + 1)::integer) as less from places)
    , masks as materialized (select word, substr(word, 1, (i - 1)::integer) || '*' || substr(word, (i + 1)::integer) as mask from places)
    , pairs as (select a.word, b.word as near from masks a join masks b on a.mask = b.mask and a.word <> b.word
        union select g.word, w.word from gaps g join words w on g.less = w.word union select w.word, g.word from gaps g join words w on g.less = w.word)
    , ranked as (select p.word, p.near, w.n as near_n, row_number() over (partition by p.word order by w.n desc, p.near) as place, count(*) over (partition by p.word) as n_near from pairs p join words w on w.word = p.near)
    , known as materialized (select w.word, w.n, coalesce(r.n_near, 0)::bigint as n_near, case when near_n >= 10 * w.n then near end as form, case when near_n >= 10 * w.n then near_n end as form_n
        from words w left join ranked r on r.word = w.word and r.place = 1)
    , chain as (select word, word as at, form as next from known union all select c.word, k.word, k.form from chain c join known k on k.word = c.next)
    select k.word, form, c.at as root, n, n_near, form_n from known k join chain c on c.word = k.word and c.next is null"""
