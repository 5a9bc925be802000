import random
import re

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcheck.llm import licenses

RULES = licenses.signatures()
COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def texts():
    rng = random.Random(6)
    pool = ["mit", "MIT", "license", "License", "apache", "general", "public", "gnu", "lesser", "version", "2.0", "3", "v2", "licensed under the", "é", "cc by-nc 4.0", "creative commons", "bsd", "three clause", "all rights reserved", "spdx-license-identifier: mit", "word", "x"]
    glue = [" ", "  ", "-", "\n", ", ", ".", "_", "", " "]
    out = ["".join(rng.choice(pool) + rng.choice(glue) for _ in range(rng.randint(1, 25))) for _ in range(250)]
    return out + [None, "", "MIT License", "mitlicense", "mit license", "émit license", "mit licenseé", "MIT—License", "filler " * 40_000 + "Apache License", "General Public License " * 3]


def plain(text):
    """Words one by one for the base; every signature tried on every text for the rest."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    raw = low.encode().decode("latin-1")
    found = [(m.start(), m.end(), r) for r in RULES for m in licenses._whole(r.pattern).finditer(raw)]
    kept = []
    for d in sorted(found, key=lambda d: (-d[2].priority, -(d[1] - d[0]), d[0], d[2].label)):
        if not any((a <= d[0] and d[1] <= b) or (d[0] < b and a < d[1] and r.label == d[2].label) for a, b, r in kept):
            kept.append(d)
    own = {label for _, label in base}
    at = [i for i, _ in base]
    score = max([d[2].confidence for d in kept] + [1.0] * bool(base), default=0.0)
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {d[2].label for d in kept})), score)


def test_equals_every_signature_tried(docs_of):
    rows = list(enumerate(texts()))
    found = docs_of(rows).withColumn("labels", F.lit("clash")).select("doc_id", licenses.scanned(F.col("text")).alias("found"))
    got = {r.doc_id: tuple(r.found[c] for c in COLUMNS) for r in found.collect()}
    assert got == {i: plain(t) for i, t in rows}
    assert found.limit(0).count() == 0


@pytest.mark.parametrize("begin", range(0, len(RULES), 40))
def test_keywords_stand_in_whatever_matches(begin):
    """The prefilter may only hide signatures that can't match."""

    @settings(max_examples=2, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.data())
    def each(data):
        for rule in RULES[begin : begin + 40]:
            expanded = rule.pattern.replace("~?", "(?:[ .-])?").replace("~", "[ .-]+")
            text = data.draw(st.from_regex(expanded, fullmatch=True))
            assert rule.keyword in text, (rule, text)

    each()


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0 (the", "apache,apache-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
        ("released under the BSD 3-Clause License", "bsd-3-clause"),
        ("see https://creativecommons.org/publicdomain/zero/1.0/", "cc0-1.0"),
        ("MPL-2.0 text; Copyright, all rights reserved", "mpl-2.0,proprietary"),
        ("the mitigation of licenses and gnu herds", ""),
    ],
)
def test_known_lines(text, labels):
    assert licenses.scan(licenses.Scanner(RULES), pa.array([text]))[0]["labels"] == labels


def test_containment_and_priority():
    rule = lambda label, priority: licenses.Signature(label, priority, 0.5, "", "")
    a, b, c = rule("a", 2), rule("b", 1), rule("a", 1)
    assert licenses.resolved([(0, 10, a), (2, 5, b), (8, 12, b), (9, 14, c)]) == [(0, 10, a), (8, 12, b)]
    assert licenses.resolved([(2, 5, a), (0, 10, b)]) == [(0, 10, b), (2, 5, a)]
    assert licenses.resolved([]) == []


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 300 and all(r.keyword for r in RULES)


def test_resolving_equals_every_pair():
    """Whatever the intervals, each detection compared with all kept ones says the same."""
    rng = random.Random(5)
    for _ in range(300):
        rules = [licenses.Signature(rng.choice("abc"), rng.randint(1, 3), 0.5, "", "") for _ in range(5)]
        found = [(a, a + rng.randint(1, 12), rng.choice(rules)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 30)))]
        kept = []
        for d in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
            if not any((a <= d[0] and d[1] <= b) or (d[0] < b and a < d[1] and r.label == d[2].label) for a, b, r in kept):
                kept.append(d)
        assert licenses.resolved(found) == sorted(kept, key=lambda d: d[:2])


def test_a_very_long_text_of_license_lines():
    """150,000 detections in one text: far beyond what comparing all pairs could do."""
    lines = 30_000
    got = licenses.scan(licenses.Scanner(RULES), pa.array(["licensed under the MIT License and the Apache License, version 2.0\n" * lines]))[0]
    assert got["n_base"] == 2 * lines and got["labels"] == "apache,apache-2.0,mit" and len(got["spans"]) >= 2 * lines
