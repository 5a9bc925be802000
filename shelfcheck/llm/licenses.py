"""License scan by ordered signature rules.

Texts are lower-cased (A-Z) and read as UTF-8 bytes. A signature is a regular expression with a label, a priority, a
confidence and a keyword; one pass of a keyword automaton finds which keywords a text holds, and only those signatures'
expressions are run. Detections are taken in the order of priority, length and place; one that lies inside an interval
already taken is suppressed, and one that overlaps it in part is kept only for a license of another label.

The base phrases are signatures as well: their words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`) stand consecutively, and their
labels always stay. Null texts count as empty. The score is the highest confidence among what is kept, 0 if nothing is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arena import kept_by_worker
from .textbytes import owner, slices, spans

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# In texts decoded as Latin-1, one character a byte.
_LETTER, _GAP = r"[0-9a-z\x80-\xff]", r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


class Signature(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str  # plain lower-case text that every match holds
    pattern: str
    base: bool = False


#: Phrases whose places are counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: License names: label, SPDX identifier (lower case), and the ways in which a text names the license.
#: In a name `~` stands for any run of separators, and the rest is a regular expression.
NAMES = (
    ("mit", "mit", ("(?:the~)?mit(?:~x11)?~licen[cs]e", "expat~licen[cs]e")),
    ("mit-0", "mit-0", ("mit~no~attribution(?:~licen[cs]e)?",)),
    ("apache-1.1", "apache-1.1", ("apache(?:~software)?~licen[cs]e~(?:version~|v~?)?1~1",)),
    ("apache-2.0", "apache-2.0", ("apache(?:~software)?~licen[cs]e~(?:version~|v~?)?2(?:~0)?", "apache~2(?:~0)?~licen[cs]e")),
    ("gpl-2.0", "gpl-2.0(?:-only|-or-later)?", ("gnu~general~public~licen[cs]e~(?:version~|v~?)2(?:~0)?", "gnu~gpl~?v~?2", "gpl~?v~?2")),
    ("gpl-3.0", "gpl-3.0(?:-only|-or-later)?", ("gnu~general~public~licen[cs]e~(?:version~|v~?)3(?:~0)?", "gnu~gpl~?v~?3", "gpl~?v~?3")),
    ("gpl-1.0", "gpl-1.0(?:-only|-or-later)?", ("gnu~general~public~licen[cs]e~(?:version~|v~?)1(?:~0)?",)),
    ("lgpl-2.1", "lgpl-2.1(?:-only|-or-later)?", ("(?:gnu~)?(?:lesser|library)~general~public~licen[cs]e~(?:version~|v~?)2(?:~[01])?", "lgpl~?v~?2(?:~1)?")),
    ("lgpl-3.0", "lgpl-3.0(?:-only|-or-later)?", ("(?:gnu~)?lesser~general~public~licen[cs]e~(?:version~|v~?)3(?:~0)?", "lgpl~?v~?3")),
    ("agpl-3.0", "agpl-3.0(?:-only|-or-later)?", ("(?:gnu~)?affero~general~public~licen[cs]e(?:~(?:version~|v~?)3(?:~0)?)?", "agpl~?v~?3")),
    ("gfdl", "gfdl-1.[123](?:-only|-or-later)?", ("gnu~free~documentation~licen[cs]e(?:~(?:version~|v~?)1~[123])?", "gfdl~1~[123]")),
    ("bsd-2-clause", "bsd-2-clause", ("(?:2|two)~clause~bsd(?:~licen[cs]e)?", "bsd~(?:2|two)~clause(?:~licen[cs]e)?", "simplified~bsd~licen[cs]e", "freebsd~licen[cs]e")),
    ("bsd-3-clause", "bsd-3-clause", ("(?:3|three)~clause~bsd(?:~licen[cs]e)?", "bsd~(?:3|three)~clause(?:~licen[cs]e)?", "(?:new|revised|modified)~bsd~licen[cs]e")),
    ("bsd-4-clause", "bsd-4-clause", ("(?:4|four)~clause~bsd(?:~licen[cs]e)?", "bsd~(?:4|four)~clause(?:~licen[cs]e)?", "original~bsd~licen[cs]e")),
    ("0bsd", "0bsd", ("zero~clause~bsd(?:~licen[cs]e)?", "0bsd~licen[cs]e")),
    ("isc", "isc", ("(?:the~)?isc~licen[cs]e",)),
    ("mpl-1.1", "mpl-1.1", ("mozilla~public~licen[cs]e~(?:version~|v~?)?1~1", "mpl~?v?~?1~1")),
    ("mpl-2.0", "mpl-2.0", ("mozilla~public~licen[cs]e~(?:version~|v~?)?2(?:~0)?", "mpl~?v?~?2~0")),
    ("epl-1.0", "epl-1.0", ("eclipse~public~licen[cs]e~(?:version~|v~?)?1(?:~0)?",)),
    ("epl-2.0", "epl-2.0", ("eclipse~public~licen[cs]e~(?:version~|v~?)?2(?:~0)?",)),
    ("cddl-1.0", "cddl-1.0", ("common~development~and~distribution~licen[cs]e(?:~(?:version~|v~?)?1~0)?", "cddl~(?:version~|v~?)?1~0")),
    ("cpl-1.0", "cpl-1.0", ("common~public~licen[cs]e(?:~(?:version~|v~?)?1~0)?",)),
    ("cc0-1.0", "cc0-1.0", ("cc0(?:~1~0)?(?:~universal)?", "creative~commons~(?:cc0|zero)(?:~1~0)?")),
    ("cc-by", "cc-by-[1-4].[05]", ("cc~by~[1-4]~[05]", "creative~commons~attribution~[1-4]~[05]", "creative~commons~attribution~licen[cs]e")),
    ("cc-by-sa", "cc-by-sa-[1-4].[05]", ("cc~by~sa(?:~[1-4]~[05])?", "creative~commons~attribution~share~?alike(?:~[1-4]~[05])?")),
    ("cc-by-nd", "cc-by-nd-[1-4].[05]", ("cc~by~nd(?:~[1-4]~[05])?", "creative~commons~attribution~no~?deriv(?:ative)?s(?:~[1-4]~[05])?")),
    ("cc-by-nc", "cc-by-nc-[1-4].[05]", ("cc~by~nc(?:~[1-4]~[05])?", "creative~commons~attribution~non~?commercial(?:~[1-4]~[05])?")),
    ("cc-by-nc-sa", "cc-by-nc-sa-[1-4].[05]", ("cc~by~nc~sa(?:~[1-4]~[05])?", "creative~commons~attribution~non~?commercial~share~?alike(?:~[1-4]~[05])?")),
    ("cc-by-nc-nd", "cc-by-nc-nd-[1-4].[05]", ("cc~by~nc~nd(?:~[1-4]~[05])?", "creative~commons~attribution~non~?commercial~no~?deriv(?:ative)?s(?:~[1-4]~[05])?")),
    ("unlicense", "unlicense", ("the~unlicense",)),
    ("wtfpl", "wtfpl", ("wtfpl(?:~(?:version~|v~?)?2)?", "what~the~f[a-z*]+~you~want~to~public~licen[cs]e")),
    ("zlib", "zlib", ("zlib(?:~libpng)?~licen[cs]e",)),
    ("bsl-1.0", "bsl-1.0", ("boost~software~licen[cs]e(?:~(?:version~|v~?)?1~0)?",)),
    ("artistic-2.0", "artistic-2.0", ("artistic~licen[cs]e(?:~(?:version~|v~?)?2(?:~0)?)?",)),
    ("eupl-1.2", "eupl-1.[12]", ("european~union~public~licen[cs]e(?:~(?:version~|v~?)?1~[12])?", "eupl~(?:version~|v~?)?1~[12]")),
    ("ofl-1.1", "ofl-1.1", ("(?:sil~)?open~font~licen[cs]e(?:~(?:version~|v~?)?1~1)?",)),
    ("ms-pl", "ms-pl", ("microsoft~public~licen[cs]e",)),
    ("ms-rl", "ms-rl", ("microsoft~reciprocal~licen[cs]e",)),
    ("psf-2.0", "psf-2.0", ("python~software~foundation~licen[cs]e(?:~(?:version~|v~?)?2)?",)),
    ("postgresql", "postgresql", ("postgresql~licen[cs]e",)),
    ("ncsa", "ncsa", ("university~of~illinois~ncsa~open~source~licen[cs]e", "ncsa~open~source~licen[cs]e")),
    ("x11", "x11", ("x11~licen[cs]e",)),
    ("openssl", "openssl", ("openssl~licen[cs]e",)),
    ("php-3.01", "php-3.0(?:1)?", ("php~licen[cs]e(?:~(?:version~|v~?)?3~01?)?",)),
    ("ruby", "ruby", ("ruby~licen[cs]e",)),
    ("w3c", "w3c", ("w3c~software~(?:notice~and~)?licen[cs]e",)),
    ("odbl-1.0", "odbl-1.0", ("open~database~licen[cs]e(?:~(?:version~|v~?)?1~0)?",)),
    ("pddl-1.0", "pddl-1.0", ("public~domain~dedication~and~licen[cs]e",)),
    ("afl-3.0", "afl-[123].[0-2]", ("academic~free~licen[cs]e(?:~(?:version~|v~?)?[123]~[0-2])?",)),
    ("osl-3.0", "osl-[123].[0-2]", ("open~software~licen[cs]e(?:~(?:version~|v~?)?[123]~[0-2])?",)),
    ("ecl-2.0", "ecl-2.0", ("educational~community~licen[cs]e(?:~(?:version~|v~?)?2~0)?",)),
    ("upl-1.0", "upl-1.0", ("universal~permissive~licen[cs]e(?:~(?:version~|v~?)?1~0)?",)),
    ("lppl-1.3c", "lppl-1.3[ac]?", ("latex~project~public~licen[cs]e(?:~(?:version~|v~?)?1~3[ac]?)?",)),
    ("vim", "vim", ("vim~licen[cs]e",)),
    ("sleepycat", "sleepycat", ("sleepycat~licen[cs]e",)),
    ("busl-1.1", "busl-1.1", ("business~source~licen[cs]e(?:~(?:version~|v~?)?1~1)?",)),
    ("sspl-1.0", "sspl-1.0", ("server~side~public~licen[cs]e(?:~(?:version~|v~?)?1~?0?)?",)),
    ("elastic-2.0", "elastic-2.0", ("elastic~licen[cs]e(?:~(?:version~|v~?)?2(?:~0)?)?",)),
)

#: Words before a name that say a text is under it: the confidence rises with what they assert.
GRANTS = (
    (4, 0.98, "licen[cs]ed~(?:to~you~)?under~(?:the~)?(?:terms~of~(?:the~)?)?"),
    (4, 0.95, "(?:released|distributed|published|available|provided|redistributed)~under~(?:the~)?(?:terms~of~(?:the~)?)?"),
    (3, 0.9, "(?:subject~to|covered~by|governed~by|in~accordance~with)~(?:the~)?(?:terms~of~(?:the~)?)?"),
    (2, 0.7, ""),
)

#: Signatures without a name of that list: label, priority, confidence, keyword, pattern.
OTHERS = (
    ("cc0-1.0", 4, 0.97, "creativecommons", r"creativecommons[.]org/publicdomain/zero/1[.]0"),
    ("mit", 4, 0.97, "opensource", r"opensource[.]org/licen[cs]es?/mit"),
    ("apache-2.0", 4, 0.97, "apache", r"apache[.]org/licen[cs]es/licen[cs]e-2[.]0"),
    ("gpl", 4, 0.95, "gnu", r"gnu[.]org/(?:copyleft|licen[cs]es)/gpl"),
    ("lgpl", 4, 0.95, "gnu", r"gnu[.]org/(?:copyleft|licen[cs]es)/lgpl"),
    ("agpl-3.0", 4, 0.95, "gnu", r"gnu[.]org/licen[cs]es/agpl"),
    ("mpl-2.0", 4, 0.97, "mozilla", r"mozilla[.]org/(?:en-us/)?mpl/2[.]0"),
    ("mit", 3, 0.9, "permission", "permission~is~hereby~granted~free~of~charge~to~any~person~obtaining~a~copy"),
    ("isc", 3, 0.9, "permission", "permission~to~use~copy~modify~and~(?:or~)?distribute~this~software~for~any~purpose~with~or~without~fee"),
    ("bsd", 3, 0.85, "redistribution", "redistribution~and~use~in~source~and~binary~forms~with~or~without~modification"),
    ("zlib", 3, 0.9, "altered", "altered~source~versions~must~be~plainly~marked~as~such"),
    ("wtfpl", 3, 0.9, "just", "you~just~do~what~the~f[a-z*]+~you~want~to"),
    ("unlicense", 3, 0.9, "unencumbered", "free~and~unencumbered~software~released~into~the~public~domain"),
    ("public-domain", 3, 0.8, "domain", "(?:dedicated|released|placed)~(?:to|into|in)~the~public~domain"),
    ("proprietary", 3, 0.6, "reserved", "all~rights~reserved"),
    ("proprietary", 3, 0.8, "proprietary", "proprietary~and~confidential"),
    ("cc", 1, 0.5, "creative", "creative~commons(?:~licen[cs]e)?"),
    ("gpl", 1, 0.5, "gpl", "gnu~gpl"),
    ("lgpl", 1, 0.5, "lgpl", "lgpl"),
    ("bsd", 1, 0.5, "bsd", "bsd~licen[cs]e"),
)


def _keyword(name: str) -> str:
    """The longest plain word of a name that every match holds: nothing of groups, sets or optional characters."""
    while (shorter := re.sub(r"\([^()]*\)[?*+]?|\[[^\]]*\][?*+]?|[^)\]]\?", " ", name)) != name:
        name = shorter
    return max(re.findall("[a-z0-9]{2,}", name), key=len)


def _whole(pattern: str) -> re.Pattern:
    return re.compile(f"(?<!{_LETTER})(?:{pattern.replace('~?', f'(?:{_GAP})?').replace('~', _GAP)})(?!{_LETTER})")


def signatures() -> tuple[Signature, ...]:
    """All rules: SPDX identifiers, each name under each grant, and the others."""
    out = [Signature(label, 6, 1.0, phrase.split()[0], phrase.replace(" ", "~"), True) for phrase, label in BASE]
    for label, identifier, names in NAMES:
        out.append(Signature(label, 7, 1.0, "spdx", rf"spdx-licen[cs]e-identifier:[\x20\t]*{identifier.replace('.', '[.]')}"))
        out += [Signature(label, priority, sure, _keyword(name), grant + name) for name in names for priority, sure, grant in GRANTS]
    return (*out, *(Signature(*x) for x in OTHERS))


class Scanner:
    def __init__(self, rules: Sequence[Signature]):
        import ahocorasick

        self.rules = [(r, _whole(r.pattern)) for r in rules]
        self.by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            self.by_keyword.setdefault(r.keyword, []).append(i)
        self.words = ahocorasick.Automaton()
        for k in self.by_keyword:
            self.words.add_word(k, k)
        self.words.make_automaton()

    def candidates(self, text: str) -> list[int]:
        return sorted(i for k in {k for _, k in self.words.iter(text)} for i in self.by_keyword[k])

    def detections(self, text: str) -> list[tuple[int, int, Signature]]:
        return [(m.start(), m.end(), r) for r, p in map(self.rules.__getitem__, self.candidates(text)) for m in p.finditer(text)]


class _Reach:
    """How far any taken interval that begins at one of the first n places reaches: a Fenwick tree of maxima."""

    def __init__(self):
        self.far: dict[int, int] = {}

    def take(self, place: int, end: int, places: int) -> None:
        place += 1
        while place <= places:
            self.far[place] = max(self.far.get(place, 0), end)
            place += place & -place

    def of(self, n: int) -> int:
        far = 0
        while n:
            far = max(far, self.far.get(n, 0))
            n &= n - 1
        return far


def resolved(found: list[tuple[int, int, Signature]]) -> list[tuple[int, int, Signature]]:
    """What stays of the detections: no interval inside one taken before it, nor crossing one of its own label. The work
    grows with the detections and the logarithm of their number."""
    begins = sorted({begin for begin, _, _ in found})
    every, of_label = _Reach(), defaultdict(_Reach)
    kept: list[tuple[int, int, Signature]] = []
    for begin, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        place, own = bisect_left(begins, begin), of_label[rule.label]
        inside = every.of(place + 1) >= end
        crossing = own.of(bisect_left(begins, end)) > begin
        if not inside and not crossing:
            kept.append((begin, end, rule))
            every.take(place, end, len(begins))
            own.take(place, end, len(begins))
    return sorted(kept, key=lambda d: d[:2])


RESULT = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,spans:array<struct<start:bigint,stop:bigint,label:string,confidence:double>>>"


def scan(scanner: Scanner, texts: pa.Array) -> list[dict]:
    out = []
    for raw, at in slices(texts):
        starts, _ = spans(_IS_WORD[raw], at)
        counts = np.bincount(owner(at, starts), minlength=len(at) - 1)
        for n, a, b in zip(counts.tolist(), at[:-1].tolist(), at[1:].tolist()):
            found = scanner.detections(raw[a:b].tobytes().lower().decode("latin-1"))
            base = [d for d in found if d[2].base]
            own = np.searchsorted(starts, a)
            places = np.searchsorted(starts, np.array([a + d[0] for d in base], np.int64)) - own
            kept = resolved(found)
            labels = {d[2].label for d in base}
            out.append(
                {
                    "n_words": n,
                    "n_base": len(base),
                    "first_word": int(places.min()) if base else None,
                    "last_word": int(places.max()) if base else None,
                    "base_labels": ",".join(sorted(labels)),
                    "labels": ",".join(sorted(labels | {d[2].label for d in kept})),
                    "score": max((d[2].confidence for d in [*kept, *base]), default=0.0),
                    "spans": [{"start": s, "stop": e, "label": r.label, "confidence": r.confidence} for s, e, r in kept],
                }
            )
    return out


def scanned(text: Column, rules: Sequence[Signature] | None = None) -> Column:
    """Struct of the counts, labels and score of a text, with the byte spans of the detections that stay. `n_words` counts
    words, `n_base` places of base phrases, `first_word` and `last_word` are the least and largest number of the word at
    which such a place starts (null without one)."""
    own = tuple(rules) if rules is not None else signatures()
    kind = pa.struct(
        [(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
        + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
        + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())])))]
    )

    def run(texts: pa.Array) -> pa.Array:
        scanner = kept_by_worker(("licenses", hash(own)), lambda: Scanner(own))
        return pa.array(scan(scanner, texts), kind)

    return F.arrow_udf(run, RESULT).asNondeterministic()(text)
