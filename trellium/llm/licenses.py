"""License scans by ordered signature rules.

A rule has a regular expression, a label, a priority and a weight. Keywords are
read off the expression: of each of its sets, every match holds a word. Only
rules with a word of each set in the text run, so nothing that matches is lost.
Where detections overlap, one that lies inside the interval of a detection of
higher rank gives way to it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from re import _constants as code
from re import _parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm.texts import annotate, lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases of the base check, in words, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_WEIGHT = 0.5

# Label | names of the license as a regular expression | address as a regular expression
LICENSES = r"""
apache-2.0 | apache(?: software)? licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)? | apache\.org/licenses/license-2\.0
apache-1.1 | apache(?: software)? licen[cs]e,?(?: version| v\.?)? ?1\.1 | apache\.org/licenses/license-1\.1
apache | apache(?: software)? licen[cs]e | apache\.org/licenses
mit | (?:mit|expat)(?:[ /](?:x11|expat))? licen[cs]e | opensource\.org/licenses/mit
mit-0 | mit(?: no attribution|-0) licen[cs]e | opensource\.org/licenses/mit-0
bsd-2-clause | (?:simplified|2-clause|two-clause|freebsd) bsd licen[cs]e|bsd 2-clause(?: licen[cs]e)? | opensource\.org/licenses/bsd-2-clause
bsd-3-clause | (?:new|revised|modified|3-clause|three-clause) bsd licen[cs]e|bsd 3-clause(?: licen[cs]e)? | opensource\.org/licenses/bsd-3-clause
bsd-4-clause | (?:original|4-clause|four-clause) bsd licen[cs]e|bsd 4-clause(?: licen[cs]e)? | directory\.fsf\.org/wiki/license:bsd-4-clause
0bsd | (?:zero-clause|0-clause|free public) bsd licen[cs]e|0bsd licen[cs]e | opensource\.org/licenses/0bsd
bsd | bsd(?:-style)? licen[cs]e | opensource\.org/licenses/bsd-license
gpl-1.0 | (?:gnu )?general public licen[cs]e,?(?: version| v\.?) ?1(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
gpl-2.0 | (?:gnu )?general public licen[cs]e,?(?: version| v\.?) ?2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | (?:gnu )?general public licen[cs]e,?(?: version| v\.?) ?3(?:\.0)? | gnu\.org/licenses/gpl-3\.0
gpl | (?:gnu )?general public licen[cs]e | gnu\.org/licenses/gpl
lgpl-2.0 | (?:gnu )?library general public licen[cs]e | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
lgpl-2.1 | (?:gnu )?lesser general public licen[cs]e,?(?: version| v\.?) ?2\.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | (?:gnu )?lesser general public licen[cs]e,?(?: version| v\.?) ?3(?:\.0)? | gnu\.org/licenses/lgpl-3\.0
lgpl | (?:gnu )?lesser general public licen[cs]e | gnu\.org/licenses/lgpl
agpl-3.0 | (?:gnu )?affero general public licen[cs]e,?(?: version| v\.?) ?3(?:\.0)? | gnu\.org/licenses/agpl-3\.0
agpl | (?:gnu )?affero general public licen[cs]e | affero\.org/oagpl
gfdl-1.3 | (?:gnu )?free documentation licen[cs]e,?(?: version| v\.?) ?1\.3 | gnu\.org/licenses/fdl-1\.3
gfdl | (?:gnu )?free documentation licen[cs]e | gnu\.org/(?:licenses/fdl|copyleft/fdl)
mpl-1.1 | mozilla public licen[cs]e,?(?: version| v\.?) ?1\.1 | mozilla\.org/mpl/(?:mpl-)?1\.1
mpl-2.0 | mozilla public licen[cs]e,?(?: version| v\.?) ?2(?:\.0)? | mozilla\.org/mpl/2\.0
mpl | mozilla public licen[cs]e | mozilla\.org/mpl
epl-1.0 | eclipse public licen[cs]e,?(?: version| v\.?|-v?| -) ?1(?:\.0)? | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse public licen[cs]e,?(?: version| v\.?|-v?| -) ?2(?:\.0)? | eclipse\.org/legal/epl-(?:v20|2\.0)
epl | eclipse public licen[cs]e | eclipse\.org/legal/epl
edl-1.0 | eclipse distribution licen[cs]e | eclipse\.org/(?:org/documents|legal)/edl
cddl-1.0 | common development and distribution licen[cs]e,?(?: version| v\.?) ?1\.0 | opensource\.org/licenses/cddl-1\.0
cddl | common development and distribution licen[cs]e | opensource\.org/licenses/cddl
cpl-1.0 | common public licen[cs]e | opensource\.org/licenses/cpl1\.0
ipl-1.0 | ibm public licen[cs]e | opensource\.org/licenses/ipl-1\.0
isc | isc licen[cs]e | opensource\.org/licenses/isc
zlib | zlib(?:/libpng)? licen[cs]e | (?:zlib\.net/zlib_license|opensource\.org/licenses/zlib)
libpng | libpng licen[cs]e | libpng\.org/pub/png/src/libpng-license
bsl-1.0 | boost software licen[cs]e | boost\.org/license_1_0
artistic-1.0 | artistic licen[cs]e,?(?: version| v\.?)? ?1(?:\.0)? | opensource\.org/licenses/artistic-1\.0
artistic-2.0 | artistic licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)? | opensource\.org/licenses/artistic-2\.0
artistic | artistic licen[cs]e | perlfoundation\.org/artistic
wtfpl | do what the \w+ you want to public licen[cs]e|wtfpl licen[cs]e | wtfpl\.net
unlicense | the unlicense|unlicense licen[cs]e | unlicense\.org
upl-1.0 | universal permissive licen[cs]e | oss\.oracle\.com/licenses/upl
eupl-1.1 | european union public licen[cs]e,?(?: version| v\.?)? ?1\.1 | joinup\.ec\.europa\.eu/software/page/eupl/licence-eupl-1\.1
eupl-1.2 | european union public licen[cs]e,?(?: version| v\.?)? ?1\.2 | joinup\.ec\.europa\.eu/.{0,40}eupl-1\.2
eupl | european union public licen[cs]e | joinup\.ec\.europa\.eu/.{0,20}eupl
cecill-2.1 | cecill(?: free software)? licen[cs]e(?: agreement)?,?(?: version| v\.?)? ?2\.1 | cecill\.info/licences/licence_cecill_v2\.1
cecill-b | cecill-b(?: free software)? licen[cs]e | cecill\.info/licences/licence_cecill-b
cecill | cecill(?: free software)? licen[cs]e | cecill\.info
ms-pl | microsoft public licen[cs]e | opensource\.org/licenses/ms-pl
ms-rl | microsoft reciprocal licen[cs]e | opensource\.org/licenses/ms-rl
afl-3.0 | academic free licen[cs]e | opensource\.org/licenses/afl-3\.0
osl-3.0 | open software licen[cs]e | opensource\.org/licenses/osl-3\.0
odbl-1.0 | open (?:data commons open )?database licen[cs]e|odbl | opendatacommons\.org/licenses/odbl
odc-by-1.0 | open data commons attribution licen[cs]e | opendatacommons\.org/licenses/by
pddl-1.0 | public domain dedication and licen[cs]e | opendatacommons\.org/licenses/pddl
ogl-uk-3.0 | open government licen[cs]e,?(?: version| v\.?) ?3(?:\.0)? | nationalarchives\.gov\.uk/doc/open-government-licence/version/3
ogl | open government licen[cs]e | nationalarchives\.gov\.uk/doc/open-government-licence
ofl-1.1 | (?:sil )?open font licen[cs]e | scripts\.sil\.org/ofl
psf-2.0 | python software foundation licen[cs]e | docs\.python\.org/.{0,10}license
ruby | ruby licen[cs]e | ruby-lang\.org/.{0,12}license
php-3.01 | php licen[cs]e | php\.net/license/3_01
postgresql | postgresql licen[cs]e | postgresql\.org/about/licen[cs]e
openssl | openssl licen[cs]e | openssl\.org/source/license
curl | curl licen[cs]e | curl\.(?:se|haxx\.se)/docs/copyright
ncsa | (?:university of illinois/)?ncsa open source licen[cs]e | opensource\.org/licenses/ncsa
w3c | w3c (?:software )?(?:notice and )?licen[cs]e | w3\.org/consortium/legal/.{0,30}copyright-software
x11 | x11 licen[cs]e | xfree86\.org/.{0,20}license
elastic-2.0 | elastic licen[cs]e,?(?: version| v\.?)? ?2(?:\.0)? | elastic\.co/licensing/elastic-license
sspl-1.0 | server side public licen[cs]e | mongodb\.com/licensing/server-side-public-license
busl-1.1 | business source licen[cs]e | mariadb\.com/bsl11
blueoak-1.0.0 | blue oak model licen[cs]e | blueoakcouncil\.org/license/1\.0\.0
json | json licen[cs]e | json\.org/license
beerware | beer-?ware licen[cs]e | people\.freebsd\.org/~phk
llama | llama(?: \d)? community licen[cs]e | ai\.meta\.com/llama/license
openrail | (?:creativeml |bigscience )?open ?rail(?:-m)? licen[cs]e | huggingface\.co/spaces/.{0,30}license
"""

# Parts of the family of licenses that share one scheme of names.
CC_PARTS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?derivatives?|no ?derivs?", "nc": "non-?commercial"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Label | weight | regular expression of a notice that names no license
NOTICES = r"""
reserved | 0.6 | all rights (?:are )?(?:strictly )?reserved
reserved | 0.6 | todos los derechos reservados
reserved | 0.6 | tous droits r[ée]serv[ée]s
reserved | 0.6 | alle rechte vorbehalten
copyright | 0.4 | copyright (?:\(c\) |© ?)?(?:19|20)\d\d(?:-(?:19|20)\d\d)?
copyright | 0.4 | © ?(?:19|20)\d\d
copyright | 0.4 | \(c\) ?(?:19|20)\d\d
public-domain | 0.8 | (?:released|placed|dedicated|is|are) (?:in|into|to) the public domain
public-domain | 0.8 | (?:this|the) (?:work|file|code|software) is (?:in the )?public domain
public-domain | 0.8 | (?:ist|sind) gemeinfrei
public-domain | 0.8 | (?:dans|tomb[ée] dans) le domaine public
public-domain | 0.8 | (?:es|son) de dominio p[úu]blico
cc0-1.0 | 1.0 | cc0(?:[ -]1\.0)?(?: universal)?
cc0-1.0 | 1.0 | creativecommons\.org/publicdomain/zero
cc | 0.8 | creative commons(?: licen[cs]e)?
mit | 1.0 | permission is hereby granted, free of charge, to any person obtaining a copy
isc | 1.0 | permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee
bsd | 0.9 | redistribution and use in source and binary forms, with or without modification, are permitted
bsd-3-clause | 0.9 | neither the name of .{1,80}? nor the names of its contributors may be used to endorse
gpl | 0.9 | this program is free software[;:,] you can redistribute it and/or modify it
lgpl | 0.9 | this library is free software[;:,] you can redistribute it and/or modify it
warranty | 0.5 | without (?:any )?warranty of any kind
warranty | 0.5 | (?:provided|distributed) (?:on an )?"as is"
proprietary | 0.8 | (?:proprietary and confidential|confidential and proprietary)
proprietary | 0.8 | unauthorized (?:copying|reproduction|use|distribution) .{0,60}?prohibited
proprietary | 0.7 | may not be reproduced(?:,| or) .{0,80}?permission
noncommercial | 0.8 | for non-commercial (?:use|purposes) only
noncommercial | 0.8 | for noncommercial (?:use|purposes) only
personal-use | 0.7 | for (?:your )?personal use only
research-use | 0.7 | for (?:academic|research)(?: (?:and|or) (?:academic|research))? (?:use|purposes) only
spdx | 0.6 | spdx-license-identifier: ?[a-z0-9.+-]+
eula | 0.7 | end[- ]user licen[cs]e agreement
terms | 0.3 | (?:subject to|see) (?:the|our) terms of use
""".strip("\n")

# Weights of the forms in which a license can be named, and their ranks.
FORMS = (
    ("spdx", 1.0, 60),
    ("notice", 1.0, 50),
    ("address", 0.9, 40),
    ("name", 0.7, 30),
)


Words = tuple[str, ...]


def _telling(words: Words) -> int:
    """How rare the words of a set are: by the shortest one, with other scripts ahead."""
    return min(len(w) + 4 * (not w.isascii()) for w in words)


def _sets_of(parsed) -> list[Words]:
    """Sets of literal words of which every match of a parsed expression holds one each."""
    sets: list[Words] = []
    run = ""
    for op, value in [*parsed, (None, None)]:
        if op is code.LITERAL:
            run += chr(value)
            continue
        if run:
            sets.append((run,))
        run = ""
        if op is code.SUBPATTERN:
            sets += _sets_of(value[-1])
        elif op in (code.MAX_REPEAT, code.MIN_REPEAT) and value[0] > 0:
            sets += _sets_of(value[2])
        elif op is code.BRANCH:
            ways = [_sets_of(way) for way in value[1]]
            if all(ways):
                sets.append(tuple(sorted({w for way in ways for w in max(way, key=_telling)})))
    return sets


def needed_words(pattern: re.Pattern) -> tuple[Words, ...]:
    """The sets of an expression, the rarest first; single letters only where there is nothing else."""
    sets = sorted(set(_sets_of(_parser.parse(pattern.pattern, pattern.flags))), key=lambda s: (-_telling(s), s))
    return tuple(s for k, s in enumerate(sets) if not k or _telling(s) > 1)


@dataclass(frozen=True)
class Rule:
    """``rank`` decides between detections: the higher goes first, then the longer match."""

    label: str
    pattern: re.Pattern
    rank: int
    weight: float
    needed: tuple[Words, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "needed", needed_words(self.pattern))

    @property
    def keyword(self) -> str:
        """A word of the rarest set."""
        return self.needed[0][0]


@dataclass(frozen=True)
class Detection:
    label: str
    start: int
    end: int
    rank: int
    weight: float


def _columns(table: str) -> list[list[str]]:
    """Cells of the rows; a ``|`` between cells has a blank on either side."""
    return [[cell.strip() for cell in line.split(" | ")] for line in table.strip().splitlines()]


def _spaced(pattern: str) -> re.Pattern:
    """A blank of the pattern stands for any run of blanks and line breaks."""
    return re.compile(pattern.replace(" ?", r"\s*").replace(" ", r"\s+"))


def _named_rules(label: str, names: str, address: str, forms: Sequence[tuple[str, float, int]] = FORMS) -> list[Rule]:
    # An exact version outranks its family in the same form.
    exact = 1 if any(c.isdigit() for c in label) else 0
    grant = (
        rf"(?:licen[cs]ed|released|distributed|published|available|covered|provided)"
        rf" (?:under|by|with|according to)(?: the)?(?: terms of)?(?: the)? (?:{names})"
    )
    patterns = {
        "spdx": rf"spdx-license-identifier: ?{re.escape(label)}(?:-only|-or-later|\+)?(?![\w.-])",
        "notice": grant,
        "address": address,
        "name": rf"(?<![a-z0-9])(?:{names})",
    }
    return [Rule(label, _spaced(patterns[form]), rank + exact, weight) for form, weight, rank in forms]


def _cc_rules() -> list[Rule]:
    rules = []
    for parts in CC_PARTS:
        short = parts.replace("-", "[- ]")
        full = r"[-\s]+".join(f"(?:{CC_NAMES[p]})" for p in parts.split("-"))
        for version in (*CC_VERSIONS, ""):
            number = rf",?(?: version| v\.?)? ?{re.escape(version)}" if version else ""
            end = r"(?![\w-]|\.\d)" if version else r"(?![\w-])"
            short_name = rf"cc[- ]{short}{number}(?: international| unported)?{end}"
            full_name = rf"creative commons(?: licen[cs]e)? {full}{number}(?: international| unported)?{end}"
            address = rf"creativecommons\.org/licenses/{parts}/{re.escape(version)}"
            label = f"cc-{parts}-{version}".rstrip("-")
            # A name with more parts outranks the shorter one that it begins with.
            longer = 2 * parts.count("-")
            named = _named_rules(label, short_name, address)
            named += _named_rules(label, full_name, address, [f for f in FORMS if f[0] in ("notice", "name")])
            rules += [Rule(r.label, r.pattern, r.rank + longer, r.weight) for r in named]
    return rules


def build_rules() -> list[Rule]:
    rules = [rule for row in _columns(LICENSES) for rule in _named_rules(*row)]
    rules += _cc_rules()
    rules += [Rule(label, _spaced(pattern), 20, float(weight)) for label, weight, pattern in _columns(NOTICES)]
    return rules


RULES = build_rules()
# Words that stand in many keywords; where one stands in all words of a set, it may be looked for instead.
STEMS = ("licen", "permi", "rights", "copyright", "domain", "warranty", "software")


def build_gate(rules: Sequence[Rule]) -> Words:
    """Words of which every match of every rule holds one: stems, and the rarest sets of rules without one."""
    stemmed = lambda rule: next((x for x in STEMS if any(all(x in w for w in s) for s in rule.needed)), None)
    stems = {x for x in map(stemmed, rules) if x}
    return (*sorted(stems), *sorted({w for rule in rules if not stemmed(rule) for w in rule.needed[0]}))


def group_rules(rules: Sequence[Rule]) -> list[tuple[Words, list[Rule]]]:
    """Rules by their rarest set."""
    groups: dict[Words, list[Rule]] = {}
    for rule in rules:
        groups.setdefault(rule.needed[0], []).append(rule)
    return list(groups.items())


GATE = build_gate(RULES)
GROUPS = group_rules(RULES)


class _FurthestEnd:
    """The largest end of the intervals that start at or before a place, in logarithmic time."""

    def __init__(self, starts: Sequence[int]):
        self.starts = sorted(set(starts))
        self.ends = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i

    def before(self, start: int) -> int:
        i, best = bisect_right(self.starts, start), -1
        while i:
            best = max(best, self.ends[i])
            i -= i & -i
        return best


def suppress(found: list[Detection]) -> list[Detection]:
    """Detections that lie in no interval of one of higher rank, by start.

    Of one rank the longer stands, then the first. What lies in a suppressed interval
    lies in the one that suppressed it, so only those that stay are looked at.
    """
    kept: list[Detection] = []
    furthest = _FurthestEnd([d.start for d in found])
    for d in sorted(found, key=lambda d: (-d.rank, d.start - d.end, d.start, d.label)):
        if furthest.before(d.start) < d.end:
            kept.append(d)
            furthest.add(d.start, d.end)
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


def detect(text: str) -> list[Detection]:
    """License detections of an ASCII-lower-cased text; overlaps are resolved."""
    if not any(word in text for word in GATE):
        return []
    known: dict[Words, bool] = {}

    def has(words: Words) -> bool:
        if words not in known:
            known[words] = any(word in text for word in words)
        return known[words]

    found = [
        Detection(rule.label, m.start(), m.end(), rule.rank, rule.weight)
        for first, rules in GROUPS
        if has(first)
        for rule in rules
        if all(map(has, rule.needed[1:]))
        for m in rule.pattern.finditer(text)
    ]
    return suppress(found)


_BASE_WORDS = [(phrase.split(), label) for phrase, label in BASE.items()]


def base_places(text: str, words: list[str]) -> list[tuple[int, str]]:
    """First word and label of every place of a base phrase."""
    places = []
    for phrase, label in _BASE_WORDS:
        if all(word in text for word in phrase):
            first, n = phrase[0], len(phrase)
            places += [(i, label) for i, w in enumerate(words) if w == first and words[i : i + n] == phrase]
    return places


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, word and base-phrase counts, ``detections`` and ``score`` of each row.

    The score is the largest weight of a detection or base phrase, 0 without
    any. A null or empty text has no words and detections. Rows stay as many as
    they are, with null ids and repeats; an empty table gives none. Nothing is
    shuffled.
    """

    def start():
        def one(value):
            lower = lower_ascii(value or "")
            words = WORD.findall(lower)
            places = base_places(lower, words)
            found = detect(lower)
            at = [i for i, _ in places]
            return (
                len(words), len(places), min(at, default=None), max(at, default=None),
                sorted({label for _, label in places}),
                [{"label": d.label, "start": d.start, "end": d.end, "weight": d.weight} for d in found],
                max([d.weight for d in found] + [BASE_WEIGHT] * bool(places), default=0.0),
            )

        return lambda texts: list(zip(*map(one, texts))) or [[]] * 7

    return annotate(
        docs, [id], text,
        "n_words long, n_base long, first_word long, last_word long, base array<string>, "
        "detections array<struct<label:string,start:long,end:long,weight:double>>, score double",
        start,
    )


def digest(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """Labels as text: those of the base phrases, and those with the detections'."""
    labels = F.array_union("base", F.transform("detections", lambda d: d["label"]))
    return scanned.select(
        id, "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        "score",
        F.size("detections").cast("long").alias("n_detections"),
    )
