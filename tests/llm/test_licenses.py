import random
import re
import time

from trellium.llm import licenses
from trellium.llm.queries import QUERIES

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def brute(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def labels(text):
    return {d.label for d in licenses.detect(licenses.lower_ascii(text))}


def test_there_are_hundreds_of_rules():
    assert len(licenses.RULES) > 300


def test_names():
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by-nc-4.0"}
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert labels("Released under the MIT License.") == {"mit"}
    assert labels("GNU Lesser General Public License v2.1") == {"lgpl-2.1"}
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == {"gpl-2.0"}
    assert labels("https://creativecommons.org/licenses/by-sa/4.0/") == {"cc-by-sa-4.0"}
    assert labels("Creative Commons\nAttribution-ShareAlike 4.0 International") == {"cc-by-sa-4.0"}
    assert labels("a permit licensee drives, commits a crime; general public") == set()


def test_the_gate_loses_nothing():
    for rule in licenses.RULES:
        for text in ("licensed under the apache license 2.0", "© 2020 x", "0bsd license", "bsd 2-clause", "the unlicense",
                     "wtfpl license", "cc by-nc 4.0", "odbl", "openrail license", "cc0", "provided \"as is\"", "beerware license"):
            if rule.pattern.search(text) and rule.keyword in text:
                assert any(word in text for word in licenses.GATE), (rule, text)


def unfiltered(text):
    return licenses.suppress([
        licenses.Detection(r.label, m.start(), m.end(), r.rank, r.weight) for r in licenses.RULES for m in r.pattern.finditer(text)
    ])


def test_keywords_are_in_every_match():
    """Detection behind keywords equals all expressions run on every text, wrapped and odd wordings too."""
    texts = [
        "distributed without any warranty of any kind", "unauthorized reproduction of this text is prohibited", "all rights are reserved",
        "end-user license agreement", "wtfpl license", "ncsa open source license", "odbl", "gnu general\npublic license version 2",
        "this program is free\nsoftware; you can redistribute it and/or modify it", "cc\tby-nc 4.0", "todos los derechos\nreservados",
        "tous droits\nréservés", "copyright\n© 2020", "(c)2019", "mit-0 license", "beerware license", "see the\nterms of  use",
        "creative\ncommons attribution-sharealike 4.0", "openrail-m license", "spdx-license-identifier:mit", "provided \"as\nis\"",
    ]
    for text in texts:
        assert licenses.detect(text) == unfiltered(text) != [], text
    for rule in licenses.RULES:
        assert rule.needed


def test_detection_equals_no_filter_on_the_test_tables(spark, sf):
    found = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(200).collect():
        lower = licenses.lower_ascii(r.text or "")
        # Blanks as line breaks: wrapped headers.
        for text in (lower, lower.replace(" ", "\n")):
            got = licenses.detect(text)
            found += len(got)
            assert got == unfiltered(text)
    assert found


def test_suppression_by_rank_and_containment():
    d = licenses.Detection
    found = licenses.suppress([d("a", 0, 10, 2, 1.0), d("b", 2, 5, 1, 1.0), d("c", 8, 12, 1, 1.0), d("d", 0, 20, 0, 1.0)])
    assert [x.label for x in found] == ["a", "d", "c"]


def test_suppression_equals_pairs_of_detections():
    rng = random.Random(6)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(0, 25)):
            start = rng.randint(0, 20)
            found.append(licenses.Detection(rng.choice("ab"), start, start + rng.randint(1, 12), rng.randint(0, 3), 1.0))
        found = list(dict.fromkeys(found))
        kept = []
        for d in sorted(found, key=lambda d: (-d.rank, d.start - d.end, d.start, d.label)):
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert licenses.suppress(found) == sorted(kept, key=lambda d: (d.start, d.end, d.label))


def test_many_license_lines_take_linear_time():
    start = time.time()
    assert len(licenses.detect("mit license\n" * 100_000)) == 100_000
    assert time.time() - start < 60


def test_query_equals_brute_force(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op4_licenses"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(rows[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.digest(licenses.scan(odd)).collect()]
    assert sorted(map(repr, got)) == sorted(repr((r.doc_id, *brute(r.text))) for r in odd.collect())
    assert licenses.scan(none).count() == 0
