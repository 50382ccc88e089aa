import re
from collections import Counter

from trellium.llm import quality
from trellium.llm.queries import QUERIES


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), failed


def check(got, texts):
    assert sorted(map(repr, got)) == sorted(map(repr, texts))


def test_measures_equal_brute_force(odd):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in quality.measure_quality(odd).collect()]
    check(got, [(r.doc_id, *brute(r.text)) for r in odd.collect()])


def test_query_equals_brute_force(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_quality"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(rows[r.doc_id])
        assert not (r.base_failed and r.kept)
        assert r.kept == (not r.base_failed and not any(rule.rejects(quality.Text(rows[r.doc_id])) for rule in quality.RULES))


def test_repeated_windows_that_overlap():
    for text in ("a b c d e " * 3, "a a a a a a a", "a b c d e f a b c d e x", "a b c d e a b c d e"):
        assert quality.Text(text).repeated_words == brute(text)[4]


def test_clean_documents_stay(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    got = QUERIES["op1_quality"](spark, sf).where("not base_failed").join(labels, "doc_id")
    n = got.count()
    assert n and got.where("kept").count() >= 0.97 * n


def test_order_changes_work_not_verdicts(odd):
    order = quality.order_rules(odd)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality.RULES)
    gains = {e.name: e.gain for e in quality.estimate([r.text for r in odd.collect()])}
    assert all(g > 0 for g in gains.values())
    for r in odd.collect():
        t = quality.Text(r.text)
        assert (quality.cascade(order, t) is None) == (quality.cascade(order[::-1], t) is None)


def test_cheap_rejecting_rules_go_first():
    slow = quality.Rule("slow", lambda t: sum(range(20_000)) < 0)
    sure = quality.Rule("sure", lambda t: True)
    found = quality.estimate(["a b"] * 20, [slow, sure])
    assert max(found, key=lambda e: e.gain).name == "sure"


def test_filter_keeps_rows_whole_and_takes_empty_tables(odd, none):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() < odd.count()
    assert quality.keep_good(none).count() == 0 and quality.measure_quality(none).count() == 0
