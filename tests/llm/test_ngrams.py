import random
import re

import numpy as np
import pytest

from trellium.llm import ngrams
from trellium.llm.components import components
from trellium.llm.queries import QUERIES
from trellium.llm.work import work


def shingles(text, n):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, n, percent):
    """(doc, size of its set, component) by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(repr((i, len(s), None if i is None else find(i))) for i, s in sets)


def found(frame):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in frame.collect())


def near_copies(seed, bases=8, copies=25):
    """Families of texts with a few changed words, shared passages, and equal texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    passage = " ".join(word() for _ in range(30))
    docs = []
    for _ in range(bases):
        base = [word() for _ in range(rng.choice((6, 40, 90)))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
            docs.append(" ".join(text) + (" " + passage if rng.random() < 0.3 else ""))
    docs += docs[:10] + [None, "", "  ", "one", "ONE", "one two", passage]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 60)])
def test_components_equal_all_pairs(spark, words, percent):
    docs = near_copies(words)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    like = ngrams.Likeness(words, percent)
    assert found(ngrams.link_documents(frame, like)) == brute(docs, words, percent)


@pytest.mark.parametrize("share", [1, 4])
def test_shares_of_hot_shingles_and_digests_change_nothing(spark, monkeypatch, share):
    docs = near_copies(7, bases=4) + [(1000 + i, "the same words in every copy of it") for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(ngrams, "SHARE_ROWS", share)
    assert found(ngrams.link_documents(frame, ngrams.Likeness(3, 80))) == brute(docs, 3, 80)


def test_columns_named_like_helpers_stay(spark):
    rows = [(1, "a b c d e f g", "x", "y", 1), (2, "a b c d e f g", "x", "y", 2), (2, "k l m n o p q", "z", "y", 3), (3, "k l", "w", None, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __bucket string, dropped string, bucket int")
    kept = ngrams.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.bucket for r in kept.collect()) == [1, 4]


def test_pairs_hold_without_centres(spark, monkeypatch):
    """The prefix join alone finds every link."""
    monkeypatch.setattr(ngrams, "_central_pairs", lambda postings, like: postings.select(
        postings.doc.alias("a"), postings.doc.alias("b")).limit(0))
    docs = near_copies(9, bases=5, copies=15)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(ngrams.link_documents(frame, ngrams.Likeness(3, 80))) == brute(docs, 3, 80)


def test_a_centre_is_no_label(spark):
    """10 has no centre and the label 1; 5 has the centre 1 and isn't connected with it: two groups, so 5 and 10 are a pair."""
    rows = [(token, doc, 20, 1, 1, 3) for token in (100, 101) for doc in (1, 5, 10)]
    postings = spark.createDataFrame(rows, "token long, doc long, n long, matches int, level int, df long")
    families = spark.createDataFrame([(1, 5, False, 20, 6, [7])], "a long, b long, linked boolean, n long, differing long, diff array<long>")
    labels = spark.createDataFrame([(1, 1), (10, 1)], "node long, label long")
    got = ngrams._open_pairs(postings, families, labels, ngrams.Likeness(3, 90)).collect()
    # 1 and 10 are connected; 1 and 5 were compared when 5 got its centre.
    assert {(r.a, r.b) for r in got} == {(5, 10)}


def test_chained_families_equal_all_pairs(spark):
    """Texts that drift away from one another step by step, ids in any order, so that centres stand below roots."""
    rng = random.Random(21)
    texts = []
    for c in range(12):
        text = [f"c{c}w{i}" for i in range(40)]
        for step in range(14):
            texts.append(" ".join(text))
            for _ in range(rng.choice((1, 2, 3))):
                text[rng.randrange(40)] = f"c{c}s{step}x{rng.randint(0, 3)}"
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(ngrams.link_documents(frame, ngrams.Likeness(1, 85))) == brute(docs, 1, 85)


def test_a_large_family_is_not_paired(spark, monkeypatch):
    """Copies of one text with a few changes each, many of them just too different: all links, few pairs."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for d in range(500):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        docs.append((d, " ".join(text)))
    seen = []
    save = ngrams.Work.save

    def counted(self, df, name):
        made = save(self, df, name)
        if name == "open":
            seen.append(made.count())
        return made

    monkeypatch.setattr(ngrams.Work, "save", counted)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(ngrams.link_documents(frame, ngrams.Likeness(3, 90))) == brute(docs, 3, 90)
    assert seen[0] < 10 * len(docs)


def test_prefixes_share_as_many_as_they_must():
    rng = random.Random(6)
    like = ngrams.Likeness(1, 80)
    for _ in range(300):
        common = rng.sample(range(1000), rng.randint(5, 60))
        a = sorted({*common, *rng.sample(range(1000, 1100), rng.randint(0, 6))})
        b = sorted({*common, *rng.sample(range(1100, 1200), rng.randint(0, 6))})
        if 100 * len(common) < 80 * len({*a, *b}):
            continue
        for m in range(1, 6):
            pa = set(a[: len(a) - like.required(len(a)) + m])
            pb = set(b[: len(b) - like.required(len(b)) + m])
            assert len(pa & pb) >= m


def test_more_matches_where_candidates_are_dear():
    rare, frequent = np.zeros(100), np.full(100, 5000.0)
    assert ngrams.choose_matches(100, 90, frequent) == ngrams.MOST_MATCHES > ngrams.choose_matches(100, 90, rare)
    assert ngrams.choose_matches(1, 1, np.zeros(1)) == 1


def test_query_equals_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op8_ngrams"](spark, sf)) == brute(docs, 3, 90)


def test_odd_rows(spark, odd, none):
    got = found(ngrams.link_documents(odd))
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()], 5, 80)
    assert ngrams.link_documents(none).count() == 0 and ngrams.keep_one(none).count() == 0


def test_one_of_each_component_stays(spark, odd):
    kept = ngrams.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    # Of the repeated rows and the two equal texts one each goes; nulls and empty texts stay.
    assert len(rows) == odd.count() - 3
    assert sum(r.text == "same words here twice" for r in rows) == 1
    assert sum(r.doc_id is None for r in rows) == 2


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 150), (150, 170), (7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    with work(spark, "test") as folder:
        got = {r.node: r.label for r in components(frame, folder, "c").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 150, 170: 150}
