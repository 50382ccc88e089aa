import random

import numpy as np

from trellium.llm import decontaminate
from trellium.llm.queries import QUERIES


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_equals_table():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([bytes([rng.choice(b"abcd")]) for _ in range(rng.randint(0, 20))] for _ in "ab")
        assert decontaminate.Pattern(a).common(b) == lcs(a, b)


def corpus(spark, seed=1):
    """Twenty items; documents with exact, changed, half and no copies of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("bcdfglmnprst", k=2)) + str(rng.randint(0, 99))
    items = [(i, " ".join(word() for _ in range(30)) + ". Answer: " + " ".join(word() for _ in range(3))) for i in range(20)]
    docs, leaks = [], set()
    for d in range(120):
        words = [word() for _ in range(rng.randint(0, 300))]
        kind = d % 4
        item, text = items[d % 20]
        inside = text.split()
        if kind == 0:
            leaks.add((d, item))
        elif kind == 1:
            for k in rng.sample(range(28), 9):
                inside[k] = word()
            leaks.add((d, item))
        elif kind == 2:
            inside = inside[:12]
        else:
            inside = []
        at = rng.randint(0, len(words))
        docs.append((d, " ".join(words[:at] + inside + words[at:])))
    docs.append((200, None))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), leaks


def test_copies_and_paraphrases_are_found(spark):
    docs, items, leaks = corpus(spark)
    got = decontaminate.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks
    assert {r.kind for r in got if r.doc_id % 4 == 0} == {"copy"}
    clean = decontaminate.keep_clean(docs, items)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in leaks}
    assert clean.columns == docs.columns


def test_items_of_all_lengths_are_found(spark):
    """Items of 3 to 1,000 words, verbatim and with every tenth word changed, in prose made of the benchmark's own words."""
    rng = random.Random(4)
    known = [f"{a}{b}{c}" for a in "bcdfglmn" for b in "aeiou" for c in "bcdfglmnprst"]
    words_in = {1: 3, 2: 5, 3: 7, 4: 12, 5: 30, 6: 120, 7: 250, 8: 500, 9: 1000}
    texts = {i: [rng.choice(known) + str(i) for _ in range(n)] for i, n in words_in.items()}
    every = [w for t in texts.values() for w in t]
    docs, leaks = [], set()
    for d in range(90):
        item = d % 9 + 1
        inside = list(texts[item])
        if d % 2 and words_in[item] >= 12:
            for k in range(4, len(inside), 10):
                inside[k] = "changed"
        before, after = (rng.choices(every, k=rng.randint(0, 200)) for _ in "ab")
        docs.append((d, " ".join(before + inside + after)))
        leaks.add((d, item))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, items).collect()}
    assert leaks <= got, sorted(leaks - got)
    assert all(words_in[i] < 8 for _, i in got - leaks)


def test_passages_are_whole_items_in_order():
    for n in (1, 63, 64, 65, 128, 129, 1000):
        words = [str(i).encode() for i in range(n)]
        parts = decontaminate.cut(words)
        assert [w for p in parts for w in p] == words
        assert all(0 < len(p) <= max(decontaminate.SCALES) for p in parts) and max(map(len, parts)) - min(map(len, parts)) <= 1


def test_a_paraphrase_without_the_answer_is_none():
    item = decontaminate.Item(1, "one two three four five six seven eight nine ten. Answer: red green blue")
    assert item.answer.common(b"red green blue".split()) == 3
    assert decontaminate.answer_of("What is it? It is red.") == [b"it", b"is", b"red"]


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items, leaks = corpus(spark, 2)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 400)
    got = decontaminate.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks


def test_spans_of_texts_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [decontaminate.Item(i, " ".join(rng.choices(words, k=rng.choice((5, 40, 150))))) for i in range(12)]
    texts = [" ".join(rng.choices(words + ["x"] * 200, k=rng.randint(0, 700))) + " " + rng.choice(items).text for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index = decontaminate.fit(docs, items, "text")
    split = [decontaminate.words_of(t) for t in ["", *texts, ""]]
    whole = set(index.near(split))
    for span in (1000, 97, 16):
        monkeypatch.setattr(decontaminate, "SPAN_WORDS", span)
        assert set(index.near(split)) == whole and whole


def test_memory_of_long_texts(spark):
    """What a search of five million words holds besides the words themselves."""
    import tracemalloc

    item = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, item)], "doc_id long, text string")
    index = decontaminate.fit(docs, [decontaminate.Item(1, item)], "text")
    rng = random.Random(1)
    some = [b"w%d" % i for i in range(60)] + [b"x"] * 300
    long = rng.choices(some, k=1_000_000)
    tracemalloc.start()
    found = sum(1 for _ in index.near([long]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= 0 and peak < 150 << 20


def test_svd_finds_the_largest_directions(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "c", "d", "e", "f"], weights=(9, 7, 5, 1, 1, 1), k=40)) for _ in range(60)]
    terms = {w: i for i, w in enumerate([b"a", b"b", b"c", b"d", b"e", b"f"])}
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = decontaminate.randomised_svd(frame, terms, np.ones(6), 3)
    matrix = np.zeros((60, 6))
    for i, t in enumerate(texts):
        for ids, values in decontaminate._rows([t], terms, np.ones(6)):
            matrix[i, ids] = values
    exact = np.linalg.svd(matrix)[2][:3]
    captured = np.linalg.norm(matrix @ got) / np.linalg.norm(matrix @ exact.T)
    assert captured > 0.97 and np.allclose(got.T @ got, np.eye(3), atol=1e-8)


def test_recall_on_the_test_tables(spark, sf):
    """Every document with a whole item in it, found by brute force, comes back."""
    items = [decontaminate.Item(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    truth = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = b" ".join(decontaminate.words_of(r.text))
        truth |= {(r.doc_id, i.id) for i in items if b" ".join(i.words) in text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontaminate"](spark, sf).collect()}
    assert len(truth & got) >= 0.9 * len(truth) and len(got - truth) <= 0.1 * len(got) + 1


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, " "), (None, "alpha beta gamma delta")], "item_id long, text string")
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.keep_clean(odd, items.limit(0)).count() == odd.count()
    decontaminate.find_leaks(odd, items).collect()
    assert decontaminate.keep_clean(odd, items).columns == odd.columns


def test_the_latent_space_is_of_all_documents(spark, monkeypatch):
    """Every passage of every document enters the decomposition, however many there are."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 200))) if i % 50 else None for i in range(2500)]
    items = [decontaminate.Item(i, " ".join(rng.choices(words, k=20))) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = []
    whole = decontaminate.randomised_svd
    monkeypatch.setattr(decontaminate, "randomised_svd", lambda rows, *more: given.append(sorted(r.text for r in rows.collect())) or whole(rows, *more))
    decontaminate.fit(docs, items, "text")
    assert given == [sorted([t for t in texts if t is not None] + [i.text for i in items])]


def test_items_need_no_python_workers_of_their_own(spark, tmp_path, monkeypatch):
    # Rows of tuples would be turned by a second daemon with workers of its own, beside those that make the matrix.
    docs, items, _ = corpus(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    given, whole = [], decontaminate.randomised_svd
    monkeypatch.setattr(decontaminate, "randomised_svd", lambda rows, *more: given.append(rows) or whole(rows, *more))
    decontaminate.find_leaks(spark.read.parquet(str(tmp_path / "docs")), items)
    plan = given[0]._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan


def test_passage_rows_equal_a_plain_count():
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "e", "unknown"]
    terms = {w.encode(): i for i, w in enumerate(words[:5])}
    weights = np.array([0.0, 1.0, 2.0, 3.0, 4.0])
    texts = [None, "", "a a", *[" ".join(rng.choices(words, k=n)) for n in (1, 63, 64, 65, 300)], "unknown"]
    rows = []
    for text in texts:
        split = (text or "").split()
        for at in range(0, len(split), 64):
            counts = np.array([split[at : at + 64].count(w) for w in words[:5]]) * weights
            if counts.any():
                rows.append(counts / np.linalg.norm(counts))
    dense = [np.bincount(ids, values, 5) for ids, values in decontaminate._rows(texts, terms, weights)]
    assert len(dense) == len(rows) and np.allclose(dense, rows)
    packed = decontaminate._packed(*decontaminate.passage_rows(texts, terms, weights))
    for cells in (1, 7, 1_024):
        decontaminate.ROW_CELLS, before = cells, decontaminate.ROW_CELLS
        try:
            parts = [np.bincount(at[a:b], values[a:b], 5) for begins, at, values in decontaminate._unpacked(packed) for a, b in zip(begins, np.append(begins[1:], len(at)))]
        finally:
            decontaminate.ROW_CELLS = before
        assert np.allclose(parts, rows, atol=1e-6)


def test_subsequences_are_only_computed_where_enough_words_are(spark, monkeypatch):
    """A third of an item's words makes a window come near it; only where enough are is the subsequence worked out."""
    rng = random.Random(12)
    items = [decontaminate.Item(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)]
    texts = [" ".join(rng.choices(["y", "z"], k=100) + rng.sample(item.text.split(), 12) + rng.choices(["y", "z"], k=100)) for item in items]
    texts += [f"y {item.text} z" for item in items[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = decontaminate.fit(docs, items, "text")
    tried, whole = [], decontaminate.Pattern.common
    monkeypatch.setattr(decontaminate.Pattern, "common", lambda self, region: tried.append(region) or whole(self, region))
    found = index.search(texts)
    assert [[h["item"] for h in hits] for hits in found] == [[]] * 40 + [[i] for i in range(5)]
    near = {(k, i) for k, i, _, _ in index.near([decontaminate.words_of(t) for t in texts])}
    assert len(near) >= 40 and 0 < len(tried) <= 20


def test_the_limit_of_a_subsequence_is_none_below_it():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 20))] for _ in "ab")
        assert lcs(a, b) <= decontaminate.Pattern(a).limit(b) <= len(a)


def test_groups_of_texts_change_nothing(spark, monkeypatch):
    docs, items, leaks = corpus(spark, 3)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    index = decontaminate.fit(docs, [decontaminate.Item(r.item_id, r.text) for r in items.collect()], "text")
    whole = index.search(texts)
    assert {(k, h["item"]) for k, hits in enumerate(whole) for h in hits} == leaks
    for span in (16, 1000):
        monkeypatch.setattr(decontaminate, "SPAN_WORDS", span)
        assert index.search(texts) == whole


def test_run_sums_equal_plain_sums():
    rng = np.random.default_rng(1)
    table = rng.standard_normal((50, 7))
    for n in (0, 1, 40):
        sizes = rng.integers(1, 9, n)
        begins = np.cumsum(sizes) - sizes
        rows, factors = rng.integers(0, 50, int(sizes.sum())), rng.standard_normal(int(sizes.sum()))
        for f in (None, factors):
            order, sums = decontaminate.run_sums(table, rows, begins, sizes, f)
            given = table[rows] * (1 if f is None else f[:, None])
            plain = [given[a : a + m].sum(axis=0) for a, m in zip(begins, sizes)]
            assert sorted(order) == list(range(n))
            assert np.allclose(sums, np.array([plain[i] for i in order]).reshape(-1, 7))
