import hashlib
import random

import agree
import pytest
from trellium.llm import exact
from trellium.llm.queries import QUERIES, SQL


def low(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256(low(t)).hexdigest()))
    return sorted(out, key=repr)


def checked(frame, rows):
    got = frame.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    assert sum(r.kept for r in got) == len({low(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_query(spark, sf):
    text, n = agree.difference(spark, agree.connect(sf), "op13", QUERIES["op13_exact"], SQL["op13_exact"], sf)
    assert not text and n > 0


@pytest.mark.parametrize("block_bytes", [1, 3, 4, 4096])
def test_blocks_of_any_size(spark, block_bytes):
    """Texts that share blocks, differ in one place or only in length, or repeat one block."""
    rng = random.Random(block_bytes)
    pool = ["abab", "ABAB", "abababab", "ababab", "aba", "a", "", "ababa b", "ü" * 9, "Ü" * 9, "xyz" * 30, "xyz" * 30 + "q", "q" + "xyz" * 30, "xyz" * 29 + "xyq"]
    rows = [(i, rng.choice(pool)) for i in range(150)]
    checked(exact.group_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_bytes=block_bytes), rows)


def test_chunks_begin_anew(spark, monkeypatch):
    monkeypatch.setattr(exact, "CHUNK_BYTES", 500)
    monkeypatch.setattr(exact, "OUT_BYTES", 50)
    rows = [(i, f"text {i % 7} " * 20) for i in range(100)]
    checked(exact.group_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), block_bytes=16), rows)


def test_long_texts(spark):
    body = "0123456789" * 300_000
    rows = [(1, body + "a"), (2, body + "A"), (3, body + "b"), (4, body)]
    checked(exact.group_copies(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    clash = odd.withColumnRenamed("lang", "leader").withColumnRenamed("spans", "spot")
    checked(exact.group_copies(clash), rows)
    assert exact.group_copies(none).count() == 0
