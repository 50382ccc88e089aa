import gc
import hashlib
import random
import struct
import weakref

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trellium.llm import bpe
from trellium.llm.queries import QUERIES
from trellium.llm.texts import made_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return bpe.load(file.read())


def same(own, library, texts):
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == expected.ids, text
        assert own.decode(ids) == library.decode(expected.ids, skip_special_tokens=False)


def test_random_texts(own, library):
    rng = random.Random(5)
    pool = [chr(c) for c in range(0x250)] + rng.sample([chr(c) for c in range(0x250, 0x30000) if not 0xD800 <= c < 0xE000], 2000)
    pool += [" ", "\n", "\t", "the", "ing", " a", "<|endoftext|>", "'s", "'ll", "1", "!!"] * 40
    same(own, library, ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(4000)])


def test_hard_texts(own, library):
    same(own, library, ["", "a" * 4000, " " * 999, "ab" * 999, "\U000329d3's \U0003d79d'll", "<|endoftext|>" * 3, "0123456789" * 40])


def test_every_token_by_itself(own, library):
    texts = [t for t in (own.decode(struct.pack("<I", i)) for i in range(0, 50257, 7)) if "�" not in t]
    same(own, library, texts)


def test_later_characters_are_neither_letters_nor_numbers(own, library):
    texts = [f"{chr(int(e, 16))}'s a{chr(int(e, 16))}1" for span in bpe.LATER.split() for e in span.split("-")]
    same(own, library, texts)


def test_unfit_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe('{"model": {"type": "WordPiece"}}')


def test_query(spark, sf, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_bpe"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_odd_rows(odd, none, library):
    got = bpe.encode_decode(odd, PATH).collect()
    assert len(got) == odd.count()
    assert sorted(r.decoded for r in got) == sorted(r.text or "" for r in odd.collect())
    assert bpe.digest(bpe.encode_decode(none, PATH)).count() == 0


def test_workers_let_go_of_the_vocabulary(spark, odd, held):
    bpe.encode_decode(odd, PATH).collect()
    assert held("trellium.llm.bpe", "ByteBpe") == 0


def test_a_vocabulary_is_made_once_for_a_broadcast(own):
    class Shared:
        value = "a"

    made, shared = [], Shared()
    first = made_of(shared, lambda value: made.append(value) or bpe._Pieces(own))
    assert made_of(shared, made.append) is first and made == ["a"]


def test_nothing_waits_for_the_garbage_collector():
    with open(PATH, encoding="utf-8") as file:
        vocabulary = bpe.load(file.read())
    vocabulary.encode("it's text")
    gone = weakref.ref(vocabulary)
    gc.disable()
    try:
        del vocabulary
        assert gone() is None
    finally:
        gc.enable()
