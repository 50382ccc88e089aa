import corpus_pipeline
from trellium.llm import bpe, decontaminate, quality, secrets
from trellium.llm.queries import QUERIES
from test_ngrams import brute

import hashlib

import public_tokenizers
from tokenizers import Tokenizer


def test_stages_by_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    good = [(i, t) for i, t in docs if not any(rule.rejects(quality.Text(t)) for rule in quality.RULES)]
    first = {eval(r)[0] for r in brute(good, 5, 80) if eval(r)[0] == eval(r)[2]}
    items = [decontaminate.Item(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        joined = b" ".join(decontaminate.words_of(text))
        return any(b" ".join(i.words) in joined for i in items)

    clean = [(i, secrets.redact(t or "")) for i, t in good if i in first and not leaks(t)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: (len(library.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean}
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == expected


def test_stages_take_empty_tables_and_odd_rows(spark, odd, none, sf):
    for docs in (none, odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            assert out.count() <= docs.count()


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in QUERIES if name.startswith("op")}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert bpe.MEMORY_PIECES > 0
