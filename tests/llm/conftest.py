import pytest

LONG = "alpha beta gamma " * 3000

ODD_TEXTS = [
    None, "", " \t\n", "one", LONG, "Straße ünï çödé ßß 東京 🙂 tail", "a b c\x1cd", "same words here twice",
    "same words here twice", "line\r\nline\n\nline\n", "x" * 20_000, "<|endoftext|> it's <|endoftext|>", "|<\\|im_end|>",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like results."""
    rows = [(i, t, None if i % 2 else "en", "kept", 7, "s") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[7], (None, "no id at all", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_words long, spans string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf(request):
    import os

    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    return path


@pytest.fixture(scope="session")
def held(spark):
    """How many objects of a class any Python worker has, at most, in a task of something else."""

    def count(module, name):
        def run(batches):
            import gc
            import importlib

            import pyarrow as pa

            kind = getattr(importlib.import_module(module), name)
            for _ in batches:
                pass
            yield pa.RecordBatch.from_pydict({"n": [sum(isinstance(x, kind) for x in gc.get_objects())]})

        return max(row.n for row in spark.range(0, 64, 1, 32).mapInArrow(run, "n long").collect())

    return count
