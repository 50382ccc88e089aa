"""Text columns through Arrow batches, in slices small enough for a worker's memory."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any
from weakref import WeakKeyDictionary

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A slice has at most so many rows, and so many bytes of text unless one text alone has more.
SLICE_ROWS = 512
SLICE_BYTES = 2 << 20

# A word of most operators: a run without blanks. Fixed by the result contracts.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

Worker = Callable[[list], Sequence[Sequence]]

_made: WeakKeyDictionary[Broadcast, Any] = WeakKeyDictionary()


def made_of(shared: Broadcast, make: Callable[[Any], Any]) -> Any:
    """What ``make`` makes of a broadcast value, once in a worker.

    It is held as long as the broadcast, which a worker drops when it is given a
    task without it; so tables of one stage don't lie beside those of the next.
    """
    if shared not in _made:
        _made[shared] = make(shared.value)
    return _made[shared]


def slices(batch, column: int) -> Iterator:
    """A batch in slices of bounded rows and bytes of text."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        room = (ends[at - 1] if at else 0) + SLICE_BYTES
        stop = min(max(at + 1, int(np.searchsorted(ends, room, "right"))), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def fresh(name: str, columns: Sequence[str]) -> str:
    """A column name like ``name`` that none of ``columns`` has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, every other character as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def plain_strings(df: DataFrame, column: str) -> DataFrame:
    """The column as string, so that any input type has texts."""
    return df.withColumn(column, F.col(f"`{column}`").cast("string"))


def annotate(df: DataFrame, keep: Sequence[str], text: str, schema: str, start: Callable[[], Worker]) -> DataFrame:
    """``keep`` columns and new ones computed from a text column.

    ``start`` runs once per task and gives a function from a list of texts
    (None for null) to one list per new column. A kept column named like a new
    one gives way to it.
    """
    new = T._parse_datatype_string(schema)
    kept = [c for c in keep if c not in new.names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(fresh("__text", kept)))
    out = T.StructType([source.schema[c] for c in kept] + list(new.fields))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        work = start()
        arrow = to_arrow_schema(out)
        for batch in batches:
            for part in slices(batch, len(kept)):
                made = work(part.column(len(kept)).to_pylist())
                columns = [part.column(i) for i in range(len(kept))]
                columns += [pa.array(v, type=arrow.field(len(kept) + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, out)


def keep_rows(df: DataFrame, text: str, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Rows of ``df``, whole and in all columns, whose text passes the test that ``start`` gives."""
    schema = df.schema
    at_text = df.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        test = start()
        for batch in batches:
            for part in slices(batch, at_text):
                passed = test(part.column(at_text).to_pylist())
                if any(passed):
                    yield part.filter(pa.array(passed, pa.bool_()))

    return df.mapInArrow(run, schema)
