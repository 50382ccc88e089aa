"""Tables of fixed size summed over all rows: each task fills one, reducers add them block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from trellium.llm.texts import slices

BLOCK = 1 << 14
SCHEMA = "block int, numbers binary"

# Given the texts (or packed parts) of a slice of rows, adds to the table.
Adder = Callable[[list, np.ndarray], None]


def sum_tables(rows: DataFrame, column: str, size: int, start: Callable[[], Adder], kind: type = np.int64) -> np.ndarray:
    """The sum over all rows of a table of ``size`` numbers.

    Tasks hold one table, reducers at most one, the driver one; how much they
    hold doesn't depend on the rows. An empty frame gives zeros.
    """

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = np.zeros(size, kind)
        add = start()
        for batch in batches:
            for part in slices(batch, 0):
                add(part.column(0).to_pylist(), table)
        for block in range(0, size, BLOCK):
            part = table[block : block + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block // BLOCK], pa.int32()), "numbers": pa.array([_pack(part)], pa.binary()),
                })

    def total(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = _unpack(numbers, kind)
                if block in sums:
                    sums[block] += part
                else:
                    sums[block] = part
        for block, part in sums.items():
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int32()), "numbers": pa.array([_pack(part)], pa.binary()),
            })

    packed = rows.schema[column].dataType == BinaryType()
    given = F.col(f"`{column}`") if packed else F.col(f"`{column}`").cast("string")
    filled = rows.select(given).mapInArrow(fill, SCHEMA)
    result = np.zeros(size, kind)
    for block, numbers in filled.repartition("block").mapInArrow(total, SCHEMA).collect():
        part = _unpack(bytes(numbers), kind)
        result[block * BLOCK : block * BLOCK + len(part)] = part
    return result


def _pack(part: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 16 or 2 ** 32 as such; the first byte tells."""
    for tag, kind in ((b"2", np.uint16), (b"4", np.uint32)):
        if part.dtype == np.int64 and part.min() >= 0 and part.max() <= np.iinfo(kind).max:
            return tag + part.astype(kind).tobytes()
    return b"8" + part.tobytes()


def _unpack(numbers: bytes, kind: type) -> np.ndarray:
    stored = {b"2": np.uint16, b"4": np.uint32}.get(numbers[:1], kind)
    return np.frombuffer(numbers, stored, offset=1).astype(kind)
