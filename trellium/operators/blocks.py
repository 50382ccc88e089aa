"""File blocks folded where they are read: counts, quote states and first lines, in one scan.

Whether a line ends a record depends on all lines before it. Each line acts on
the state "inside quotes or not" in one of three ways: it keeps the state, flips
it, or sets it. These compose, so a task folds each block it reads into one row
that holds for both states the block may start in. Lines never leave their task
but for the first few of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trellium.functions.csv_text import record_open

KEEP, FLIP, SET_OUT, SET_IN = range(4)
# Text of a block's first lines that is kept at most; a record longer than that is reported, not read.
RECORD_BYTES = 256 << 10

SCHEMA = (
    "file string, block long, n_lines long, ends_out long, ends_in long, leaves_out int, leaves_in int, "
    "first string, head array<string>, actions binary, whole boolean"
)


def action(value: Column) -> Column:
    """What a line does to the state, as a number."""
    quoted = value.contains('"')  # most lines hold none and keep the state
    from_out = quoted & record_open(value)
    from_in = ~quoted | record_open(F.concat(F.lit('"'), value))
    sets = F.when(from_out, SET_IN).otherwise(SET_OUT)
    return F.when(from_out == from_in, sets).when(from_out, FLIP).otherwise(KEEP).cast("byte")


def states(actions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State after each line, if the lines begin outside quotes and if inside."""
    flipped = np.cumsum(actions == FLIP) & 1
    at = np.maximum.accumulate(np.where(actions >= SET_OUT, np.arange(len(actions)), -1))
    known = at >= 0
    found = np.where(known, (actions[at] - SET_OUT) ^ flipped ^ flipped[at], 0)
    return np.where(known, found, flipped), np.where(known, found, 1 ^ flipped)


class _Block:
    """What is known of the block that is being read."""

    def __init__(self, file: str, block: int, records: int):
        self.file, self.block, self.records = file, block, records
        self.n = self.head_bytes = 0
        self.ends, self.leaves, self.head_ends = [0, 0], [0, 1], [0, 0]
        self.head: list[str] = []
        self.actions: list[np.ndarray] = []
        self.open = records > 0

    def add(self, actions: np.ndarray, values) -> None:
        out, inside = states(actions)
        by_start = [inside if leaves else out for leaves in self.leaves]
        if self.open:
            self._add_head(actions, values, by_start)
        self.n += len(actions)
        self.ends = [e + int((s == 0).sum()) for e, s in zip(self.ends, by_start)]
        self.leaves = [int(s[-1]) for s in by_start]

    def _add_head(self, actions: np.ndarray, values, by_start: list[np.ndarray]) -> None:
        import pyarrow.compute as pc

        # Lines up to those that end enough records, whatever the state before; a file begins outside quotes.
        starts = (0,) if self.block == 0 else (0, 1)
        ends = [self.head_ends[i] + np.cumsum(by_start[i] == 0) for i in starts]
        enough = np.logical_and.reduce([e >= self.records for e in ends])
        sizes = self.head_bytes + np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        room = int(np.searchsorted(sizes, RECORD_BYTES, "right"))
        stop = min(int(enough.argmax()) + 1 if enough.any() else len(actions), room)
        self.head += values.slice(0, stop).to_pylist()
        self.actions.append(actions[:stop].astype(np.int8))
        if stop:
            self.head_bytes = int(sizes[stop - 1])
            self.head_ends = [e + int((s[:stop] == 0).sum()) for e, s in zip(self.head_ends, by_start)]
        self.open = stop == len(actions) and not enough.any()

    def row(self) -> dict:
        return {
            "file": self.file, "block": self.block, "n_lines": self.n, "ends_out": self.ends[0], "ends_in": self.ends[1],
            "leaves_out": self.leaves[0], "leaves_in": self.leaves[1], "first": self.head[0] if self.head else None, "head": self.head,
            "actions": b"".join(a.tobytes() for a in self.actions), "whole": len(self.head) == self.n,
        }


def fold_blocks(lines: DataFrame, records: int = 0) -> DataFrame:
    """One row per file block, of ``lines`` as they are read; ``head`` holds the lines of its first ``records`` records."""
    out = T._parse_datatype_string(SCHEMA)
    value = F.col("value") if records else F.lit("")
    source = lines.select("file", "block", action(F.col("value")).alias("action"), value.alias("value"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        arrow = to_arrow_schema(out)
        now: _Block | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            files, blocks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            actions = batch.column(2).to_numpy(zero_copy_only=False)
            new = np.zeros(n, bool)
            new[1:] = (blocks[1:] != blocks[:-1]) | pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(new), n]
            for a, b in zip(starts, starts[1:]):
                file, block = files[a].as_py(), int(blocks[a])
                if now is None or (now.file, now.block) != (file, block):
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([now.row()], arrow)
                    now = _Block(file, block, records)
                now.add(actions[a:b], batch.column(3).slice(a, b - a))
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], arrow)

    return source.mapInArrow(run, out)


def settle_blocks(blocks: DataFrame) -> DataFrame:
    """``file, block, n_lines, enters, ends, leaves, before``: the state each block begins in, and records that end in it and before it.

    A pass over narrow rows, one per block. Blocks that set the state don't depend
    on what is before them; the others flip or keep it.
    """
    by_file = Window.partitionBy("file").orderBy("block")
    upto = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed = F.col("leaves_out") == F.col("leaves_in")
    narrow = blocks.select("file", "block", "n_lines", "ends_out", "ends_in", "leaves_out", "leaves_in")
    marked = narrow.withColumn("flipped", F.sum(F.when(~fixed, F.col("leaves_out")).otherwise(0)).over(upto) % 2).withColumn(
        "anchor", F.last(F.when(fixed, (F.col("leaves_out") + F.col("flipped")) % 2), ignorenulls=True).over(upto)
    )
    marked = marked.withColumn("leaves", (F.coalesce("anchor", F.lit(0)) + F.col("flipped")) % 2)
    marked = marked.withColumn("enters", F.lag("leaves", 1, 0).over(by_file))
    ends = F.when(F.col("enters") == 0, F.col("ends_out")).otherwise(F.col("ends_in"))
    settled = marked.withColumn("ends", ends)
    return settled.withColumn("before", F.sum("ends").over(upto) - F.col("ends")).select(
        "file", "block", "n_lines", "enters", "ends", "leaves", "before"
    )


RECORDS = "dataset string, records array<string>, lines array<string>, readable boolean"


def scan_records(heads: DataFrame, n: int) -> DataFrame:
    """First ``n`` records from ``dataset, parts``, an array of (head, actions, whole, last, skip) in file order.

    A line is looked at once. A record that is still open where its file ends
    counts; one that is open where the head was cut doesn't, and then, if it is the
    first, the data set is not ``readable``. ``skip`` drops a repeated header line.
    """
    out = T._parse_datatype_string(RECORDS)

    def records_of(parts: list[dict]) -> tuple[list[str], list[str], bool]:
        records, lines, held, state = [], [], [], 0
        for part in parts:
            actions = np.frombuffer(part["actions"], np.int8)
            for i, (line, act) in enumerate(zip(part["head"], actions)):
                if i == 0 and part["skip"]:
                    continue
                lines.append(line)
                held.append(line)
                state = state if act == KEEP else 1 - state if act == FLIP else int(act) - SET_OUT
                if not state:
                    records.append("\n".join(held))
                    held = []
                    if len(records) == n:
                        return records, lines, True
            if not part["whole"]:
                return records, lines, bool(records)
            if part["last"]:
                if held:
                    records.append("\n".join(held))
                held, state = [], 0
        return records[:n], lines, True

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        arrow = to_arrow_schema(out)
        for batch in batches:
            for row in batch.to_pylist():
                records, lines, readable = records_of(row["parts"])
                yield pa.RecordBatch.from_pylist([{"dataset": row["dataset"], "records": records, "lines": lines, "readable": readable}], arrow)

    return heads.mapInArrow(run, out)
