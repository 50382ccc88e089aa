"""Hard negatives for labelled embeddings, by a vertical scan with branch and bound.

Vectors are stored in blocks of columns, one column per dimension, with the
least and largest entry of each. For an anchor, columns are read in the order of
its own entries' magnitude. What the unread columns can still add lies between
bounds, so rows that cannot reach the results any more leave the candidates; the
scores of those that stay are exact when the last column is read.

Nulls: rows with a null id, label or vector, or a null or non-finite entry take
no part, nor do vectors of another length than the commonest. Repeated rows:
each is a row of its own; rows with the anchor's id are neither its positives
nor its negatives, and an anchor id with several rows has results for each. Ties
go to the smaller id. An empty table, or one without anchors, gives an empty
result. Other columns are never read.

Blocks are written to the shared folder once. Anchors are taken in groups of
bounded bytes; each group is broadcast and meets all blocks twice, first for its
positives, then for the windows that these open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trellium.llm.vectors import integer_vectors, matrix, reach, whole_kind
from trellium.llm.work import lasting

BLOCK_BYTES = 2 << 20
GROUP_BYTES = 4 << 20
STRIDE = 8  # columns read between two looks at the bounds

BLOCK_SCHEMA = "n int, dims int, width int, ids binary, labels binary, cells binary, least binary, most binary"
RESULT_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, and the window of a negative's score in percent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


@dataclass(frozen=True)
class Block:
    """Rows in the order of their labels, vectors column by column."""

    ids: np.ndarray
    labels: np.ndarray
    cells: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))


def _pack(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict:
    order = np.lexsort((ids, labels))
    cells = np.ascontiguousarray(x[order].T)
    width = next(w for w in (2, 4, 8) if w == 8 or reach(cells) < 1 << (8 * w - 1))
    return {
        "n": len(ids), "dims": len(cells), "width": width, "ids": ids[order].tobytes(), "labels": labels[order].tobytes(),
        "cells": cells.astype(f"i{width}").tobytes(), "least": cells.min(axis=1).tobytes(), "most": cells.max(axis=1).tobytes(),
    }


def _unpack(row: dict) -> Block:
    cells = np.frombuffer(row["cells"], f"i{row['width']}").reshape(row["dims"], row["n"])
    return Block(*[np.frombuffer(row[c], np.int64) for c in ("ids", "labels")], cells, *[np.frombuffer(row[c], np.int64) for c in ("least", "most")])


def _blocks(rows: DataFrame, bytes_each: int) -> DataFrame:
    """Packs of the rows (id, label, x) of each partition."""

    kind = T._parse_datatype_string(BLOCK_SCHEMA)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = to_arrow_schema(kind)
        held: list[tuple] = []

        def out():
            packed = _pack(*[np.concatenate(parts) for parts in zip(*held)])
            held.clear()
            return pa.RecordBatch.from_pylist([packed], schema)

        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2))
                ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                step = max(1, bytes_each // (8 * x.shape[1]))
                for at in range(0, len(x), step):
                    room = step - sum(len(h[0]) for h in held)
                    piece = slice(at, at + step)
                    if len(ids[piece]) > room and held:
                        yield out()
                    held.append((ids[piece], labels[piece], x[piece]))
        if held:
            yield out()

    return rows.mapInArrow(run, BLOCK_SCHEMA)


class Scan:
    """One anchor's walk through the columns of blocks."""

    def __init__(self, q: np.ndarray):
        self.q = [int(v) for v in q]
        self.order = sorted(range(len(self.q)), key=lambda j: -abs(self.q[j]))
        self.reach = max([abs(v) for v in self.q], default=0)

    def rest(self, block: Block) -> tuple[list[int], list[int]]:
        """What the columns from the t-th in order on add at least and at most."""
        low, high = [0], [0]
        for j in reversed(self.order):
            a, b = self.q[j] * int(block.least[j]), self.q[j] * int(block.most[j])
            low.append(low[-1] + min(a, b))
            high.append(high[-1] + max(a, b))
        return low[::-1], high[::-1]

    def exact(self, block: Block, rows: np.ndarray, bounds: Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows that ``bounds`` leaves after the last column, and their scores.

        ``bounds`` gets partial scores, the least and the most that the rest adds,
        and returns which rows may still count.
        """
        low, high = self.rest(block)
        kind = whole_kind(self.reach * max(reach(block.least), reach(block.most)) * max(1, len(self.q)) * 2)
        partial = np.zeros(len(rows), kind)
        whole = len(rows) == block.cells.shape[1]
        for t in range(0, len(self.order), STRIDE):
            for j in self.order[t : t + STRIDE]:
                column = block.cells[j] if whole else block.cells[j][rows]
                partial += column.astype(kind) * self.q[j]
            done = min(t + STRIDE, len(self.order))
            alive = bounds(partial, low[done], high[done])
            if not alive.all():
                rows, partial, whole = rows[alive], partial[alive], False
                if not len(rows):
                    break
        return rows, partial


class Best:
    """The first ``k`` rows by falling score, then id."""

    def __init__(self, k: int):
        self.k = k
        self.scores: list[int] = []
        self.ids: list[int] = []

    def floor(self) -> int | None:
        """A row below this score can't enter."""
        return self.scores[-1] if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            s, i = [*self.scores, *scores.tolist()], [*self.ids, *ids.tolist()]
            first = sorted(range(len(s)), key=lambda r: (-s[r], i[r]))[: self.k]
            self.scores, self.ids = [s[r] for r in first], [i[r] for r in first]


def _other_rows(block: Block, rows: np.ndarray, anchor_id: int) -> np.ndarray:
    return rows[block.ids[rows] != anchor_id]


def scan_positives(block: Block, scan: Scan, anchor_id: int, label: int, best: Best) -> None:
    """Add a block's rows of the anchor's label to its best."""
    start, stop = block.of_label(label)
    rows = _other_rows(block, np.arange(start, stop), anchor_id)
    if not len(rows):
        return
    k = best.k

    def bounds(partial, low, high):
        floor = best.floor()
        if len(partial) > k:
            own = int(np.partition(partial, len(partial) - k)[len(partial) - k]) + low  # k rows reach it for certain
            floor = own if floor is None else max(floor, own)
        return np.ones(len(partial), bool) if floor is None else partial >= floor - high

    rows, scores = scan.exact(block, rows, bounds)
    best.add(scores, block.ids[rows])


def scan_negatives(block: Block, scan: Scan, anchor_id: int, label: int, windows: list[tuple[int, int, Best]]) -> None:
    """Add a block's rows of other labels to the best of each window of scores."""
    start, stop = block.of_label(label)
    rows = _other_rows(block, np.concatenate([np.arange(start), np.arange(stop, len(block.ids))]), anchor_id)
    if not len(rows):
        return
    spans = []
    for low, high, best in windows:
        floor = best.floor()
        spans.append((low if floor is None else max(low, floor), high))
    spans = [s for s in spans if s[0] <= s[1]]
    if not spans:
        return
    least, most = min(a for a, _ in spans), max(b for _, b in spans)

    def bounds(partial, low, high):
        return (partial >= least - high) & (partial <= most - low)

    rows, scores = scan.exact(block, rows, bounds)
    ids = block.ids[rows]
    for (low, high, best) in windows:
        floor = best.floor()
        inside = (scores >= (low if floor is None else max(low, floor))) & (scores <= high)
        best.add(scores[inside], ids[inside])


def _rows_out(rows: list[tuple], kind: T.StructType):
    import pyarrow as pa

    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) or [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def _group_of(packed: DataFrame, group: int) -> dict:
    return packed.where(F.col("group") == group).first().asDict()


def _mine_group(blocks: DataFrame, group: dict, mining: Mining) -> DataFrame:
    """Results of one group of anchors; all that is broadcast is bounded by the group's bytes."""
    spark = blocks.sparkSession
    anchors = spark.sparkContext.broadcast({k: bytes(v) if isinstance(v, bytearray) else v for k, v in group.items()})
    found_kind, part_kind, result_kind = (
        T._parse_datatype_string(x) for x in ("anchor int, score long, id long", "anchor int, positive int, score long, id long", RESULT_SCHEMA)
    )

    def each_block(batches: Iterator) -> Iterator[Block]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _unpack(row)

    def opened() -> list[tuple[Scan, int, int]]:
        pack = _unpack(anchors.value)
        return [(Scan(pack.cells[:, a]), int(pack.ids[a]), int(pack.labels[a])) for a in range(len(pack.ids))]

    def positives(batches: Iterator) -> Iterator:
        walks = opened()
        best = [Best(mining.positives) for _ in walks]
        for block in each_block(batches):
            for (scan, anchor_id, label), b in zip(walks, best):
                scan_positives(block, scan, anchor_id, label, b)
        yield _rows_out([(a, s, i) for a, b in enumerate(best) for s, i in zip(b.scores, b.ids)], found_kind)

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = blocks.mapInArrow(positives, found_kind).withColumn("place", F.row_number().over(first)).where(F.col("place") <= mining.positives)
    by_anchor: dict[int, list[tuple[int, int]]] = {}
    for r in near.orderBy("anchor", "place").collect():  # at most ``positives`` rows for each anchor of the group
        by_anchor.setdefault(r.anchor, []).append((r.id, r.score))
    chosen = spark.sparkContext.broadcast(by_anchor)

    def negatives(batches: Iterator) -> Iterator:
        walks = opened()
        windows = {
            a: [(-((-mining.low * s) // 100), mining.high * s // 100, Best(mining.negatives)) for _, s in found]
            for a, found in chosen.value.items()
        }
        for block in each_block(batches):
            for a, own in windows.items():
                scan, anchor_id, label = walks[a]
                scan_negatives(block, scan, anchor_id, label, own)
        yield _rows_out(
            [(a, p, s, i) for a, own in windows.items() for p, (_, _, b) in enumerate(own) for s, i in zip(b.scores, b.ids)], part_kind
        )

    ranked = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    far = blocks.mapInArrow(negatives, part_kind).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= mining.negatives)

    def name(batches: Iterator) -> Iterator:
        pack = _unpack(anchors.value)
        for batch in batches:
            yield _rows_out([
                (int(pack.ids[r["anchor"]]), *chosen.value[r["anchor"]][r["positive"]][:1], r["rank"], r["id"],
                 chosen.value[r["anchor"]][r["positive"]][1], r["score"]) for r in batch.to_pylist()
            ], result_kind)

    return far.mapInArrow(name, RESULT_SCHEMA)


def mine(df: DataFrame, anchors: Column, label: Column, mining: Mining = Mining(), vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels in the score window.

    ``anchors`` is a condition on ``df``, ``label`` the label to use. Scores are
    inner products of vectors as whole numbers; a score beyond the range of long is
    an error.
    """
    folder = lasting(df.sparkSession, "negatives")
    rows = integer_vectors(df, vector, {"id": F.col(f"`{id_column}`").cast("long"), "label": label.cast("long"), "is_anchor": anchors})
    rows = folder.save(rows.where("id is not null and label is not null"), "rows")
    queries = rows.where("is_anchor")
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size.n:
        return df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    blocks = folder.save(_blocks(rows.select("id", "label", "x"), BLOCK_BYTES), "blocks")
    groups = -(-size.n * size.d * 8 // GROUP_BYTES)
    dealt = queries.select("id", "label", "x").repartition(groups)
    packed = folder.save(_blocks(dealt, GROUP_BYTES).withColumn("group", F.monotonically_increasing_id()), "anchors")
    folder.drop("rows")
    paths = []
    for group in sorted(r.group for r in packed.select("group").collect()):
        folder.save(_mine_group(blocks, _group_of(packed, group), mining), f"found-{group}")
        paths.append(f"{folder.path}/found-{group}")
    return df.sparkSession.read.schema(RESULT_SCHEMA).parquet(*paths)
