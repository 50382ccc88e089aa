"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of fixed size. The distinct blocks are put in order
and numbered, so a block has a whole number as its name. Adjacent names are then
paired and the pairs named in the same way, level by level, until each document
has one name. Equal names at the same number of blocks mean equal texts, without
a hash that could collide.

Nulls: a null text counts as empty, a null id is a document like any other and
smaller than every id. Repeated rows are documents of their own; of those with
the largest id one stays. An empty table gives an empty result. Very long texts
only have more blocks and levels. Other columns are never read.

Each task first names what it has read itself: a block or text it has met
before in the last ``CHUNK_BYTES`` is not sent again. So a text that a third of
all rows share is one row per chunk in the shuffles, and no group of copies is
ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trellium.llm.work import Work, lasting

BLOCK_BYTES = 4096
CHUNK_BYTES = 16 << 20
OUT_BYTES = 4 << 20
TASK_BITS = 40  # a name is the task's number and the place in its order


def _cut(docs: DataFrame, id_column: str, text: str, block_bytes: int) -> DataFrame:
    """A row for each document and one for each block that its task had not met before.

    Documents: ``doc`` (a number of their own), ``id``, ``sha256``, ``leader`` (the
    document of the chunk with the same text) and, for leaders, ``spots``, the
    numbers of the blocks. Blocks: ``spot`` and ``block``.
    """
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    kind = source.schema["id"].dataType
    schema = f"doc long, id {kind.simpleString()}, sha256 string, leader long, spots array<long>, spot long, block binary"
    made = T._parse_datatype_string(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        arrow = to_arrow_schema(made)
        base = TaskContext.get().partitionId() << TASK_BITS
        spots: dict[bytes, int] = {}
        leaders: dict[tuple[int, ...], int] = {}
        held = next_doc = next_spot = waiting = 0
        out: list[dict] = []

        def flush():
            batch = pa.RecordBatch.from_pylist(out, arrow)
            out.clear()
            return batch

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (value.as_py() or b"").lower()
                if held > CHUNK_BYTES:
                    spots.clear()
                    leaders.clear()
                    held = 0
                own = []
                for at in range(0, max(1, len(data)), block_bytes):
                    block = data[at : at + block_bytes]
                    spot = spots.get(block)
                    if spot is None:
                        spot = spots[block] = base + next_spot
                        next_spot += 1
                        held += len(block) + 100
                        waiting += len(block)
                        out.append({"spot": spot, "block": block})
                    own.append(spot)
                    if waiting > OUT_BYTES:
                        yield flush()
                        waiting = 0
                doc = base + next_doc
                next_doc += 1
                leader = leaders.setdefault(tuple(own), doc)
                if leader == doc:
                    held += 8 * len(own) + 100
                out.append({"doc": doc, "id": doc_id, "sha256": hashlib.sha256(data).hexdigest(), "leader": leader, "spots": own if leader == doc else None})
                waiting += 100 + 8 * len(own)
        if out:
            yield flush()

    return source.mapInArrow(run, made)


def _named(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with a column ``name`` in place of ``keys``: a whole number for each distinct key.

    Keys are dealt by their hash and put in order; a name is the task's number
    and the key's place in the order.
    """
    kept = [c for c in rows.columns if c not in keys]
    ordered = rows.select(*kept, *keys).repartition(*keys).sortWithinPartitions(*keys)
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + ["name long"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        place = TaskContext.get().partitionId() << TASK_BITS
        last: list | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for i, k in enumerate(range(len(kept), len(kept) + len(keys))):
                column = batch.column(k)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[0] |= last is None or last[i] != column[0].as_py()
            last = [batch.column(k)[n - 1].as_py() for k in range(len(kept), len(kept) + len(keys))]
            names = place + np.cumsum(new)
            place = int(names[-1])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(names, pa.int64())], names=[*kept, "name"])

    return ordered.mapInArrow(run, schema)


def _identities(cut: DataFrame, folder: Work) -> DataFrame:
    """(leader, blocks, name): equal texts, and only they, agree in the last two."""
    spots = _named(cut.where("spot is not null").select("spot", "block"), ["block"])
    led = cut.where("spots is not null").select(F.col("doc").alias("leader"), F.size("spots").alias("blocks"), F.posexplode("spots").alias("pos", "spot"))
    level = folder.save(led.join(spots, "spot").select("leader", "blocks", "pos", "name"), "level-0")
    most = level.agg(F.max("blocks")).first()[0] or 1
    done = [level.where("blocks = 1")]
    width, k = 1, 0
    while width < most:
        half = F.col("pos").bitwiseAND(1) == 0
        pairs = level.where(F.col("blocks") > width).groupBy("leader", "blocks", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(half, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(-1)).alias("right")
        )
        width, k = 2 * width, k + 1
        level = folder.save(_named(pairs, ["left", "right"]), f"level-{k}")
        done.append(level.where((F.col("blocks") <= width) & (F.col("blocks") > width // 2)))
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    return names.select("leader", "blocks", "name")


def group_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document with the row that stays of its group of equal texts.

    Texts are compared after lower-casing A-Z. Of each group the row with the largest
    id stays. Columns: the id, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256`` of the compared text.
    """
    folder = lasting(docs.sparkSession, "exact")
    cut = folder.save(_cut(docs, id_column, text, block_bytes), "cut")
    members = cut.where("doc is not null").select("doc", "id", "sha256", "leader")
    identities = _identities(cut, folder)
    counted = members.groupBy("leader").agg(F.count("*").alias("n"), F.max(F.struct("id", "doc")).alias("last"))
    named = folder.save(counted.join(identities, "leader"), "named")
    groups = named.groupBy("blocks", "name").agg(F.sum("n").alias("size"), F.max("last").alias("keep"))
    verdicts = named.join(groups, ["blocks", "name"]).select("leader", "size", "keep")
    return members.join(verdicts, "leader").select(
        F.col("id").alias(id_column), F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("doc") == F.col("keep.doc")).alias("kept"), F.col("sha256").alias("text_sha256"),
    )
