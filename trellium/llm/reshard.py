"""Resharding by minimum-cost flow.

Old shard sizes are supplies, new capacities are demands, and a byte that
leaves its shard costs one (or what a cost table says). The flow that moves the
fewest bytes is solved on the driver, over shards only. Rows follow it: those
too large to be cut by are placed one by one (there are few, whatever the size
of the data), and the flow of the rest is solved again; the others of a shard are
laid end to end and cut into blocks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellium.llm.work import delete, lasting

# A row larger than this part of a shard is placed on its own: at most LARGE rows per shard can be.
LARGE = 1000
# Rows of a bucket, on average; a bucket is what one task puts in order.
BUCKET_ROWS = 200_000


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (1 if k < total % shards else 0) for k in range(shards)]


def min_cost_flow(
    supplies: Sequence[int], capacities: Sequence[int], cost: Mapping[tuple[int, int], int] | None = None
) -> dict[tuple[int, int], int]:
    """Bytes that go from old shard i to new shard j, all of them, at least cost.

    ``cost`` of a byte from i to j defaults to 0 at home and 1 elsewhere. Works
    by successive shortest paths: each round sends as much as it can along the
    cheapest way, taking earlier decisions back where that is cheaper.
    """
    if sum(supplies) > sum(capacities):
        raise ValueError("capacities are smaller than what is to be stored")
    n, m = len(supplies), len(capacities)
    price = lambda i, j: (cost or {}).get((i, j), 0 if i == j else 1)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supplies), list(capacities)
    while any(left):
        # Nodes: old shards 0..n-1, new shards n..n+m-1; all old shards with bytes left are sources.
        best = {i: 0 for i in range(n) if left[i]}
        came: dict[int, int] = {}
        queue = deque(best)
        while queue:
            node = queue.popleft()
            if node < n:
                steps = [(n + j, price(node, j)) for j in range(m)]
            else:
                steps = [(i, -price(i, node - n)) for i in range(n) if flow.get((i, node - n))]
            for to, extra in steps:
                if best[node] + extra < best.get(to, 1 << 62):
                    best[to] = best[node] + extra
                    came[to] = node
                    if to not in queue:
                        queue.append(to)
        end = min((n + j for j in range(m) if room[j]), key=lambda v: (best[v], v))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for a, b in zip(path, path[1:]):
            if b < n:
                amount = min(amount, flow[b, a - n])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a, b - n] = flow.get((a, b - n), 0) + amount
            else:
                flow[b, a - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return {edge: amount for edge, amount in flow.items() if amount}


def place_large(
    rows: Sequence[tuple[int, int, int]], supplies: Sequence[int], capacities: Sequence[int], cost: Mapping[tuple[int, int], int] | None = None
) -> dict[tuple[int, int], int]:
    """New shard of each large row (old shard, rank, size), the largest first, along the flow.

    A row stays if its shard's flow to itself carries it, else takes the way that
    carries most. A flow may split a row's bytes; where no way carries the row
    whole, it takes the cheapest shard with room, and the flow of what is left is
    solved again.
    """
    left, room = list(supplies), list(capacities)
    flow = min_cost_flow(left, room, cost)
    placed = {}
    for old, rank, size in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        ways = [j for j in range(len(room)) if flow.get((old, j), 0) >= size]
        open_to = [j for j in range(len(room)) if room[j] >= size]
        if old in ways:
            to = old
        elif ways:
            to = max(ways, key=lambda j: (flow[old, j], -j))
        elif open_to:
            to = min(open_to, key=lambda j: ((cost or {}).get((old, j), 0 if old == j else 1), -flow.get((old, j), 0), -room[j], j))
        else:
            to = max(range(len(room)), key=lambda j: (room[j], -j))
        placed[old, rank] = to
        left[old] -= size
        room[to] -= size
        if ways:
            flow[old, to] -= size
        else:
            flow = min_cost_flow(left, [max(0, r) for r in room], cost)
    return placed


def _blocks(supplies: Sequence[int], room: Sequence[int], cost, spare: int) -> dict[int, tuple[list[int], list[int]]]:
    """Per old shard the ends of its blocks along the laid-out bytes, and where each goes; the home block first.

    ``spare`` is the room that was asked for beyond all bytes; the flow decides where it stays free.
    """
    # Large rows may have overfilled a shard; its room is none then, and the others' room is cut to fit.
    room = [max(0, r) for r in room]
    excess = sum(room) - sum(supplies) - spare
    while excess > 0:
        j = max(range(len(room)), key=lambda k: room[k])
        others = sorted(room)[-2] if len(room) > 1 else 0
        cut = min(excess, max(1, room[j] - others))
        room[j] -= cut
        excess -= cut
    flow = min_cost_flow(supplies, room, cost)
    found = {}
    for old in range(len(supplies)):
        ends, to, at = [], [], 0
        for j in sorted((j for i, j in flow if i == old), key=lambda j: (j != old, j)):
            at += flow[old, j]
            ends.append(at)
            to.append(j)
        found[old] = (ends, to)
    return found


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


def reshard(
    docs: DataFrame,
    old: Column,
    shards: int = 16,
    capacities: Sequence[int] | None = None,
    cost: Mapping[tuple[int, int], int] | None = None,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, old_shard, shard, slot.

    ``old`` is the shard a row is in, from 0 to ``shards - 1``. Without
    ``capacities`` all shards get the same number of bytes, up to rounding by
    rows. Slots run from 0 in each shard without gaps. A null text has no
    bytes; null ids and repeated rows are rows like others; an empty table gives
    none. The rows travel without their texts.
    """
    spark = docs.sparkSession
    folder = lasting(spark, "reshard")
    slim = folder.save(
        docs.select(
            F.col(f"`{id}`").alias("id"),
            text_size(F.col(f"`{text}`")).alias("size"),
            F.crc32(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")).cast("long").alias("crc"),
            old.cast("int").alias("old"),
        ),
        "rows",
    )
    sums = {r.old: (r.n, r.bytes) for r in slim.groupBy("old").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    if not set(sums) <= set(range(shards)):
        raise ValueError(f"old shards must be 0 to {shards - 1}")
    supplies = [sums.get(k, (0, 0))[1] for k in range(shards)]
    total, rows = sum(supplies), sum(n for n, _ in sums.values())
    capacities = list(capacities or equal_capacities(total, shards))

    # At most LARGE * shards rows are larger than the limit, as together they hold no more than all bytes.
    limit = max(1, total // (LARGE * shards))
    ranked = slim.where(F.col("size") > limit).withColumn(
        "rank", F.row_number().over(Window.partitionBy("old").orderBy(F.desc("size"), "crc", "id"))
    )
    large = [(r.old, r["rank"], r["size"]) for r in ranked.select("old", "rank", "size").collect()]
    placed = place_large(large, supplies, capacities, cost)
    room, rest = list(capacities), list(supplies)
    for old_shard, rank, size in large:
        room[placed[old_shard, rank]] -= size
        rest[old_shard] -= size
    blocks = _blocks(rest, room, cost, sum(capacities) - total)

    places = spark.createDataFrame([(o, r, to) for (o, r), to in placed.items()], "old int, rank int, shard int")
    ways = spark.createDataFrame([(o, ends, to) for o, (ends, to) in blocks.items()], "old int, ends array<long>, ways array<int>")

    buckets = max(1, -(-rows // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("id", "crc"), F.lit(buckets)).cast("int")
    in_bucket = Window.partitionBy("old", "bucket").orderBy("crc", "id", "size")
    small = slim.where(F.col("size") <= limit).withColumn("bucket", bucket)
    before = Window.partitionBy("old").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = small.groupBy("old", "bucket").agg(F.sum("size").alias("bytes")).select(
        "old", "bucket", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start")
    )
    running = F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("start") + F.col("end") - F.col("size") / 2
    way = F.least(F.size(F.filter("ends", lambda e: e <= middle)), F.size("ends") - 1)
    moved_small = (
        small.withColumn("end", running).join(starts, ["old", "bucket"])
        .join(F.broadcast(ways), "old")
        .select("id", "size", "crc", "old", "bucket", F.get("ways", way).alias("shard"))
    )
    moved_large = ranked.join(F.broadcast(places), ["old", "rank"]).select(
        "id", "size", "crc", "old", F.lit(-1).alias("bucket"), "shard"
    )
    placed_rows = folder.save(moved_small.unionByName(moved_large), "placed")

    cell = ["shard", "old", "bucket"]
    counted = placed_rows.groupBy(*cell).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("old", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select(*cell, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy(*cell).orderBy("crc", "id", "size")) - 1
    return (
        placed_rows.withColumn("within", within).join(first, cell)
        .select(
            F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
            "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"),
        )
    )


def rewrite_shards(
    docs: DataFrame, root: str, target: str, shards: int = 16, capacities: Sequence[int] | None = None,
    id: str = "doc_id", text: str = "text",
) -> dict[int, str]:
    """Even out a table stored as ``root/shard=K``; the folder that holds each shard afterwards.

    ``docs`` is that table as read from ``root``, with unique ids and its
    ``shard`` column. Shards that neither lose nor gain a row stay where they
    are; the others are written anew under ``target``, which is emptied first,
    so that a run that was cut off can be repeated.
    """
    spark = docs.sparkSession
    plan = reshard(docs, F.col("shard"), shards, capacities, id=id, text=text)
    plan = lasting(spark, "plan").save(plan.select(id, "old_shard", F.col("shard").alias("__to")), "plan")
    seen = plan.agg(F.count("*").alias("n"), F.count_distinct(id).alias("ids")).first()
    if seen.n != seen.ids:
        raise ValueError(f"{id} must be unique and not null to rewrite files")
    moves = plan.where("old_shard <> __to").select("old_shard", "__to").distinct().collect()
    affected = sorted({r.old_shard for r in moves} | {r["__to"] for r in moves})
    delete(spark, target)
    if affected:
        moving = docs.where(F.col("shard").isin(affected)).join(plan.select(id, "__to"), id)
        moving.withColumn("shard", F.col("__to")).drop("__to").repartition("shard", F.xxhash64(id) % 8).write.partitionBy(
            "shard"
        ).parquet(target)
    return {k: f"{target if k in affected else root}/shard={k}" for k in range(shards)}
