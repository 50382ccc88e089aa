"""Joins against a side that is small most of the time, but need not be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a side that may be broadcast; the side is counted before it is.
SMALL_ROWS = 10_000


def broadcast_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """The frame marked for broadcast if it holds at most ``limit`` rows, else unmarked.

    The rows that prove the bound are kept, so a small side is computed once and
    the large side of the join is not shuffled. For narrow frames: a key and a
    few values.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


# Rows of one key that stay together; a key with more is dealt into as many shares as it has times so many.
SHARE_ROWS = 1_000_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", share_rows: int = SHARE_ROWS) -> DataFrame:
    """Join rows to a table with one row per key, where one key may hold much of the rows.

    Keys are counted first, folded on the map side. The rows of a hot key, equal
    ones too, are dealt at random into shares in proportion to their number, and
    only its row of the table is repeated, once per share. There is at most one
    hot key per ``share_rows`` rows, so their list is small and is broadcast: a
    shuffle of the rows by the bare key would bring a hot key into one task. How
    the sides of the join itself travel is left to Spark's byte threshold. The result is spread by
    key and share, so a grouping by the key that comes next folds its rows first.
    """
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > share_rows).select(
        key, F.ceil(F.col("__n") / share_rows).cast("int").alias("__shares")
    ))
    shares = F.coalesce("__shares", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__share", F.floor(F.rand(7) * shares).cast("int")).drop("__shares")
    repeated = keyed.join(hot, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
    return dealt.join(repeated, [key, "__share"], how).drop("__share")
