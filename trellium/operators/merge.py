"""Keyed merges on catalog tables. Each returns the new table; nothing is written here.

Every side is reduced to one row per key before it is joined, so a key that
arrives many times folds map-side and cannot blow up or skew the join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.functions.rows import row_pick, unpack


def with_columns_if_absent(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Additive migration: new columns are null in old rows, present ones untouched."""
    have = {c.lower() for c in df.columns}
    return df.withColumns(
        {name: F.lit(None).cast(kind) for name, kind in columns.items() if name.lower() not in have}
    )


def _checked(key: str) -> Column:
    return F.when(
        F.col(key).isNull(), F.raise_error(F.lit(f"merge key {key} must not be null"))
    ).otherwise(F.col(key))


def first_per_key(df: DataFrame, key: str, order_by: Sequence[str] = ()) -> DataFrame:
    picked = df.groupBy(_checked(key).alias("_key")).agg(row_pick(df, "min", order_by).alias("r"))
    return picked.select(*unpack("r", df.columns))


def merge_keep_first(
    target: DataFrame, source: DataFrame, key: str, order_by: Sequence[str] = ()
) -> DataFrame:
    """Insert, keep the existing row on a key clash."""
    fresh = first_per_key(source, key, order_by).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def merge_update(
    target: DataFrame,
    source: DataFrame,
    key: str,
    update: Sequence[str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Insert, or on a key clash take the source's ``update`` columns only, nulls included.

    Several source rows of one key act in ``order_by`` order: the first is the
    row inserted, the last gives the updated columns.
    """
    src = source.groupBy(_checked(key).alias("_k")).agg(
        row_pick(source, "min", order_by).alias("_first"),
        row_pick(source, "max", order_by).alias("_last"),
    )
    both = target.withColumn("_old", F.lit(True)).join(src, F.col(key) == F.col("_k"), "full_outer")
    out = [F.coalesce(F.col(key), F.col("_k")).alias(key)]
    names = [*target.columns, *[c for c in source.columns if c not in target.columns]]
    for name in names:
        if name == key:
            continue
        if name not in source.columns:
            out.append(F.col(name))
            continue
        if name not in target.columns:
            old: Column = F.lit(None)
        else:
            old = F.col(name)
        if name in update:
            value = F.when(F.col("_k").isNotNull(), F.col(f"_last.{name}")).otherwise(old)
        else:
            value = F.when(F.col("_old"), old).otherwise(F.col(f"_first.{name}"))
        out.append(value.alias(name))
    return both.select(*out).select(*names)


def merge_replace(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Source rows replace target rows of the same key. The source has one row per key."""
    kept = target.join(source.select(key), key, "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def update_where_key(
    target: DataFrame, keys: DataFrame, key: str, values: Mapping[str, Column]
) -> DataFrame:
    """Set columns on the rows whose key is in ``keys``; other rows stay as they are."""
    hit = keys.select(F.col(key).alias("_k")).distinct()
    both = target.join(hit, F.col(key) == F.col("_k"), "left")
    return both.select(
        *[
            F.when(F.col("_k").isNotNull(), values[c]).otherwise(F.col(c)).alias(c)
            if c in values
            else F.col(c)
            for c in target.columns
        ]
    )
