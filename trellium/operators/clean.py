"""Cleaning: fold names, require the target, drop null targets, one row per id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.functions.feature_lists import fold, folded_names, require_target
from trellium.functions.rows import row_pick, unpack


def fold_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*folded_names(df.columns))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """NaN is a value here and stays."""
    return df.filter(F.col(f"`{target}`").isNotNull())


def one_row_per_id(
    df: DataFrame, id_column: str = "id", order_by: Sequence[str] | None = None, any_row: bool = False
) -> DataFrame:
    """One row per id; null ids count as one id. No id column: nothing to do.

    The survivor is the first by ``order_by`` and then by all other columns, so
    the result repeats. ``any_row`` leaves the choice to Spark. Both fold copies
    map-side: an id that holds a third of the rows sends one row per task.
    """
    if id_column not in df.columns:
        return df
    if any_row:
        return df.dropDuplicates([id_column])
    best = row_pick(df, "min", order_by or ()).alias("r")
    return df.groupBy(F.col(f"`{id_column}`").alias("_key")).agg(best).select(*unpack("r", df.columns))


def clean(df: DataFrame, target: str, order_by: Sequence[str] | None = None, any_row: bool = False) -> DataFrame:
    """The cleaned training table; one shuffle, for the ids."""
    folded = fold_columns(df)
    require_target([*df.columns, *folded.columns], target)
    return one_row_per_id(drop_null_target(folded, fold(target)), "id", order_by, any_row)
