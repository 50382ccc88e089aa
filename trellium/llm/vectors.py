"""Vector columns as whole numbers, so that sums and products are exact on any partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def integer_vectors(df: DataFrame, vector: str, others: dict[str, Column]) -> DataFrame:
    """``others`` and ``x``, floor(256 * entry) of each entry, for the rows that have a whole vector.

    Rows whose vector is null or holds a null or non-finite entry are left out, as
    are vectors of another length than the commonest (of equally common ones the
    longest). Entries beyond the range of long take its nearest end.
    """
    entries = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    rows = df.select(*[c.alias(name) for name, c in others.items()], entries.alias("x"))
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", _finite))
    common = rows.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    length = common.k if common else 0
    scaled = F.transform("x", lambda c: F.floor(c * SCALE))
    return rows.where((F.size("x") == length) & (F.size("x") > 0)).withColumn("x", scaled)


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long lists as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def whole_kind(bound: int) -> type:
    """The quickest type that holds whole numbers up to ``bound`` without overflow."""
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def reach(numbers: np.ndarray) -> int:
    """The largest absolute value; 0 if there is none."""
    return max(abs(int(numbers.min())), abs(int(numbers.max()))) if numbers.size else 0
