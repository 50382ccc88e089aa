"""Total orders over rows, for picks that must repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    return False


def row_pick(df: DataFrame, pick: str, first: Sequence[str] = (), lead: Column | None = None) -> Column:
    """Aggregate giving the whole ``min`` or ``max`` row of a group as a struct.

    Rows are ordered by ``lead``, then the columns of ``first``, then all other
    columns. Maps have no order in Spark and count as JSON text.
    """
    names = [*first, *[c for c in df.columns if c not in first]]
    columns = [F.col(f"`{c}`") for c in names]
    leads = [] if lead is None else [lead.alias("_lead")]
    if not any(holds_map(df.schema[c].dataType) for c in names):
        return (F.min if pick == "min" else F.max)(F.struct(*leads, *columns))
    order = [
        F.to_json(F.struct(c)) if holds_map(df.schema[n].dataType) else c for n, c in zip(names, columns)
    ]
    by = F.min_by if pick == "min" else F.max_by
    return by(F.struct(*columns), F.struct(*leads, *[c.alias(f"o{i}") for i, c in enumerate(order)]))


def unpack(struct: str, names: Sequence[str]) -> list[Column]:
    return [F.col(f"{struct}.`{c}`").alias(c) for c in names]


def is_missing(df: DataFrame, name: str) -> Column:
    """Is there no value in a column? Not a number counts as none."""
    column = F.col(f"`{name}`")
    fractional = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return column.isNull() | F.isnan(column) if fractional else column.isNull()
