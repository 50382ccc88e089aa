"""A feature assembler that takes whatever a table holds.

Missing numbers are filled and marked, dates become days, texts become the share
of rows that have them. What it learned is a few numbers per column, so it is
saved with the model and scores batches and streams like any stage.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.functions.feature_lists import SchemaError

# A text is known by its share of the rows if it makes up so much of them: at most a thousand texts a column.
TEXT_SHARE = 0.001

NUMBER, DAYS, TEXT = "number", "days", "text"


def kind_of(kind: T.DataType) -> str | None:
    """How a column of this type becomes a number; None if it can't."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return NUMBER
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DAYS
    return TEXT if isinstance(kind, T.StringType) else None


def _number(name: str, kind: str) -> Column:
    """The column as a number, null where it has none."""
    column = F.col(f"`{name}`")
    if kind == DAYS:
        return F.unix_date(column.cast("date")).cast("double")
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


class TolerantAssembler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns fill values (the mean) and text shares, in one aggregate and one grouped count."""

    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), outputCol: str = "features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TolerantModel:
        kinds = {c: kind_of(dataset.schema[c].dataType) for c in self.getOrDefault(self.inputCols)}
        known = {c: k for c, k in kinds.items() if k}
        if not known:
            raise SchemaError(f"no feature can become a number: {sorted(kinds)}")
        facts = [F.count("*").alias("rows")]
        for i, (name, kind) in enumerate(known.items()):
            if kind == TEXT:
                facts.append(F.count(f"`{name}`").alias(f"n{i}"))
            else:
                value = _number(name, kind)
                facts += [F.count(value).alias(f"n{i}"), F.avg(value).alias(f"mean{i}")]
        row = dataset.agg(*facts).first()
        codes = self._text_shares(dataset, [c for c, k in known.items() if k == TEXT], row.rows)
        spec = []
        for i, (name, kind) in enumerate(known.items()):
            column = {"name": name, "kind": kind, "marked": 0 < row[f"n{i}"] < row.rows}
            column |= {"codes": codes.get(name, {})} if kind == TEXT else {"fill": row[f"mean{i}"] or 0.0}
            spec.append(column)
        return TolerantModel(json.dumps(spec), self.getOrDefault(self.outputCol))

    @staticmethod
    def _text_shares(dataset: DataFrame, names: Sequence[str], rows: int) -> dict[str, dict[str, float]]:
        if not names or not rows:
            return {}
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in names]))
        counts = dataset.select(values.alias("t")).where("t.v is not null").groupBy("t.c", "t.v").agg(F.count("*").alias("n"))
        found: dict[str, dict[str, float]] = {}
        for r in counts.where(F.col("n") >= TEXT_SHARE * rows).collect():
            found.setdefault(r.c, {})[r.v] = r.n / rows
        return found


class TolerantModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the vector: per column its number or share, and a mark where training had rows without one."""

    spec = Param(Params._dummy(), "spec", "what was learned per column, as JSON", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    def __init__(self, spec: str | None = None, outputCol: str = "features"):
        super().__init__()
        self._set(outputCol=outputCol)
        if spec is not None:
            self._set(spec=spec)

    def cells(self) -> list[Column]:
        out = []
        for column in json.loads(self.getOrDefault(self.spec)):
            name = column["name"]
            if column["kind"] == TEXT:
                pairs = [F.lit(x) for pair in sorted(column["codes"].items()) for x in pair]
                share = F.create_map(*pairs)[F.col(f"`{name}`").cast("string")] if pairs else F.lit(None)
                out.append(F.coalesce(share.cast("double"), F.lit(0.0)))
                missing = F.col(f"`{name}`").isNull()
            else:
                value = _number(name, column["kind"])
                out.append(F.coalesce(value, F.lit(float(column["fill"]))))
                missing = value.isNull()
            if column["marked"]:
                out.append(missing.cast("double"))
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(F.array(*self.cells())))
