"""Feature stages: assembling, and optional imputation, encoding and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trellium.functions.feature_lists import SchemaError
from trellium.operators.tolerant import TolerantAssembler


@dataclass(frozen=True)
class Preparation:
    """Everything off by default: a null feature is then an error, a text feature too.

    ``tolerant`` takes any column instead: see ``TolerantAssembler``.
    """

    impute: str | None = None  # mean, median or mode
    encode: bool = False
    scale: bool = False
    invalid: str = "error"  # error, skip or keep: what the assembler does with nulls
    tolerant: bool = False

    def refuses_missing(self, kind: T.DataType) -> bool:
        """Does a missing value in a column of this type end the fit?"""
        if self.tolerant or self.invalid != "error" or isinstance(kind, T.StringType):
            return False
        return not (self.impute and isinstance(kind, T.NumericType))


def feature_types(df: DataFrame, features: Sequence[str]) -> dict[str, str]:
    return {c: df.schema[c].dataType.simpleString() for c in features}


def stages(df: DataFrame, features: Sequence[str], prep: Preparation = Preparation()) -> list[Estimator | Transformer]:
    """Stages that turn the feature columns into the vector ``features``."""
    if prep.tolerant:
        target = "features__raw" if prep.scale else "features"
        scaled = [StandardScaler(inputCol=target, outputCol="features", withMean=True, withStd=True)] if prep.scale else []
        return [TolerantAssembler(inputCols=list(features), outputCol=target), *scaled]
    texts = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    if texts and not prep.encode:
        raise SchemaError(f"text features need encoding: {texts}")
    usable = (T.NumericType, T.BooleanType, T.StringType, VectorUDT)
    others = {c: df.schema[c].dataType.simpleString() for c in features if not isinstance(df.schema[c].dataType, usable)}
    if others:
        raise SchemaError(f"features of these types can't be assembled: {others}")
    out: list[Estimator | Transformer] = []
    inputs = list(features)
    numbers = [c for c in features if isinstance(df.schema[c].dataType, T.NumericType)]
    if prep.impute and numbers:
        filled = [f"{c}__filled" for c in numbers]
        out.append(Imputer(strategy=prep.impute, inputCols=numbers, outputCols=filled))
        swap = dict(zip(numbers, filled))
        inputs = [swap.get(c, c) for c in inputs]
    if texts:
        coded = [f"{c}__code" for c in texts]
        hot = [f"{c}__hot" for c in texts]
        out.append(StringIndexer(inputCols=texts, outputCols=coded, handleInvalid="keep"))
        out.append(OneHotEncoder(inputCols=coded, outputCols=hot))
        swap = dict(zip(texts, hot))
        inputs = [swap.get(c, c) for c in inputs]
    target = "features__raw" if prep.scale else "features"
    out.append(VectorAssembler(inputCols=inputs, outputCol=target, handleInvalid=prep.invalid))
    if prep.scale:
        out.append(StandardScaler(inputCol=target, outputCol="features", withMean=True, withStd=True))
    return out


def drop_stage_columns(df: DataFrame) -> DataFrame:
    """Remove what model stages add beside the prediction."""
    helpers = [c for c in df.columns if c.endswith(("__filled", "__code", "__hot")) or c == "features__raw"]
    return df.drop("features", "rawPrediction", "probability", "label__code", *helpers)
