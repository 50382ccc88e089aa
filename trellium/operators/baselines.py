"""Constant models: mean regressor and majority classifier, as Spark ML stages.

Fitting is one aggregate; scoring adds a literal column.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.operators.metrics import majority_label, mean_label


class ConstantModel(Model, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Predicts one value. Kept as text beside its SQL type, so any label type survives a save."""

    value = Param(Params._dummy(), "value", "predicted value as text", TypeConverters.toString)
    valueType = Param(Params._dummy(), "valueType", "SQL type of the value", TypeConverters.toString)

    def __init__(self, value: str | None = None, valueType: str | None = None, predictionCol: str = "prediction"):
        super().__init__()
        self._set(predictionCol=predictionCol)
        if value is not None:
            self._set(value=value, valueType=valueType)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kind = self.getOrDefault(self.valueType)
        constant = F.lit(self.getOrDefault(self.value)).cast(kind)
        return dataset.withColumn(self.getPredictionCol(), constant)


class MeanRegressor(Estimator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of the label, 0.0 without rows."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ConstantModel:
        mean = dataset.agg(mean_label(self.getLabelCol()).alias("m")).first().m
        return ConstantModel(repr(float(mean)), "double", self.getPredictionCol())


class MajorityClassifier(Estimator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Most frequent label, the smallest one on a tie."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ConstantModel:
        label = self.getLabelCol()
        row = majority_label(dataset, label).select(F.col("label").cast("string")).first()
        if row is None or row[0] is None:
            raise ValueError("no labelled row to fit a majority on")
        return ConstantModel(row[0], dataset.schema[label].dataType.simpleString(), self.getPredictionCol())
