"""Nearest class centre, as an Estimator and a Model of pyspark.ml."""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Columns(Params):
    """Names of the columns: an array of numbers, a raw label, and the label predicted."""

    featuresCol = Param(Params._dummy(), "featuresCol", "array of numbers for each pixel", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "raw label to learn", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "raw label predicted", TypeConverters.toString)

    def _named(self, features: str | None, label: str | None, prediction: str | None) -> None:
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="lab")
        given = {"featuresCol": features, "labelCol": label, "predictionCol": prediction}
        self._set(**{k: v for k, v in given.items() if v is not None})


class NearestCentre(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """The mean features of each label; a pixel gets the label whose mean is nearest. One aggregation, a row for each label."""

    @keyword_only
    def __init__(self, *, featuresCol: str | None = None, labelCol: str | None = None, predictionCol: str | None = None):
        super().__init__()
        self._named(featuresCol, labelCol, predictionCol)

    def _fit(self, dataset: DataFrame) -> NearestCentreModel:
        names = [self.getOrDefault(p) for p in (self.featuresCol, self.labelCol, self.predictionCol)]
        first = dataset.select(F.size(names[0])).first()
        if first is None:
            raise ValueError("no training rows")
        means = dataset.groupBy(F.col(names[1]).cast("long").alias("label")).agg(F.array(*(F.avg(F.col(names[0])[k]) for k in range(first[0]))).alias("m")).orderBy("label").collect()
        model = NearestCentreModel(featuresCol=names[0], labelCol=names[1], predictionCol=names[2])
        return model._set(labels=[r["label"] for r in means], centres=[list(r["m"]) for r in means])


class NearestCentreModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Raw labels by the nearest centre (the least squared distance; of equal ones the smallest label)."""

    labels = Param(Params._dummy(), "labels", "raw labels in order", TypeConverters.toListInt)
    centres = Param(Params._dummy(), "centres", "mean features of each label", TypeConverters.toListListFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str | None = None, labelCol: str | None = None, predictionCol: str | None = None):
        super().__init__()
        self._named(featuresCol, labelCol, predictionCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        feature = F.col(self.getOrDefault(self.featuresCol))

        def far(centre: list[float]) -> Column:
            return reduce(Column.__add__, ((feature[k] - m) * (feature[k] - m) for k, m in enumerate(centre)))

        ranked = F.array_min(F.array(*(F.struct(far(c).alias("d"), F.lit(label).cast("long").alias("label")) for label, c in zip(self.getOrDefault(self.labels), self.getOrDefault(self.centres), strict=True))))
        return dataset.withColumn(self.getOrDefault(self.predictionCol), ranked["label"])
