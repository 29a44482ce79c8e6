"""Agreement of predicted and true labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmere.operators.region import volume

COUNTS = ("tp", "fp", "fn", "correct", "total")


def align(pred: DataFrame, truth: DataFrame, value: str = "lab") -> DataFrame:
    """(x, y, z, p, t): both labels of every voxel that either side has; absence is background."""
    zero, keys = F.lit(0).cast("long"), [*volume(pred), "x", "y", "z"]
    joined = pred.select(*keys, F.col(value).alias("p")).join(truth.select(*keys, F.col(value).alias("t")), keys, "full_outer")
    return joined.select(*keys, F.coalesce("p", zero).alias("p"), F.coalesce("t", zero).alias("t"))


def confusion(aligned: DataFrame, *by: str) -> DataFrame:
    """Foreground counts; correct counts equal labels."""
    p, t = F.col("p") != 0, F.col("t") != 0
    return aligned.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(F.col("p") == F.col("t")).alias("correct"), F.count(F.lit(1)).alias("total"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 1.0).otherwise(part / F.nullif(whole, F.lit(0)))


def with_ratios(counts: DataFrame) -> DataFrame:
    """Dice, IoU, accuracy and loss; an empty denominator gives 1."""
    tp, fp, fn = (F.col(c) for c in COUNTS[:3])
    out = counts.withColumns({"dice": _ratio(2 * tp, 2 * tp + fp + fn), "iou": _ratio(tp, tp + fp + fn), "accuracy": _ratio(F.col("correct"), F.col("total"))})
    return out.withColumn("loss", 1 - F.col("dice"))


def micro(per_slice: DataFrame) -> DataFrame:
    return with_ratios(per_slice.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)))
