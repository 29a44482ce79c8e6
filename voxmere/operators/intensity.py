"""Intensity windows over voxel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmere.functions.pixels import window
from voxmere.operators.quantiles import exact_quantiles

ENOUGH = 128
SHARES = (0.01, 0.995)


def window_bounds(voxels: DataFrame, by: str = "label") -> DataFrame:
    """For each volume its extremes and the automatic window: the 1 and 99.5 percentiles of the values that aren't zero if
    there are ENOUGH of them, else of all; the extremes where that window is empty.

    The percentile aggregate keeps a count for each distinct value, so volumes of whole numbers need bounded memory; volumes of
    floats are counted by histograms. There values that aren't finite don't count.
    """
    if isinstance(voxels.schema["v"].dataType, T.FractionalType):
        kinds = F.explode(F.when(F.col("v") != 0, F.array(F.lit("all"), F.lit("some"))).otherwise(F.array(F.lit("all")))).alias("kind")
        found = exact_quantiles(voxels.select(by, "v", kinds), [by, "kind"], "v", SHARES)
        one = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        both = found.groupBy(by).agg(one("all", "low").alias("source_min"), one("all", "high").alias("source_max"), F.coalesce(one("some", "n"), F.lit(0)).alias("n_some"), one("some", "q").alias("p_some"), one("all", "q").alias("p_all"))
    else:
        v = F.col("v")
        some, shares = F.when(v != 0, v), F.array(*map(F.lit, SHARES))
        both = voxels.groupBy(by).agg(F.min(v).alias("source_min"), F.max(v).alias("source_max"), F.count(some).alias("n_some"), F.percentile(some, shares).alias("p_some"), F.percentile(v, shares).alias("p_all"))
    picked = F.when(F.col("n_some") >= ENOUGH, F.col("p_some")).otherwise(F.col("p_all"))
    low, high = F.get(picked, F.lit(0)), F.get(picked, F.lit(1))
    good = high > low
    return both.select(by, "source_min", "source_max", F.when(good, low).otherwise(F.col("source_min").cast("double")).alias("window_min"), F.when(good, high).otherwise(F.col("source_max").cast("double")).alias("window_max"))


def auto_window(voxels: DataFrame, by: str = "label") -> DataFrame:
    """Voxels on 0..255 by their volume's automatic window; a constant volume is 0, or 255 if its value is positive."""
    bounds = window_bounds(voxels, by)
    flat = F.when(F.col("v") > 0, 255).otherwise(0).cast("long")
    joined = voxels.join(bounds, by)
    w = F.when(F.col("window_max") > F.col("window_min"), window(F.col("v"), F.col("window_min"), F.nullif("window_max", "window_min"))).otherwise(flat)
    return joined.withColumn("w", w)
