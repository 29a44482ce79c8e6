"""Exact quantiles of values of any type, by histograms that close in on each rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmere.sources.paths import scratch

#: Buckets of one histogram.
BUCKETS = 1 << 16


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, n, low, high, q): number, extremes and, in an array, the quantiles of a numeric column for each key, as numpy.percentile
    interpolates them.

    A pass counts the values between the known bounds of a rank in BUCKETS stretches of equal width, and keeps the extremes
    of the stretch that holds the rank, until they are one value; doubles take four or five passes. So memory is that of
    the histograms, where an aggregate that keeps every distinct value would grow with a volume of floats. Nulls and values
    that aren't finite don't count; keys without any are left out.
    """
    spark = rows.sparkSession
    some = rows.select(*by, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('inf')")
    ends = some.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = scratch(spark)
    ends.write.parquet(f"{place}/ends")
    ends = spark.read.parquet(f"{place}/ends")
    at = F.col("share") * (F.col("n") - 1)
    ranks = ends.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("rank", F.explode(F.array(F.floor(at), F.ceil(at)))).select(*by, "rank", "low", "high", F.lit(0).cast("long").alias("before")).distinct()
    k = 0
    while True:
        ranks.write.parquet(f"{place}/{k}")
        ranks, k = spark.read.parquet(f"{place}/{k}"), k + 1
        if ranks.filter("low < high").isEmpty():
            break
        spans = ranks.filter("low < high").select(*by, "low", "high", "before").distinct()
        inside = some.join(spans, by).filter(F.col("v").between(F.col("low"), F.col("high")))
        v, low, high = F.col("v"), F.col("low"), F.col("high")
        wide = high - low == F.lit(float("inf"))  # then halves, whose width is a number
        way = F.when(wide, (v / 2 - low / 2) / F.when(wide, high / 2 - low / 2)).otherwise((v - low) / (high - low))
        bucket = F.least(F.floor(way * BUCKETS), F.lit(BUCKETS - 1))
        counts = inside.groupBy(*by, "low", "high", "before", bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low_"), F.max("v").alias("high_"))
        upto = F.sum("c").over(Window.partitionBy(*by, "low", "high").orderBy("b")) + F.col("before")
        cut = counts.withColumn("upto", upto).select(*by, "low", "high", "low_", "high_", (F.col("upto") - F.col("c")).alias("from_"), "upto")
        closer = ranks.filter("low < high").join(cut, [*by, "low", "high"]).filter("rank >= from_ and rank < upto").select(*by, "rank", F.col("low_").alias("low"), F.col("high_").alias("high"), F.col("from_").alias("before"))
        ranks = ranks.filter("low = high").unionByName(closer)
    found = ranks.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("values"))

    def quantile(share: float) -> F.Column:
        at = F.lit(share) * (F.col("n") - 1)
        one, two = F.col("values")[F.floor(at)], F.col("values")[F.ceil(at)]
        return one + (two - one) * (at - F.floor(at))

    return ends.join(found, by).select(*by, "n", "low", "high", F.array(*map(quantile, shares)).alias("q"))
