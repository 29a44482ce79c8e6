"""Structured Streaming over job events and landed files. Every query here runs to the end of what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.sources.paths import scratch


def land(rows: DataFrame, parts: int, by: str) -> str:
    """rows as a folder of several Parquet files, as a landing folder fills."""
    path = scratch(rows.sparkSession)
    rows.withColumn("_part", F.col(by) % parts).repartition(parts, "_part").drop("_part").write.parquet(path)
    return path


def follow(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_end(stream: DataFrame, mode: str, sink) -> None:
    """Every micro-batch through sink(batch, id), with a checkpoint, until the input is used up."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(stream.sparkSession))
    writer.foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def intake(spark: SparkSession, path: str, schema) -> DataFrame:
    """New rows appended once each to a block-ordered store; read back when all are in."""
    out = scratch(spark)
    run_to_end(follow(spark, path, schema), "append", lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    return spark.read.parquet(out).drop("batch")


def latest_state(spark: SparkSession, path: str, schema, key: str, order: str, value: str) -> DataFrame:
    """Current value of each key from a log of changes: a keyed state with one row per key, replaced when it changes."""
    out = scratch(spark)
    log = follow(spark, path, schema).groupBy(key).agg(F.max_by(F.struct(value, order), order).alias("last"))
    run_to_end(log, "update", lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/step={k}"))
    changes = spark.read.parquet(out)
    return changes.groupBy(key).agg(F.max_by("last", "batch").alias("last")).select(key, f"last.{value}", f"last.{order}")


def counts(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    """Rows seen for each key so far."""
    out = scratch(spark)
    grouped = follow(spark, path, schema).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    run_to_end(grouped, "update", lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/step={k}"))
    return spark.read.parquet(out).groupBy(key).agg(F.max_by("n", "batch").alias("n"))
