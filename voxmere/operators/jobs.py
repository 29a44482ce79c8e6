"""Job tables: status, stages, upserts and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Stages in order, and for each status its stage and whether it is an error.
STAGES = ("upload", "convert", "annotate", "segment", "mesh", "done")
STATUSES = (
    ("pending", 0, False), ("uploading", 0, False), ("uploaded", 1, False), ("upload_error", 0, True), ("converting", 1, False), ("convert_error", 1, True), ("converted", 2, False),
    ("annotating", 2, False), ("annotated", 3, False), ("training_queued", 3, False), ("training", 3, False), ("segmenting", 3, False), ("segmented", 4, False), ("segment_error", 3, True),
    ("meshing_queued", 4, False), ("meshing", 4, False), ("meshed", 5, False), ("mesh_error", 4, True), ("done", 5, False),
)


def status(text: Column) -> Column:
    """Status name without its enumeration's prefix."""
    return F.lower(F.element_at(F.split(text, "[.]"), -1))


def known_status(text: Column) -> Column:
    return status(text).isin([s for s, _, _ in STATUSES])


def by_stage(jobs: DataFrame) -> DataFrame:
    """(stage, state, n): for every stage how many jobs have done it, are in it, failed in it or have it before them."""
    dimension = jobs.sparkSession.createDataFrame(STATUSES, "status string, at int, error boolean")
    marked = jobs.select(status(F.col("status")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(dimension), "status")
    stages = marked.select("at", "error", "n", F.posexplode(F.array(*map(F.lit, STAGES))).alias("k", "stage"))
    state = F.when(F.col("k") < F.col("at"), "done").when(F.col("k") > F.col("at"), "upcoming").when(F.col("error"), "error").otherwise("current")
    return stages.groupBy("stage", state.alias("state")).agg(F.sum("n").alias("n"))


def first_by_status(jobs: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """For each status wanted its first job by creation, then id."""
    rows = jobs.withColumn("status", status(F.col("status"))).filter(F.col("status").isin(*wanted))
    return rows.groupBy("status").agg(F.min(F.struct("created_at", "id")).alias("first")).select("status", F.col("first.id").alias("id"), F.col("first.created_at").alias("created_at"))


def upsert(old: DataFrame, changes: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Old rows with each field's last given value; a change's null field leaves what was there."""
    rows = old.withColumn(order, F.lit(-1).cast("long")).unionByName(changes, allowMissingColumns=True)
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return rows.groupBy(key).agg(*last, F.max(order).alias("last_change"))


def reassemble(parts: DataFrame) -> DataFrame:
    """Files from their parts: text in part order, whether all parts came and the size is the declared one.

    Of a part that came twice the first by text stays.
    """
    once = parts.groupBy("file_id", "part_index").agg(F.min("payload").alias("payload"), F.first("total_parts").alias("total_parts"), F.first("total_size").alias("total_size"))
    joined = once.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_index", "payload"))), lambda p: p["payload"]), "").alias("content"), F.count(F.lit(1)).alias("n_parts"), F.max("total_parts").alias("total_parts"), F.max("total_size").alias("total_size"))
    size = F.length("content").cast("long")
    return joined.select("file_id", F.sha2("content", 256).alias("content_sha256"), size.alias("size"), (F.col("n_parts") == F.col("total_parts")).alias("complete"), (size == F.col("total_size")).alias("size_ok"))


def running_progress(done: DataFrame, by: str, order: str) -> DataFrame:
    """Share of a job's blocks that are finished, at each of them; the last reaches 1."""
    w = Window.partitionBy(by)
    return done.withColumn("progress", F.row_number().over(w.orderBy(order)) / F.count(F.lit(1)).over(w))
