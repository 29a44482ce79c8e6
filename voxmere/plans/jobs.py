"""Queries on jobs, uploads and source files' headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmere.operators import jobs as J
from voxmere.plans.registry import query
from voxmere.sources.views import view

CLEAN = "lower(split_part(status, '.', -1))"
DIM = "dm(status, pos, error) AS (VALUES " + ", ".join(f"('{s}', {a}, {str(e).lower()})" for s, a, e in J.STATUSES) + ")"
STAGE = "sg(k, stage) AS (VALUES " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(J.STAGES)) + ")"


def jobs(spark, d):
    return view(spark, d, "jobs")


@query("status_filter", "jobs", sql=f"SELECT id, created_at FROM jobs WHERE {CLEAN} = 'meshed'")
def status_filter(spark, d):
    return jobs(spark, d).filter(J.status(F.col("status")) == "meshed").select("id", "created_at")


@query("parse_status", "jobs", sql=f"WITH {DIM} SELECT id, {CLEAN} AS status, {CLEAN} IN (SELECT status FROM dm) AS known FROM jobs")
def parse_status(spark, d):
    return jobs(spark, d).select("id", J.status(F.col("status")).alias("status"), J.known_status(F.col("status")).alias("known"))


@query("jobs_by_stage", "jobs", sql=f"WITH {DIM}, {STAGE} SELECT stage, CASE WHEN k < pos THEN 'done' WHEN k > pos THEN 'upcoming' WHEN error THEN 'error' ELSE 'current' END AS state, count(*) AS n FROM jobs JOIN dm ON dm.status = lower(split_part(jobs.status, '.', -1)) CROSS JOIN sg GROUP BY 1, 2")
def jobs_by_stage(spark, d):
    return J.by_stage(jobs(spark, d))


@query("next_job", "jobs", sql=f"SELECT {CLEAN} AS status, arg_min(id, (created_at, id)) AS id, min(created_at) AS created_at FROM jobs WHERE {CLEAN} IN ('uploaded', 'training_queued', 'meshing_queued') GROUP BY 1")
def next_job(spark, d):
    return J.first_by_status(jobs(spark, d), ("uploaded", "training_queued", "meshing_queued"))


@query("voxel_count", "jobs", sql="SELECT id, CASE WHEN id % 10 = 0 THEN 0 ELSE nx * ny * nz END AS n FROM jobs")
def voxel_count(spark, d):
    shape = F.when(F.col("id") % 10 != 0, F.array("nx", "ny", "nz"))
    return jobs(spark, d).select("id", F.coalesce(F.aggregate(shape, F.lit(1).cast("long"), lambda a, b: a * b), F.lit(0).cast("long")).alias("n"))


@query("job_upsert", "jobs", sql="WITH c AS (SELECT user_id AS id, event_id AS seq, event_type AS status, CASE WHEN event_id % 3 = 0 THEN value END AS progress FROM events), u AS (SELECT id, -1 AS seq, status, progress FROM jobs UNION ALL SELECT * FROM c) SELECT id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(progress, seq) FILTER (progress IS NOT NULL) AS progress, max(seq) AS last_change FROM u GROUP BY id")
def job_upsert(spark, d):
    from voxmere.sources.tables import table

    changes = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("progress"))
    return J.upsert(jobs(spark, d).select("id", "status", "progress"), changes, "id", "seq", ["status", "progress"])


@query("job_table_scan", "jobs", sql="SELECT CASE WHEN id % 11 <> 0 THEN id END AS id, CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN 0.0 ELSE progress END AS progress, CASE WHEN id % 5 = 0 OR id % 11 = 0 THEN 'image_stack' ELSE 'dicom' END AS source_type, CASE WHEN id % 11 <> 0 THEN status END AS status, id % 11 = 0 AS corrupt FROM jobs")
def job_table_scan(spark, d):
    """Job records as JSON lines with an explicit schema; missing fields get defaults, broken records stay marked."""
    from voxmere.sources.paths import scratch

    i, path = F.col("id"), scratch(spark)
    record = F.to_json(F.struct("id", "status", F.when(i % 7 != 0, F.col("progress")).alias("progress"), F.when(i % 5 != 0, "dicom").alias("source_type")))
    line = F.when(i % 11 == 0, F.substring(record, 1, 12)).otherwise(record)
    jobs(spark, d).select(line.alias("value")).write.text(path)
    schema = "id long, status string, progress double, source_type string, _corrupt_record string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.select("id", F.coalesce("progress", F.lit(0.0)).alias("progress"), F.coalesce("source_type", F.lit("image_stack")).alias("source_type"), "status", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("upload_reassemble", "upload_parts", sql="SELECT file_id, sha256(string_agg(payload, '' ORDER BY part_index)) AS content_sha256, sum(length(payload))::BIGINT AS size, count(*) = max(total_parts) AS complete, sum(length(payload)) = max(total_size) AS size_ok FROM upload_parts GROUP BY file_id")
def upload_reassemble(spark, d):
    return J.reassemble(view(spark, d, "upload_parts"))


@query("job_progress", sql="SELECT user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) / CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS progress FROM events WHERE event_type = 'view'")
def job_progress(spark, d):
    from voxmere.sources.tables import table

    blocks = table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("job_id"), "event_id")
    return J.running_progress(blocks, "job_id", "event_id")
