"""Queries on streams; each equals its batch twin in SQL."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from voxmere.operators.region import floor_div
from voxmere.plans.registry import query
from voxmere.sources.images import broken, png_rows, write_files
from voxmere.sources.paths import scratch
from voxmere.sources.tables import table
from voxmere.sources.views import view
from voxmere.streaming import intake as S
from voxmere.streaming import landing as L
from voxmere.streaming import progress as P

WAVES, JOBS = 3, 6


def uploads(spark, d):
    """(wave, name, content): the files of six jobs as they land in three waves.

    Jobs 0, 1 and 3 are loose images (the last wave of 1 comes late, every fourth of 3 is broken), 2 is an archive a wave, 4 has
    a header file among its images, 5 never gets all files that its note promises.
    """
    images = png_rows(view(spark, d, "voxels").withColumn("v", F.col("v") % 256), name="{:09d}.png")
    job, wave = (F.col("z") % JOBS).alias("job"), (floor_div("z", JOBS) % WAVES).alias("wave")
    halves = broken(images.withColumn("place", F.col("z")).withColumn("z", F.when(F.col("z") % JOBS == 3, floor_div("z", JOBS) + 1).otherwise(1)), 4).withColumn("z", F.col("place"))
    path = scratch(spark)
    halves.select(job, wave, "name", "content").write.parquet(path)
    rows = spark.read.parquet(path)

    def zipped(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                archive.writestr(f"in/{name}", content)
                archive.writestr(f"__MACOSX/{name}", b"fork")
        return pd.DataFrame({"wave": [frame["wave"].iloc[0]], "name": [f"2/{frame['wave'].iloc[0]}.zip"], "content": [out.getvalue()]})

    loose = rows.filter("job <> 2").select("wave", F.concat("job", F.lit("/"), "name").alias("name"), "content")
    archives = rows.filter("job = 2").groupBy("wave").applyInPandas(zipped, "wave long, name string, content binary")
    promised = F.count_if((F.col("job") != 1) | (F.col("wave") < WAVES - 1)) + F.when(F.col("job") >= 4, 1).otherwise(0)
    counts = rows.groupBy("job").agg(F.countDistinct("wave").alias("waves"), promised.alias("n"))
    notes = counts.select(F.lit(0).cast("long").alias("wave"), F.concat("job", F.lit(f"/{L.NOTE}")).alias("name"), F.concat(F.lit('{"files": '), F.when(F.col("job") == 2, F.col("waves")).otherwise(F.col("n")), F.lit("}")).cast("binary").alias("content"))
    header = rows.filter("job = 4").select("wave").distinct().filter("wave = 0").select("wave", F.lit("4/head.dcm").alias("name"), F.lit("DICM").cast("binary").alias("content"))
    return loose.unionByName(archives).unionByName(notes).unionByName(header)


@query("landing_intake", "voxels", sql=f"""SELECT z % {JOBS} AS job_id, x, y, z // {JOBS} AS z, CASE WHEN z % {JOBS} = 3 AND (z // {JOBS} + 1) % 4 = 0 THEN 0 ELSE v % 256 END AS v FROM voxels WHERE z % {JOBS} < 4""")
def landing_intake(spark, d):
    """Uploads land in three waves; after each, what is whole is converted into the block table, by one checkpoint."""
    files = scratch(spark)
    uploads(spark, d).write.partitionBy("wave").parquet(files)
    folder, blocks, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    for wave in range(WAVES):
        write_files(spark.read.parquet(files).filter(F.col("wave") == wave), folder)
        L.convert_landed(spark, folder, blocks, checkpoint)
    return L.converted(spark, blocks).select(F.col("volume_id").cast("long").alias("job_id"), "x", "y", "z", "v")


@query("event_intake", sql="SELECT event_id, user_id, event_type FROM events")
def event_intake(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return S.intake(spark, S.land(rows, 4, "event_id"), rows.schema)


@query("job_state_latest", sql="SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def job_state_latest(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return S.latest_state(spark, S.land(rows, 4, "event_id"), rows.schema, "user_id", "ts", "event_type")


@query("stream_job_progress", sql="SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id")
def stream_job_progress(spark, d):
    rows = table(spark, d, "events").filter("event_type = 'view'").select("event_id", "user_id")
    return S.counts(spark, S.land(rows, 4, "event_id"), rows.schema, "user_id")


@query("job_progress_stream", sql="WITH t AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS total FROM events GROUP BY user_id) SELECT user_id AS job_id, total AS done, total, 1.0::DOUBLE AS progress FROM t")
def job_progress_stream(spark, d):
    """Finished blocks in four batches, some told twice, and totals in three; what was last said of each job."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    blocks = events.filter("event_type = 'view'").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("block_id"))
    again = blocks.unionByName(blocks.filter("block_id % 3 = 0"))
    totals = events.groupBy(F.col("user_id").alias("job_id")).agg(F.count_if(F.col("event_type") == "view").alias("total"))
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", L.STATE_STORE)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    told = P.job_progress(S.follow(session, S.land(again, 4, "block_id"), again.schema), S.follow(session, S.land(totals, 3, "job_id"), totals.schema))
    out = scratch(spark)
    S.run_to_end(told, "update", lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/step={k}"))
    last = spark.read.parquet(out).groupBy("job_id").agg(F.max_by(F.struct("done", "total", "progress"), "batch").alias("p"))
    return last.select("job_id", "p.*")
