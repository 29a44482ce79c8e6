"""Landed uploads, converted once each: a watched folder, keyed state that says when a job is whole, and a block table.

A job's files lie in a folder of its name below the landing folder: image files, or zip archives of them. A file job.json
with {"files": n} may say how many there are.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from voxmere.operators import headers as H
from voxmere.sources.blocks import open_blocks, pack
from voxmere.sources.images import decode, placed, spread, together
from voxmere.sources.paths import exists, scratch

NOTE = "job.json"
FILES = "path string, modificationTime timestamp, length long, content binary"
JOBS = 1000  # converted together
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Completeness(StatefulProcessor):
    """Per job the names of its files so far and how many it was said to have.

    A job is whole when it has that many; without a note when `quiet` milliseconds have passed since its last file, by a timer.
    Each file that comes to a whole job makes it whole anew, so late parts are converted, too. Time is that of the batches
    in which files came, so a file with an old date isn't late; it goes on when further files land, of any job.
    """

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "name string", "length long")
        self.counts = handle.getValueState("counts", "n long, needed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, needed = self.counts.get() if self.counts.exists() else (0, None)
        for frame in rows:
            now = int(frame["at"].max().timestamp() * 1000)
            for name, length, said in zip(frame["name"], frame["length"], frame["needed"], strict=True):
                if name == NOTE:
                    needed = None if pd.isna(said) else int(said)
                    continue
                n += not self.seen.containsKey((name,))
                self.seen.updateValue((name,), (int(length),))
        self.counts.update((n, needed))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if needed is None:
            self.handle.registerTimer(now + self.quiet)
        elif n >= needed:
            yield self.whole(key, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _ = self.counts.get()
        if n:
            yield self.whole(key, n)

    def whole(self, key, n: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "n_files": [n]})

    def close(self) -> None:
        pass


def expand(files: DataFrame) -> DataFrame:
    """(job_id, source, path, content, is_dicom, width, height) of files and of the members of archives, source being the landed
    file; resource forks, hidden files and members whose path leads out of the archive are left out. Members are passed on
    in lists of bounded size; width and height are null where the file has no readable head."""

    def facts(path: str, content: bytes) -> dict:
        size = struct.unpack(">II", content[16:24]) if content[:4] == b"\x89PNG" and len(content) >= 33 else (None, None)
        return {"path": path, "content": content, "is_dicom": path.lower().endswith(".dcm") or content[128:132] == b"DICM", "width": size[0], "height": size[1]}

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[dict, int]]:
        for frame in frames:
            for job, path, content in zip(frame["job_id"], frame["path"], frame["content"], strict=True):
                found = [facts(path, content)]
                if path.lower().endswith(".zip"):
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    found = (facts(i.filename, archive.read(i)) for i in archive.infolist() if not i.is_dir())
                for one in found:
                    yield {"job_id": job, "source": path, **one}, len(one["content"])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in together(members(frames)):
            yield pd.DataFrame(some).astype({"width": "Int64", "height": "Int64"})

    rows = files.select("job_id", "path", "content").mapInPandas(each, "job_id string, source string, path string, content binary, is_dicom boolean, width long, height long")
    return rows.filter(H.is_source(F.col("path")) & H.is_safe(F.col("path")))


def convert(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(voxels, states) of whole jobs from (job_id, path, content).

    voxels (volume_id, x, y, z, v) of the jobs that are image stacks of PNG files; z is a file's rank by name, then path. An image
    that can't be read is a slice of zeros of the size of the job's first readable one. states (job_id, status, n_files, nx,
    ny, nz) has all jobs: mixed or unreadable files end in convert_error, as do series of headers, which have no pixels here.
    """
    path = scratch(files.sparkSession)
    expand(files).write.parquet(path)  # archives are opened once
    order = F.concat_ws("\0", F.element_at(F.split("path", "/"), -1), "path", "source")
    rows = files.sparkSession.read.parquet(path).withColumn("name", order)
    routes = H.route(rows.withColumn("declared", F.lit("image_stack")))
    sizes = rows.groupBy("job_id").agg(F.min_by(F.struct("width", "height"), F.when(F.col("width").isNotNull(), F.col("name"))).alias("s"))
    good = routes.filter("route = 'image_stack'").join(sizes, "job_id").filter("s.width is not null").select("job_id", F.col("s.width").alias("w"), F.col("s.height").alias("h"))
    done = F.col("w").isNotNull()
    states = routes.join(good, "job_id", "left").select("job_id", F.when(done, "converted").otherwise("convert_error").alias("status"), "n_files", F.col("w").alias("nx"), F.col("h").alias("ny"), F.when(done, F.col("n_files")).alias("nz"))
    stacks = rows.join(good, "job_id").withColumnRenamed("job_id", "stack")
    voxels = spread(placed(stacks.select("stack", "name", "content", "w", "h"), stacks.select("stack", "name")), lambda row: decode(bytes(row.content)))
    return voxels.select(F.col("stack").alias("volume_id"), "x", "y", "z", "v"), states


def watch(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """(job_id, name, length, needed, at) of files as they land, `at` being their batch; contents are read of the notes only."""

    def landed(glob: str) -> DataFrame:
        return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).load(folder)

    job, name = F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("job_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("name")
    needed = F.get_json_object(F.col("content").cast("string"), "$.files").try_cast("long").alias("needed")
    notes = landed(NOTE).select(job, name, "length", needed)
    files = landed("*").select(job, name, "length", F.lit(None).cast("long").alias("needed")).filter(F.col("name") != NOTE)
    return notes.unionByName(files).withColumn("at", F.current_timestamp()).withWatermark("at", "0 seconds")


def convert_landed(spark: SparkSession, folder: str, blocks: str, checkpoint: str, quiet: int = 60_000, files_a_batch: int = 1000) -> None:
    """Convert all jobs below folder that are whole by now into the block table `blocks`, and stop.

    The checkpoint keeps which files were seen, so that a run after it, or after a failure, goes on where the last one
    ended. Batches only note which jobs they made whole, in a folder `due` of the checkpoint; after the last batch each of
    those jobs is converted once, however many batches its files came in, and the notes go. A run that fails before that
    leaves them to the next. A job's blocks and state are one partition each, replaced as a whole: a job that is converted
    twice leaves what it left before. blocks gets two tables: `voxels` (by volume_id and cz) and `states` (by job_id).
    """
    session = spark.newSession()  # the state store is set for this query alone
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch adds its changes, no copy
    cores = spark.sparkContext.defaultParallelism
    session.conf.set("spark.sql.shuffle.partitions", min(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # each is a store and a worker a batch
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", cores)  # else a task a file
    session.conf.set("spark.sql.hive.filesourcePartitionFileCacheSize", 0)  # else the driver remembers every file that a batch named
    session.conf.set("spark.sql.files.openCostInBytes", "64k")  # else a task for a few files, whose images are small
    due = f"{checkpoint}/due"
    whole = watch(session, folder, files_a_batch).groupBy("job_id").transformWithStateInPandas(Completeness(quiet), "job_id string, n_files long", "Update", "eventTime")

    def sink(batch: DataFrame, k: int) -> None:
        batch.select("job_id").write.mode("overwrite").parquet(f"{due}/{k}")  # folders that a batch of files completed

    def convert_jobs(jobs: list[str]) -> None:
        reader = session.read.format("binaryFile").option("recursiveFileLookup", "true")
        files = reader.load([f"{folder}/{job}" for job in jobs])
        rows = files.select(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("job_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("path"), "content").filter(F.col("path") != NOTE)
        voxels, states = convert(rows)
        save = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(f"{blocks}/{name}")
        save(pack(voxels), "voxels", "volume_id")
        save(states, "states", "job_id")

    writer = whole.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer.trigger(availableNow=True).start().awaitTermination()
    if not exists(session, due):
        return
    notes = session.read.schema("job_id string").option("recursiveFileLookup", "true").parquet(due)
    jobs = sorted(r["job_id"] for r in notes.distinct().collect())
    for lo in range(0, len(jobs), JOBS):
        convert_jobs(jobs[lo : lo + JOBS])
    if jobs:
        session.range(0).select(F.lit("").alias("job_id")).write.mode("overwrite").parquet(due)  # createDataFrame would make the session the active one


def states(spark: SparkSession, blocks: str) -> DataFrame:
    """(job_id, status, n_files, nx, ny, nz) of the jobs converted so far."""
    return spark.read.schema("status string, n_files long, nx long, ny long, nz long, job_id string").parquet(f"{blocks}/states")


def converted(spark: SparkSession, blocks: str) -> DataFrame:
    """Voxels (volume_id, x, y, z, v, with chunk columns) of the jobs that are converted."""
    done = states(spark, blocks).filter("status = 'converted'").select(F.col("job_id").alias("volume_id"))
    voxels = open_blocks(spark, f"{blocks}/voxels")
    return voxels.withColumn("volume_id", F.col("volume_id").cast("string")).join(done, "volume_id", "left_semi")
