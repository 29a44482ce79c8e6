"""Zip archives of source files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.sources.paths import scratch


def write_archives(files: DataFrame) -> str:
    """One archive for each job of (job_id, path), as Parquet rows (archive, content)."""

    def zipped(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for path in frame["path"]:
                archive.writestr(path, path)
        return pd.DataFrame({"archive": [f"{frame['job_id'].iloc[0]}.zip"], "content": [out.getvalue()]})

    path = scratch(files.sparkSession)
    files.groupBy("job_id").applyInPandas(zipped, "archive string, content binary").write.parquet(path)
    return path


def members(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, path, content) of all members of the archives; an archive is opened in one task."""

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["archive"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [i.filename for i in archive.infolist() if not i.is_dir()]
                    yield pd.DataFrame({"archive": name, "path": names, "content": [archive.read(n) for n in names]})

    found = spark.read.parquet(path).mapInPandas(opened, "archive string, path string, content binary")
    return found.select(F.regexp_extract("archive", "^([0-9]+)", 1).cast("long").alias("job_id"), "path", "content")
