"""Paths as Spark and Arrow both open them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark opens it in, so that tasks reach the same place through Arrow."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def opened(path: str):
    """(file system, path) of a qualified path, in a task."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, _, rest = path.partition(":")
    return (LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else FileSystem.from_uri(path)


def scratch(spark: SparkSession) -> str:
    """A new folder in the space that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{base}/{uuid.uuid4().hex}"
