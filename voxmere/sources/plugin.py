"""A pluggable volume source and sink: one folder of Parquet parts that each hold a range of z, and a note of shape and dtype.

The note is written last, so a folder without one isn't a volume. Filters on z are pushed into the source, which then opens
only the parts and row groups that may hold such slices.
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from voxmere.sources.paths import opened, qualified

NOTE = "_volume.json"
#: Values a voxel may have, by the volume's dtype.
DTYPES = {"uint8": "short", "int8": "short", "uint16": "int", "int16": "short", "uint32": "long", "int32": "int", "int64": "long", "float32": "float", "float64": "double"}


def read_note(path: str) -> dict:
    """shape, dtype, columns and parts of a volume, in a task or on the driver."""
    system, place = opened(path)
    with system.open_input_stream(posixpath.join(place, NOTE)) as f:
        return json.loads(f.read())


class Slices(InputPartition):
    """Parts of a volume that may hold slices lo <= z < hi."""

    def __init__(self, files: list[str], lo: float, hi: float):
        self.files, self.lo, self.hi = files, lo, hi


class SliceReader(DataSourceReader):
    """One partition for each part; a partition opens its files itself, and only the row groups of its slices."""

    def __init__(self, path: str):
        self.path, self.note = path, read_note(path)
        self.lo, self.hi = -math.inf, math.inf

    def pushFilters(self, filters):
        """Bounds on z are kept here; all other filters are left to Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            bound = getattr(f, "attribute", None) == ("z",) and value is not None
            if bound and isinstance(f, EqualTo):
                self.lo, self.hi = max(self.lo, value), min(self.hi, value + 1)
            elif bound and isinstance(f, GreaterThanOrEqual):
                self.lo = max(self.lo, value)
            elif bound and isinstance(f, GreaterThan):
                self.lo = max(self.lo, value + 1)
            elif bound and isinstance(f, LessThan):
                self.hi = min(self.hi, value)
            elif bound and isinstance(f, LessThanOrEqual):
                self.hi = min(self.hi, value + 1)
            else:
                if bound and isinstance(f, In) and value and None not in value:
                    self.lo, self.hi = max(self.lo, min(value)), min(self.hi, max(value) + 1)
                yield f

    def partitions(self):
        wanted = [p for p in self.note["parts"] if p["z1"] >= self.lo and p["z0"] < self.hi]
        return [Slices([p["file"]], self.lo, self.hi) for p in wanted] or [Slices([], 0, 0)]

    def read(self, partition):
        import pyarrow.dataset as ds

        system, place = opened(self.path)
        wanted = None
        if partition.lo > -math.inf:
            wanted = ds.field("z") >= partition.lo
        if partition.hi < math.inf:
            below = ds.field("z") < partition.hi
            wanted = below if wanted is None else wanted & below
        for name in partition.files:
            yield from ds.dataset(posixpath.join(place, name), format="parquet", filesystem=system).to_batches(columns=self.note["columns"], filter=wanted)


@dataclass
class Part(WriterCommitMessage):
    file: str
    n: int
    low: tuple
    high: tuple


class SliceWriter(DataSourceArrowWriter):
    """Each task writes one part under a name of this write; the driver then writes the note, or takes the parts away again."""

    def __init__(self, path: str, dtype: str, columns: list[str], overwrite: bool):
        self.path, self.dtype, self.columns, self.overwrite, self.run = path, dtype, columns, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        system, place = opened(self.path)
        system.create_dir(place)
        context = TaskContext.get()
        name, writer, n, low, high = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{self.run}.parquet", None, 0, None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    writer = pq.ParquetWriter(posixpath.join(place, name), batch.schema, filesystem=system, compression="zstd")
                writer.write_batch(batch, row_group_size=1 << 16)
                ends = [pc.min_max(batch.column(a)).as_py() for a in "xyz"]
                low = [e["min"] if low is None else min(e["min"], low[k]) for k, e in enumerate(ends)]
                high = [e["max"] if high is None else max(e["max"], high[k]) for k, e in enumerate(ends)]
                n += batch.num_rows
        except BaseException:
            if writer is not None:
                writer.close()
                system.delete_file(posixpath.join(place, name))
            raise
        if writer is None:
            return Part("", 0, (), ())
        writer.close()
        return Part(name, n, tuple(low), tuple(high))

    def commit(self, messages):
        from pyarrow.fs import FileSelector

        parts = [m for m in messages if m is not None and m.n]
        system, place = opened(self.path)
        system.create_dir(place)
        old = [] if not self.overwrite else [f.path for f in system.get_file_info(FileSelector(place)) if f.base_name.startswith("part-") and self.run not in f.base_name]
        note = {
            "dtype": self.dtype, "columns": self.columns, "shape": [max(p.high[k] for p in parts) + 1 for k in range(3)] if parts else [0, 0, 0],
            "parts": sorted(({"file": p.file, "n": p.n, "z0": p.low[2], "z1": p.high[2]} for p in parts), key=lambda p: (p["z0"], p["file"])),
        }
        hidden = posixpath.join(place, f".{self.run}")
        with system.open_output_stream(hidden) as f:
            f.write(json.dumps(note).encode())
        system.move(hidden, posixpath.join(place, NOTE))
        for path in old:
            system.delete_file(path)

    def abort(self, messages):
        system, place = opened(self.path)
        for m in messages:
            if m is not None and m.n:
                system.delete_file(posixpath.join(place, m.file))


class SliceSource(DataSource):
    """voxel_slices: rows x, y, z, v whose v has the type of the volume's dtype."""

    @classmethod
    def name(cls) -> str:
        return "voxel_slices"

    def schema(self) -> str:
        kind = DTYPES[read_note(self.options["path"])["dtype"]]
        return f"x long, y long, z long, v {kind}"

    def reader(self, schema):
        return SliceReader(self.options["path"])

    def writer(self, schema, overwrite):
        if not overwrite:
            raise ValueError("a volume is written as a whole: use mode overwrite")
        return SliceWriter(self.options["path"], self.options.get("dtype", "int64"), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SliceSource)


def write_volume(voxels: DataFrame, path: str, dtype: str = "int64", parts: int | None = None) -> str:
    """Write x, y, z, v in `parts` ranges of z (none: as many as Spark finds right); v must fit the dtype. Returns the path as
    tasks open it."""
    register(voxels.sparkSession)
    target = qualified(voxels.sparkSession, path)
    rows = voxels.selectExpr("x", "y", "z", f"CAST(v AS {DTYPES[dtype]}) AS v").repartitionByRange(*([parts] if parts else []), "z").sortWithinPartitions("z")
    rows.write.format("voxel_slices").option("dtype", dtype).mode("overwrite").save(target)
    return target


def open_volume(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("voxel_slices").load(path)


def shape(path: str) -> tuple[int, int, int]:
    return tuple(read_note(path)["shape"])
