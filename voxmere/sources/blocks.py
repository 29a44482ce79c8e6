"""Chunked volumes as Parquet, partitioned by cz. A row is a brick of a chunk: places inside it and values, in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxmere.operators.region import AXES, CHUNK, floor_div, volume
from voxmere.sources.paths import scratch

#: at most 65,536 voxels a row, so that one aggregation row stays at about a megabyte whatever the chunk holds
BRICK = {"x": 64, "y": 64, "z": 16}


def pack(voxels: DataFrame, value: str = "v") -> DataFrame:
    """One row for each brick: its chunk and brick coordinates, and its voxels by their place in it."""
    chunks = {f"c{a}": floor_div(a, CHUNK[a]) for a in AXES}
    bricks = {f"b{a}": floor_div(a, BRICK[a]) for a in AXES}
    inside = {a: F.pmod(a, F.lit(BRICK[a])) for a in AXES}
    place = ((inside["x"] * BRICK["y"] + inside["y"]) * BRICK["z"] + inside["z"]).cast("int")
    keyed = voxels.select(*volume(voxels), *(c.alias(n) for n, c in (chunks | bricks).items()), F.struct(place.alias("at"), F.col(value).alias("v")).alias("voxel"))
    return keyed.groupBy(*volume(voxels), *chunks, *bricks).agg(F.array_sort(F.collect_list("voxel")).alias("voxels"))


def write_blocks(voxels: DataFrame, path: str | None = None, value: str = "v") -> str:
    path = path or scratch(voxels.sparkSession)
    pack(voxels, value).write.mode("overwrite").option("compression", "zstd").partitionBy("cz").parquet(path)
    return path


def open_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Voxels of a block table, with their chunk coordinates for pruning."""
    return unpack(spark.read.parquet(path))


def unpack(bricks: DataFrame) -> DataFrame:
    """Voxels of packed bricks, with their chunk coordinates."""
    kept = [*volume(bricks), "cx", "cy", "cz"]
    each = bricks.select(*kept, *(f"b{a}" for a in AXES), F.explode("voxels").alias("p"))
    inside = {"x": floor_div("p.at", BRICK["y"] * BRICK["z"]), "y": floor_div("p.at", BRICK["z"]) % BRICK["y"], "z": F.col("p.at") % BRICK["z"]}
    return each.select(*kept, *((F.col(f"b{a}") * BRICK[a] + inside[a]).alias(a) for a in AXES), "p.v")


def transform_bricks(bricks: DataFrame, function: Callable[[np.ndarray], np.ndarray], dtype: str) -> DataFrame:
    """A packed table with function(array) -> array applied to each brick: a dense array (x, y, z) of that dtype, zero where no voxel
    is, in place and order of the brick. What it gives must have the brick's shape. Bricks are rows already, so nothing is shuffled."""
    at_type = bricks.schema["voxels"].dataType.elementType["v"].dataType
    size = (BRICK["x"], BRICK["y"], BRICK["z"])
    names, value = bricks.schema.names, to_arrow_type(at_type)
    where = names.index("voxels")

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(where)
            places = lists.flatten().field("at").to_numpy(zero_copy_only=False)
            values = lists.flatten().field("v").to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            out = []
            for lo, hi in zip(ends, ends[1:]):
                dense = np.zeros(size, dtype)
                dense.reshape(-1)[places[lo:hi]] = values[lo:hi]
                made = np.asarray(function(dense))
                if made.shape != size:
                    raise ValueError(f"a transform gave {made.shape} for a brick of {size}")
                out.append(made.reshape(-1)[places[lo:hi]])
            flat = pa.array(np.concatenate(out) if out else np.zeros(0)).cast(value)
            voxels = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(places, pa.int32()), flat], ["at", "v"]))
            yield pa.RecordBatch.from_arrays([voxels if k == where else c for k, c in enumerate(batch.columns)], names)

    return bricks.mapInArrow(changed, bricks.schema)
