"""Work on neighbourhoods in bricks: each brick gets a rim from its neighbours, so no task holds a slice."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxmere.operators.region import floor_div, volume

BRICK = (256, 256, 16)


def rimmed(voxels: DataFrame, reach: int, brick: tuple[int, int, int] = BRICK) -> DataFrame:
    """(keys, bx, by, bz, x, y, z, v, row) where a voxel stands once in its own brick, with its whole row, and once, without it, in each
    brick along x and y that has it within `reach`. So the shuffle grows by the rims alone: with bricks of n pixels by
    (1 + 2 reach / n) along each axis."""
    kept = [*volume(voxels), "x", "y", "z", "v"]

    def near(axis: str, size: int) -> F.Column:
        return F.explode(F.sequence(floor_div(F.col(axis) - reach, size), floor_div(F.col(axis) + reach, size))).alias(f"b{axis}")

    along = voxels.select(*kept, F.struct(*voxels.columns).alias("row"), near("x", brick[0])).select("*", near("y", brick[1]))
    own = (F.col("bx") == floor_div("x", brick[0])) & (F.col("by") == floor_div("y", brick[1]))
    return along.withColumns({"bz": floor_div("z", brick[2]), "row": F.when(own, F.col("row"))})


def over_bricks(voxels: DataFrame, reach: int, work: Callable[[np.ndarray], dict[str, np.ndarray]], fields: str, brick: tuple[int, int, int] = BRICK, clipped: bool = True) -> DataFrame:
    """voxels with further columns that `work` gives for each pixel of a slice from its surroundings.

    work takes an image (x, y) and gives an array for each name in fields, (x, y) or (x, y, channels) for arrays; what it gives for a pixel
    must depend only on pixels up to `reach` away. Pixels where no voxel is count as 0. clipped: images end where their
    slice does, so that work sees true edges and can mirror there; else they are surrounded by zeros.
    """
    keys = volume(voxels)
    rows = rimmed(voxels, reach, brick)
    if clipped:
        ends = voxels.groupBy(*keys, "z").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        rows = rows.join(ends, [*keys, "z"])
    added = T._parse_datatype_string(fields)
    schema = T.StructType([*voxels.schema.fields, *added.fields])

    def image(at: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, box: list[int]) -> np.ndarray:
        x0, x1, y0, y1 = box
        out = np.zeros((x1 - x0 + 1, y1 - y0 + 1), v.dtype)
        out[x[at] - x0, y[at] - y0] = v[at]
        return out

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        get = lambda c: table.column(c).to_numpy()
        x, y, z, v = (get(c) for c in ("x", "y", "z", "v"))
        mine = table.column("row").is_valid().to_numpy()
        bx, by = int(table.column("bx")[0].as_py()) * brick[0], int(table.column("by")[0].as_py()) * brick[1]
        order = np.argsort(z, kind="stable")
        cuts = np.flatnonzero(np.diff(z[order], prepend=z[order][0] - 1))
        places, found = [], []
        for at in np.split(order, cuts[1:]):
            own = at[mine[at]]
            if not len(own):
                continue
            box = [bx - reach, bx + brick[0] + reach - 1, by - reach, by + brick[1] + reach - 1]
            if clipped:
                ends = [int(table.column(c)[int(at[0])].as_py()) for c in ("x0", "x1", "y0", "y1")]
                box = [max(box[0], ends[0]), min(box[1], ends[1]), max(box[2], ends[2]), min(box[3], ends[3])]
            else:  # no wider than what is there and its surroundings
                box = [max(box[0], int(x[at].min()) - reach), min(box[1], int(x[at].max()) + reach), max(box[2], int(y[at].min()) - reach), min(box[3], int(y[at].max()) + reach)]
            made = work(image(at, x, y, v, box))
            places.append(own)
            found.append({f.name: made[f.name][x[own] - box[0], y[own] - box[2]] for f in added.fields})
        own = np.concatenate(places) if places else np.zeros(0, np.int64)
        row = table.column("row").take(pa.array(own)).combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        columns = list(row.flatten())
        for f in added.fields:
            values = np.concatenate([part[f.name] for part in found]) if found else np.zeros(0)
            if isinstance(f.dataType, T.ArrayType):
                width = values.shape[1] if values.ndim == 2 else 0
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), pa.array(values.reshape(-1))))
            else:  # a brick that holds another's rim alone has no pixel of its own
                columns.append(pa.array(values).cast(to_arrow_type(f.dataType)))
        return pa.table(columns, names=schema.names)

    return rows.groupBy(*keys, "bx", "by", "bz").applyInArrow(run, schema)
