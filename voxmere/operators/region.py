"""Regions, grids, strides, cutouts and padding over voxel tables (x, y, z, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
CHUNK = {"x": 256, "y": 256, "z": 64}


def floor_div(value: Column | str, by: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(by)).cast("long")


def region(voxels: DataFrame, **bounds: int | tuple[int | None, int | None]) -> DataFrame:
    """Voxels with lo <= axis < hi for each axis given; a chunk column c<axis> is bounded too, so partitions are pruned.

    A single number is one layer. A start of none is 0; a stop of none or 0 is the volume's end.
    """
    out = voxels
    for axis, bound in bounds.items():
        lo, hi = (bound, bound + 1) if isinstance(bound, int) else (bound[0] or 0, bound[1] or None)
        out = out.filter(F.col(axis) >= lo)
        out = out if hi is None else out.filter(F.col(axis) < hi)
        if f"c{axis}" in voxels.columns:
            out = out.filter(F.col(f"c{axis}") >= lo // CHUNK[axis])
            out = out if hi is None else out.filter(F.col(f"c{axis}") <= (hi - 1) // CHUNK[axis])
    return out


def block_grid(shapes: DataFrame, block: tuple[int, int, int]) -> DataFrame:
    """Blocks that cover [0, nx) x [0, ny) x [0, nz) of every row of shapes, clipped at the far edges."""
    out = shapes.filter("nx > 0 and ny > 0 and nz > 0")
    for axis, size in zip(AXES, block, strict=True):
        out = out.withColumn(f"{axis}0", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{axis}") - 1, F.lit(size).cast("long"))))
    for axis, size in zip(AXES, block, strict=True):
        out = out.withColumn(f"{axis}1", F.least(F.col(f"{axis}0") + size, F.col(f"n{axis}")))
    return out


def stride(voxels: DataFrame, factors: tuple[int, int, int]) -> DataFrame:
    """Every f-th voxel along each axis, renumbered."""
    out = voxels
    for axis, f in zip(AXES, factors, strict=True):
        out = out.filter(F.col(axis) % f == 0).withColumn(axis, floor_div(axis, f))
    return out


def volume(rows: DataFrame) -> list[str]:
    """The column that tells volumes apart, if rows have it; operators on neighbours and groups never mix volumes."""
    return ["volume_id"] if "volume_id" in rows.columns else []


def block_max(voxels: DataFrame, m: int, value: str = "v") -> DataFrame:
    """Maximum over m x m x m cells; cells at the edge count as filled up with zeros."""
    cells = [floor_div(a, m).alias(a) for a in AXES]
    return voxels.groupBy(*volume(voxels), *cells).agg(F.greatest(F.max(value), F.lit(0).cast("long")).alias(value))


def permute(voxels: DataFrame, to: tuple[str, str, str]) -> DataFrame:
    """Axes renamed: to names the old axes in their new order."""
    rest = [c for c in voxels.columns if c not in AXES]
    return voxels.select(*(F.col(old).alias(new) for new, old in zip(AXES, to, strict=True)), *rest)


def non_empty_blocks(labels: DataFrame, block: tuple[int, int, int], value: str = "lab") -> DataFrame:
    """Labels in blocks whose largest label is positive."""
    names = ["bx", "by", "bz"]
    blocked = labels.withColumns({n: floor_div(a, s) for n, a, s in zip(names, AXES, block, strict=True)})
    full = blocked.groupBy(*names).agg(F.max(value).alias("m")).filter("m > 0").select(*names)
    return blocked.join(full, names, "left_semi")


def mosaic_pack(voxels: DataFrame, height: int) -> DataFrame:
    """Slices one below the other along y."""
    return voxels.withColumn("y", F.col("z") * height + F.col("y")).drop("z")


def mosaic_unpack(mosaic: DataFrame, height: int, z: int | None = None) -> DataFrame:
    """Slices of a mosaic again, or the one band of slice z; the filter on y reaches the scan."""
    band = mosaic if z is None else mosaic.filter((F.col("y") >= z * height) & (F.col("y") < (z + 1) * height))
    return band.withColumns({"z": floor_div("y", height), "y": F.col("y") % height})


def resize_nearest(voxels: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Each slice on a new grid, every new pixel from the nearest old one.

    An old pixel makes all new ones whose centre it holds: their range is known, so no grid has to be joined.
    """

    def cover(old: str, n: int, m: int) -> Column:
        first = F.ceil((F.col(old) * m - F.lit(n) / 2) / n)
        last = F.ceil(((F.col(old) + 1) * m - F.lit(n) / 2) / n) - 1
        return F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))

    out = voxels.withColumns({"_x": cover("x", width, new_width), "_y": cover("y", height, new_height)})
    return out.withColumn("x", F.explode("_x")).withColumn("y", F.explode("_y")).drop("_x", "_y")


def random_origins(rows: DataFrame, key: str, shape: tuple[int, int, int], size: tuple[int, int, int], seed: int) -> DataFrame:
    """(tile_id, ox, oy, oz): for each key a place where a box of that size lies inside the volume, uniform on every axis.

    The place follows from the seed, the axis and the key by a hash, so it is the same on every run and partitioning.
    """
    out = rows.select(F.col(key).cast("long").alias("tile_id"))
    for axis, n, want in zip(AXES, shape, size, strict=True):
        drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(axis), F.col("tile_id").cast("string"))), 1, 15), 16, 10)
        out = out.withColumn(f"o{axis}", drawn.cast("long") % (max(n - want, 0) + 1))
    return out


def cutouts(voxels: DataFrame, origins: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """For each row (tile_id, ox, oy, oz) of origins the box of that shape, in box coordinates, zero where no voxel is."""
    box = origins
    for axis, n in zip(AXES, shape, strict=True):
        box = box.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    placed = box.withColumns({f"g{a}": F.col(a) + F.col(f"o{a}") for a in AXES})
    source = voxels.select(*(F.col(a).alias(f"g{a}") for a in AXES), "v")
    return placed.join(source, [f"g{a}" for a in AXES], "left").select("tile_id", *AXES, F.coalesce("v", F.lit(0).cast("long")).alias("v"))


def centred_cutouts(origins: DataFrame, shape: tuple[int, int, int], requested: tuple[int, int, int]) -> DataFrame:
    """Actual extent of each cutout inside a volume of that shape, and the padding before and after that centres it.

    The annotated slice is the middle of the requested depth; its place in the volume is null where it is padding.
    """
    out = origins
    for axis, n, want in zip(AXES, shape, requested, strict=True):
        actual = F.greatest(F.least(F.col(f"o{axis}") + want, F.lit(n)) - F.col(f"o{axis}"), F.lit(0)).cast("long")
        pad = F.lit(want) - actual
        out = out.withColumns({f"n{axis}": actual, f"before_{axis}": floor_div(pad, 2), f"after_{axis}": pad - floor_div(pad, 2)})
    inside = F.lit(requested[2] // 2).cast("long") - F.col("before_z")
    ok = (inside >= 0) & (inside < F.col("nz"))
    return out.withColumns({"local_z": F.lit(requested[2] // 2).cast("long"), "global_z": F.when(ok, F.col("oz") + inside)})


def padded(voxels: DataFrame, placed: DataFrame, requested: tuple[int, int, int]) -> DataFrame:
    """Voxels of the cutouts that centred_cutouts placed: each in the middle of the requested box, zeros around it."""
    corner = placed.select("tile_id", *((F.col(f"o{a}") - F.col(f"before_{a}")).alias(f"o{a}") for a in AXES))
    return cutouts(voxels, corner, requested)
