"""Queries on voxel geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmere.functions.pixels import first_channel
from voxmere.operators import region as R
from voxmere.plans.registry import query
from voxmere.sources.views import view

SEED = 7


def drawn_sql(*size: int) -> str:
    """Origins for every sample, and the padding that centres a box of that size."""
    at = ", ".join(f"CAST('0x' || substr(md5(concat('{SEED}:{a}:', sample_id)), 1, 15) AS BIGINT) % (greatest(n{a} - {n}, 0) + 1) AS o{a}, least(n{a}, {n}) AS n{a}, ({n} - least(n{a}, {n})) // 2 AS before_{a}" for a, n in zip("xyz", size, strict=True))
    return f"s AS (SELECT max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM voxels), origins AS (SELECT sample_id AS tile_id, {at} FROM anno_meta, s)"


def tiles_sql(*size: int) -> str:
    grid = " ".join(f"CROSS JOIN range({n}) at_{k}({k})" for k, n in zip("ijk", size, strict=True))
    return f"""SELECT tile_id, i AS x, j AS y, k AS z, coalesce(v, 0) AS v FROM origins {grid}
    LEFT JOIN voxels ON voxels.x = i + ox - before_x AND voxels.y = j + oy - before_y AND voxels.z = k + oz - before_z"""


def placed(spark, d, size):
    """A cutout for every annotation sample."""
    extent = shape(spark, d).first()
    whole = tuple(extent[f"n{a}"] for a in R.AXES)
    return R.centred_cutouts(R.random_origins(view(spark, d, "anno_meta"), "sample_id", whole, size, SEED), whole, size)


def shape(spark, d):
    return view(spark, d, "voxels").agg(*((F.coalesce(F.max(a), F.lit(-1)) + 1).alias(f"n{a}") for a in R.AXES))


@query("array_source", "voxels", sql="SELECT x, y, z, v FROM voxels")
def array_source(spark, d):
    return view(spark, d, "voxels").select("x", "y", "z", "v")


@query("region_slice", "voxels", sql="SELECT x, y, z, v FROM voxels WHERE x >= 2 AND x < 6 AND y = 4 AND z >= 10")
def region_slice(spark, d):
    return R.region(view(spark, d, "voxels"), x=(2, 6), y=4, z=(10, 0)).select("x", "y", "z", "v")


@query(
    "block_grid",
    "voxels",
    sql="""WITH s AS (SELECT max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM voxels)
    SELECT x0, y0, z0, least(x0 + 4, nx) AS x1, least(y0 + 3, ny) AS y1, least(z0 + 64, nz) AS z1
    FROM s, unnest(range(0, nx, 4)) a(x0), unnest(range(0, ny, 3)) b(y0), unnest(range(0, nz, 64)) c(z0)""",
)
def block_grid(spark, d):
    return R.block_grid(shape(spark, d), (4, 3, 64)).select("x0", "y0", "z0", "x1", "y1", "z1")


@query("stride_downsample", "voxels", sql="SELECT x // 2 AS x, y // 2 AS y, z // 3 AS z, v FROM voxels WHERE x % 2 = 0 AND y % 2 = 0 AND z % 3 = 0")
def stride_downsample(spark, d):
    return R.stride(view(spark, d, "voxels"), (2, 2, 3)).select("x", "y", "z", "v")


@query("block_max_downsample", "voxels", sql="SELECT x // 3 AS x, y // 3 AS y, z // 3 AS z, greatest(max(v), 0) AS v FROM voxels GROUP BY 1, 2, 3")
def block_max_downsample(spark, d):
    return R.block_max(view(spark, d, "voxels"), 3)


@query("axis_permute", "voxels", sql="SELECT z AS x, y, x AS z, v FROM voxels")
def axis_permute(spark, d):
    return R.permute(view(spark, d, "voxels"), ("z", "y", "x")).select("x", "y", "z", "v")


@query("first_channel", "voxels", sql="SELECT x, y, z, CASE WHEN z % 3 = 0 THEN v % 256 ELSE v % 7 END AS c0 FROM voxels")
def first_channel_query(spark, d):
    blue_green_red = F.when(F.col("z") % 3 == 0, F.array(F.col("v") % 256)).otherwise(F.array(F.col("v") % 256, F.col("v") % 11, F.col("v") % 7))
    return view(spark, d, "voxels").select("x", "y", "z", first_channel(blue_green_red).alias("c0"))


@query(
    "skip_empty_blocks",
    "seg_labels",
    sql="""WITH b AS (SELECT *, x // 4 AS bx, y // 4 AS bb, z // 16 AS bz FROM seg_labels)
    SELECT x, y, z, lab FROM b SEMI JOIN (SELECT bx, bb, bz FROM b GROUP BY bx, bb, bz HAVING max(lab) > 0) f USING (bx, bb, bz)""",
)
def skip_empty_blocks(spark, d):
    return R.non_empty_blocks(view(spark, d, "seg_labels"), (4, 4, 16)).select("x", "y", "z", "lab")


@query("mosaic_pack", "voxels", sql="SELECT x, z * 8 + y AS y, v FROM voxels")
def mosaic_pack(spark, d):
    return R.mosaic_pack(view(spark, d, "voxels"), 8).select("x", "y", "v")


@query("mosaic_unpack", "voxels", sql="SELECT x, y, z, v, z = (SELECT max(z) + 1 FROM voxels) // 2 AS middle FROM voxels")
def mosaic_unpack(spark, d):
    """All slices of a mosaic; the middle one, shown where none is asked for, is cropped from it as a band."""
    mosaic = R.mosaic_pack(view(spark, d, "voxels"), 8)
    middle = (shape(spark, d).first()["nz"]) // 2
    band = R.mosaic_unpack(mosaic, 8, middle).withColumn("middle", F.lit(True))
    rest = R.mosaic_unpack(mosaic, 8).filter(F.col("z") != middle).withColumn("middle", F.lit(False))
    return band.unionByName(rest).select("x", "y", "z", "v", "middle")


@query(
    "nearest_resize",
    "voxels",
    sql="""SELECT i AS x, j AS y, z, v FROM range(12) a(i), range(5) b(j), voxels
    WHERE x = CAST(floor((i + 0.5) * 8 / 12) AS BIGINT) AND y = CAST(floor((j + 0.5) * 8 / 5) AS BIGINT)""",
)
def nearest_resize(spark, d):
    return R.resize_nearest(view(spark, d, "voxels"), 8, 8, 12, 5).select("x", "y", "z", "v")


@query("random_tiles", "voxels", "anno_meta", sql=f"WITH {drawn_sql(4, 4, 1)} {tiles_sql(4, 4, 1)}")
def random_tiles(spark, d):
    """A tile of one slice for every sample."""
    return R.padded(view(spark, d, "voxels"), placed(spark, d, (4, 4, 1)), (4, 4, 1))


@query("pad_to_shape", "voxels", "anno_meta", sql=f"WITH {drawn_sql(11, 6, 1)} {tiles_sql(11, 6, 1)}")
def pad_to_shape(spark, d):
    """Tiles wider than the volume: the slice in the middle, zeros on both sides."""
    return R.padded(view(spark, d, "voxels"), placed(spark, d, (11, 6, 1)), (11, 6, 1))


CUTOUT = (6, 11, 5)


@query(
    "random_cutouts",
    "voxels",
    "anno_meta",
    sql=f"""WITH {drawn_sql(*CUTOUT)}, t AS ({tiles_sql(*CUTOUT)}),
    a AS (SELECT tile_id, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (1 + x + 6 * y + 66 * z)) AS BIGINT) AS placed_total FROM t GROUP BY tile_id)
    SELECT tile_id, ox, oy, oz, nx, ny, nz, before_x, 6 - nx - before_x AS after_x, before_y, 11 - ny - before_y AS after_y, before_z, 5 - nz - before_z AS after_z,
    CAST(2 AS BIGINT) AS local_z, CASE WHEN 2 - before_z >= 0 AND 2 - before_z < nz THEN oz + 2 - before_z END AS global_z, total, placed_total FROM origins JOIN a USING (tile_id)""",
)
def random_cutouts(spark, d):
    """Where each sample's cutout lies, how it is padded, and sums over its voxels that depend on their places."""
    where = placed(spark, d, CUTOUT)
    weight = F.lit(1) + F.col("x") + 6 * F.col("y") + 66 * F.col("z")
    sums = R.padded(view(spark, d, "voxels"), where, CUTOUT).groupBy("tile_id").agg(F.sum("v").alias("total"), F.sum(F.col("v") * weight).alias("placed_total"))
    return where.join(sums, "tile_id")


@query(
    "block_store_scan",
    "voxels",
    sql="SELECT x, y, z, v FROM voxels WHERE z >= 64 AND z < 128",
)
def block_store_scan(spark, d):
    from voxmere.sources.blocks import open_blocks, write_blocks

    return R.region(open_blocks(spark, write_blocks(view(spark, d, "voxels"))), z=(64, 128)).select("x", "y", "z", "v")


@query("block_store_write", "voxels", sql="SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, CAST(v > 33000 AS BIGINT) AS v FROM voxels WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0")
def block_store_write(spark, d):
    from voxmere.sources.blocks import open_blocks, write_blocks

    binary = view(spark, d, "voxels").withColumn("v", (F.col("v") > 33000).cast("long"))
    return open_blocks(spark, write_blocks(R.stride(binary, (2, 2, 2)))).select("x", "y", "z", "v")
