"""Queries on intensities."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmere.functions import pixels
from voxmere.operators import intensity as I
from voxmere.plans.registry import query
from voxmere.sources.views import view

STATS = """b AS (SELECT label, min(v) AS source_min, max(v) AS source_max, count(*) FILTER (v <> 0) AS n_some, quantile_cont(v, 0.01) FILTER (v <> 0) AS a1, quantile_cont(v, 0.995) FILTER (v <> 0) AS a2,
    quantile_cont(v, 0.01) AS c1, quantile_cont(v, 0.995) AS c2 FROM voxels GROUP BY label),
    p AS (SELECT label, source_min, source_max, CASE WHEN n_some >= 128 THEN a1 ELSE c1 END AS lo, CASE WHEN n_some >= 128 THEN a2 ELSE c2 END AS hi FROM b),
    w AS (SELECT label, source_min, source_max, CASE WHEN hi > lo THEN lo ELSE CAST(source_min AS DOUBLE) END AS window_min, CASE WHEN hi > lo THEN hi ELSE CAST(source_max AS DOUBLE) END AS window_max FROM p)"""
SCALED = "CAST(round_even(greatest(0.0, least(1.0, (CAST(v AS DOUBLE) - {lo}) / ({hi} - {lo}))) * 255, 0) AS BIGINT)"


@query("cuboid_transform", "voxels", sql="SELECT x, y, z, v > 36043 AS v FROM voxels")
def cuboid_transform(spark, d):
    return view(spark, d, "voxels").select("x", "y", "z", (F.col("v") > 36043).alias("v"))


@query("cast_wrap", "voxels", sql="SELECT x, y, z, v % 256 AS v FROM voxels")
def cast_wrap(spark, d):
    return view(spark, d, "voxels").select("x", "y", "z", pixels.wrap(F.col("v"), 8).alias("v"))


@query("window_intensity", "voxels", sql=f"SELECT x, y, z, {SCALED.format(lo='30000.0', hi='38000.0')} AS w FROM voxels")
def window_intensity(spark, d):
    return view(spark, d, "voxels").select("x", "y", "z", pixels.window(F.col("v"), F.lit(30000.0), F.lit(38000.0)).alias("w"))


@query("intensity_stats", "voxels", sql=f"WITH {STATS} SELECT * FROM w")
def intensity_stats(spark, d):
    return I.window_bounds(view(spark, d, "voxels"))


STATED = ("source_min", "source_max", "window_min", "window_max")
FLOATS = "fv AS (SELECT label, CAST(CAST(v - 32768 AS DOUBLE) / 7 * (1 + x) AS FLOAT)::DOUBLE AS v FROM voxels)"


@query("float_intensity_stats", "voxels", sql=f"WITH {FLOATS}, {STATS.replace('FROM voxels', 'FROM fv')} SELECT label, {', '.join(f'round({c}, 4) AS {c}' for c in STATED)} FROM w")
def float_intensity_stats(spark, d):
    """As intensity_stats for a volume of 32-bit floats, where distinct values have no bound."""
    value = ((F.col("v") - 32768).cast("double") / 7 * (F.lit(1) + F.col("x"))).cast("float")
    return I.window_bounds(view(spark, d, "voxels").withColumn("v", value)).select("label", *(F.round(c, 4).alias(c) for c in STATED))


@query(
    "auto_window_intensity",
    "voxels",
    sql=f"WITH {STATS} SELECT x, y, z, CASE WHEN window_max > window_min THEN {SCALED.format(lo='window_min', hi='window_max')} WHEN v > 0 THEN 255 ELSE 0 END AS w FROM voxels JOIN w USING (label)",
)
def auto_window_intensity(spark, d):
    return I.auto_window(view(spark, d, "voxels")).select("x", "y", "z", "w")


@query("custom_transform", "voxels", sql="SELECT x, y, z, v // 256 + (v % 256) AS v FROM voxels")
def custom_transform(spark, d):
    plug_in = lambda v: F.floor(v / 256).cast("long") + v % 256
    return view(spark, d, "voxels").select("x", "y", "z", plug_in(F.col("v")).alias("v"))


@query("array_transform", "voxels", sql="SELECT x, y, z, v - max(v) OVER (PARTITION BY x, y, z // 16) AS v FROM voxels")
def array_transform(spark, d):
    """A plug-in over dense 32-bit arrays: each value less the largest of its column of voxels in the brick."""
    from voxmere.sources.blocks import pack, transform_bricks, unpack

    relative = lambda a: a - a.max(axis=2, keepdims=True)
    return unpack(transform_bricks(pack(view(spark, d, "voxels")), relative, "int32")).select("x", "y", "z", "v")


@query("slice_stack_export", "voxels", sql="SELECT printf('%04d.png', z) AS name, x // 2 AS x, y // 2 AS y, v % 256 AS v FROM voxels WHERE x % 2 = 0 AND y % 2 = 0")
def slice_stack_export(spark, d):
    """Slices written as 8-bit image files named by z; the files read again."""
    from voxmere.operators.region import stride
    from voxmere.sources.paths import scratch
    from voxmere.sources.images import png_rows, read_folder, write_files

    small = stride(view(spark, d, "voxels"), (2, 2, 1)).withColumn("v", pixels.wrap(F.col("v"), 8))
    folder = scratch(spark)
    write_files(png_rows(small, name="{:04d}.png"), folder)
    return read_folder(spark, folder).select("name", "x", "y", "v")
