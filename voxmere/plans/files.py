"""Queries on source files and headers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxmere.operators import headers as H
from voxmere.operators.region import floor_div
from voxmere.plans.registry import query
from voxmere.sources.paths import scratch
from voxmere.sources.views import view

PARTS = "str_split(path, '/')"
KEEP = f"NOT list_contains({PARTS}, '__MACOSX') AND len(list_filter({PARTS}, lambda p: p LIKE '.%' AND p NOT IN ('.', '..'))) = 0"


def files(spark, d):
    return view(spark, d, "source_files")


def headers(spark, d):
    return view(spark, d, "dicom_headers")


@query("file_order_to_z", "source_files", sql="SELECT job_id, path, row_number() OVER (PARTITION BY job_id ORDER BY split_part(path, '/', -1), path) - 1 AS z FROM source_files")
def file_order_to_z(spark, d):
    return H.z_order(files(spark, d)).select("job_id", "path", "z")


@query("source_file_filter", "source_files", sql=f"SELECT job_id, path FROM source_files WHERE {KEEP}")
def source_file_filter(spark, d):
    return files(spark, d).filter(H.is_source(F.col("path"))).select("job_id", "path")


@query("archive_expand", "source_files", sql=f"SELECT job_id, path, path NOT LIKE 'a/../../%' AS safe FROM source_files WHERE {KEEP}")
def archive_expand(spark, d):
    """Members of each job's archive, written as zip files and read back, with their safety."""
    from voxmere.sources.archives import members, write_archives

    found = members(spark, write_archives(files(spark, d)))
    return found.filter(H.is_source(F.col("path"))).select("job_id", "path", H.is_safe(F.col("path")).alias("safe"))


@query("source_type_normalize", "source_files", sql="WITH s AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' DCM ' WHEN 1 THEN 'Images' WHEN 2 THEN NULL WHEN 3 THEN 'dicom_series' ELSE 'tiff' END AS declared FROM pages) SELECT page_id, CASE WHEN declared IS NULL THEN 'image_stack' WHEN lower(trim(declared)) IN ('image', 'images', 'image-stack', 'image_stack') THEN 'image_stack' WHEN lower(trim(declared)) IN ('dicom', 'dicom-series', 'dicom_series', 'dcm') THEN 'dicom' END AS source_type FROM s")
def source_type_normalize(spark, d):
    from voxmere.sources.tables import table

    p = F.col("page_id")
    declared = F.when(p % 5 == 0, " DCM ").when(p % 5 == 1, "Images").when(p % 5 == 3, "dicom_series").when(p % 5 == 4, "tiff")
    return table(spark, d, "pages").select("page_id", H.source_type(declared).alias("source_type"))


ROUTED = "r AS (SELECT job_id, count(*) FILTER (is_dicom) AS n_dicom, count(*) AS n_files FROM source_files GROUP BY job_id)"


@query("source_type_route", "source_files", sql=f"WITH {ROUTED} SELECT job_id, n_dicom, n_files, CASE WHEN n_dicom > 0 AND n_dicom < n_files THEN 'error: mixed' WHEN job_id = 5 OR n_dicom = n_files THEN 'dicom' ELSE 'image_stack' END AS route FROM r")
def source_type_route(spark, d):
    declared = F.when(F.col("job_id") == 5, "dicom").otherwise("image_stack")
    return H.route(files(spark, d).withColumn("declared", declared)).select("job_id", "n_dicom", "n_files", "route")


@query("dicom_file_count", "source_files", sql=f"WITH {ROUTED} SELECT job_id, n_dicom FROM r")
def dicom_file_count(spark, d):
    return files(spark, d).groupBy("job_id").agg(F.count_if("is_dicom").alias("n_dicom"))


@query("dicom_series_select", "dicom_headers", sql="WITH s AS (SELECT job_id, coalesce(CAST(series_uid AS VARCHAR), '__missing__') AS series, count(*) AS n FROM dicom_headers GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY job_id ORDER BY n DESC) AS k FROM s) SELECT job_id, min(series) AS series, max(n) AS n, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'ok' END AS state FROM r WHERE k = 1 GROUP BY job_id")
def dicom_series_select(spark, d):
    return H.select_series(headers(spark, d))


KEY = "CASE WHEN image_position_z IS NOT NULL THEN 0 WHEN instance_number IS NOT NULL THEN 1 ELSE 2 END, coalesce(image_position_z, instance_number), name"


@query("dicom_slice_order", "dicom_headers", sql=f"SELECT job_id, series_uid, name, row_number() OVER (PARTITION BY job_id, series_uid ORDER BY {KEY}) - 1 AS z FROM dicom_headers")
def dicom_slice_order(spark, d):
    return H.order_slices(headers(spark, d)).select("job_id", "series_uid", "name", "z")


@query("dicom_series_validate", "dicom_headers", sql=f"WITH f AS (SELECT *, first_value(cols_) OVER (PARTITION BY job_id, series_uid ORDER BY {KEY}) AS c FROM dicom_headers) SELECT job_id, series_uid, count(*) FILTER (cols_ <> c) AS n_other_size, count(*) FILTER (n_frames > 1) AS n_multi_frame FROM f GROUP BY job_id, series_uid")
def dicom_series_validate(spark, d):
    return H.validate_series(headers(spark, d))


@query("multiframe_explode", "voxels", sql="SELECT z // 4 AS file_id, z % 4 AS z, x, y, v FROM voxels")
def multiframe_explode(spark, d):
    """Files of four frames, each an array of pixel arrays, to voxels."""
    frames = view(spark, d, "voxels").groupBy(floor_div("z", 4).alias("file_id"), (F.col("z") % 4).alias("frame")).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"]).alias("pixels"))
    files_ = frames.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("frame", "pixels"))).alias("frames"))
    slices = files_.select("file_id", F.explode("frames").alias("f"))
    pixels = slices.select("file_id", F.col("f.frame").alias("z"), F.posexplode("f.pixels").alias("p", "v"))
    return pixels.select("file_id", "z", (F.col("p") % 8).cast("long").alias("x"), floor_div("p", 8).alias("y"), "v")


@query("frames_of_files", "voxels", sql="""SELECT z // 4 AS file_id, NULL AS reason, z % 4 AS z, x, y, v FROM voxels WHERE z // 4 % 5 <> 0 AND z // 4 % 5 <> 3 AND NOT (z // 4 % 5 = 4 AND z % 4 > 0) AND NOT (z // 4 % 5 = 2 AND z % 4 > 0)
    UNION ALL SELECT DISTINCT z // 4, CASE WHEN z // 4 % 5 = 0 THEN 'colour frames' ELSE 'wrong size' END, NULL, NULL, NULL, NULL FROM voxels WHERE z // 4 % 5 IN (0, 3)""")
def frames_of_files(spark, d):
    """Files of four frames; some have one frame, some one in colours, some four in colours, and of some a pixel is missing."""
    v, kind = view(spark, d, "voxels"), F.col("file_id") % 5
    files_ = v.groupBy(floor_div("z", 4).alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("z", "y", "x", "v"))).alias("ps"), (F.max("x") + 1).alias("cols_"), (F.max("y") + 1).alias("rows_"), F.countDistinct("z").alias("n_frames"))
    gray = F.transform("ps", lambda p: p["v"])
    first = F.slice(gray, F.lit(1), (F.col("cols_") * F.col("rows_")).cast("int"))
    coloured = lambda a: F.flatten(F.transform(a, lambda p: F.array(p, p % 7, p % 3)))
    pixels = F.when(kind == 0, coloured(gray)).when(kind == 2, coloured(first)).when(kind == 3, F.slice(gray, 2, 1 << 20)).when(kind == 4, first).otherwise(gray)
    voxels, rejected = H.explode_frames(files_.select("file_id", F.when(kind.isin(2, 4), 1).otherwise(F.col("n_frames")).alias("n_frames"), "rows_", "cols_", F.when(kind.isin(0, 2), 3).otherwise(1).alias("n_channels"), pixels.alias("pixels")))
    return voxels.unionByName(rejected, allowMissingColumns=True).select("file_id", "reason", F.col("z").cast("long"), F.col("x").cast("long"), F.col("y").cast("long"), "v")


@query("infer_volume_shape", "dicom_headers", sql=f"WITH f AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {KEY}) AS k FROM dicom_headers) SELECT job_id, max(cols_) FILTER (k = 1) AS width, max(rows_) FILTER (k = 1) AS height, count(*) AS depth FROM f GROUP BY job_id")
def infer_volume_shape(spark, d):
    order = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(H.slice_key())))
    size = headers(spark, d).groupBy("job_id").agg(F.min_by(F.struct("cols_", "rows_"), order).alias("s"), F.count(F.lit(1)).alias("depth"))
    return size.select("job_id", F.col("s.cols_").alias("width"), F.col("s.rows_").alias("height"), "depth")


@query("artifact_inventory", "models", sql="SELECT job_id, CASE model_id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'segmentation' ELSE 'mesh' END AS kind, count(*) AS n, max(model_id) AS newest FROM models GROUP BY 1, 2")
def artifact_inventory(spark, d):
    """Artifacts from a listing of paths."""
    m = F.col("model_id")
    ending = F.when(m % 3 == 0, ".model").when(m % 3 == 1, ".zarr").otherwise(".combined.stl")
    listing = view(spark, d, "models").select(F.concat(F.lit("volume/"), "job_id", F.lit("/"), "model_id", ending).alias("path"))
    kind = F.when(F.col("path").endswith(".model"), "model").when(F.col("path").endswith(".zarr"), "segmentation").otherwise("mesh")
    rows = listing.select(F.regexp_extract("path", "volume/([0-9]+)/", 1).cast("long").alias("job_id"), kind.alias("kind"), F.regexp_extract("path", "/([0-9]+)[.]", 1).cast("long").alias("id"))
    return rows.groupBy("job_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("newest"))


@query("image_stack_scan", "voxels", sql="SELECT x, y, z, v % 256 AS v FROM voxels")
def image_stack_scan(spark, d):
    """All slices as a folder of 8-bit image files, read by Spark's image source."""
    from voxmere.sources.images import png_rows, read_folder, write_files

    folder = scratch(spark)
    write_files(png_rows(view(spark, d, "voxels").withColumn("v", F.col("v") % 256)), folder)
    return read_folder(spark, folder, glob="*.png").select("x", "y", "z", "v")


@query("slice_decode_fallback", "voxels", sql="SELECT x, y, z, CASE WHEN z % 5 = 0 THEN 0 ELSE v % 256 END AS v FROM voxels")
def slice_decode_fallback(spark, d):
    """As image_stack_scan, where every fifth file is broken and reads as zeros, and every third is in colours."""
    from voxmere.sources.images import broken, png_rows, read_folder, write_files

    paint = lambda image, z: image if z % 3 else np.stack([image, image // 2, 255 - image], axis=-1)
    folder = scratch(spark)
    write_files(broken(png_rows(view(spark, d, "voxels").withColumn("v", F.col("v") % 256), paint=paint), 5), folder)
    return read_folder(spark, folder, width=8, height=8).select("x", "y", "z", "v")
