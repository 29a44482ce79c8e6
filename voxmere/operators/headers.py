"""Source files and image series by their paths and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a declared source type may be called.
SOURCE_NAMES = {"image": "image_stack", "images": "image_stack", "image-stack": "image_stack", "image_stack": "image_stack", "dicom": "dicom", "dicom-series": "dicom", "dicom_series": "dicom", "dcm": "dicom"}
NO_SERIES = "__missing__"


def source_type(declared: Column) -> Column:
    """Canonical name; null means an image stack, an unknown name gives null."""
    names = F.create_map(*(F.lit(x) for pair in SOURCE_NAMES.items() for x in pair))
    return F.when(declared.isNull(), "image_stack").otherwise(names[F.lower(F.trim(declared))])


def is_source(path: Column) -> Column:
    """Neither in a resource-fork folder nor hidden at any level."""
    parts = F.split(path, "/")
    return ~F.array_contains(parts, "__MACOSX") & ~F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", ".."))


def is_safe(path: Column) -> Column:
    """A relative path that stays below where it starts."""
    steps = F.transform(F.split(path, "/"), lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda s, x: F.struct((s["at"] + x).alias("at"), (s["ok"] & (s["at"] + x >= 0)).alias("ok")))
    return ~path.startswith("/") & depth["ok"]


def z_order(files: DataFrame) -> DataFrame:
    """z of each file: its rank by name, then path, in its job."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("z", (F.row_number().over(Window.partitionBy("job_id").orderBy(name, "path")) - 1).cast("long"))


def route(files: DataFrame, declared: str = "declared") -> DataFrame:
    """How each job is read: mixed files are an error, all (or declared) header files a series, else an image stack."""
    counted = files.groupBy("job_id").agg(F.count_if("is_dicom").alias("n_dicom"), F.count(F.lit(1)).alias("n_files"), F.max(declared).alias(declared))
    n, total = F.col("n_dicom"), F.col("n_files")
    kind = F.when((n > 0) & (n < total), "error: mixed").when((F.col(declared) == "dicom") | (n == total), "dicom").otherwise("image_stack")
    return counted.withColumn("route", kind)


def select_series(headers: DataFrame) -> DataFrame:
    """Each job's largest series, or the state ambiguous where several are the largest."""
    sizes = headers.groupBy("job_id", F.coalesce(F.col("series_uid").cast("string"), F.lit(NO_SERIES)).alias("series")).agg(F.count(F.lit(1)).alias("n"))
    ranked = sizes.withColumn("rank", F.rank().over(Window.partitionBy("job_id").orderBy(F.desc("n")))).filter("rank = 1")
    return ranked.groupBy("job_id").agg(F.min("series").alias("series"), F.max("n").alias("n"), F.when(F.count(F.lit(1)) > 1, "ambiguous").otherwise("ok").alias("state"))


def slice_key() -> list[Column]:
    """Order of slices: by position, then by instance number, then by name, each tier before the next."""
    tier = F.when(F.col("image_position_z").isNotNull(), 0).when(F.col("instance_number").isNotNull(), 1).otherwise(2)
    number = F.when(tier == 0, F.col("image_position_z")).when(tier == 1, F.col("instance_number").cast("double"))
    return [tier, number, F.col("name")]


def order_slices(headers: DataFrame) -> DataFrame:
    return headers.withColumn("z", (F.row_number().over(Window.partitionBy("job_id", "series_uid").orderBy(*slice_key())) - 1).cast("long"))


def validate_series(headers: DataFrame) -> DataFrame:
    """Slices of another size than the first, and files of several frames, per series; counted by size, no series is gathered."""
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(slice_key())))
    sizes = headers.groupBy("job_id", "series_uid", "rows_", "cols_").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("key"), F.count_if(F.col("n_frames") > 1).alias("n_multi"))
    series = sizes.groupBy("job_id", "series_uid").agg((F.sum("n") - F.min_by("n", "key")).alias("n_other_size"), F.sum("n_multi").alias("n_multi_frame"))
    return series.select("job_id", "series_uid", "n_other_size", "n_multi_frame")


def explode_frames(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(voxels, rejected) of image files (file_id, n_frames, rows_, cols_, n_channels, pixels), pixels being one flat array, frame by frame and row
    by row, channels last.

    A file of one frame is one slice, of several a slice for each; of a single frame in colours the first channel is taken. rejected (file_id, reason):
    several frames in colours, or a number of pixels that doesn't fit.
    """
    fits = F.size("pixels") == F.col("n_frames") * F.col("rows_") * F.col("cols_") * F.col("n_channels")
    reason = F.when(F.coalesce(~fits, F.lit(True)), "wrong size").when((F.col("n_frames") > 1) & (F.col("n_channels") > 1), "colour frames")
    judged = files.withColumn("reason", reason)
    each = judged.filter("reason is null").select("file_id", "rows_", "cols_", "n_channels", F.posexplode("pixels").alias("p", "v")).filter("p % n_channels = 0").withColumn("p", F.expr("p DIV n_channels"))
    voxels = each.select("file_id", F.expr("p DIV (rows_ * cols_)").alias("z"), (F.col("p") % F.col("cols_")).alias("x"), F.expr("(p DIV cols_) % rows_").alias("y"), "v")
    return voxels, judged.filter("reason is not null").select("file_id", "reason")
