"""Annotation samples, polygons and training rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmere.operators.halo import over_bricks
from voxmere.operators.region import volume


def pairs(images: DataFrame, masks: DataFrame, meta: DataFrame) -> DataFrame:
    """Samples with image and mask, and their metadata where there is some."""
    return images.join(masks, "sample_id").join(meta, "sample_id", "left")


def global_z(meta: DataFrame) -> DataFrame:
    """Local z clamped to the requested depth, and the volume's z where it lies inside the cutout, else null."""
    local = F.greatest(F.lit(0).cast("long"), F.least(F.col("annotated_local_z_index"), F.col("requested_z") - 1))
    inside = local - F.col("z_pad_before")
    ok = (inside >= 0) & (inside < F.col("actual_z"))
    return meta.withColumns({"local_z": local, "global_z": F.when(ok, F.col("z_origin") + inside)})


def restore_slices(meta: DataFrame, voxels: DataFrame, origin: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """The annotated slice of each sample rebuilt from the volume: shifted to its cutout, zero where nothing is."""
    wanted = global_z(meta).filter("global_z is not null").select("sample_id", F.col("global_z").alias("z"))
    inside = voxels.filter(F.col("x").between(origin[0], origin[0] + size[0] - 1) & F.col("y").between(origin[1], origin[1] + size[1] - 1))
    found = wanted.join(inside, "z").select("sample_id", (F.col("x") - origin[0]).alias("x"), (F.col("y") - origin[1]).alias("y"), "v")
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = wanted.select("sample_id", axis(size[0]).alias("x")).select("sample_id", "x", axis(size[1]).alias("y"))
    return grid.join(found, ["sample_id", "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))


def rasterize(regions: DataFrame, width: int, height: int, source: tuple[int, int] | None = None) -> DataFrame:
    """Mask pixels (mask_id, x, y) of polygons (mask_id, poly_id, negative, points): positives less negatives.

    Half-open parity rule. Each edge gives its crossings for the rows it spans, so nothing is joined with a pixel grid:
    a row's sorted crossings bound its runs of pixels. Points that aren't two numbers are dropped, then polygons with fewer
    than three points. Points drawn on a picture of size `source` are scaled to the mask's; a size of zero counts as none.
    """
    by = (width / source[0], height / source[1]) if source and min(source) > 0 else (1.0, 1.0)
    good = F.filter("points", lambda p: (F.size(p) == 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    scaled = regions.withColumn("points", F.transform(good, lambda p: F.array(p[0] * by[0], p[1] * by[1])))
    edges = scaled.filter(F.size("points") >= 3).select("mask_id", "poly_id", "negative", F.posexplode("points").alias("k", "p"), "points")
    after = F.get("points", (F.col("k") + 1) % F.size("points"))
    edges = edges.select("mask_id", "poly_id", "negative", F.col("p")[0].alias("x1"), F.col("p")[1].alias("y1"), after[0].alias("x2"), after[1].alias("y2"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.greatest(F.ceil(low), F.lit(0)), F.least(F.ceil(high) - 1, F.lit(height - 1))
    crossing = edges.filter(last >= first).withColumn("y", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    rows = crossing.groupBy("mask_id", "poly_id", "negative", "y").agg(F.array_sort(F.collect_list(at)).alias("xs"))
    runs = rows.select("mask_id", "negative", "y", F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2))).alias("k"), "xs")
    begin, end = F.greatest(F.ceil(F.get("xs", F.col("k"))), F.lit(0)), F.least(F.ceil(F.get("xs", F.col("k") + 1)) - 1, F.lit(width - 1))
    pixels = runs.filter(end >= begin).select("mask_id", "negative", F.explode(F.sequence(begin.cast("long"), end.cast("long"))).alias("x"), "y")
    return pixels.groupBy("mask_id", "x", "y").agg(F.bool_or("negative").alias("cut")).filter("not cut").drop("cut")


def regions_by_slice(submissions: DataFrame, by: str, payload: str, default_z: str) -> DataFrame:
    """(by, z, positive, negative): the regions of JSON submissions by slice, as JSON arrays.

    Slices whose key isn't a whole number or whose regions are all empty are left out. A submission that has no slice
    left counts as one on the slice in column default_z, by its regions under `polygons` or at the top. Names may be in
    snake or camel case, snake first. Text that isn't a JSON object gives nothing.
    """

    def given(body: Column, snake: str, camel: str) -> Column:
        return F.coalesce(F.get_json_object(body, f"$.{snake}"), F.get_json_object(body, f"$.{camel}"))

    def regions(body: Column) -> list[Column]:
        inner = F.get_json_object(body, "$.polygons")
        body = F.when(inner.startswith("{"), inner).otherwise(body)
        found = [given(body, f"{kind}_regions", f"{kind}Regions") for kind in ("positive", "negative")]
        return [F.when(F.json_array_length(f) > 0, f).alias(kind) for kind, f in zip(("positive", "negative"), found, strict=True)]

    some = "positive is not null or negative is not null"
    text = F.col(payload)
    slices = F.from_json(given(text, "regions_by_slice", "regionsBySlice"), "map<string,string>")
    keyed = submissions.select(F.col(by), text.alias("_text"), F.col(default_z).cast("long").alias("_z"), slices.alias("_slices"))
    entries = F.filter(F.transform(F.map_entries("_slices"), lambda e: F.struct(F.trim(e["key"]).try_cast("long").alias("z"), *regions(e["value"]))), lambda e: e["z"].isNotNull() & (e["positive"].isNotNull() | e["negative"].isNotNull()))
    flat = F.array(F.struct(F.col("_z").alias("z"), *regions(F.col("_text"))))
    either = keyed.withColumn("_e", entries).withColumn("_e", F.when(F.size("_e") > 0, F.col("_e")).otherwise(flat))
    return either.select(by, F.explode("_e").alias("e")).select(by, "e.*").filter(some)


def subsample_negatives(rows: DataFrame, every: int, by: str = "z") -> DataFrame:
    """All positives, and of each slice's negatives in x, y order the first and then every `every`-th."""
    if every <= 1:
        return rows
    negative = F.col("label") == 0
    place = F.row_number().over(Window.partitionBy(*volume(rows), by, negative).orderBy("x", "y"))
    return rows.withColumn("_k", place).filter(~negative | ((F.col("_k") - 1) % every == 0)).drop("_k")


def training_rows(voxels: DataFrame, truth: DataFrame) -> DataFrame:
    """(z, x, y, v, label): pixels with their mask, 0 outside it."""
    return voxels.join(truth.select("x", "y", "z", "lab"), ["x", "y", "z"], "left").select("z", "x", "y", "v", F.coalesce("lab", F.lit(0).cast("long")).alias("label"))


def sample_training_rows(raw: DataFrame, images: DataFrame, masks: DataFrame) -> DataFrame:
    """(sample_id, x, y, v, label, uses_raw): pixels of annotated samples with their mask, 0 outside it.

    raw (sample_id, x, y, v) are slices restored from the volume for samples with metadata, images those of the pictures saved
    for all; a sample that has both is taken from the volume. Only samples with a mask (sample_id, x, y, lab) count. All must
    have one size: an error names it and the first that differs.
    """
    known = raw.select("sample_id").distinct()
    pictures = images.join(known, "sample_id", "left_anti")
    both = raw.select("sample_id", "x", "y", "v").withColumn("uses_raw", F.lit(True)).unionByName(pictures.select("sample_id", "x", "y", "v").withColumn("uses_raw", F.lit(False)))
    rows = both.join(masks.select("sample_id").distinct(), "sample_id", "left_semi")
    sizes = rows.groupBy("sample_id").agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny")).groupBy("nx", "ny").agg(F.min("sample_id").alias("first")).orderBy("first").limit(2).collect()
    if len(sizes) > 1:
        one, other = sizes
        raise ValueError(f"samples must have one size: {one['first']} has {one['nx']} x {one['ny']}, {other['first']} has {other['nx']} x {other['ny']}")
    return rows.join(masks.select("sample_id", "x", "y", "lab"), ["sample_id", "x", "y"], "left").select("sample_id", "x", "y", "v", F.coalesce("lab", F.lit(0).cast("long")).alias("label"), "uses_raw")


def sample_records(slices: DataFrame, rasters: DataFrame, metadata: DataFrame) -> DataFrame:
    """(sample_id, z, record): what is saved for each annotated slice, as JSON.

    slices (sample_id, job_id, z, default_z) have drawn regions, rasters (sample_id, job_id, z) a painted mask; metadata
    (sample_id, meta) is a map, if there is one. Several slices without metadata: only the default one, else the first, is
    kept. A record is the metadata for its slice, with id, job, file names and source laid over it; several slices of one
    submission have their z in the id. A painted sample without metadata leaves no record, its row a null.
    """
    drawn = slices.join(metadata, "sample_id", "left")
    own = Window.partitionBy("sample_id")
    first = F.row_number().over(own.orderBy((F.col("z") != F.col("default_z")).cast("int"), "z"))
    kept = drawn.withColumns({"k": first, "n": F.count(F.lit(1)).over(own)}).filter(F.col("meta").isNotNull() | (F.col("k") == 1))
    several = (F.col("n") > 1) & F.col("meta").isNotNull()
    text = lambda c: F.col(c).cast("string")
    named = kept.select("sample_id", "job_id", "z", "meta", F.when(several, F.format_string("%d-z%02d", "sample_id", "z")).otherwise(text("sample_id")).alias("id"), F.lit("polygon_v2").alias("source"))
    painted = rasters.join(metadata, "sample_id", "left").select("sample_id", "job_id", "z", "meta", text("sample_id").alias("id"), F.lit("legacy_raster").alias("source"))
    pair = lambda k, v: [F.lit(k), v]
    over = F.create_map(*pair("timestamp", F.col("id")), *pair("job_id", text("job_id")), *pair("training_image_filename", F.concat(F.lit("img"), "id", F.lit(".png"))), *pair("training_mask_filename", F.concat(F.lit("seg"), "id", F.lit(".png"))), *pair("annotation_source", F.col("source")))
    base = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    placed = F.when(F.col("meta").isNotNull(), F.create_map(F.lit("annotated_local_z_index"), text("z"))).otherwise(F.create_map().cast("map<string,string>"))
    rest = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k) & (k != "annotated_local_z_index"))
    record = F.when((F.col("source") == "polygon_v2") | F.col("meta").isNotNull(), F.to_json(F.map_concat(rest, placed, over)))
    return named.unionByName(painted).select("sample_id", "z", record.alias("record"))


def reject_reason(has_image: Column, has_mask: Column, has_meta: Column, n_regions: Column) -> Column:
    """Why a submission can't be used, null if it can: image and mask, or regions with an image or metadata."""
    return F.when(has_image & has_mask, None).when(n_regions == 0, "no regions").when(~(has_image | has_meta), "no image or metadata")


def stencil(voxels: DataFrame) -> DataFrame:
    """3 x 3 sums in each slice, zero where no voxel is: smooth (1 2 1 both ways) and gradient (-1 0 1 along x, 1 2 1 along y).

    By bricks with a rim of one pixel: a voxel is dealt once, and once more only along the edges of its brick.
    """

    def sums(image: np.ndarray) -> dict[str, np.ndarray]:
        wide = np.pad(image, 1)
        down = wide[:, :-2] + 2 * wide[:, 1:-1] + wide[:, 2:]
        return {"smooth": down[:-2] + 2 * down[1:-1] + down[2:], "gradient": down[2:] - down[:-2]}

    return over_bricks(voxels.withColumn("v", F.col("v").cast("long")), 1, sums, "smooth long, gradient long", clipped=False)
