"""Queries on annotations and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmere.operators import annotations as A
from voxmere.plans.registry import query
from voxmere.sources.views import view


def v(spark, d, name):
    return view(spark, d, name)


@query("annotation_pairs", "anno_images", "anno_masks", "anno_meta", sql="SELECT i.sample_id, job_id, quality, toxic, annotated_local_z_index FROM anno_images i JOIN anno_masks USING (sample_id) LEFT JOIN anno_meta USING (sample_id)")
def annotation_pairs(spark, d):
    return A.pairs(v(spark, d, "anno_images"), v(spark, d, "anno_masks"), v(spark, d, "anno_meta")).select("sample_id", "job_id", "quality", "toxic", "annotated_local_z_index")


@query("annotation_count", "anno_images", "anno_masks", sql="SELECT job_id, count(*) AS n FROM anno_images JOIN anno_masks USING (sample_id) GROUP BY job_id")
def annotation_count(spark, d):
    return v(spark, d, "anno_images").join(v(spark, d, "anno_masks"), "sample_id").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


GLOBAL = "gz AS (SELECT *, greatest(0, least(annotated_local_z_index, requested_z - 1)) AS local_z FROM anno_meta), gg AS (SELECT *, CASE WHEN local_z - z_pad_before >= 0 AND local_z - z_pad_before < actual_z THEN z_origin + local_z - z_pad_before END AS global_z FROM gz)"


@query("sample_metadata_for_z", "anno_meta", sql=f"WITH {GLOBAL} SELECT sample_id, local_z, global_z FROM gg")
def sample_metadata_for_z(spark, d):
    return A.global_z(v(spark, d, "anno_meta")).select("sample_id", "local_z", "global_z")


@query("cutout_slice_restore", "anno_meta", "voxels", sql=f"WITH {GLOBAL} SELECT sample_id, i AS x, j AS y, coalesce(v, 0) AS v FROM gg CROSS JOIN range(10) a(i) CROSS JOIN range(6) b(j) LEFT JOIN voxels o ON o.z = global_z AND o.x = i - 1 AND o.y = j + 3 WHERE global_z IS NOT NULL")
def cutout_slice_restore(spark, d):
    return A.restore_slices(v(spark, d, "anno_meta"), v(spark, d, "voxels"), (-1, 3), (10, 6))


POLYGONS = "pg AS (SELECT item_id AS mask_id, unnest([{'poly': 1, 'neg': false, 'pts': [[1 + item_id % 3, 1], [6, 1], [6, 6], [1, 6]]}, {'poly': 2, 'neg': true, 'pts': [[2, 2], [4, 2 + item_id % 2], [4, 4], [2, 4]]}, {'poly': 3, 'neg': false, 'pts': [[0, 0], [3, 3]]}, {'poly': 4, 'neg': false, 'pts': [[5, 5], [7 + item_id % 2, 5], [8, 8]]}]) AS q FROM benchmark), pe AS (SELECT mask_id, q.poly AS poly, q.neg AS neg, q.pts AS pts, unnest(range(len(q.pts))) AS k FROM pg WHERE len(q.pts) >= 3), ed AS (SELECT mask_id, poly, neg, pts[k + 1][1] AS x1, pts[k + 1][2] AS y1, pts[(k + 1) % len(pts) + 1][1] AS x2, pts[(k + 1) % len(pts) + 1][2] AS y2 FROM pe)"


@query("rasterize_regions", sql=f"WITH {POLYGONS}, px AS (SELECT mask_id, poly, neg, i AS x, j AS y, count(*) AS n FROM ed, range(8) a(i), range(8) b(j) WHERE (y1 > j) <> (y2 > j) AND i < (x2 - x1) * (j - y1) / CAST(y2 - y1 AS DOUBLE) + x1 GROUP BY 1, 2, 3, 4, 5) SELECT mask_id, x, y FROM px WHERE n % 2 = 1 GROUP BY mask_id, x, y HAVING NOT bool_or(neg)")
def rasterize_regions(spark, d):
    from voxmere.sources.tables import table

    m, pt = F.col("item_id"), lambda x, y: F.array(F.lit(0.0) + x, F.lit(0.0) + y)
    poly = lambda k, neg, *pts: F.struct(F.lit(k).alias("poly_id"), F.lit(neg).alias("negative"), F.array(*(pt(*p) for p in pts)).alias("points"))
    regions = F.array(poly(1, False, (1 + m % 3, 1), (6, 1), (6, 6), (1, 6)), poly(2, True, (2, 2), (4, 2 + m % 2), (4, 4), (2, 4)), poly(3, False, (0, 0), (3, 3)), poly(4, False, (5, 5), (7 + m % 2, 5), (8, 8)))
    rows = table(spark, d, "benchmark").select(m.alias("mask_id"), F.explode(regions).alias("r")).select("mask_id", "r.*")
    drawn = F.transform("points", lambda p: F.array(p[0] * 3, p[1] * 2))  # on a picture of 24 x 16, with a point that isn't one
    return A.rasterize(rows.withColumn("points", F.concat(drawn, F.array(F.array(F.lit(1.0))))), 8, 8, (24, 16))


@query("stencil_features", "voxels", sql="""WITH o AS (SELECT unnest([-1, 0, 1]) AS d) SELECT c.x, c.y, c.z, CAST(sum(n.v * (2 - abs(a.d)) * (2 - abs(b.d))) AS BIGINT) AS smooth, CAST(sum(n.v * a.d * (2 - abs(b.d))) AS BIGINT) AS gradient
    FROM voxels c CROSS JOIN o a CROSS JOIN o b JOIN voxels n ON n.z = c.z AND n.x = c.x + a.d AND n.y = c.y + b.d GROUP BY c.x, c.y, c.z""")
def stencil_features(spark, d):
    return A.stencil(v(spark, d, "voxels")).select("x", "y", "z", "smooth", "gradient")


ROWS = "tr AS (SELECT o.z, o.x, o.y, v, coalesce(lab, 0) AS label FROM voxels o LEFT JOIN truth t ON t.x = o.x AND t.y = o.y AND t.z = o.z)"
KEPT = "kp AS (SELECT *, row_number() OVER (PARTITION BY z, label = 0 ORDER BY x, y) AS k FROM tr)"


@query("training_rows", "voxels", "truth", sql=f"WITH {ROWS} SELECT * FROM tr")
def training_rows(spark, d):
    return A.training_rows(v(spark, d, "voxels"), v(spark, d, "truth"))


@query("negative_subsample", "voxels", "truth", sql=f"WITH {ROWS}, {KEPT} SELECT z, x, y, v, label FROM kp WHERE label <> 0 OR (k - 1) % 5 = 0")
def negative_subsample(spark, d):
    return A.subsample_negatives(training_rows(spark, d), 5)


@query("pos_neg_union", "voxels", "truth", sql=f"WITH {ROWS}, {KEPT} SELECT z, CAST(label <> 0 AS BIGINT) AS positive, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM kp WHERE label <> 0 OR (k - 1) % 50 = 0 GROUP BY 1, 2")
def pos_neg_union(spark, d):
    rows = training_rows(spark, d)
    both = rows.filter("label <> 0").unionByName(A.subsample_negatives(rows.filter("label = 0"), 50))
    return both.groupBy("z", (F.col("label") != 0).cast("long").alias("positive")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("sample_source_union", "voxels", sql="SELECT z, x, y, v, true AS uses_raw FROM voxels WHERE z % 2 = 0 UNION ALL SELECT z, x, y, v % 256, false FROM voxels WHERE z % 2 = 1")
def sample_source_union(spark, d):
    raw = v(spark, d, "voxels").select("z", "x", "y", "v")
    return raw.filter("z % 2 = 0").withColumn("uses_raw", F.lit(True)).unionByName(raw.filter("z % 2 = 1").withColumns({"v": F.col("v") % 256, "uses_raw": F.lit(False)}))


@query("submission_quality", "anno_images", "anno_masks", "anno_meta", sql="SELECT i.sample_id, CASE WHEN i.sample_id % 3 <> 0 AND k.sample_id IS NOT NULL THEN NULL WHEN i.sample_id % 4 = 0 THEN 'no regions' WHEN NOT (i.sample_id % 3 <> 0 OR m.sample_id IS NOT NULL) THEN 'no image or metadata' END AS reject_reason FROM anno_images i LEFT JOIN anno_masks k USING (sample_id) LEFT JOIN anno_meta m USING (sample_id)")
def submission_quality(spark, d):
    rows = v(spark, d, "anno_images").join(v(spark, d, "anno_masks"), "sample_id", "left").join(v(spark, d, "anno_meta"), "sample_id", "left")
    s = F.col("sample_id")
    return rows.select("sample_id", A.reject_reason(s % 3 != 0, F.col("quality").isNotNull(), F.col("z_origin").isNotNull(), s % 4).alias("reject_reason"))


@query("ordered_slices", "anno_meta", sql="WITH s AS (SELECT sample_id, unnest([sample_id % 5, 7, 2]) AS z, sample_id % 3 <> 0 AS has_meta FROM anno_meta), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY z) AS k FROM s) SELECT sample_id, z, k FROM r WHERE has_meta OR k = 1")
def ordered_slices(spark, d):
    from pyspark.sql.window import Window

    s = F.col("sample_id")
    rows = v(spark, d, "anno_meta").select("sample_id", F.explode(F.array(s % 5, F.lit(7).cast("long"), F.lit(2).cast("long"))).alias("z"), (s % 3 != 0).alias("has_meta"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("sample_id").orderBy("z")).cast("long"))
    return numbered.filter("has_meta or k = 1").select("sample_id", "z", "k")


SLICES = """SELECT sample_id, z, CAST(CASE WHEN z = 7 THEN 0 ELSE 1 END AS BIGINT) AS n_negative, 1 + sample_id % 2 AS n_positive FROM (SELECT sample_id, unnest([sample_id % 5, 7]) AS z FROM anno_meta WHERE sample_id % 4 < 2)
    UNION ALL SELECT sample_id, annotated_local_z_index, CAST(1 AS BIGINT), 1 + sample_id % 2 FROM anno_meta WHERE sample_id % 4 >= 2"""


def submissions(spark, d):
    """JSON submissions in three spellings: by slice, flat, and flat below `polygons` beside slices that can't be used."""
    s = F.col("sample_id")
    square = "[[1,1],[6,1],[6,6]]"
    many = F.when(s % 2 == 0, f"[{square}]").otherwise(f"[{square},{square}]")
    body = lambda p, n, negative: F.concat(F.lit(f'{{"{p}":'), many, F.lit(f',"{n}":{negative}}}'))
    whole, camel = body("positive_regions", "negative_regions", f"[{square}]"), body("positiveRegions", "negativeRegions", f"[{square}]")
    sliced = F.concat(F.lit('{"regions_by_slice":{"'), s % 5, F.lit('":'), whole, F.lit(',"7":'), body("positive_regions", "negativeRegions", "[]"), F.lit(',"x":'), whole, F.lit(',"9":{"positive_regions":[]}}}'))
    below = F.concat(F.lit('{"regionsBySlice":{"x":'), whole, F.lit('},"polygons":'), camel, F.lit("}"))
    text = F.when(s % 4 < 2, sliced).when(s % 4 == 2, camel).otherwise(below)
    return v(spark, d, "anno_meta").select("sample_id", "annotated_local_z_index", text.alias("payload"))


@query("regions_by_slice", "anno_meta", sql=SLICES)
def regions_by_slice(spark, d):
    """How many regions each slice of the submissions has."""
    found = A.regions_by_slice(submissions(spark, d), "sample_id", "payload", "annotated_local_z_index")
    size = lambda f: F.coalesce(F.json_array_length(f), F.lit(0)).cast("long")
    return found.select("sample_id", "z", size("positive").alias("n_positive"), size("negative").alias("n_negative"))


@query("annotation_sample_write", "anno_meta", sql=f"WITH s AS ({SLICES}), c AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM s) SELECT sample_id, z, CASE WHEN n > 1 THEN printf('%d-z%02d', sample_id, z) ELSE CAST(sample_id AS VARCHAR) END AS id, 'polygon_v2' AS annotation_source FROM c")
def annotation_sample_write(spark, d):
    from pyspark.sql.window import Window

    rows = regions_by_slice(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sample_id")))
    name = F.when(F.col("n") > 1, F.format_string("%d-z%02d", "sample_id", "z")).otherwise(F.col("sample_id").cast("string"))
    return rows.select("sample_id", "z", name.alias("id"), F.lit("polygon_v2").alias("annotation_source"))


RAW = "rw AS (SELECT sample_id, i AS x, j AS y, coalesce(v, 0) AS v FROM gg CROSS JOIN range(8) a(i) CROSS JOIN range(8) b(j) LEFT JOIN voxels o ON o.z = global_z AND o.x = i AND o.y = j WHERE global_z IS NOT NULL)"


@query(
    "sample_training_rows", "anno_meta", "voxels",
    sql=f"""WITH {GLOBAL}, {RAW} SELECT sample_id, x, y, CASE WHEN sample_id % 3 <> 0 THEN v ELSE v % 256 END AS v, CAST(CASE WHEN (x + y + sample_id) % 5 = 0 THEN 255 ELSE 0 END AS BIGINT) AS label, sample_id % 3 <> 0 AS uses_raw FROM rw WHERE sample_id % 7 <> 0""",
)
def sample_training_rows(spark, d):
    """Two of three samples have metadata and come from the volume, the others from their 8-bit picture; one in seven has no mask."""
    pixels = A.restore_slices(v(spark, d, "anno_meta"), v(spark, d, "voxels"), (0, 0), (8, 8))
    s = F.col("sample_id")
    masks = pixels.filter((s % 7 != 0) & ((F.col("x") + F.col("y") + s) % 5 == 0)).select("sample_id", "x", "y", F.lit(255).cast("long").alias("lab"))
    return A.sample_training_rows(pixels.filter(s % 3 != 0), pixels.withColumn("v", F.col("v") % 256), masks)


@query(
    "annotation_sample_records", "anno_meta",
    sql=f"""WITH s AS ({SLICES}), c AS (SELECT s.sample_id, z, count(*) OVER w AS n, row_number() OVER (PARTITION BY s.sample_id ORDER BY CASE WHEN z = annotated_local_z_index THEN 0 ELSE 1 END, z) AS k, s.sample_id % 3 <> 0 AS has FROM s JOIN anno_meta m ON m.sample_id = s.sample_id WHERE s.sample_id % 5 <> 4 WINDOW w AS (PARTITION BY s.sample_id)),
    r AS (SELECT sample_id, z, CASE WHEN n > 1 AND has THEN printf('%d-z%02d', sample_id, z) ELSE CAST(sample_id AS VARCHAR) END AS id, 'polygon_v2' AS source, has FROM c WHERE has OR k = 1
    UNION ALL SELECT sample_id, annotated_local_z_index, CAST(sample_id AS VARCHAR), 'legacy_raster', sample_id % 3 <> 0 FROM anno_meta WHERE sample_id % 5 = 4)
    SELECT r.sample_id, z, CASE WHEN ok THEN id END AS id, CASE WHEN ok THEN source END AS source, CASE WHEN ok THEN concat('img', id, '.png') END AS image, CASE WHEN ok THEN concat('seg', id, '.png') END AS mask, CASE WHEN ok THEN CAST(r.sample_id % 20 AS VARCHAR) END AS job,
    CASE WHEN has THEN CAST(z AS VARCHAR) END AS local_z, CASE WHEN has THEN CAST(z_origin AS VARCHAR) END AS z_origin FROM (SELECT *, has OR source = 'polygon_v2' AS ok FROM r) r JOIN anno_meta m ON m.sample_id = r.sample_id""",
)
def annotation_sample_records(spark, d):
    """Records of drawn and painted samples, written as JSON lines and read again: metadata with names and source laid over it."""
    from voxmere.sources.paths import scratch

    s, meta = F.col("sample_id"), v(spark, d, "anno_meta")
    drawn = A.regions_by_slice(submissions(spark, d).filter(s % 5 != 4), "sample_id", "payload", "annotated_local_z_index").select("sample_id", "z")
    slices = drawn.join(meta.select("sample_id", F.col("annotated_local_z_index").alias("default_z")), "sample_id").withColumn("job_id", s % 20)
    rasters = meta.filter(s % 5 == 4).select("sample_id", (s % 20).alias("job_id"), F.col("annotated_local_z_index").alias("z"))
    known = meta.filter(s % 3 != 0).select("sample_id", F.create_map(F.lit("z_origin"), F.col("z_origin").cast("string"), F.lit("annotated_local_z_index"), F.lit("-1"), F.lit("annotation_source"), F.lit("unknown")).alias("meta"))
    path = scratch(spark)
    A.sample_records(slices, rasters, known).write.json(path)
    rows = spark.read.schema("sample_id long, z long, record string").json(path)
    got = lambda k: F.get_json_object("record", f"$.{k}")
    return rows.select("sample_id", "z", got("timestamp").alias("id"), got("annotation_source").alias("source"), got("training_image_filename").alias("image"), got("training_mask_filename").alias("mask"), got("job_id").alias("job"), got("annotated_local_z_index").alias("local_z"), got("z_origin").alias("z_origin"))
