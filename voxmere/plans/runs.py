"""Queries on model runs, metrics and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmere.functions import runs as N
from voxmere.operators import runs as R
from voxmere.plans.registry import query
from voxmere.sources.paths import scratch
from voxmere.sources.views import view

ASOF = "seen AS (SELECT m.job_id, m.model_id, count(s.sample_id) AS n_samples FROM models m LEFT JOIN samples s ON s.job_id = m.job_id AND s.sample_ts <= m.model_ts GROUP BY m.job_id, m.model_id)"
PATHS = "p AS (SELECT concat('volume/models/', job_id, '/', CASE WHEN model_id % 3 = 0 THEN 'best-' ELSE '' END, model_id, CASE model_id % 4 WHEN 0 THEN '.model' WHEN 1 THEN '.json' WHEN 2 THEN '.zarr' ELSE '' END) AS path, job_id FROM models)"
VALUES = "n AS (SELECT model_id, CASE model_id % 6 WHEN 0 THEN '0.5' WHEN 1 THEN concat(model_id, '%') WHEN 2 THEN 'true' WHEN 3 THEN 'inf' WHEN 4 THEN ' 7e1 % ' ELSE 'n/a' END AS value, CASE model_id % 5 WHEN 0 THEN ' Train  Dice' WHEN 1 THEN 'val-IoU' WHEN 2 THEN '  ' WHEN 3 THEN 'epochs' ELSE 'F1' END AS name FROM models)"


def models(spark, d):
    return view(spark, d, "models")


def paths(spark, d):
    m = F.col("model_id")
    ending = F.element_at(F.array(F.lit(".model"), F.lit(".json"), F.lit(".zarr"), F.lit("")), (m % 4 + 1).cast("int"))
    return models(spark, d).select(F.concat(F.lit("volume/models/"), "job_id", F.lit("/"), F.when(m % 3 == 0, "best-").otherwise(""), "model_id", ending).alias("path"), "job_id")


def named_values(spark, d):
    m = F.col("model_id")
    value = F.when(m % 6 == 0, "0.5").when(m % 6 == 1, F.concat(m.cast("string"), F.lit("%"))).when(m % 6 == 2, "true").when(m % 6 == 3, "inf").when(m % 6 == 4, " 7e1 % ").otherwise("n/a")
    name = F.when(m % 5 == 0, " Train  Dice").when(m % 5 == 1, "val-IoU").when(m % 5 == 2, "  ").when(m % 5 == 3, "epochs").otherwise("F1")
    return models(spark, d).select("model_id", value.alias("value"), name.alias("name"))


@query("annotations_asof_model", "models", "samples", sql=f"WITH {ASOF} SELECT * FROM seen")
def annotations_asof_model(spark, d):
    return R.growth(view(spark, d, "samples"), models(spark, d))


@query("annotation_growth", "models", "samples", sql=f"WITH {ASOF} SELECT job_id, model_id, n_samples, n_samples - coalesce(lag(n_samples) OVER (PARTITION BY job_id ORDER BY model_ts, model_id), 0) AS added FROM seen JOIN models USING (job_id, model_id)")
def annotation_growth(spark, d):
    from pyspark.sql.window import Window

    grown = R.growth(view(spark, d, "samples"), models(spark, d)).join(models(spark, d), ["job_id", "model_id"])
    before = F.lag("n_samples", 1, 0).over(Window.partitionBy("job_id").orderBy("model_ts", "model_id"))
    return grown.select("job_id", "model_id", "n_samples", (F.col("n_samples") - before).alias("added"))


@query(
    "model_runs", "models", "samples", "segmentations", "meshes", "model_json",
    sql=f"""WITH {ASOF} SELECT m.model_id, m.job_id, m.model_ts, j.meta, a.n_samples,
    (SELECT count(*) FROM segmentations s WHERE s.seg_id = m.model_id) AS n_segmentations, (SELECT count(*) FROM meshes s WHERE s.mesh_id = m.model_id) AS n_meshes,
    EXISTS (SELECT 1 FROM segmentations s WHERE s.seg_id = m.model_id) AS segmentation_ready, EXISTS (SELECT 1 FROM meshes s WHERE s.mesh_id = m.model_id) AS mesh_ready,
    row_number() OVER (PARTITION BY m.job_id ORDER BY m.model_id DESC) AS rank FROM models m LEFT JOIN model_json j USING (model_id) LEFT JOIN seen a USING (model_id)""",
)
def model_runs(spark, d):
    v = lambda n: view(spark, d, n)
    return R.model_runs(v("models"), v("model_json"), v("segmentations"), v("meshes"), R.growth(v("samples"), v("models"))).select("model_id", "job_id", "model_ts", "meta", "n_samples", "n_segmentations", "n_meshes", "segmentation_ready", "mesh_ready", "rank")


@query("latest_artifact_run", "segmentations", "models", sql="SELECT s.job_id, s.seg_id, m.model_ts FROM (SELECT job_id, arg_max(seg_id, CAST(seg_id AS VARCHAR)) AS seg_id FROM segmentations GROUP BY job_id) s LEFT JOIN models m ON m.model_id = s.seg_id")
def latest_artifact_run(spark, d):
    runs = models(spark, d).select(F.col("model_id").alias("seg_id"), "model_ts")
    return R.latest(view(spark, d, "segmentations"), "job_id", "seg_id", True).join(runs, "seg_id", "left").select("job_id", "seg_id", "model_ts")


@query("latest_segmentation", "segmentations", sql="SELECT job_id, arg_max(seg_id, CAST(seg_id AS VARCHAR)) AS seg_id FROM segmentations GROUP BY job_id")
def latest_segmentation(spark, d):
    return R.latest(view(spark, d, "segmentations"), "job_id", "seg_id", True)


@query("latest_mesh", "meshes", sql="SELECT job_id, arg_max(mesh_id, CAST(mesh_id AS VARCHAR)) AS mesh_id FROM meshes WHERE run_id % 3 <> 0 GROUP BY job_id")
def latest_mesh(spark, d):
    return R.latest(view(spark, d, "meshes").filter("run_id % 3 <> 0"), "job_id", "mesh_id", True)


@query("newest_first", "models", sql="SELECT job_id, model_id, model_ts, row_number() OVER (PARTITION BY job_id ORDER BY model_id DESC) AS rank FROM models")
def newest_first(spark, d):
    return R.newest(models(spark, d), "model_id", "job_id")


MATCH = f"""{ASOF}, nl AS (SELECT job_id, count(*) AS n, list(sample_id ORDER BY sample_id) AS ids FROM samples GROUP BY job_id),
    mc AS (SELECT a.job_id, a.model_id, coalesce(r.annotation_count, a.n_samples) AS n_seen, CASE WHEN len(coalesce(r.sample_ids, [])) > 0 THEN coalesce(list_sort(r.sample_ids) = nl.ids, false) ELSE coalesce(r.annotation_count, a.n_samples) = coalesce(nl.n, 0) END AS matches
    FROM seen a LEFT JOIN records r ON r.job_id = a.job_id AND r.model_id = a.model_id LEFT JOIN nl ON nl.job_id = a.job_id)"""
FRESH = f"""{MATCH}, nw AS (SELECT job_id, count(*) AS n_now FROM samples GROUP BY job_id), md AS (SELECT job_id, max(model_id) AS model_id FROM models GROUP BY job_id),
    sg AS (SELECT job_id, arg_max(seg_id, CAST(seg_id AS VARCHAR)) AS seg_id FROM segmentations GROUP BY job_id), ms AS (SELECT job_id, arg_max(mesh_id, CAST(mesh_id AS VARCHAR)) AS mesh_id FROM meshes GROUP BY job_id),
    j AS (SELECT job_id FROM nw UNION SELECT job_id FROM md),
    r AS (SELECT j.job_id, coalesce(n_now, 0) AS n_now, md.model_id, seg_id, mesh_id, coalesce(a.n_seen, 0) AS n_seen, coalesce(a.matches, false) AS matches FROM j LEFT JOIN nw USING (job_id) LEFT JOIN md USING (job_id) LEFT JOIN sg USING (job_id) LEFT JOIN ms USING (job_id) LEFT JOIN mc a ON a.job_id = j.job_id AND a.model_id = seg_id),
    q AS (SELECT *, CASE WHEN seg_id IS NOT NULL AND model_id IS NOT NULL AND model_id <> seg_id THEN 'newer model' END AS r1, CASE WHEN seg_id IS NOT NULL AND n_now > 0 AND NOT matches THEN CASE WHEN n_seen < n_now THEN 'new samples' ELSE 'does not reflect samples' END END AS r2 FROM r),
    f AS (SELECT *, r1 IS NOT NULL OR r2 IS NOT NULL AS seg_stale, concat_ws('; ', r1, r2) AS seg_reasons FROM q),
    fr AS (SELECT *, CASE WHEN mesh_id IS NOT NULL AND seg_id IS NOT NULL THEN CASE WHEN mesh_id <> seg_id THEN CASE WHEN seg_stale THEN 'predates annotations' ELSE 'newer segmentation' END WHEN seg_stale THEN 'from a stale segmentation' END END AS mesh_reason FROM f)"""


@query("artifact_freshness", "models", "samples", "segmentations", "meshes", "records", sql=f"WITH {FRESH} SELECT job_id, n_now, model_id, seg_id, mesh_id, seg_stale, seg_reasons, mesh_reason IS NOT NULL AS mesh_stale, mesh_reason FROM fr")
def artifact_freshness(spark, d):
    return R.freshness(*(view(spark, d, n) for n in ("samples", "models", "segmentations", "meshes", "records")))


@query("readiness_flags", "models", "samples", "segmentations", "meshes", "records", sql=f"WITH {FRESH} SELECT job_id, n_now > 0 AS annotation_ready, seg_id IS NOT NULL AS segmentation_ready, mesh_id IS NOT NULL AS meshes_ready, n_now >= 2 AS can_segment, seg_id IS NOT NULL AND NOT seg_stale AS can_mesh, mesh_reason IS NOT NULL AS mesh_outdated FROM fr")
def readiness_flags(spark, d):
    rows = R.freshness(*(view(spark, d, n) for n in ("samples", "models", "segmentations", "meshes", "records")))
    seg = F.col("seg_id").isNotNull()
    return rows.select("job_id", (F.col("n_now") > 0).alias("annotation_ready"), seg.alias("segmentation_ready"), F.col("mesh_id").isNotNull().alias("meshes_ready"), (F.col("n_now") >= 2).alias("can_segment"), (seg & ~F.col("seg_stale")).alias("can_mesh"), F.col("mesh_stale").alias("mesh_outdated"))


@query("sample_set_match", "models", "samples", "records", sql=f"WITH {MATCH} SELECT job_id, model_id, n_seen, matches FROM mc")
def sample_set_match(spark, d):
    return R.set_matches(view(spark, d, "samples"), models(spark, d), view(spark, d, "records"))


@query(
    "sample_id_diff", "models", "samples",
    sql="""WITH l AS (SELECT job_id, max(model_ts) AS ts FROM models GROUP BY job_id), a AS (SELECT job_id, sample_id FROM samples WHERE sample_id % 7 <> 0), b AS (SELECT s.job_id, s.sample_id FROM samples s JOIN l USING (job_id) WHERE sample_ts <= ts)
    SELECT job_id, sample_id, 'added' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT job_id, sample_id, 'removed' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def sample_id_diff(spark, d):
    samples = view(spark, d, "samples")
    last = models(spark, d).groupBy("job_id").agg(F.max("model_ts").alias("ts"))
    now = samples.filter("sample_id % 7 <> 0").select("job_id", "sample_id")
    then = samples.join(last, "job_id").filter("sample_ts <= ts").select("job_id", "sample_id")
    return now.exceptAll(then).withColumn("change", F.lit("added")).unionByName(then.exceptAll(now).withColumn("change", F.lit("removed")))


@query("normalize_model_id", "models", sql=f"WITH {PATHS} SELECT path, regexp_replace(split_part(path, '/', -1), '\\.(model|json|zarr)$', '') AS model, concat(regexp_replace(split_part(path, '/', -1), '\\.(model|json|zarr)$', ''), '.zarr') AS segmentation FROM p")
def normalize_model_id(spark, d):
    return paths(spark, d).select("path", N.model_id(F.col("path")).alias("model"), N.segmentation_id(F.col("path")).alias("segmentation"))


@query("model_sort_key", "models", sql=f"WITH {PATHS}, i AS (SELECT job_id, regexp_replace(split_part(path, '/', -1), '\\.(model|json|zarr)$', '') AS id FROM p) SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN regexp_full_match(id, '[0-9]+') THEN 0 ELSE 1 END, TRY_CAST(id AS BIGINT), id) AS place FROM i")
def model_sort_key(spark, d):
    from pyspark.sql.window import Window

    ids = paths(spark, d).select("job_id", N.model_id(F.col("path")).alias("id"))
    return ids.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy(N.sort_key(F.col("id")))).cast("long"))


VALUE = r"TRY_CAST(CASE WHEN regexp_full_match(trim(regexp_replace(trim(value), '%$', '')), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN trim(regexp_replace(trim(value), '%$', '')) END AS DOUBLE)"


@query("coerce_metric_value", "models", sql=f"WITH {VALUES} SELECT model_id, value, {VALUE} AS number FROM n")
def coerce_metric_value(spark, d):
    return named_values(spark, d).select("model_id", "value", N.metric_value(F.col("value")).alias("number"))


@query("normalize_metric_key", "models", sql=f"WITH {VALUES} SELECT model_id, nullif(replace(lower(trim(name)), ' ', '_'), '') AS key FROM n")
def normalize_metric_key(spark, d):
    return named_values(spark, d).select("model_id", N.metric_key(F.col("name")).alias("key"))


@query("is_metric_key", "models", sql=f"WITH {VALUES} SELECT model_id, name, regexp_matches(lower(name), '{'|'.join(N.METRIC_WORDS)}') AS is_metric FROM n")
def is_metric_key(spark, d):
    return named_values(spark, d).select("model_id", "name", N.is_metric(F.col("name")).alias("is_metric"))


def metrics(spark, d):
    """(model_id, job_id, key, text): scalar metric entries of the sidecars, booleans left out."""
    both = view(spark, d, "model_json").withColumn("m", F.from_json("meta", "metrics map<string,string>")["metrics"])
    return both.select("model_id", "job_id", F.explode("m").alias("key", "text")).filter(N.is_metric(F.col("key")) & ~F.col("text").isin("true", "false"))


METRIC_SQL = "k AS (SELECT model_id, job_id, unnest(json_keys(meta, '$.metrics')) AS key, meta FROM model_json), e AS (SELECT model_id, job_id, key, json_extract_string(meta, '$.metrics.' || key) AS value FROM k), mt AS (SELECT model_id, job_id, key, " + VALUE + f" AS value FROM e WHERE regexp_matches(key, '{'|'.join(N.METRIC_WORDS)}') AND value NOT IN ('true', 'false'))"


# Worked out by hand from the rule: pairs, then numbers with metric names (metric_value is one itself), then sections in
# their order; later ones stand.
DEEP_SQL = """SELECT event_id AS model_id, unnest(['val_dice', 'metric_value', 'final__loss', 'f1-score', 'best_metric_value', 'iou', 'precision', 'loss']) AS key,
    unnest([CAST(event_id % 50 AS DOUBLE), CAST(event_id % 50 AS DOUBLE), 1.0, 0.5, CAST(event_id % 7 AS DOUBLE), CAST(event_id % 5 AS DOUBLE), CAST(event_id % 11 AS DOUBLE), CAST(event_id % 13 AS DOUBLE)]) AS value
    FROM events WHERE event_type = 'purchase'"""


@query("extract_metrics", sql=DEEP_SQL)
def extract_metrics(spark, d):
    return R.nested_metrics(view(spark, d, "deep_json"), "model_id", "meta")


@query("metric_available_count", "model_json", sql=f"WITH {METRIC_SQL} SELECT job_id, key, count(value) AS n FROM mt GROUP BY job_id, key")
def metric_available_count(spark, d):
    return metrics(spark, d).groupBy("job_id", "key").agg(F.count(N.metric_value(F.col("text"))).alias("n"))


DICE = "dc AS (SELECT model_id, job_id, CASE WHEN model_id % 7 <> 0 THEN CAST(json_extract_string(meta, '$.metrics.train_foreground_dice') AS DOUBLE) END AS dice FROM model_json)"
PAD = "coalesce(nullif((high - low) * 0.1, 0), nullif(abs(high) * 0.1, 0), 1.0)"


def dice(spark, d):
    value = F.get_json_object("meta", "$.metrics.train_foreground_dice").cast("double")
    return view(spark, d, "model_json").select("model_id", "job_id", F.when(F.col("model_id") % 7 != 0, value).alias("dice"))


@query("metric_trend", "model_json", sql=f"WITH {DICE}, i AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY model_id) - 1 AS index FROM dc), g AS (SELECT *, min(dice) OVER (PARTITION BY job_id) AS low, max(dice) OVER (PARTITION BY job_id) AS high FROM i WHERE dice IS NOT NULL), h AS (SELECT *, {PAD} AS pad FROM g) SELECT job_id, model_id, index, dice, (dice - low + pad) / (high - low + 2 * pad) AS y FROM h")
def metric_trend(spark, d):
    return R.trend(dice(spark, d), "job_id", "model_id", "dice").select("job_id", "model_id", "index", "dice", "y")


@query("metric_range", "model_json", sql=f"WITH {DICE}, g AS (SELECT job_id, min(dice) AS low, max(dice) AS high FROM dc WHERE dice IS NOT NULL GROUP BY job_id) SELECT job_id, low, high, {PAD} AS pad FROM g")
def metric_range(spark, d):
    return R.trend(dice(spark, d), "job_id", "model_id", "dice").select("job_id", "low", "high", "pad").distinct()


@query("needs_migration", "model_json", sql="SELECT model_id, json_extract(meta, '$.model_id') IS NULL OR json_extract(meta, '$.job_id') IS NULL OR json_extract(meta, '$.created_at') IS NULL OR TRY_CAST(json_extract_string(meta, '$.annotation_count') AS BIGINT) IS NULL AS needs, TRY_CAST(json_extract_string(meta, '$.annotation_count') AS BIGINT) AS annotation_count FROM model_json")
def needs_migration(spark, d):
    got = lambda k: F.get_json_object("meta", f"$.{k}")
    count = got("annotation_count").try_cast("long")
    return view(spark, d, "model_json").select("model_id", (got("model_id").isNull() | got("job_id").isNull() | got("created_at").isNull() | count.isNull()).alias("needs"), count.alias("annotation_count"))


@query("sample_id", "anno_images", sql="WITH f AS (SELECT concat(CASE WHEN sample_id % 3 = 0 THEN 'img' ELSE '' END, sample_id, CASE WHEN sample_id % 5 = 0 THEN '-z05' ELSE '' END, '.png') AS name FROM anno_images) SELECT name, TRY_CAST(CASE WHEN regexp_full_match(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '^img', ''), '[0-9]+') THEN regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '^img', '') END AS BIGINT) AS id FROM f")
def sample_id(spark, d):
    s = F.col("sample_id")
    names = view(spark, d, "anno_images").select(F.concat(F.when(s % 3 == 0, "img").otherwise(""), s.cast("string"), F.when(s % 5 == 0, "-z05").otherwise(""), F.lit(".png")).alias("name"))
    return names.select("name", N.sample_id(F.col("name")).alias("id"))


@query("infer_created_at", "models", sql="SELECT model_id, CASE WHEN model_id % 2 = 0 THEN make_timestamp(CAST((1700000000 + model_id) AS BIGINT) * 1000000) ELSE model_ts END AS created_at FROM models")
def infer_created_at(spark, d):
    name = F.when(F.col("model_id") % 2 == 0, (F.lit(1700000000) + F.col("model_id")).cast("string")).otherwise("latest")
    from_name = F.timestamp_seconds(name.try_cast("long")).cast("timestamp_ntz")
    return models(spark, d).select("model_id", F.coalesce(from_name, F.col("model_ts").cast("timestamp_ntz")).alias("created_at"))


@query("backfill_metadata", "model_json", "models", "samples", "segmentations", sql=f"WITH {ASOF}, s AS (SELECT DISTINCT seg_id FROM segmentations) SELECT j.model_id, coalesce(TRY_CAST(json_extract_string(meta, '$.job_id') AS BIGINT), j.job_id) AS job_id, coalesce(CASE WHEN j.model_id % 2 = 0 THEN TRY_CAST(json_extract_string(meta, '$.annotation_count') AS BIGINT) END, a.n_samples) AS annotation_count, coalesce(json_extract_string(meta, '$.model_class'), 'forest') AS model_class, CASE WHEN s.seg_id IS NOT NULL THEN concat(j.model_id, '.zarr') END AS segmentation_id FROM model_json j LEFT JOIN seen a USING (model_id) LEFT JOIN s ON s.seg_id = j.model_id")
def backfill_metadata(spark, d):
    got = lambda k: F.get_json_object("meta", f"$.{k}")
    counts = R.growth(view(spark, d, "samples"), models(spark, d)).select("model_id", "n_samples")
    segs = view(spark, d, "segmentations").select(F.col("seg_id").alias("model_id"), F.lit(True).alias("has")).distinct()
    rows = view(spark, d, "model_json").join(counts, "model_id", "left").join(segs, "model_id", "left")
    count = F.coalesce(F.when(F.col("model_id") % 2 == 0, got("annotation_count").try_cast("long")), F.col("n_samples"))
    return rows.select("model_id", F.coalesce(got("job_id").try_cast("long"), "job_id").alias("job_id"), count.alias("annotation_count"), F.coalesce(got("model_class"), F.lit("forest")).alias("model_class"), F.when(F.col("has"), F.concat("model_id", F.lit(".zarr"))).alias("segmentation_id"))


@query("training_sample_ids", "models", "samples", sql="SELECT m.model_id, string_agg(CAST(s.sample_id AS VARCHAR), ',' ORDER BY s.sample_id) FILTER (s.sample_id % 4 <> 0) AS ids FROM models m JOIN samples s ON s.job_id = m.job_id AND s.sample_ts <= m.model_ts GROUP BY m.model_id HAVING count(*) FILTER (s.sample_id % 4 <> 0) > 0")
def training_sample_ids(spark, d):
    """Lists grow from run to run by what each run saw first; no run is joined with all samples before it."""
    from pyspark.sql.window import Window

    s = F.col("sample_id")
    named = R.new_samples(view(spark, d, "samples"), models(spark, d)).filter("model_id is not null")
    entry = R.listed_sample_id(F.when(s % 2 == 1, s), F.when(s % 4 == 2, F.concat(F.lit("img"), s.cast("string"), F.lit(".png"))))
    added = named.groupBy("job_id", "model_id").agg(F.collect_list(entry).alias("ids"))
    upto = Window.partitionBy("job_id").orderBy("model_ts", "model_id").rowsBetween(Window.unboundedPreceding, 0)
    lists = models(spark, d).join(added, ["job_id", "model_id"], "left").withColumn("ids", F.array_sort(F.flatten(F.collect_list("ids").over(upto))))
    return lists.filter(F.size("ids") > 0).select("model_id", F.array_join("ids", ",").alias("ids"))


@query("metadata_merge", "model_json", sql="SELECT model_id, CAST(job_id AS VARCHAR) AS job_id, CASE WHEN model_id % 2 = 0 THEN 'new' ELSE 'forest' END AS kind, CASE WHEN model_id % 3 = 0 THEN 'x' END AS note FROM model_json")
def metadata_merge(spark, d):
    """A later map wins over an earlier one, key by key."""
    old = F.create_map(F.lit("job_id"), F.col("job_id").cast("string"), F.lit("kind"), F.lit("forest"))
    new = F.map_from_entries(F.array_compact(F.array(F.when(F.col("model_id") % 2 == 0, F.struct(F.lit("kind").alias("k"), F.lit("new").alias("v"))), F.when(F.col("model_id") % 3 == 0, F.struct(F.lit("note").alias("k"), F.lit("x").alias("v"))))))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    merged = view(spark, d, "model_json").select("model_id", F.map_concat(kept, new).alias("m"))
    return merged.select("model_id", *(F.col("m")[k].alias(k) for k in ("job_id", "kind", "note")))


@query("sidecar_write", "model_json", "segmentations", sql="WITH s AS (SELECT seg_id, count(*) AS n FROM segmentations GROUP BY seg_id) SELECT model_id, job_id, meta, CASE WHEN n IS NOT NULL THEN concat(model_id, '.zarr') END AS segmentation_id FROM model_json LEFT JOIN s ON seg_id = model_id")
def sidecar_write(spark, d):
    """Sidecars, written, then read and merged with what is known later."""
    path = scratch(spark)
    view(spark, d, "model_json").write.parquet(path)
    done = view(spark, d, "segmentations").select(F.col("seg_id").alias("model_id")).distinct().withColumn("segmentation_id", F.concat("model_id", F.lit(".zarr")))
    return spark.read.parquet(path).join(done, "model_id", "left").select("model_id", "job_id", "meta", "segmentation_id")


@query(
    "training_record", "models", "samples", "anno_meta", "model_json",
    sql="""WITH fs AS (SELECT s.job_id, s.sample_id, m.sample_id IS NOT NULL AS uses_raw, (SELECT arg_min(o.model_id, (o.model_ts, o.model_id)) FROM models o WHERE o.job_id = s.job_id AND o.model_ts >= s.sample_ts) AS model_id FROM samples s LEFT JOIN anno_meta m ON m.sample_id = s.sample_id),
    ad AS (SELECT model_id, count(*) AS n, count(*) FILTER (uses_raw) AS raw, string_agg(concat('img', sample_id, '.png ', 'seg', sample_id, '.png', CASE WHEN uses_raw THEN concat(' meta', sample_id, '.json') ELSE '' END), '; ' ORDER BY sample_id) AS files FROM fs WHERE model_id IS NOT NULL GROUP BY model_id),
    rc AS (SELECT m.*, coalesce(files, '') AS files, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS annotation_count, CAST(coalesce(sum(raw) OVER w, 0) AS BIGINT) AS metadata_backed_sample_count FROM models m LEFT JOIN ad ON ad.model_id = m.model_id WINDOW w AS (PARTITION BY job_id ORDER BY model_ts, m.model_id ROWS UNBOUNDED PRECEDING))
    SELECT rc.model_id, rc.job_id, annotation_count, metadata_backed_sample_count, files, CAST(json_extract_string(meta, '$.rf_kwargs.n_estimators') AS BIGINT) AS n_estimators, CAST(json_extract_string(meta, '$.metrics.train_foreground_dice') AS DOUBLE) AS dice,
    CAST(replace(json_extract_string(meta, '$.metrics.train_foreground_iou'), '%', '') AS DOUBLE) AS iou, 'ready' AS curve FROM rc LEFT JOIN model_json j ON j.model_id = rc.model_id""",
)
def training_record(spark, d):
    """Records of all runs, written as JSON and read again: counts, the samples that are new in each, parameters and metrics."""
    raw = view(spark, d, "anno_meta").select("sample_id", F.lit(True).alias("raw")).distinct()
    samples = view(spark, d, "samples").join(raw, "sample_id", "left").withColumn("uses_raw", F.coalesce("raw", F.lit(False))).drop("raw")
    records, path = R.training_records(samples, models(spark, d), view(spark, d, "model_json").select("model_id", "meta")), scratch(spark)
    records.write.json(path)
    rows = spark.read.schema(records.schema).json(path)
    line = F.transform("new_samples", lambda s: F.concat_ws(" ", s["image_filename"], s["mask_filename"], s["metadata_filename"]))
    return rows.select(
        "model_id", "job_id", "annotation_count", "metadata_backed_sample_count", F.array_join(line, "; ").alias("files"), F.col("parameters")["n_estimators"].cast("long").alias("n_estimators"),
        F.col("metrics")["train_foreground_dice"].alias("dice"), F.col("metrics")["train_foreground_iou"].alias("iou"), F.col("artifacts.training_curve.status").alias("curve"),
    )


@query("sidecar_scan", "model_json", sql="SELECT model_id, CASE WHEN model_id % 10 <> 0 THEN TRY_CAST(json_extract_string(meta, '$.annotation_count') AS BIGINT) END AS annotation_count FROM model_json")
def sidecar_scan(spark, d):
    """Sidecars as text; one in ten is broken and reads as null."""
    text = F.when(F.col("model_id") % 10 == 0, F.concat(F.lit("["), "meta")).otherwise(F.col("meta"))
    parsed = F.try_parse_json(text)
    shape = F.schema_of_variant(parsed)
    count = F.when(shape.startswith("OBJECT"), F.try_variant_get(parsed, "$.annotation_count", "bigint"))
    return view(spark, d, "model_json").select("model_id", count.alias("annotation_count"))
