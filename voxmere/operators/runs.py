"""Model runs, their artifacts, and what is current."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from voxmere.functions.runs import METRIC_PAIRS, is_metric, is_section, metric_key, metric_value
from voxmere.functions.runs import sample_id as name_sample_id
from voxmere.sources.paths import scratch


def growth(samples: DataFrame, models: DataFrame) -> DataFrame:
    """(job_id, model_id, n_samples): samples up to each model's time, as a running count over the union of both.

    One pass sorted by (job, time) instead of a range join; at equal times the sample counts.
    """
    events = samples.select("job_id", F.col("sample_ts").alias("ts"), F.lit(0).alias("late"), F.lit(None).cast("long").alias("model_id")).unionByName(models.select("job_id", F.col("model_ts").alias("ts"), F.lit(1).alias("late"), "model_id"))
    so_far = Window.partitionBy("job_id").orderBy("ts", "late").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("n_samples", F.count_if(F.col("late") == 0).over(so_far)).filter("late = 1").select("job_id", "model_id", "n_samples")


def newest(rows: DataFrame, order: str, *by: str) -> DataFrame:
    """Rows numbered from the newest in each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))).cast("long"))


def model_runs(models: DataFrame, sidecars: DataFrame, segmentations: DataFrame, meshes: DataFrame, counts: DataFrame) -> DataFrame:
    """One wide row for each model, newest first: sidecar, samples, segmentations and meshes."""
    segs = segmentations.groupBy(F.col("seg_id").alias("model_id")).agg(F.count(F.lit(1)).alias("n_segmentations"))
    mesh = meshes.groupBy(F.col("mesh_id").alias("model_id")).agg(F.count(F.lit(1)).alias("n_meshes"))
    out = models.join(sidecars.drop("job_id"), "model_id", "left").join(counts.drop("job_id"), "model_id", "left").join(segs, "model_id", "left").join(mesh, "model_id", "left")
    out = out.fillna(0, ["n_segmentations", "n_meshes"]).withColumns({"segmentation_ready": F.col("n_segmentations") > 0, "mesh_ready": F.col("n_meshes") > 0})
    return newest(out, "model_id", "job_id")


def latest(rows: DataFrame, by: str, run: str, text_order: bool) -> DataFrame:
    """The greatest run of each job, in text or number order."""
    key = F.col(run).cast("string") if text_order else F.col(run)
    return rows.groupBy(by).agg(F.max_by(run, key).alias(run))


def digest(ids: Column) -> list[Column]:
    """Aggregates that tell multisets of ids apart without holding them: how many, a sum and an exclusive or of two 64-bit hashes."""
    return [F.count(ids).alias("n"), F.sum(F.xxhash64(ids).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.when(ids.isNotNull(), F.xxhash64(F.lit(1), ids))).alias("x")]


def list_digest(ids: Column) -> Column:
    """The same of an array, as a struct (n, s, x); null ids don't count."""
    known = F.filter(ids, lambda i: i.isNotNull())
    zero = F.lit(0).cast("decimal(38,0)")
    total = F.aggregate(known, zero, lambda s, i: (s + F.xxhash64(i)).cast("decimal(38,0)"))
    mixed = F.aggregate(known, F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(F.xxhash64(F.lit(1), i)))
    return F.struct(F.size(known).cast("long").alias("n"), total.alias("s"), mixed.alias("x"))


def set_matches(samples: DataFrame, models: DataFrame, records: DataFrame) -> DataFrame:
    """(job_id, model_id, n_seen, matches): whether a model was trained on just the job's present samples.

    records has for each run (job_id, model_id, sample_ids, annotation_count), either of them null where it wasn't
    recorded. Recorded ids decide, compared as multisets; without them the recorded number, and without that the number
    of samples up to the model's time. n_seen is the recorded number, else the one up to the model's time. A job's samples are never gathered:
    both sides are compared by their number and 128 bits of hash sums, so a job costs the same with any number of samples and models.
    """
    now = samples.groupBy("job_id").agg(*digest(F.col("sample_id"))).select("job_id", F.col("n").alias("n_now"), F.struct("n", "s", "x").alias("now"))
    rows = growth(samples, models).join(records, ["job_id", "model_id"], "left").join(now, "job_id", "left")
    n_now = F.coalesce("n_now", F.lit(0))
    n_seen = F.coalesce("annotation_count", "n_samples")
    ids = list_digest(F.col("sample_ids").cast(T.ArrayType(samples.schema["sample_id"].dataType)))
    recorded = F.col("sample_ids").isNotNull() & (ids["n"] > 0)
    matches = F.when(recorded, F.coalesce(ids == F.col("now"), F.lit(False))).otherwise(n_seen == n_now)
    return rows.select("job_id", "model_id", n_seen.alias("n_seen"), matches.alias("matches"))


def new_samples(samples: DataFrame, models: DataFrame) -> DataFrame:
    """samples with model_id, the first model of their job that saw them; null where none has yet.

    A model's samples are those of its job whose first model isn't later than it, so each sample stands once and lists
    are kept as differences. One sort by job and time; models of one time are taken by number, and at equal times the sample counts.
    """
    rows = samples.select("job_id", F.col("sample_ts").alias("ts"), F.lit(0).alias("late"), F.struct(*samples.columns).alias("sample"), F.lit(None).cast("long").alias("m"))
    marks = models.select("job_id", F.col("model_ts").alias("ts"), F.lit(1).alias("late"), F.lit(None).cast(rows.schema["sample"].dataType).alias("sample"), F.col("model_id").alias("m"))
    on = Window.partitionBy("job_id").orderBy("ts", "late", "m").rowsBetween(0, Window.unboundedFollowing)
    return rows.unionByName(marks).withColumn("model_id", F.first("m", ignorenulls=True).over(on)).filter("late = 0").select("sample.*", "model_id")


def listed_sample_id(sample_id: Column, image_filename: Column) -> Column:
    """A sample's own id, else the one in its image's name."""
    return F.coalesce(sample_id, name_sample_id(image_filename))


def training_records(samples: DataFrame, models: DataFrame, sidecars: DataFrame) -> DataFrame:
    """One record for each run, with what it was trained on and how well it did.

    samples (job_id, sample_id, sample_ts, uses_raw), models (job_id, model_id, model_ts), sidecars (model_id, meta). A record
    has model_id, job_id, created_at, annotation_count and metadata_backed_sample_count (of all samples up to the model),
    new_samples (those that no earlier model of the job saw, as structs with file names, by id), parameters and metrics (maps)
    and artifacts. A model's whole list is what new_samples of its job hold up to it.
    """
    seen = new_samples(samples, models).filter("model_id is not null")
    name = lambda kind, ending: F.concat(F.lit(kind), F.col("sample_id").cast("string"), F.lit(ending))
    entry = F.struct("sample_id", name("img", ".png").alias("image_filename"), name("seg", ".png").alias("mask_filename"), F.when(F.col("uses_raw"), name("meta", ".json")).alias("metadata_filename"), F.col("uses_raw").alias("uses_raw_volume_metadata"))
    added = seen.groupBy("job_id", "model_id").agg(F.sort_array(F.collect_list(entry)).alias("new_samples"), F.count(F.lit(1)).alias("n"), F.count_if("uses_raw").alias("raw"))
    upto = Window.partitionBy("job_id").orderBy("model_ts", "model_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = models.join(added, ["job_id", "model_id"], "left")
    rows = rows.withColumns({"annotation_count": F.coalesce(F.sum("n").over(upto), F.lit(0)), "metadata_backed_sample_count": F.coalesce(F.sum("raw").over(upto), F.lit(0))})
    metrics = nested_metrics(sidecars, "model_id", "meta").groupBy("model_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metrics"))
    parameters = sidecars.select("model_id", F.from_json(F.get_json_object("meta", "$.rf_kwargs"), "map<string,string>").alias("parameters"))
    none = F.array().cast(added.schema["new_samples"].dataType)
    curve = F.struct(F.struct(F.lit("ready").alias("status"), F.col("model_ts").alias("generated_at"), F.lit("train_foreground_dice").alias("metric_name")).alias("training_curve"))
    joined = rows.join(parameters, "model_id", "left").join(metrics, "model_id", "left")
    return joined.select("model_id", "job_id", F.col("model_ts").alias("created_at"), "annotation_count", "metadata_backed_sample_count", F.coalesce("new_samples", none).alias("new_samples"), "parameters", "metrics", curve.alias("artifacts"))


#: Levels of sections that one round looks through.
METRIC_LEVELS = 6


def nested_metrics(sidecars: DataFrame, by: str, body: str, levels: int = METRIC_LEVELS) -> DataFrame:
    """(by, key, value): the metrics in a column of JSON objects, sections inside each other to any depth.

    An object gives first the names and values of METRIC_PAIRS, then its numbers with metric names, then what its sections
    give, in their order; what comes later stands. Each of these is one step, so the steps on the way to a value order it.
    A round looks through `levels` of sections and writes what it found with the sections left below, which the next goes on
    with; it ends when none is left. Text that isn't an object gives nothing.
    """
    spark, places, folders = sidecars.sparkSession, F.col("steps"), []
    step = lambda kind, k: F.concat(places, F.array(F.lit(kind), k.cast("int")))
    at = sidecars.select(by, F.array().cast("array<int>").alias("steps"), F.col(body).alias("body"))
    while True:
        found = []
        for _ in range(levels):
            at = at.withColumn("m", F.from_json("body", "map<string,string>"))
            pairs = F.array(*(F.struct(F.get_json_object("body", f"$.{n}").alias("name"), F.col("m")[v].alias("text")) for n, v in METRIC_PAIRS))
            named = at.select(by, "steps", F.posexplode(pairs).alias("k", "p")).select(by, step(0, F.col("k")).alias("at"), metric_key(F.col("p.name")).alias("key"), metric_value(F.col("p.text")).alias("value"))
            inner = at.select(by, "steps", F.posexplode("m").alias("k", "name", "text"))
            plain = inner.filter(is_metric(F.col("name"))).select(by, step(1, F.col("k")).alias("at"), metric_key(F.col("name")).alias("key"), metric_value(F.col("text")).alias("value"))
            found += [rows.filter("key is not null and value is not null").withColumn("body", F.lit(None).cast("string")) for rows in (named, plain)]
            at = inner.filter(is_section(F.col("name")) & F.col("text").startswith("{")).select(by, step(2, F.col("k")).alias("steps"), F.col("text").alias("body"))
        rest = at.select(by, F.col("steps").alias("at"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"), "body")
        folders.append(scratch(spark))
        reduce(DataFrame.unionByName, [*found, rest]).write.parquet(folders[-1])
        at = spark.read.parquet(folders[-1]).filter("body is not null").select(by, F.col("at").alias("steps"), "body")
        if at.isEmpty():
            break
    rows = spark.read.parquet(*folders).filter("body is null")
    return rows.groupBy(by, "key").agg(F.max_by("value", "at").alias("value"))


def freshness(samples: DataFrame, models: DataFrame, segmentations: DataFrame, meshes: DataFrame, records: DataFrame) -> DataFrame:
    """For each job whether its latest segmentation and mesh still reflect its models and samples, and why not.

    A segmentation is stale if a newer model exists, or if there are samples and its model wasn't trained on just these
    (see set_matches); a mesh if it belongs to another run than the segmentation, or to a stale one.
    """
    now = samples.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_now"))
    model = models.groupBy("job_id").agg(F.max("model_id").alias("model_id"))
    seg = latest(segmentations, "job_id", "seg_id", True)
    mesh = latest(meshes, "job_id", "mesh_id", True)
    seen = set_matches(samples, models, records).select("job_id", F.col("model_id").alias("seg_id"), "n_seen", "matches")
    jobs = now.select("job_id").unionByName(model.select("job_id")).distinct()
    rows = jobs.join(now, "job_id", "left").join(model, "job_id", "left").join(seg, "job_id", "left").join(mesh, "job_id", "left").join(seen, ["job_id", "seg_id"], "left")
    rows = rows.fillna(0, ["n_now", "n_seen"])
    has_seg, has_mesh = F.col("seg_id").isNotNull(), F.col("mesh_id").isNotNull()
    newer = has_seg & F.col("model_id").isNotNull() & (F.col("model_id") != F.col("seg_id"))
    differs = has_seg & (F.col("n_now") > 0) & ~F.coalesce("matches", F.lit(False))
    seg_reasons = F.array_compact(F.array(F.when(newer, "newer model"), F.when(differs, F.when(F.col("n_seen") < F.col("n_now"), "new samples").otherwise("does not reflect samples"))))
    rows = rows.withColumn("seg_reasons", seg_reasons).withColumn("seg_stale", F.size("seg_reasons") > 0)
    other = has_mesh & has_seg & (F.col("mesh_id") != F.col("seg_id"))
    mesh_reason = F.when(other, F.when(F.col("seg_stale"), "predates annotations").otherwise("newer segmentation")).when(has_mesh & has_seg & F.col("seg_stale"), "from a stale segmentation")
    return rows.withColumn("mesh_reason", mesh_reason).select("job_id", "n_now", "model_id", "seg_id", "mesh_id", "seg_stale", F.array_join("seg_reasons", "; ").alias("seg_reasons"), F.col("mesh_reason").isNotNull().alias("mesh_stale"), "mesh_reason")


def trend(values: DataFrame, by: str, run: str, metric: str) -> DataFrame:
    """Runs from the oldest on: a dense index over all runs, rows without the metric dropped after that, y scaled to the
    group's range with a tenth of padding."""
    indexed = values.withColumn("index", (F.row_number().over(Window.partitionBy(by).orderBy(run)) - 1).cast("long")).filter(F.col(metric).isNotNull())
    group = Window.partitionBy(by)
    low, high = F.min(metric).over(group), F.max(metric).over(group)
    ranged = indexed.withColumns({"low": low, "high": high})
    pad = F.coalesce(F.nullif((F.col("high") - F.col("low")) * 0.1, F.lit(0.0)), F.nullif(F.abs("high") * 0.1, F.lit(0.0)), F.lit(1.0))
    ranged = ranged.withColumn("pad", pad)
    return ranged.withColumn("y", (F.col(metric) - F.col("low") + F.col("pad")) / (F.col("high") - F.col("low") + 2 * F.col("pad")))
