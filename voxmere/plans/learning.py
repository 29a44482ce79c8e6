"""Queries on features, training and prediction."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from voxmere.operators import annotations as A
from voxmere.operators import learning as L
from voxmere.operators import model_store as M
from voxmere.operators import overlap as O
from voxmere.operators.centres import NearestCentre
from voxmere.plans.annotations import GLOBAL
from voxmere.plans.registry import query
from voxmere.sources.paths import scratch
from voxmere.sources.views import view


def training(spark, d):
    return A.training_rows(view(spark, d, "voxels"), view(spark, d, "truth"))


def segmenter(spark, d):
    """The default forest (50 trees, depth 12, six octaves, every 500th negative) on all slices."""
    return L.ForestSegmenter().fit(training(spark, d), seed=7)


@query("multiscale_features")
def multiscale_features(spark, d):
    rows = L.features(view(spark, d, "voxels").select("x", "y", "z", "v"))
    return rows.select("x", "y", "z", F.transform("features", lambda f: F.round(f, 6)).alias("features"))


@query("custom_features", "voxels", sql="SELECT x, y, z, v, CAST(v * 2 AS DOUBLE) AS twice, CAST(v - avg(v) OVER (PARTITION BY z) AS DOUBLE) > 0 AS above FROM voxels")
def custom_features(spark, d):
    plug_in = lambda image: np.stack([image * 2, image - image.mean()], axis=-1)
    rows = L.features(view(spark, d, "voxels").select("x", "y", "z", "v"), plug_in)
    return rows.select("x", "y", "z", "v", F.col("features")[0].alias("twice"), (F.col("features")[1] > 0).alias("above"))


@query("forest_fit")
def forest_fit(spark, d):
    """What the forest weighs: one row for each feature."""
    model = segmenter(spark, d).model.stages[2]
    rows = [(k, float(w)) for k, w in enumerate(model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature long, importance double")


@query("segment_volume")
def segment_volume(spark, d):
    return segmenter(spark, d).segment(view(spark, d, "voxels").select("x", "y", "z", "v"))


@query("evaluate_model")
def evaluate_model(spark, d):
    rows = training(spark, d)
    truth = rows.filter("label <> 0").select("x", "y", "z", F.col("label").alias("lab"))
    return O.micro(O.confusion(O.align(segmenter(spark, d).segment(rows.select("x", "y", "z", "v")), truth), "z"))


@query("model_save_load")
def model_save_load(spark, d):
    """Segmentation by a model that was written and read back."""
    path = scratch(spark)
    segmenter(spark, d).save(path)
    again = L.ForestSegmenter.load(path)
    return again.segment(view(spark, d, "voxels").select("x", "y", "z", "v"))


@query("threshold_plugin", "voxels", sql="SELECT x, y, z, CAST(255 AS BIGINT) AS lab FROM voxels WHERE v > 36500")
def threshold_plugin(spark, d):
    class Threshold:
        def fit(self, rows):
            return self

        def segment(self, voxels):
            return voxels.filter("v > 36500").select("x", "y", "z", F.lit(255).cast("long").alias("lab"))

    return Threshold().fit(None).segment(view(spark, d, "voxels"))


def smoothed(spark, d):
    """Training rows with two features, the value and its 3 x 3 sum."""
    return A.stencil(training(spark, d)).select("x", "y", "z", "label", F.array(F.col("v").cast("double"), F.col("smooth").cast("double")).alias("features"))


SMOOTHED = """o AS (SELECT unnest([-1, 0, 1]) AS d), sm AS (SELECT c.x, c.y, c.z, CAST(any_value(c.v) AS DOUBLE) AS a, CAST(sum(n.v * (2 - abs(p.d)) * (2 - abs(q.d))) AS DOUBLE) AS b
    FROM voxels c CROSS JOIN o p CROSS JOIN o q JOIN voxels n ON n.z = c.z AND n.x = c.x + p.d AND n.y = c.y + q.d GROUP BY c.x, c.y, c.z),
    fe AS (SELECT s.*, coalesce(lab, 0) AS label FROM sm s LEFT JOIN truth t ON t.x = s.x AND t.y = s.y AND t.z = s.z)"""
NEAREST = "arg_min(ce.label, ((a - ma) * (a - ma) + (b - mb) * (b - mb), ce.label)) AS lab"


@query("segmenter_plugin", "voxels", "truth", sql=f"WITH {SMOOTHED}, ce AS (SELECT label, avg(a) AS ma, avg(b) AS mb FROM fe WHERE z % 2 = 0 GROUP BY label) SELECT x, y, z, {NEAREST} FROM fe, ce GROUP BY x, y, z, a, b")
def segmenter_plugin(spark, d):
    """Another method in the forest's place: nearest class centres, fitted on every other slice as a stage of a Pipeline, saved, loaded."""
    rows, path = smoothed(spark, d), scratch(spark)
    Pipeline(stages=[NearestCentre()]).fit(rows.filter("z % 2 = 0")).save(path)
    return PipelineModel.load(path).transform(rows).select("x", "y", "z", "lab")


JOB_OF = "sample_id % 4"


def annotated(spark, d):
    """(sample_id, job_id, z) of the annotated slices; samples are dealt to four jobs."""
    return A.global_z(view(spark, d, "anno_meta")).filter("global_z is not null").select("sample_id", F.expr(JOB_OF).alias("job_id"), F.col("global_z").alias("z"))


def centre_model(spark, rows):
    return M.save_centres(NearestCentre().fit(rows), scratch(spark))


@query("predict_samples")
def predict_samples(spark, d):
    """Predicted pixels of the annotated slices by the newest model of each job: the default forest for job 0 (it has an older model,
    too), centres for job 1, null for jobs without a model."""
    truth = training(spark, d)
    shape = lambda rows, **o: L.features(rows, L.multiscale, **o)
    forest = M.save_forest(segmenter(spark, d).model, scratch(spark))
    centres = centre_model(spark, shape(truth.filter("z % 2 = 0")))
    models = spark.createDataFrame([(0, 100, centres), (0, 200, forest), (1, 150, centres)], "job_id long, model_id long, path string")
    slices = annotated(spark, d).join(view(spark, d, "voxels").select("x", "y", "z", "v"), "z").withColumnRenamed("sample_id", "volume_id")
    found = M.predict_newest(shape(slices), models)
    return found.select(F.col("volume_id").alias("sample_id"), "job_id", "model_id", "x", "y", "lab")


@query(
    "predict_samples_by_centres", "voxels", "truth", "anno_meta",
    sql=f"""WITH {SMOOTHED}, md(job_id, model_id, part) AS (VALUES (0, 100, 0), (0, 200, 1), (1, 150, 0), (2, 90, 2)), nm AS (SELECT job_id, arg_max(part, model_id) AS part, max(model_id) AS model_id FROM md GROUP BY job_id),
    ce AS (SELECT part, label, avg(a) AS ma, avg(b) AS mb FROM fe JOIN (SELECT DISTINCT part FROM md) ON part = z % 3 GROUP BY part, label),
    {GLOBAL}, sa AS (SELECT sample_id, {JOB_OF} AS job_id, global_z AS z FROM gg WHERE global_z IS NOT NULL)
    SELECT sample_id, sa.job_id, CAST(any_value(model_id) AS BIGINT) AS model_id, x, y, {NEAREST} FROM sa JOIN fe ON fe.z = sa.z LEFT JOIN nm ON nm.job_id = sa.job_id LEFT JOIN ce ON ce.part = nm.part GROUP BY sample_id, sa.job_id, x, y, a, b""",
)
def predict_samples_by_centres(spark, d):
    """As predict_samples with centres alone: job 0 has two models, 1 and 2 have one each, 3 has none."""
    path = scratch(spark)
    smoothed(spark, d).write.parquet(path)
    rows = spark.read.parquet(path)
    parts = [centre_model(spark, rows.filter(F.col("z") % 3 == k)) for k in range(3)]
    models = spark.createDataFrame([(0, 100, parts[0]), (0, 200, parts[1]), (1, 150, parts[0]), (2, 90, parts[2])], "job_id long, model_id long, path string")
    return M.predict_newest(annotated(spark, d).join(rows.drop("label"), "z"), models).select("sample_id", "job_id", "model_id", "x", "y", "lab")


@query("source_plugin", "voxels", sql="SELECT x, y, z, v FROM voxels")
def source_plugin(spark, d):
    """Voxels through a sink and a source of our own: written as 16-bit values by ranges of z, and read again."""
    from voxmere.sources.plugin import open_volume, write_volume

    rows = open_volume(spark, write_volume(view(spark, d, "voxels"), scratch(spark), "uint16"))
    return rows.select("x", "y", "z", F.col("v").cast("long").alias("v"))


@query("source_plugin_region", "voxels", sql="SELECT x, y, z, v FROM voxels WHERE z >= 20 AND z < 60 AND x <> 3")
def source_plugin_region(spark, d):
    """A region of such a volume: the bounds on z are pushed into the source."""
    from voxmere.sources.plugin import open_volume, write_volume

    rows = open_volume(spark, write_volume(view(spark, d, "voxels"), scratch(spark), "float64"))
    return rows.filter("z >= 20 AND z < 60 AND x <> 3").select("x", "y", "z", F.col("v").cast("long").alias("v"))
