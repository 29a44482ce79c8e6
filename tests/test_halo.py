"""Neighbourhoods over bricks equal those over whole slices; models stored for tasks equal pyspark.ml's."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from voxmere.operators import annotations, halo, learning, model_store
from voxmere.operators.centres import NearestCentre, NearestCentreModel
from voxmere.sources.paths import scratch


@pytest.fixture(scope="module")
def scattered(spark):
    """Two volumes with gaps and negative places, cut by many bricks."""
    r = np.random.default_rng(2)
    rows = [(k, int(x) - 5, int(y), int(z), int(r.integers(0, 1000))) for k in (1, 2) for (x, y, z) in np.ndindex(23, 17, 2) if r.random() < 0.8]
    return spark.createDataFrame(rows, "volume_id int, x long, y long, z long, v long").repartition(3)


def collected(df, value):
    return {(r["volume_id"], r["x"], r["y"], r["z"]): r[value] for r in df.collect()}


@pytest.mark.parametrize("brick", [(4, 5, 1), (7, 3, 2), (64, 64, 16)])
def test_features_of_bricks_equal_those_of_slices(scattered, brick):
    shape = lambda image: learning.multiscale(image, (1.0, 2.0))
    whole = collected(learning.features(scattered, shape), "features")
    found = collected(learning.features(scattered, shape, reach=learning.reach_of((1.0, 2.0)), brick=brick), "features")
    assert whole.keys() == found.keys() and all(np.allclose(whole[k], found[k], rtol=1e-9, atol=1e-6) for k in whole)


def test_stencil_of_bricks(scattered, monkeypatch):
    image = {(r["volume_id"], r["x"], r["y"], r["z"]): r["v"] for r in scattered.collect()}
    want = {k: sum(image.get((k[0], k[1] + i, k[2] + j, k[3]), 0) * (2 - abs(i)) * (2 - abs(j)) for i in (-1, 0, 1) for j in (-1, 0, 1)) for k in image}
    monkeypatch.setattr(halo, "BRICK", (4, 4, 1))
    assert collected(annotations.stencil(scattered), "smooth") == want
    sums = lambda image: {"smooth": np.pad(image, 1)[:-2, 1:-1] + np.pad(image, 1)[2:, 1:-1]}
    found = collected(halo.over_bricks(scattered, 1, sums, "smooth long", (3, 2, 1), clipped=False), "smooth")
    assert found == {k: image.get((k[0], k[1] - 1, *k[2:]), 0) + image.get((k[0], k[1] + 1, *k[2:]), 0) for k in image}


def test_only_rims_are_dealt_twice(scattered):
    n, rows = scattered.count(), halo.rimmed(scattered, 1, (8, 8, 4))
    assert rows.filter("row is not null").count() == n
    assert n < rows.count() <= n * (1 + 2 / 8) ** 2 * 1.05
    assert halo.over_bricks(scattered.filter("false"), 2, lambda image: {"a": image}, "a long").count() == 0


@pytest.fixture(scope="module")
def pixels(spark):
    r = np.random.default_rng(4)
    rows = [(i, i % 5, int(label), [float(r.normal(label / 50, 1)), float(r.normal(-label / 90, 2)), float(r.random())]) for i in range(900) for label in [(0, 100, 255)[i % 3]]]
    return spark.createDataFrame(rows, "id long, job_id long, label long, features array<double>")


def test_nearest_centre_in_a_pipeline(spark, pixels):
    model = Pipeline(stages=[NearestCentre(predictionCol="found")]).fit(pixels)
    path = scratch(spark)
    model.save(path)
    again = PipelineModel.load(path)
    assert isinstance(again.stages[0], NearestCentreModel)
    rows = pixels.collect()
    centres = {c: np.mean([r["features"] for r in rows if r["label"] == c], axis=0) for c in (0, 100, 255)}
    want = {r["id"]: min(centres, key=lambda c: (((np.array(r["features"]) - centres[c]) ** 2).sum(), c)) for r in rows}
    assert {r["id"]: r["found"] for r in again.transform(pixels).collect()} == want
    estimator = scratch(spark)
    NearestCentre(labelCol="y").save(estimator)
    assert NearestCentre.load(estimator).getOrDefault("labelCol") == "y"
    with pytest.raises(ValueError):
        NearestCentre().fit(pixels.filter("false"))


def test_newest_models_predict(spark, pixels, monkeypatch):
    """Job 0 by a forest that replaced centres, 1 and 2 by centres, 3 and 4 have no model; a model may need several tasks."""
    monkeypatch.setattr(model_store, "ROWS_A_TASK", 50)
    forest = learning.fit_forest(pixels, 3, trees=7, depth=5, seed=3)
    some, other = NearestCentre().fit(pixels), NearestCentre().fit(pixels.filter("id < 200"))
    rows = [(0, 9, model_store.save_centres(some, scratch(spark))), (0, 10, model_store.save_forest(forest, scratch(spark))), (1, 3, model_store.save_centres(some, scratch(spark))), (2, 5, model_store.save_centres(other, scratch(spark))), (7, 1, "file:/nowhere")]
    models = spark.createDataFrame(rows, "job_id long, model_id long, path string")
    found = {r["id"]: (r["model_id"], r["lab"]) for r in model_store.predict_newest(pixels.repartition(3), models).collect()}
    by = {0: learning.predict(forest, pixels), 1: some.transform(pixels), 2: other.transform(pixels)}
    want = {r["id"]: ({0: 10, 1: 3, 2: 5}[job], r["lab"]) for job, df in by.items() for r in df.filter(F.col("job_id") == job).collect()}
    want |= {r["id"]: (None, None) for r in pixels.filter("job_id > 2").collect()}
    assert found == want
    assert model_store.predict_newest(pixels, models.filter("false")).filter("lab is not null").count() == 0
