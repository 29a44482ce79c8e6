"""Runs and their records: sets told apart by digests, lists as differences, metrics at any depth."""

import json
import random

from voxmere.operators import runs as R


def test_digests_tell_multisets_apart(spark):
    """Order doesn't matter, repeats do; ids that don't fit in a list of another type count as they are."""
    samples = spark.createDataFrame([(1, k, 0) for k in (5, 7, 7)] + [(2, 9, 0)], "job_id long, sample_id long, sample_ts long")
    models = spark.createDataFrame([(1, k, 1) for k in range(1, 8)] + [(2, 20, 1), (3, 30, 1)], "job_id long, model_id long, model_ts long")
    lists = {1: [7, 5, 7], 2: [5, 7], 3: [5, 5, 7], 4: [7, 7, 5, None], 5: [], 6: None, 7: [5, 7, 8]}
    rows = [(1, k, ids, None) for k, ids in lists.items()] + [(2, 20, [9], 4), (3, 30, [1], None)]
    records = spark.createDataFrame(rows, "job_id long, model_id long, sample_ids array<int>, annotation_count long")
    found = {r["model_id"]: r["matches"] for r in R.set_matches(samples, models, records).collect()}
    assert found == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: False, 20: True, 30: False}


def test_each_sample_stands_with_the_first_model_that_saw_it(spark):
    r = random.Random(4)
    samples = [(r.randrange(4), k, r.randrange(30)) for k in range(200)]
    models = [(r.randrange(5), 1000 + k, r.randrange(30)) for k in range(25)]
    found = {s["sample_id"]: s["model_id"] for s in R.new_samples(spark.createDataFrame(samples, "job_id long, sample_id long, sample_ts long"), spark.createDataFrame(models, "job_id long, model_id long, model_ts long")).collect()}
    want = {s: min(((t, m) for j, m, t in models if j == job and t >= ts), default=(None, None))[1] for job, s, ts in samples}
    assert found == want


def test_metrics_forty_levels_deep(spark):
    def deep(levels, leaf):
        return leaf if not levels else {"scores": deep(levels - 1, leaf), "loss": levels}

    bodies = {1: deep(40, {"dice": 0.5, "loss": 99}), 2: {"dice": 1}, 3: deep(7, {"iou": "50 %"}), 4: {"a": {"dice": 3}}, 5: deep(6, {"f1": 2}), 6: deep(5, {"f1": 2})}
    rows = [(k, json.dumps(b)) for k, b in bodies.items()] + [(7, None), (8, "broken"), (9, "[1]"), (10, "")]
    found = {(r["id"], r["key"]): r["value"] for r in R.nested_metrics(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()}
    assert found == {(1, "dice"): 0.5, (1, "loss"): 99.0, (2, "dice"): 1.0, (3, "iou"): 50.0, (3, "loss"): 1.0, (5, "f1"): 2.0, (5, "loss"): 1.0, (6, "f1"): 2.0, (6, "loss"): 1.0}
    assert R.nested_metrics(spark.createDataFrame([], "id long, body string"), "id", "body").count() == 0


def test_training_records(spark):
    samples = spark.createDataFrame([(1, 10, 1, True), (1, 11, 3, False), (1, 12, 9, True)], "job_id long, sample_id long, sample_ts long, uses_raw boolean")
    models = spark.createDataFrame([(1, 100, 2), (1, 101, 3), (1, 102, 4), (2, 200, 5)], "job_id long, model_id long, model_ts long")
    sidecars = spark.createDataFrame([(100, '{"rf_kwargs": {"n_estimators": 7}, "metrics": {"dice": 0.25}}'), (101, "x")], "model_id long, meta string")
    found = {r["model_id"]: r for r in R.training_records(samples, models, sidecars).collect()}
    assert {k: (r["annotation_count"], r["metadata_backed_sample_count"], [s["sample_id"] for s in r["new_samples"]]) for k, r in found.items()} == {100: (1, 1, [10]), 101: (2, 1, [11]), 102: (2, 1, []), 200: (0, 0, [])}
    assert found[100]["parameters"] == {"n_estimators": "7"} and found[100]["metrics"] == {"dice": 0.25} and found[101]["metrics"] is None
    assert found[100]["new_samples"][0]["metadata_filename"] == "meta10.json" and found[101]["new_samples"][0]["metadata_filename"] is None
