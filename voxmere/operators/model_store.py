"""A store of trained models that tasks read by themselves, and predictions by each job's newest model.

A model is one small Parquet folder: the nodes of a forest's trees, or the centres of a nearest-centre model. So samples of
many jobs are predicted by many models in one pass, where a pyspark.ml model must be the same for all rows of a plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmere.operators.centres import NearestCentreModel
from voxmere.sources.paths import opened, qualified, scratch

#: Pixels that one task predicts by one model before another task takes part.
ROWS_A_TASK = 1 << 21


def save_forest(model: PipelineModel, path: str) -> str:
    """The nodes of a forest that learning.fit_forest gave, (tree, id, left, right, feature, cut, votes, labels); returns the path as
    tasks open it."""
    spark, whole = SparkSession.getActiveSession(), scratch(SparkSession.getActiveSession())
    model.stages[2].write().save(whole)
    labels = F.array(*(F.lit(int(text)).cast("long") for text in model.stages[0].labels))
    node = F.col("nodeData")
    total = F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, b: a + b)
    votes = F.transform(node["impurityStats"], lambda n: F.when(total > 0, n / total).otherwise(0.0))
    rows = spark.read.parquet(f"{whole}/data").select(F.col("treeID").cast("long").alias("tree"), node["id"].cast("long").alias("id"), node["leftChild"].cast("long").alias("left"), node["rightChild"].cast("long").alias("right"), node["split"]["featureIndex"].cast("long").alias("feature"), F.coalesce(F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("cut"), votes.alias("votes"), labels.alias("labels"))
    rows.coalesce(1).write.mode("overwrite").parquet(path)  # trees times two to the depth rows
    return qualified(spark, path)


def save_centres(model: NearestCentreModel, path: str) -> str:
    """A row (label, centre) for each label; returns the path as tasks open it."""
    rows = list(zip(model.getOrDefault(model.labels), model.getOrDefault(model.centres), strict=True))
    spark = SparkSession.getActiveSession()
    spark.createDataFrame(rows, "label long, centre array<double>").coalesce(1).write.mode("overwrite").parquet(path)
    return qualified(spark, path)


def _forest(table: pa.Table):
    tree, left, right, feature, cut = (table.column(c).to_numpy() for c in ("tree", "left", "right", "feature", "cut"))
    order = np.lexsort((table.column("id").to_numpy(), tree))
    tree, left, right, feature, cut = tree[order], left[order], right[order], feature[order], cut[order]
    votes = np.array(table.column("votes").to_pylist())[order]
    labels = np.array(table.column("labels")[0].as_py())
    roots = np.flatnonzero(np.diff(tree, prepend=-1))

    def predict(x: np.ndarray) -> np.ndarray:
        sums, each = np.zeros((len(x), votes.shape[1])), np.arange(len(x))
        for root in roots:  # ids of a tree count from 0 at its root
            at = np.full(len(x), root)
            while len(going := np.flatnonzero(left[at] >= 0)):
                node = at[going]
                at[going] = root + np.where(x[each[going], feature[node]] <= cut[node], left[node], right[node])
            sums += votes[at]
        return labels[np.minimum(sums.argmax(axis=1), len(labels) - 1)]

    return predict


def _centres(table: pa.Table):
    label, centre = table.column("label").to_numpy(), np.array(table.column("centre").to_pylist())
    order = np.argsort(label)

    def predict(x: np.ndarray) -> np.ndarray:
        far = [sum((x[:, k] - c[k]) * (x[:, k] - c[k]) for k in range(x.shape[1])) for c in centre[order]]
        return label[order][np.argmin(np.stack(far), axis=0)]

    return predict


def load(path: str):
    """The function (pixels x features) -> raw labels of a stored model, in a task."""
    import pyarrow.parquet as pq

    system, place = opened(path)
    table = pq.read_table(place, filesystem=system)
    return _forest(table) if "tree" in table.column_names else _centres(table)


def newest_model(models: DataFrame) -> DataFrame:
    """(job_id, model_id, path): the newest of each job's models (job_id, model_id, path), by number."""
    last = models.groupBy("job_id").agg(F.max_by(F.struct("model_id", "path"), "model_id").alias("m"))
    return last.select("job_id", "m.model_id", "m.path")


def predict_newest(rows: DataFrame, models: DataFrame, features: str = "features") -> DataFrame:
    """rows (with job_id and an array of features) with model_id and lab by their job's newest model; null where a job has none.

    Rows are dealt by model, so that a task reads a model once; a model with many rows is given as many tasks as its rows
    need. The number of rows of each model is counted first. Paths are those that save_forest and save_centres return.
    """
    known = newest_model(models)
    counts = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    tasks = known.join(counts, "job_id").select("job_id", "model_id", "path", F.ceil(F.col("n") / ROWS_A_TASK).alias("tasks"))
    place = F.xxhash64(*(c for c in rows.columns if c != features))
    matched = rows.join(tasks, "job_id", "left").withColumn("salt", F.pmod(place, F.coalesce("tasks", F.lit(1))))
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("model_id", tasks.schema["model_id"].dataType), T.StructField("lab", T.LongType())])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model = None, None
        for batch in batches:
            paths = batch.column("path")
            codes = paths.dictionary_encode(null_encoding="encode")
            cuts = np.flatnonzero(np.diff(codes.indices.to_numpy(zero_copy_only=False), prepend=-1)) if batch.num_rows else []
            for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                path = part.column("path")[0].as_py()
                if path is None:
                    lab = pa.nulls(hi - lo, pa.int64())
                else:
                    if path != now:
                        now, model = path, load(path)
                    values = part.column(features)
                    x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
                    lab = pa.array(model(x), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), part.column("model_id"), lab], schema.names)

    dealt = matched.repartition("path", "salt").sortWithinPartitions("path")
    return dealt.select(*kept, "model_id", "path").mapInArrow(predicted, schema)
