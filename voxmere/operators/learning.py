"""Pixel features, forests and their predictions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmere.operators.halo import over_bricks
from voxmere.operators.region import volume
from voxmere.sources.paths import scratch

SIGMAS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
#: wide, as its rim is: what is shuffled for the default reach is twice the volume
BRICK = (512, 512, 1)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian with mirrored edges."""
    radius = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        wide = np.pad(image, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        image = np.apply_along_axis(np.convolve, axis, wide, kernel, "valid")
    return image


def multiscale(image: np.ndarray, sigmas: tuple[float, ...] = SIGMAS) -> np.ndarray:
    """(x, y, channels): for each sigma the smoothed image, its gradient size and the two eigenvalues of its Hessian."""
    out = []
    for sigma in sigmas:
        smooth = gaussian(image.astype(float), sigma)
        gx, gy = np.gradient(smooth)
        xx, xy = np.gradient(gx)
        yy = np.gradient(gy)[1]
        mean, root = (xx + yy) / 2, np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
        out += [smooth, np.hypot(gx, gy), mean + root, mean - root]
    return np.stack(out, axis=-1)


def reach_of(sigmas: tuple[float, ...] = SIGMAS) -> int:
    """How far a pixel of multiscale looks: the widest kernel, and two differences of neighbours."""
    return max(int(3 * sigma + 0.5) for sigma in sigmas) + 2


def features(voxels: DataFrame, function: Callable[[np.ndarray], np.ndarray] = multiscale, *by: str, reach: int | None = None, brick: tuple[int, int, int] = BRICK) -> DataFrame:
    """voxels with array column `features`, computed in each slice (of each key in `by`, if given).

    A function that looks no further than `reach` pixels works on bricks with a rim, so slices may have any size; the default
    does. Without a reach a function sees the whole slice, and one task holds one slice.
    """
    reach = reach_of() if reach is None and function is multiscale else reach
    if reach is not None and not by:
        return over_bricks(voxels, reach, lambda image: {"features": function(image).astype(float)}, "features array<double>", brick)
    keys = by or (*volume(voxels), "z")
    schema = T.StructType([*voxels.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(table: pa.Table) -> pa.Table:
        x, y, v = (table.column(c).to_numpy() for c in ("x", "y", "v"))
        x, y = x - x.min(), y - y.min()
        image = np.zeros((x.max() + 1, y.max() + 1))
        image[x, y] = v
        found = np.asarray(function(image)[x, y], float)
        offsets = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
        return table.append_column("features", pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1))))

    return voxels.groupBy(*keys).applyInArrow(run, schema)


def channels(function: Callable[[np.ndarray], np.ndarray]) -> int:
    """How many numbers a feature function gives for each pixel."""
    return function(np.zeros((4, 4))).shape[-1]


def _vector(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("*", *(F.col("features")[k].alias(name) for k, name in enumerate(names)))


def fit_forest(rows: DataFrame, width: int, trees: int = 50, depth: int = 12, seed: int = 0) -> PipelineModel:
    """A forest over `features`, arrays of the given width, that predicts raw labels, as one pipeline."""
    names = [f"f{k}" for k in range(width)]
    wide = _vector(rows.withColumn("label_text", F.col("label").cast("string")), names)
    indexer = StringIndexer(inputCol="label_text", outputCol="label_index", handleInvalid="keep")
    labels = indexer.fit(wide)
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label_index", numTrees=trees, maxDepth=depth, seed=seed)
    back = IndexToString(inputCol="prediction", outputCol="predicted_text", labels=labels.labels)
    return Pipeline(stages=[labels, VectorAssembler(inputCols=names, outputCol="vector"), forest, back]).fit(wide)


def predict(model: Transformer, rows: DataFrame) -> DataFrame:
    """rows with column lab, the predicted raw label."""
    names = model.stages[1].getInputCols()
    wide = _vector(rows.withColumn("label_text", F.lit("0")) if "label_text" not in rows.columns else rows, names)
    return model.transform(wide).withColumn("lab", F.col("predicted_text").cast("long")).drop(*names, "vector", "label_text", "label_index", "rawPrediction", "probability", "prediction", "predicted_text")


class ForestSegmenter:
    """fit, segment, save and load; any object with these methods can take its place."""

    def __init__(self, model: PipelineModel | None = None, function: Callable[[np.ndarray], np.ndarray] = multiscale, every: int = 500):
        self.model, self.function, self.every = model, function, every

    def fit(self, rows: DataFrame, **forest) -> ForestSegmenter:
        from voxmere.operators.annotations import subsample_negatives

        path = scratch(rows.sparkSession)  # every round of the forest reads the features again
        subsample_negatives(features(rows, self.function), self.every).write.parquet(path)
        self.model = fit_forest(rows.sparkSession.read.parquet(path), channels(self.function), **forest)
        return self

    def segment(self, voxels: DataFrame) -> DataFrame:
        """Sparse labels: voxels predicted as background are left out."""
        return predict(self.model, features(voxels, self.function)).filter("lab <> 0").select(*volume(voxels), "x", "y", "z", "lab")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, **options) -> ForestSegmenter:
        return cls(PipelineModel.load(path), **options)
