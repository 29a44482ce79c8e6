"""Ids, metric names and metric values of model runs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sections that hold metrics, spellings of name and value, and what makes a key a metric.
METRIC_SECTIONS = ("metric", "metrics", "scores", "evaluation", "validation", "validation_metrics", "val_metrics", "results", "summary")
METRIC_PAIRS = (("best_metric_name", "best_metric_value"), ("metric_name", "metric_value"), ("score_name", "score_value"), ("name", "value"))
METRIC_WORDS = ("metric", "dice", "iou", "jaccard", "f1", "score", "accuracy", "precision", "recall", "loss")


def model_id(path: Column) -> Column:
    """Last part of a path without one of the known endings."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.(model|json|zarr)$", "")


def segmentation_id(path: Column) -> Column:
    return F.concat(model_id(path), F.lit(".zarr"))


def sort_key(run_id: Column) -> Column:
    """Numbers of any length before text, each in its own order."""
    digits = F.when(run_id.rlike("^[0-9]+$"), F.regexp_replace(run_id, "^0+", ""))
    return F.struct(digits.isNull().cast("int").alias("kind"), F.length(digits).alias("size"), digits.alias("digits"), run_id.alias("text"))


def metric_value(text: Column) -> Column:
    """A number, or text that is one but for white space and one percent sign at its end; true, false and infinite values
    give null."""
    plain = F.regexp_replace(F.regexp_replace(text, "^\\s+|\\s*%?\\s*$", ""), "\\s+$", "")
    number = F.when(plain.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    return F.when(number.isNotNull() & (F.abs(number) < F.lit(float("inf"))), number)


def metric_key(name: Column) -> Column:
    """Trimmed, in lower case, each space as one underscore; null if nothing is left."""
    return F.nullif(F.replace(F.lower(F.regexp_replace(name, "^\\s+|\\s+$", "")), F.lit(" "), F.lit("_")), F.lit(""))


def is_metric(name: Column) -> Column:
    return F.coalesce(metric_key(name).rlike("|".join(METRIC_WORDS)), F.lit(False))


def is_section(name: Column) -> Column:
    """Whether an object of this name is searched for metrics."""
    return F.coalesce(metric_key(name).isin(*METRIC_SECTIONS), F.lit(False)) | is_metric(name)


def sample_id(name: Column) -> Column:
    """Seconds in an image's name, null where it isn't a plain number."""
    stem = F.regexp_replace(F.regexp_replace(name, "\\.[^.]*$", ""), "^img", "")
    return F.when(stem.rlike("^[0-9]+$"), stem.try_cast("long"))
