"""Queries on segmentation quality."""

from __future__ import annotations

from voxmere.operators import overlap as O
from voxmere.plans.registry import query
from voxmere.sources.views import view

ALIGNED = "al AS (SELECT coalesce(p.x, t.x) AS x, coalesce(p.y, t.y) AS y, coalesce(p.z, t.z) AS z, coalesce(p.lab, 0) AS p, coalesce(t.lab, 0) AS t FROM seg_labels p FULL JOIN truth t ON p.x = t.x AND p.y = t.y AND p.z = t.z)"
COUNTS = "count(*) FILTER (p <> 0 AND t <> 0) AS tp, count(*) FILTER (p <> 0 AND t = 0) AS fp, count(*) FILTER (p = 0 AND t <> 0) AS fn, count(*) FILTER (p = t) AS correct, count(*) AS total"
RATIOS = "CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS dice, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp + fn) END AS iou, CASE WHEN total = 0 THEN 1.0 ELSE CAST(correct AS DOUBLE) / total END AS accuracy, 1 - CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS loss"


def aligned(spark, d):
    return O.align(view(spark, d, "seg_labels"), view(spark, d, "truth"))


@query("pred_truth_align", "seg_labels", "truth", sql=f"WITH {ALIGNED} SELECT * FROM al")
def pred_truth_align(spark, d):
    return aligned(spark, d)


@query("foreground_confusion", "seg_labels", "truth", sql=f"WITH {ALIGNED}, c AS (SELECT z, {COUNTS} FROM al GROUP BY z) SELECT *, {RATIOS} FROM c")
def foreground_confusion(spark, d):
    return O.with_ratios(O.confusion(aligned(spark, d), "z"))


@query("training_metrics", "seg_labels", "truth", sql=f"WITH {ALIGNED}, c AS (SELECT {COUNTS} FROM al) SELECT *, {RATIOS} FROM c")
def training_metrics(spark, d):
    return O.micro(O.confusion(aligned(spark, d), "z"))
