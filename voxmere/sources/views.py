"""Voxel, annotation, run and job tables derived from the given tables, and the same views as DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name: (Spark SQL or None where the DuckDB text serves both, DuckDB SQL, views that it reads)
VIEWS: dict[str, tuple[str | None, str, tuple[str, ...]]] = {
    "voxels": (
        "SELECT CAST(p % 8 AS BIGINT) AS x, CAST(p div 8 AS BIGINT) AS y, vec_id AS z, CAST(floor((CAST(e AS DOUBLE) + 1.0D) * 32767.0D) AS BIGINT) AS v, label FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, e",
        "SELECT x, y, z, v, label FROM (SELECT vec_id AS z, label, CAST(p % 8 AS BIGINT) AS x, CAST(p // 8 AS BIGINT) AS y, CAST(floor((CAST(e AS DOUBLE) + 1.0) * 32767.0) AS BIGINT) AS v FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS p, unnest(embedding) AS e FROM embeddings))",
        (),
    ),
    "seg_labels": (None, "SELECT x, y, z, CAST(1 + label % 3 AS BIGINT) AS lab FROM voxels WHERE v > 36043", ("voxels",)),
    "truth": (None, "SELECT x, y, z, CAST(255 AS BIGINT) AS lab FROM voxels WHERE v > 37000 OR (x + y + z) % 11 = 0", ("voxels",)),
    "samples": (None, "SELECT user_id AS job_id, event_id AS sample_id, ts AS sample_ts FROM events WHERE event_type = 'click'", ()),
    "models": (None, "SELECT user_id AS job_id, event_id AS model_id, ts AS model_ts FROM events WHERE event_type = 'purchase'", ()),
    "segmentations": (
        None,
        "SELECT user_id AS job_id, seg_id, event_id AS run_id FROM (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts) AS seg_id FROM events) q WHERE event_type = 'view' AND seg_id IS NOT NULL",
        (),
    ),
    "meshes": (
        None,
        "SELECT user_id AS job_id, mesh_id, event_id AS run_id FROM (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts) AS mesh_id FROM events) q WHERE event_type = 'signup' AND mesh_id IS NOT NULL",
        (),
    ),
    "jobs": (
        None,
        "SELECT o_orderkey AS id, o_orderdate AS created_at, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'uploaded' WHEN '2' THEN 'training_queued' WHEN '3' THEN 'segmented' WHEN '4' THEN 'meshing_queued' ELSE 'JobStatus.MESHED' END AS status, CAST(o_custkey % 100 AS DOUBLE) / 100 AS progress, o_custkey % 512 + 1 AS nx, o_custkey % 256 + 1 AS ny, o_orderkey % 128 + 1 AS nz FROM orders",
        (),
    ),
    "dicom_headers": (
        None,
        "SELECT o_custkey AS job_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END AS series_uid, concat(l_orderkey, '_', l_partkey, '_', l_suppkey, '_', l_linenumber, '.dcm') AS name, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS image_position_z, CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS instance_number, 512 AS rows_, CASE WHEN l_partkey % 97 = 0 THEN 256 ELSE 512 END AS cols_, CASE WHEN l_suppkey % 89 = 0 THEN 4 ELSE 1 END AS n_frames FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        (),
    ),
    "source_files": (
        None,
        "SELECT page_id % 10 AS job_id, concat(CASE WHEN page_id % 7 = 0 THEN '__MACOSX/' WHEN page_id % 11 = 0 THEN '.cache/' WHEN page_id % 13 = 0 THEN 'a/../../' ELSE 'stack/' END, CASE WHEN page_id % 17 = 0 THEN '._' ELSE '' END, 'slice', page_id, '.png') AS path, page_id % 10 = 3 OR (page_id % 10 = 4 AND page_id % 20 = 4) AS is_dicom FROM pages",
        (),
    ),
    "upload_parts": (
        None,
        "SELECT conv_id AS file_id, turn AS part_index, text AS payload, count(*) OVER (PARTITION BY conv_id) AS total_parts, CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) + CASE WHEN conv_id % 9 = 0 THEN 1 ELSE 0 END AS total_size FROM conversations",
        (),
    ),
    "anno_images": (None, "SELECT doc_id AS sample_id, doc_id % 20 AS job_id FROM documents", ()),
    "anno_masks": (None, "SELECT doc_id AS sample_id, quality, toxic FROM labels", ()),
    "anno_meta": (None, "SELECT item_id AS sample_id, item_id % 11 AS annotated_local_z_index, item_id * 3 AS z_origin, 11 AS requested_z, item_id % 4 AS z_pad_before, 11 - item_id % 4 AS actual_z FROM benchmark", ()),
    # of three models one has recorded ids (of all samples, or without some), one a number, one nothing
    "records": (
        "SELECT m.job_id, m.model_id, CASE WHEN m.model_id % 3 = 0 THEN CASE WHEN m.model_id % 2 = 0 THEN s.whole ELSE s.some END END AS sample_ids, CASE WHEN m.model_id % 3 <> 2 THEN CASE WHEN m.model_id % 4 = 1 THEN s.n ELSE m.model_id % 9 END END AS annotation_count FROM models m LEFT JOIN (SELECT job_id, count(*) AS n, collect_list(sample_id) AS whole, collect_list(CASE WHEN sample_id % 7 <> 0 THEN sample_id END) AS some FROM samples GROUP BY job_id) s ON s.job_id = m.job_id",
        "SELECT m.job_id, m.model_id, CASE WHEN m.model_id % 3 = 0 THEN CASE WHEN m.model_id % 2 = 0 THEN s.whole ELSE s.some END END AS sample_ids, CASE WHEN m.model_id % 3 <> 2 THEN CASE WHEN m.model_id % 4 = 1 THEN s.n ELSE m.model_id % 9 END END AS annotation_count FROM models m LEFT JOIN (SELECT job_id, count(*) AS n, list(sample_id ORDER BY sample_id) AS whole, list(sample_id ORDER BY sample_id) FILTER (sample_id % 7 <> 0) AS some FROM samples GROUP BY job_id) s ON s.job_id = m.job_id",
        ("samples", "models"),
    ),
    "deep_json": (
        None,
        """SELECT event_id AS model_id, concat('{"metric_name":" Val Dice","metric_value":', event_id % 50, ',"LOSS":"', event_id % 30, ' %","final  loss":1,"rf_kwargs":{"loss":3},"note":"x","accuracy":true,"evaluation":{"name":"F1-Score","value":"0.5","best_metric_name":"IoU","best_metric_value":', event_id % 7, ',"iou":', event_id % 5, ',"scores":{"precision":', event_id % 11, ',"loss":7}},"val_metrics":{"loss":', event_id % 13, '}}') AS meta FROM events WHERE event_type = 'purchase'""",
        (),
    ),
    "model_json": (
        None,
        """SELECT event_id AS model_id, user_id AS job_id, concat('{"job_id":"', user_id, '","annotation_count":', event_id % 9, ',"rf_kwargs":{"n_estimators":50},"metrics":{"train_foreground_dice":', event_id % 100, ',"train_foreground_iou":"', event_id % 90, '%","note":"x","ok_score":true}}') AS meta FROM events WHERE event_type = 'purchase'""",
        (),
    ),
}
BASE = ("embeddings", "events", "orders", "lineitem", "pages", "conversations", "documents", "labels", "benchmark")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a DataFrame, read from the Parquet tables in sf_dir."""
    spark_sql, sql, needs = VIEWS[name]
    text = spark_sql or sql
    tables = {n: view(spark, sf_dir, n) for n in needs}
    tables |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f" {t}" in text}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    if name.endswith("_json"):
        columns = re.split(r", (?=user_id AS|concat\()", sql.removeprefix("SELECT ").split(" FROM events")[0])
        return tables["events"].filter("event_type = 'purchase'").selectExpr(*columns)
    return spark.sql(text, **tables)


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL: body with the named views, and those they read, as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in VIEWS[name][2]:
            need(n)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    head = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if not head:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
