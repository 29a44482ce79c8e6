"""The pluggable volume source and sink, transforms of arrays, quantiles of floats, progress, records and frames."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from voxmere.operators import annotations, headers, intensity
from voxmere.operators.quantiles import exact_quantiles
from voxmere.sources import blocks, plugin
from voxmere.sources.paths import scratch
from voxmere.streaming import intake, landing, progress


@pytest.fixture(scope="module")
def voxels(spark):
    return spark.range(40 * 6).select((F.col("id") % 3).alias("x"), (F.col("id") % 2).alias("y"), F.expr("id DIV 6").alias("z"), (F.col("id") * 7 % 65536).alias("v"))


@pytest.fixture(scope="module")
def stored(spark, voxels):
    return plugin.write_volume(voxels.repartition(5), scratch(spark), "uint16", parts=5)


def test_volume_round_trip(spark, voxels, stored):
    back = plugin.open_volume(spark, stored)
    assert dict(back.dtypes)["v"] == "int" and plugin.shape(stored) == (3, 2, 40)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, voxels.collect()))
    assert sorted(r["x"] for r in back.select("x").filter("z = 3").collect()) == [0, 0, 1, 1, 2, 2]
    assert back.filter("z in (4, 9) and v > 0").count() == 12 and back.filter("z > 100").count() == 0
    empty = plugin.write_volume(voxels.filter("z < 0"), scratch(spark))
    assert plugin.shape(empty) == (0, 0, 0) and plugin.open_volume(spark, empty).count() == 0


def test_filters_open_only_their_parts(spark, stored):
    everything = plugin.SliceReader(stored).partitions()
    reader = plugin.SliceReader(stored)
    left = list(reader.pushFilters([GreaterThanOrEqual(("z",), 10), LessThan(("z",), 12), EqualTo(("x",), 1), In(("z",), (11, 30))]))
    assert len(everything) > 2 and [type(f) for f in left] == [EqualTo, In] and (reader.lo, reader.hi) == (11, 12)
    assert len(reader.partitions()) < len(everything)
    plan = plugin.open_volume(spark, stored).filter("z = 3")
    assert plan.rdd.getNumPartitions() < len(everything) and plan.count() == 6


def test_a_failed_write_leaves_nothing(spark, voxels, stored):
    before = sorted(map(tuple, plugin.open_volume(spark, stored).collect()))
    files = {f.name for f in Path(stored.removeprefix("file:")).iterdir()}
    bad = voxels.withColumn("v", F.when(F.col("z") == 39, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        bad.selectExpr("x", "y", "z", "CAST(v AS int) AS v").repartition(4).write.format("voxel_slices").option("dtype", "uint16").mode("overwrite").save(stored)
    assert {f.name for f in Path(stored.removeprefix("file:")).iterdir() if not f.name.endswith(".crc")} == {f for f in files if not f.endswith(".crc")}
    assert sorted(map(tuple, plugin.open_volume(spark, stored).collect())) == before
    plugin.write_volume(voxels.filter("z < 2"), stored, "uint16")
    assert plugin.open_volume(spark, stored).count() == 12 and plugin.shape(stored) == (3, 2, 2)


def test_transform_of_bricks(spark):
    rows = [(k, x, 0, z, 10 * x + z) for k in (1, 2) for x in (0, 70) for z in (0, 3, 17)]
    packed = blocks.pack(spark.createDataFrame(rows, "volume_id int, x long, y long, z long, v long"))
    seen = blocks.unpack(blocks.transform_bricks(packed, lambda a: (a * 2 + (a.dtype == np.uint16)), "uint16"))
    assert sorted(map(tuple, seen.select("volume_id", "x", "y", "z", "v").collect())) == sorted((k, x, y, z, 2 * v + 1) for k, x, y, z, v in rows)
    with pytest.raises(Exception, match="a transform gave"):
        blocks.transform_bricks(packed, lambda a: a[:1], "int64").collect()
    assert blocks.transform_bricks(packed.filter("false"), lambda a: a, "int64").count() == 0


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    groups = {1: r.normal(size=700), 2: np.concatenate([r.integers(0, 3, 400), [1e308, -1e308, 5e-324]]), 3: np.array([2.5]), 4: np.full(50, -0.1), 5: r.random(301).astype("f4").astype(float), 6: np.array([])}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [(1, math.nan), (1, math.inf), (2, None), (6, None), (6, -math.inf)]
    shares = (0.0, 0.01, 0.5, 0.995, 1.0)
    found = {x["k"]: x for x in exact_quantiles(spark.createDataFrame(rows, "k int, v double").repartition(3), ["k"], "v", shares).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    for k, x in found.items():
        assert x["n"] == len(groups[k]) and x["low"] == groups[k].min() and x["high"] == groups[k].max()
        if k != 2:
            assert np.allclose(x["q"], np.percentile(groups[k], [100 * s for s in shares]), rtol=1e-12, atol=0)
    assert found[2]["q"][2] == np.median(groups[2])
    flat = spark.createDataFrame([(1, 0.0)] * 10 + [(1, 3.5)] * 3, "label int, v float")
    assert intensity.window_bounds(flat).first()["window_max"] == 3.5


def test_progress_in_any_order(spark):
    """Totals before, between and after their blocks; blocks told twice; a job without a total, and one of nothing."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", landing.STATE_STORE)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    done = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 5), (3, 1), (3, 2), (1, 6)], "job_id long, block_id long")
    totals = spark.createDataFrame([(1, 2), (2, 4), (4, 0)], "job_id long, total long")
    told = progress.job_progress(intake.follow(session, intake.land(done, 3, "block_id"), done.schema), intake.follow(session, intake.land(totals, 2, "job_id"), totals.schema))
    out = scratch(spark)
    intake.run_to_end(told, "update", lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/step={k}"))
    last = spark.read.parquet(out).groupBy("job_id").agg(F.max_by(F.struct("done", "total", "progress"), "batch").alias("p")).collect()
    assert {r["job_id"]: tuple(r["p"]) for r in last} == {1: (2, 2, 1.0), 2: (1, 4, 0.25), 3: (2, None, None), 4: (0, 0, 1.0)}


def test_samples_of_two_sizes_are_an_error(spark):
    rows = lambda *s: spark.createDataFrame([(k, x, y, 7) for k, n in s for x in range(n) for y in range(2)], "sample_id long, x long, y long, v long")
    mask = spark.createDataFrame([(k, 0, 0, 255) for k in (1, 2)], "sample_id long, x long, y long, lab long")
    good = annotations.sample_training_rows(rows((1, 3)), rows((1, 9), (2, 3), (3, 5)), mask)
    assert {(r["sample_id"], r["uses_raw"]) for r in good.collect()} == {(1, True), (2, False)} and good.agg(F.sum("label")).first()[0] == 510
    with pytest.raises(ValueError, match="1 has 3 x 2, 2 has 4 x 2"):
        annotations.sample_training_rows(rows((1, 3)), rows((2, 4)), mask)


def test_frames(spark):
    rows = [(1, 2, 1, 2, 1, [1, 2, 3, 4]), (2, 1, 2, 1, 3, [5, 0, 0, 6, 0, 0]), (3, 2, 1, 1, 3, [0] * 6), (4, 1, 2, 2, 1, [1]), (5, 1, 1, 1, 1, None)]
    voxels, rejected = headers.explode_frames(spark.createDataFrame(rows, "file_id int, n_frames int, rows_ int, cols_ int, n_channels int, pixels array<int>"))
    assert sorted(tuple(r) for r in voxels.collect()) == [(1, 0, 0, 0, 1), (1, 0, 1, 0, 2), (1, 1, 0, 0, 3), (1, 1, 1, 0, 4), (2, 0, 0, 0, 5), (2, 0, 0, 1, 6)]
    assert {tuple(r) for r in rejected.collect()} == {(3, "colour frames"), (4, "wrong size"), (5, "wrong size")}
