"""Operators on hand-made volumes, with the edge rules of each."""

import io
import math
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxmere.functions import pixels, runs
from voxmere.operators import annotations, headers, intensity, jobs, learning, overlap, region, surfaces
from voxmere.sources import archives, blocks, images, paths


def volume(spark, array):
    rows = [(int(x), int(y), int(z), int(v)) for (x, y, z), v in np.ndenumerate(array)]
    return spark.createDataFrame(rows, "x long, y long, z long, v long")


def dense(df, shape, value="v"):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = r[value]
    return out


@pytest.fixture(scope="module")
def v345():
    x, y, z = np.indices((3, 4, 5))
    return x + 10 * y + 100 * z


def test_region_stride_max_equal_numpy(spark, v345):
    df = volume(spark, v345)
    assert (dense(region.region(df, x=(1, 3), z=(2, 4)), (3, 4, 5))[1:3, :, 2:4] == v345[1:3, :, 2:4]).all()
    assert region.region(df, x=(2, 2)).count() == 0
    assert (dense(region.region(df, x=(1, 0), y=2, z=(None, 3)), (3, 4, 5))[1:, 2, :3] == v345[1:, 2, :3]).all()
    assert region.region(df, x=(1, 0), y=2, z=(None, 3)).count() == 2 * 1 * 3
    assert (dense(region.stride(df, (2, 3, 2)), (2, 2, 3)) == v345[::2, ::3, ::2]).all()
    padded = np.pad(v345, [(0, 1), (0, 0), (0, 1)])
    assert (dense(region.block_max(df, 2), (2, 2, 3)) == padded.reshape(2, 2, 2, 2, 3, 2).max(axis=(1, 3, 5))).all()
    below = df.withColumn("v", -F.col("v"))
    assert {r["v"] for r in region.block_max(below, 2).collect()} == {0}


def test_block_grid_covers_once(spark):
    shapes = spark.createDataFrame([(1, 3, 4, 5), (2, 0, 1, 1), (3, 1, 1, 1)], "volume_id int, nx long, ny long, nz long")
    grid = region.block_grid(shapes, (2, 3, 5)).collect()
    assert {r["volume_id"] for r in grid} == {1, 3}
    assert sum((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) * (r["z1"] - r["z0"]) for r in grid) == 61


@pytest.mark.parametrize("size", [(2, 3), (3, 4), (7, 9), (1, 1)])
def test_resize_nearest(spark, v345, size):
    image = v345[:, :, :1]
    found = dense(region.resize_nearest(volume(spark, image), 3, 4, *size), (*size, 1))
    pick = [np.floor((np.arange(n) + 0.5) * m / n).astype(int) for n, m in zip(size, (3, 4), strict=True)]
    assert (found == image[np.ix_(*pick, [0])]).all()


def test_cutouts_pad_with_zeros(spark, v345):
    origins = spark.createDataFrame([(0, -1, 2, 3)], "tile_id long, ox long, oy long, oz long")
    found = dense(region.cutouts(volume(spark, v345), origins, (3, 4, 4)), (3, 4, 4))
    assert (found[1:, :2, :2] == v345[:2, 2:, 3:]).all() and found.sum() == v345[:2, 2:, 3:].sum()


def test_random_cutouts(spark, v345):
    """Boxes lie inside the volume, wider ones in its middle; each is that part of the array, padded."""
    size, df = (2, 7, 3), volume(spark, v345)
    origins = region.random_origins(spark.range(40), "id", v345.shape, size, 3)
    places = {r["tile_id"]: r for r in region.centred_cutouts(origins, v345.shape, size).collect()}
    assert {r["ox"] for r in places.values()} == {0, 1} and {r["oy"] for r in places.values()} == {0} and {r["oz"] for r in places.values()} == {0, 1, 2}
    assert {(r["before_y"], r["after_y"], r["ny"], r["local_z"], r["global_z"] - r["oz"]) for r in places.values()} == {(1, 2, 4, 1, 1)}
    again = region.random_origins(spark.range(40).repartition(7), "id", v345.shape, size, 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, origins.collect()))
    boxes = region.padded(df, region.centred_cutouts(origins, v345.shape, size), size)
    for k in (0, 17, 39):
        r = places[k]
        part = v345[r["ox"] : r["ox"] + 2, :, r["oz"] : r["oz"] + 3]
        assert (dense(boxes.filter(F.col("tile_id") == k), size) == np.pad(part, [(0, 0), (1, 2), (0, 0)])).all()
    deep = region.centred_cutouts(spark.createDataFrame([(1, 0, 0, 4)], "tile_id long, ox long, oy long, oz long"), (3, 4, 5), (3, 4, 9)).first()
    assert (deep["nz"], deep["before_z"], deep["local_z"], deep["global_z"]) == (1, 4, 4, 4)


def test_blocks_keep_volumes_apart(spark):
    """Bricks, chunks and volumes that meet: negative places, edges of a brick, equal places in two volumes."""
    rows = [(k, x, y, z, k + x + y + z) for k in (1, 2) for x in (-1, 0, 63, 64, 300) for y in (0, 255, 256) for z in (-17, 15, 16, 64)]
    df = spark.createDataFrame(rows, "volume_id int, x long, y long, z long, v long")
    back = blocks.open_blocks(spark, blocks.write_blocks(df))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(rows)
    assert region.region(back, x=(0, 64), z=16).count() == 2 * 2 * 3


def test_surface_files(spark, tmp_path):
    """Files read in name order: OBJ faces name their own three vertices, STL facets follow each other; one voxel has 12."""
    labels = spark.createDataFrame([(1, 0, 0, 0), (2, 3, 0, 0), (2, 3, 0, 1)], "lab long, x long, y long, z long")
    tris = surfaces.numbered(surfaces.triangles(surfaces.faces(labels)))
    texts = {}
    for kind, lines in (("obj", surfaces.obj_lines), ("stl", surfaces.stl_lines)):
        surfaces.write_lines(lines(tris), str(tmp_path / kind))
        texts[kind] = {k: "".join(f.read_text() for f in sorted((tmp_path / kind / f"lab={k}").glob("part-*"))).splitlines() for k in (1, 2)}
    for k, n in ((1, 12), (2, 20)):
        assert [line[0] for line in texts["obj"][k]] == ["v"] * 3 * n + ["f"] * n
        assert texts["obj"][k][3 * n :] == [f"f {3 * i + 1} {3 * i + 2} {3 * i + 3}" for i in range(n)]
        stl = texts["stl"][k]
        assert len(stl) == 7 * n + 2 and stl[0] == f"solid {k}" and stl[-1] == f"endsolid {k}"
        assert [line.split()[-3:] for line in stl if "vertex" in line] == [line.split()[1:] for line in texts["obj"][k][: 3 * n]]
        for i in range(n):  # the facet's normal is that of its corners, in their order
            facet = [line.split() for line in stl[1 + 7 * i : 8 + 7 * i]]
            a, b, c = (np.array(facet[j][1:], int) for j in (2, 3, 4))
            assert np.cross(b - a, c - a).tolist() == [int(q) for q in facet[0][2:]]


def test_binary_surface_files(spark, tmp_path):
    """The parts of an object in name order are a binary STL file: header, number, then 50 bytes for each facet; any part size."""
    from voxmere.sources.images import write_files

    labels = spark.createDataFrame([(1, 0, 0, 0), (2, 3, 0, 0), (2, 3, 0, 1)], "lab long, x long, y long, z long")
    tris = surfaces.numbered(surfaces.triangles(surfaces.faces(labels)))
    want = {k: [r for r in sorted(tris.collect(), key=lambda r: r["n"]) if r["lab"] == k] for k in (1, 2)}
    for facets in (7, surfaces.FACETS):
        folder = tmp_path / str(facets)
        write_files(surfaces.stl_parts(tris, facets), str(folder))
        for k, n in ((1, 12), (2, 20)):
            parts = sorted(p for p in (folder / f"{k}.combined.stl").iterdir() if p.name.isdigit())
            data = b"".join(p.read_bytes() for p in parts)
            assert len(parts) == -(-n // facets) and len(data) == 84 + 50 * n and int.from_bytes(data[80:84], "little") == n
            found = np.frombuffer(data, surfaces.FACET, offset=84)
            assert found["corners"].tolist() == [[[float(c) for c in r[f"v{i}"]] for i in range(3)] for r in want[k]]
            assert np.cross(found["corners"][:, 1] - found["corners"][:, 0], found["corners"][:, 2] - found["corners"][:, 0]).tolist() == found["normal"].tolist()
    empty = surfaces.numbered(surfaces.triangles(surfaces.faces(labels.filter("lab = 9"))))
    assert surfaces.stl_parts(empty).count() == 0


def test_surface_files_of_blocks(spark, tmp_path):
    """One solid for each object and block, negative places too; together they hold each triangle once."""
    labels = spark.createDataFrame([(1, -1, 0, 0), (1, 0, 0, 0), (1, 9, 9, 9)], "lab long, x long, y long, z long")
    tris = surfaces.triangles(surfaces.faces(labels))
    surfaces.write_blocks(tris, (4, 4, 4), str(tmp_path / "b"))
    found = {f.name: [p.read_text().splitlines() for p in f.glob("part-*")] for f in (tmp_path / "b").glob("lab=*")}
    assert set(found) == {"lab=_1_-4_0_0", "lab=_1_0_0_0", "lab=_1_8_8_8"}
    for name, files in found.items():
        (lines,) = files
        assert lines[0] == f"solid {name[4:]}" and lines[-1] == f"endsolid {name[4:]}"
        assert len(lines) == 2 + 7 * (12 if name.endswith("_8") else 10)


def test_blocks_are_read_by_their_notes(spark, tmp_path, monkeypatch):
    """A block's file has the lines of stl_lines, whatever is made into text at once; what isn't noted isn't read."""
    labels = spark.createDataFrame([(1, 5, 5, 5), (1, 6, 5, 5), (2, 6, 6, 6), (1, -1, 0, 0)], "lab long, x long, y long, z long")
    tris = surfaces.triangles(surfaces.faces(labels))
    rows = surfaces.stl_lines(surfaces.numbered(tris.filter("x > 0"))).orderBy("lab", "part", "place").collect()
    want = {f"_{k}_4_4_4": [line.replace(f"solid {k}", f"solid _{k}_4_4_4") for r in rows if r["lab"] == k for line in r["line"].split("\n")] for k in (1, 2)}
    for facets in (3, 1 << 12):
        monkeypatch.setattr(surfaces, "TEXT_FACETS", facets)
        folder = tmp_path / str(facets)
        surfaces.write_blocks(tris, (4, 4, 4), str(folder))
        for name, lines in want.items():
            (file,) = (folder / f"lab={name}").glob("part-*")
            assert file.read_text() == "\n".join(lines) + "\n"
        (folder / "lab=_9_0_0_0").mkdir()
        (folder / "lab=_9_0_0_0" / "part-0").write_text("solid _9_0_0_0\n")
        found = {}
        for r in surfaces.read_blocks(spark, str(folder)).collect():
            found.setdefault(r["part"], []).append(r["line"])
        assert set(found) == {*want, "_1_-4_0_0"} and all(found[k] == want[k] for k in want)
    empty = tmp_path / "empty"
    surfaces.write_blocks(tris.filter("x > 99"), (4, 4, 4), str(empty))
    assert surfaces.read_blocks(spark, str(empty)).count() == 0


def test_tasks_of_block_files_dont_grow_with_files(spark, sf_dir):
    """Some four hundred files are written and read; neither moving nor listing them takes a task for each."""
    from voxmere.plans.surfaces import surface_export_blocks

    spark.sparkContext.setJobGroup("blocks", "blocks")
    try:
        n = surface_export_blocks(spark, sf_dir).select("part").distinct().count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup("blocks") for s in tracker.getJobInfo(job).stageIds]
    assert n > 300 and 0 < max(s.numTasks for s in stages if s is not None) < 50


def test_regions_of_submissions(spark):
    square = "[[[1,1],[6,1],[6,6]]]"
    payloads = [
        f'{{"regions_by_slice":{{"3":{{"positive_regions":{square}}}," 4 ":{{"negativeRegions":{square}}},"5":{{"positive_regions":[]}},"x":{{"positive_regions":{square}}}}},"positive_regions":{square}}}',
        f'{{"regionsBySlice":{{"5":{{}}}},"positiveRegions":{square},"negative_regions":{square}}}',
        f'{{"polygons":{{"negativeRegions":{square}}},"positive_regions":{square}}}',
        f'{{"regions_by_slice":7,"polygons":"x","positive_regions":{square}}}',
        '{"positive_regions":[]}', "[1]", "broken", "", None,
    ]
    df = spark.createDataFrame([(k, p, 9) for k, p in enumerate(payloads)], "sample_id int, payload string, z0 int")
    found = {(r["sample_id"], r["z"], r["positive"] is not None, r["negative"] is not None) for r in annotations.regions_by_slice(df, "sample_id", "payload", "z0").collect()}
    assert found == {(0, 3, True, False), (0, 4, False, True), (1, 9, True, True), (2, 9, False, True), (3, 9, True, False)}


def test_polygons_scaled(spark):
    """A picture twice as wide; points that aren't two numbers go first, and a polygon that has two left after them."""
    rows = [(1, 1, False, [[4.0, 1.0], [12.0, 1.0], [5.0], [12.0, 6.0], [None, 3.0], [4.0, 6.0]]), (2, 1, False, [[0.0, 0.0], [8.0, 8.0], [1.0]])]
    regions = spark.createDataFrame(rows, "mask_id int, poly_id int, negative boolean, points array<array<double>>")
    assert {tuple(r) for r in annotations.rasterize(regions, 8, 8, (16, 8)).select("mask_id", "x", "y").collect()} == {(1, x, y) for x in range(2, 6) for y in range(1, 6)}
    assert annotations.rasterize(regions, 8, 8, (0, 8)).count() == 20


def test_block_store_round_trip(spark, v345):
    path = blocks.write_blocks(volume(spark, v345))
    assert (dense(blocks.open_blocks(spark, path), (3, 4, 5)) == v345).all()
    plan = region.region(blocks.open_blocks(spark, path), z=(0, 4))._jdf.queryExecution().toString()
    assert "cz" in plan.split("PartitionFilters")[1].split("]")[0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=8, max_size=8), st.lists(st.integers(0, 3), min_size=8, max_size=8))
def test_overlap_equals_numpy(spark, p, t):
    sparse = lambda xs: volume(spark, np.array(xs).reshape(2, 2, 2)).filter("v <> 0").withColumnRenamed("v", "lab")
    found = overlap.micro(overlap.confusion(overlap.align(sparse(p), sparse(t)), "z")).first()
    p, t = np.array(p), np.array(t)
    tp, fp, fn = ((p > 0) & (t > 0)).sum(), ((p > 0) & (t == 0)).sum(), ((p == 0) & (t > 0)).sum()
    assert (found["tp"], found["fp"], found["fn"]) == (tp, fp, fn)
    assert math.isclose(found["dice"], 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 1.0)


def test_windows(spark):
    df = spark.createDataFrame([(1, v) for v in (0, 0, *range(1, 201))] + [(2, 7), (2, 7), (3, 0)], "label int, v long")
    got = {r["label"]: r for r in intensity.window_bounds(df).collect()}
    values = np.arange(1, 201)
    assert math.isclose(got[1]["window_min"], np.percentile(values, 1)) and math.isclose(got[1]["window_max"], np.percentile(values, 99.5))
    flat = {(r["label"], r["w"]) for r in intensity.auto_window(df).filter("label > 1").collect()}
    assert flat == {(2, 255), (3, 0)}
    row = spark.range(1).select(pixels.wrap(F.lit(-1), 8).alias("a"), pixels.wrap(F.lit(300), 8).alias("b"), pixels.window(F.lit(1), F.lit(0), F.lit(510)).alias("c"), pixels.window(F.lit(3), F.lit(0), F.lit(510)).alias("d")).first()
    assert tuple(row) == (255, 44, 0, 2)


def test_polygons(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b]]
    rows = [(1, 1, False, square(1.0, 6.0)), (1, 2, True, square(2.0, 4.0)), (2, 1, False, square(-3.0, 50.0)), (3, 1, False, [[0.0, 0.0], [1.0, 1.0]])]
    found = annotations.rasterize(spark.createDataFrame(rows, "mask_id int, poly_id int, negative boolean, points array<array<double>>"), 8, 8).collect()
    count = {m: sum(r["mask_id"] == m for r in found) for m in (1, 2, 3)}
    assert count == {1: 21, 2: 64, 3: 0}


def test_negatives(spark):
    rows = spark.createDataFrame([(z, x, 0, 5, 255 if x == 3 else 0) for z in range(2) for x in range(8)], "z long, x long, y long, v long, label long")
    kept = annotations.subsample_negatives(rows, 3).collect()
    assert sorted((r["z"], r["x"]) for r in kept) == [(z, x) for z in range(2) for x in (0, 3, 4, 7)]
    assert annotations.subsample_negatives(rows, 1).count() == 16


def test_surface_of_a_cube_is_closed(spark):
    cube = volume(spark, np.ones((2, 2, 2), int)).withColumnRenamed("v", "lab")
    two = cube.unionByName(cube.withColumns({"x": F.col("x") + 2, "lab": F.lit(2).cast("long")}))
    found = {r["lab"]: r["n_triangles"] for r in surfaces.combine(surfaces.triangles(surfaces.faces(two))).collect()}
    assert found == {1: 48, 2: 48}
    corners = [(tuple(r["v0"]), tuple(r["v1"]), tuple(r["v2"])) for r in surfaces.triangles(surfaces.faces(cube)).collect()]
    edges = [e for a, b, c in corners for e in ((a, b), (b, c), (c, a))]
    assert sorted(edges) == sorted((b, a) for a, b in edges)


def test_names(spark):
    texts = ["a/b/12.model", "12.json", "x.zarr", "plain", "1.model.model"]
    row = spark.createDataFrame([(t,) for t in texts], "t string").select(runs.model_id(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in row] == ["12", "12", "x", "plain", "1.model"]
    values = {"0.5": 0.5, "50%": 50.0, "true": None, "inf": None, "1e400": None, "": None, None: None, " 7 ": 7.0}
    rows = spark.createDataFrame([(t,) for t in values], "t string").select("t", runs.metric_value(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == values


def test_paths(spark):
    paths = {"a/b.png": (True, True), "__MACOSX/a": (False, True), ".h/a": (False, True), "a/._b": (False, True), "a/../../b": (True, False), "/a": (True, False), "a/../b": (True, True)}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", headers.is_source(F.col("p")).alias("s"), headers.is_safe(F.col("p")).alias("o")).collect()
    assert {r["p"]: (r["s"], r["o"]) for r in rows} == paths


def test_series_ties(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7), (2, None), (3, None)], "job_id long, series_uid long")
    found = {r["job_id"]: (r["series"], r["n"], r["state"]) for r in headers.select_series(rows).collect()}
    assert found == {1: ("5", 2, "ok"), 2: ("7", 1, "ambiguous"), 3: ("__missing__", 1, "ok")}


def test_uploads(spark):
    rows = [(1, 1, "b", 2, 2), (1, 0, "a", 2, 2), (2, 0, "a", 2, 2), (3, 0, "abc", 1, 9), (4, 0, "b", 1, 1), (4, 0, "a", 1, 1)]
    found = {r["file_id"]: (r["size"], r["complete"], r["size_ok"]) for r in jobs.reassemble(spark.createDataFrame(rows, "file_id long, part_index long, payload string, total_parts long, total_size long")).collect()}
    assert found == {1: (2, True, True), 2: (1, False, False), 3: (3, True, False), 4: (1, True, True)}


def test_images_of_16_bits(spark):
    deep = np.array([[0, 5000], [65535, 1]], "u2")
    assert (images.decode(images.png(deep)) == deep).all() and images.decode(b"broken") is None
    colours = np.stack([deep, deep // 2, deep // 3], axis=-1)
    assert (images.decode(images.png(colours)) == deep).all()
    assert (images.decode(images.png(colours.astype("u1"))) == deep.astype("u1")).all()


def test_filtered_rows():
    """Rows filtered by the PNG rules read back: each kind of filter, pixels of one and three bytes."""
    for step in (1, 3):
        plain = np.random.default_rng(step).integers(0, 256, (10, 4 * step)).astype(np.uint8)
        rows = []
        for k, line in enumerate(plain.astype(int)):
            up = plain[k - 1].astype(int) if k else np.zeros(4 * step, int)
            left, corner = (np.concatenate([np.zeros(step, int), a[:-step]]) for a in (line, up))
            guess = left + up - corner
            far = np.abs(np.stack([guess - left, guess - up, guess - corner]))
            paeth = np.choose(far.argmin(axis=0), [left, up, corner])
            taken = (0 * line, left, up, (left + up) // 2, paeth)[k % 5]
            rows.append(np.concatenate([[k % 5], (line - taken) % 256]))
        assert (images.unfiltered(np.array(rows, np.uint8), step) == plain).all()


def test_image_folders(spark, tmp_path):
    """Two stacks below one folder, a broken file, and a colour file: first channel, z by name in each stack."""
    image = np.arange(6, dtype="u1").reshape(2, 3)
    for stack, names in (("a", ("s10.png", "s2.png")), ("b", ("x.png", "y.png", "z.txt"))):
        rows = [(n, bytearray(b"none" if n == "y.png" else images.png(np.stack([image, image + 9, image + 7], -1) if n == "s2.png" else image + 1))) for n in names]
        images.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "all" / stack))
    found = images.read_folder(spark, str(tmp_path / "all"), width=3, height=2, glob="*.png").withColumn("stack", F.regexp_extract("stack", "([^/]*)$", 1))
    for stack, z, want in (("a", 0, image + 1), ("a", 1, image), ("b", 0, image + 1), ("b", 1, image * 0)):
        rows = found.filter((F.col("stack") == stack) & (F.col("z") == z)).collect()
        assert len(rows) == 6 and all(want[r["y"], r["x"]] == r["v"] for r in rows)
    assert found.select("stack", "z").distinct().count() == 4


def test_folders_of_one_name_stay_apart(spark, tmp_path):
    """Also below folders whose names hold spaces, signs and letters beyond ASCII."""
    for folder, add in (("1+ a%20/stack", 0), ("2 é/stack", 100)):
        rows = [(f"s {k}.png", bytearray(images.png(np.full((2, 2), k + add, "u1")))) for k in range(2)]
        images.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / folder))
    found = [(r["name"], r["z"], r["v"]) for r in images.read_folder(spark, str(tmp_path)).collect()]
    assert sorted(set(found)) == [("s 0.png", 0, 0), ("s 0.png", 0, 100), ("s 1.png", 1, 1), ("s 1.png", 1, 101)] and len(found) == 16


def test_slices_of_two_volumes_are_written_apart(spark, tmp_path):
    voxels = spark.createDataFrame([(k, x, 0, z, 10 * k + z) for k in (1, 2) for x in (0, 1) for z in (0, 1)], "volume_id int, x long, y long, z long, v long")
    images.write_files(images.png_rows(voxels, name="{:03d}.png"), str(tmp_path / "out"))
    found = images.read_folder(spark, str(tmp_path / "out")).withColumn("stack", F.regexp_extract("stack", "([^/]*)$", 1))
    assert sorted(tuple(r) for r in found.select("stack", "z", "x", "v").collect()) == sorted((str(k), z, x, 10 * k + z) for k in (1, 2) for x in (0, 1) for z in (0, 1))


def test_landed_stacks(spark):
    rows = spark.createDataFrame([(k, f"{n}.png", bytearray(images.png(np.full((1, 2), 10 * k + n, "u2")))) for k in (1, 2) for n in range(3)], "volume_id int, name string, content binary")
    path = paths.scratch(spark)
    rows.write.parquet(path)
    assert sorted(map(tuple, images.read_stack(spark, path).collect())) == sorted((k, x, 0, n, 10 * k + n) for k in (1, 2) for n in range(3) for x in (0, 1))


def test_zip_members(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b.txt", "x")
        z.mkdir("empty")
    path = paths.scratch(spark)
    spark.createDataFrame([("7.zip", out.getvalue())], "archive string, content binary").write.parquet(path)
    assert [(r["job_id"], r["path"], bytes(r["content"])) for r in archives.members(spark, path).collect()] == [(7, "a/b.txt", b"x")]


def test_forest_learns_a_separable_volume(spark):
    rng = np.random.default_rng(0)
    truth = np.zeros((12, 12, 4), int)
    truth[3:9, 3:9] = 255
    v = truth * 10 + rng.integers(0, 50, truth.shape)
    rows = volume(spark, v).join(volume(spark, truth).withColumnRenamed("v", "label"), ["x", "y", "z"])
    model = learning.ForestSegmenter(function=lambda image: learning.multiscale(image, (1.0,)), every=1).fit(rows, trees=5, depth=5)
    found = model.segment(volume(spark, v))
    dice = overlap.micro(overlap.confusion(overlap.align(found, volume(spark, truth).filter("v > 0").withColumnRenamed("v", "lab")), "z")).first()["dice"]
    assert dice >= 0.95
    assert {r["lab"] for r in found.select("lab").distinct().collect()} == {255}


def test_metric_texts_by_the_rule(spark):
    """Hand cases: each space one underscore, hyphens stay; one percent sign goes, white space around it too."""
    from voxmere.functions import runs as N

    rows = [(" Val  IoU ", "5 %", "val__iou", 5.0), ("val-IoU", "5%%", "val-iou", None), ("   ", " 7e1 ", None, 70.0), ("F1", "true", "f1", None), ("x", "inf", "x", None), ("y", "%", "y", None), ("z", "-0.5%", "z", -0.5), (None, None, None, None)]
    found = spark.createDataFrame([r[:2] for r in rows], "name string, text string").select(N.metric_key(F.col("name")), N.metric_value(F.col("text"))).collect()
    assert [tuple(r) for r in found] == [r[2:] for r in rows]


def test_ids_of_any_length_are_in_order(spark):
    from voxmere.functions import runs as N

    ids = ["9" * 30, "10", "abc", "7", "1" + "0" * 45]
    found = spark.createDataFrame([(i,) for i in ids], "id string").orderBy(N.sort_key(F.col("id"))).collect()
    assert [r[0] for r in found] == ["7", "10", "9" * 30, "1" + "0" * 45, "abc"]


def test_sample_sets_match_by_ids_before_numbers(spark):
    """A deleted and a new sample don't cancel out where ids were recorded."""
    from voxmere.operators import runs as R

    samples = spark.sql("SELECT * FROM VALUES (1L, 11L, 1), (1L, 12L, 2), (1L, 14L, 9) AS t(job_id, sample_id, sample_ts)")
    models = spark.sql("SELECT 1L AS job_id, m AS model_id, 5 AS model_ts FROM VALUES (1L), (2L), (3L), (4L), (5L) AS t(m)")
    records = spark.sql("SELECT 1L AS job_id, * FROM VALUES (1L, array(12L, 14L, 11L), 99L), (2L, array(11L, 12L, 13L), 3L), (3L, CAST(NULL AS array<bigint>), 3L), (4L, CAST(array() AS array<bigint>), CAST(NULL AS bigint)) AS t(model_id, sample_ids, annotation_count)")
    found = {r["model_id"]: (r["n_seen"], r["matches"]) for r in R.set_matches(samples, models, records).collect()}
    assert found == {1: (99, True), 2: (3, False), 3: (3, True), 4: (2, False), 5: (2, False)}


def test_stencil_takes_gaps_as_zeros_and_volumes_apart(spark):
    from voxmere.operators.annotations import stencil

    rows = [("a", 0, 0, 0, 5), ("a", 2, 0, 0, 7), ("a", 1, 1, 0, 1), ("b", 1, 0, 0, 100)]
    found = {(r["volume_id"], r["x"], r["y"]): (r["smooth"], r["gradient"]) for r in stencil(spark.createDataFrame(rows, "volume_id string, x long, y long, z long, v long")).collect()}
    assert found == {("a", 0, 0): (21, 1), ("a", 2, 0): (29, -1), ("a", 1, 1): (16, 2), ("b", 1, 0): (400, 0)}


def test_multiscale_features_against_plain_sums():
    """The smoothed channel by direct weighted sums over mirrored pixels, and the others by differences of it."""
    from voxmere.operators.learning import multiscale

    r = np.random.default_rng(3)
    image, sigma = r.random((9, 7)), 1.0
    radius = int(3 * sigma + 0.5)
    mirror = lambda k, n: min(k % (2 * n), 2 * n - 1 - k % (2 * n))
    weights = {(i, j): np.exp(-(i * i + j * j) / 2 / sigma**2) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)}
    total = sum(weights.values())
    smooth = np.array([[sum(w * image[mirror(x + i, 9), mirror(y + j, 7)] for (i, j), w in weights.items()) / total for y in range(7)] for x in range(9)])
    found = multiscale(image, (sigma,))
    gx, gy = np.gradient(smooth)
    hessian = np.stack([np.stack([np.gradient(gx)[0], np.gradient(gx)[1]], -1), np.stack([np.gradient(gx)[1], np.gradient(gy)[1]], -1)], -1)
    values = np.linalg.eigvalsh(hessian)
    assert np.allclose(found[..., 0], smooth) and np.allclose(found[..., 1], np.hypot(gx, gy))
    assert np.allclose(found[..., 2], values[..., 1]) and np.allclose(found[..., 3], values[..., 0])


def test_empty_training_rows_say_so(spark):
    from voxmere.operators import learning as L

    assert L.features(spark.createDataFrame([], "x long, y long, z long, v long")).count() == 0
