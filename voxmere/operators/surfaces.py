"""Surfaces of labelled regions as exposed voxel faces."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxmere.operators.region import floor_div, volume
from voxmere.sources.grouped import grouped
from voxmere.sources.images import together
from voxmere.sources.paths import opened, qualified

#: face: (neighbour offset, corners in order)
FACES = (
    ((-1, 0, 0), ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0))),
    ((1, 0, 0), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1))),
    ((0, -1, 0), ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1))),
    ((0, 1, 0), ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0))),
    ((0, 0, -1), ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0))),
    ((0, 0, 1), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))),
)

#: corners of a face's triangles
HALVES = ((0, 1, 2), (0, 2, 3))


def faces(labels: DataFrame) -> DataFrame:
    """(lab, x, y, z, face): sides of labelled voxels whose neighbour doesn't have the label.

    Every side is keyed by the plane it lies in: two voxels of one label that touch give the same key, so a side is
    exposed where its key comes once. One aggregation, no join with neighbours.
    """
    sides = F.array(*(F.struct(F.lit(k).alias("face"), F.lit(k // 2).alias("axis"), F.lit(max(sum(o), 0)).alias("step")) for k, (o, _) in enumerate(FACES)))
    keys = [*volume(labels), "lab"]
    each = labels.filter("lab > 0").select(*keys, "x", "y", "z", F.explode(sides).alias("s"))
    plane = {a: (F.col(a) + F.when(F.col("s.axis") == k, F.col("s.step")).otherwise(0)).alias(f"p{a}") for k, a in enumerate("xyz")}
    keyed = each.select(*keys, F.col("s.axis").alias("axis"), *plane.values(), "x", "y", "z", F.col("s.face").alias("face"))
    own = ("x", "y", "z", "face")  # of the one side where a key comes once
    once = keyed.groupBy(*keys, "axis", "px", "py", "pz").agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in own)).filter("n = 1")
    return once.select(*keys, *own)


def triangles(exposed: DataFrame) -> DataFrame:
    """(lab, x, y, z, face, tri, v0, v1, v2): two triangles for each face."""
    offsets = F.array(*(F.array(*(F.array(*(F.struct(*(F.lit(c).alias(a) for a, c in zip("xyz", corners[i], strict=True))) for i in half)) for half in HALVES)) for _, corners in FACES))
    halves = exposed.select("lab", "x", "y", "z", "face", F.posexplode(F.element_at(offsets, F.col("face") + 1)).alias("tri", "t"))
    return halves.select("lab", "x", "y", "z", "face", "tri", *(F.struct(*((F.col(a) + F.col("t")[i][a]).alias(a) for a in "xyz")).alias(f"v{i}") for i in range(3)))


def combine(tris: DataFrame) -> DataFrame:
    """For each object its number of triangles and its bounding box."""
    bounds = [f(c(f"v{i}.{a}" for i in range(3))).alias(f"{n}_{a}") for a in "xyz" for f, c, n in ((F.min, lambda s: F.least(*s), "min"), (F.max, lambda s: F.greatest(*s), "max"))]
    return tris.groupBy("lab").agg(F.count(F.lit(1)).alias("n_triangles"), *bounds)


def numbered(tris: DataFrame) -> DataFrame:
    """Triangles with column n, their place in their object's file: by z, x, y, face and half, from 0.

    Places are counted inside each layer of an object and shifted by what lower layers hold, so no task sorts a whole object.
    """
    layers = tris.groupBy("lab", "z").agg(F.count(F.lit(1)).alias("size"))
    below = layers.select("lab", "z", (F.sum("size").over(Window.partitionBy("lab").orderBy("z")) - F.col("size")).alias("below"))
    inside = F.row_number().over(Window.partitionBy("lab", "z").orderBy("x", "y", "face", "tri")) - 1
    return tris.withColumn("inside", inside).join(below, ["lab", "z"]).withColumn("n", F.col("below") + F.col("inside")).drop("below", "inside")


def obj_lines(placed: DataFrame) -> DataFrame:
    """(lab, part, place, line): each object of numbered triangles as a text mesh, three vertex lines for each, then the faces."""
    corners = placed.select("lab", "n", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "p"))
    vertices = corners.select("lab", F.lit(0).alias("part"), (3 * F.col("n") + F.col("k")).alias("place"), F.format_string("v %d %d %d", "p.x", "p.y", "p.z").alias("line"))
    first = 3 * F.col("n")
    return vertices.unionByName(placed.select("lab", F.lit(1).alias("part"), F.col("n").alias("place"), F.format_string("f %d %d %d", first + 1, first + 2, first + 3).alias("line")))


def stl_lines(placed: DataFrame) -> DataFrame:
    """(lab, part, place, line): each object of numbered triangles as an ASCII STL solid; a row is a facet with its seven lines."""
    normal = F.element_at(F.array(*(F.lit("%d %d %d" % o) for o, _ in FACES)), F.col("face") + 1)
    corner = [F.format_string("      vertex %d %d %d", *(f"v{i}.{a}" for a in "xyz")) for i in range(3)]
    facet = F.concat_ws("\n", F.concat(F.lit("  facet normal "), normal), F.lit("    outer loop"), *corner, F.lit("    endloop"), F.lit("  endfacet"))
    facets = placed.select("lab", F.lit(1).alias("part"), F.col("n").alias("place"), facet.alias("line"))
    names = placed.select("lab").distinct()
    ends = [names.select("lab", F.lit(part).alias("part"), F.lit(0).cast("long").alias("place"), F.concat(F.lit(word), F.col("lab").cast("string")).alias("line")) for part, word in ((0, "solid "), (2, "endsolid "))]
    return facets.unionByName(ends[0]).unionByName(ends[1])


#: The file of a block's folder.
PART = "part-00000.txt"

#: Lines of one file.
LINES = 1 << 17


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder lab=<object> for each object; its text files, one after the other by name, are the object's file.

    Lines know their place in their part of an object, so their file follows from how many lines the parts before have, and
    no sample of them has to be drawn. Only objects are counted and put in order.
    """
    order = ["lab", "part", "place"]
    sizes = lines.groupBy("lab", "part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("lab", "part")) - F.col("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    dealt = lines.join(before.drop("size"), ["lab", "part"]).withColumn("file", F.floor((F.col("before") + F.col("place")) / LINES).cast("int"))
    dealt.repartitionById(max(1, -(-total // LINES)), F.col("file")).sortWithinPartitions(*order).select("lab", "line").write.partitionBy("lab").text(path)


#: A facet of an ASCII STL file, and how many are made into text at once.
FACET_TEXT = "  facet normal %d %d %d\n    outer loop\n" + 3 * "      vertex %d %d %d\n" + "    endloop\n  endfacet\n"
TEXT_FACETS = 1 << 12


def by_block(tris: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Triangles with bx, by and bz, the first voxel of the block that holds the triangle's voxel."""
    return tris.withColumns({f"b{a}": floor_div(a, n) * n for a, n in zip("xyz", size, strict=True)})


def write_blocks(tris: DataFrame, size: tuple[int, int, int], path: str) -> None:
    """A folder lab=_<object>_<x>_<y>_<z> for each object and block with its ASCII STL solid in one file: a block bounds it, so
    it is put in order in one task.

    Triangles are dealt and sorted by block, with their voxel, face and half, from which the corners follow. Tasks write the
    files of their blocks themselves, under a hidden name until they are whole, so the driver neither moves nor lists files,
    however many there are; the parts' names are noted as a table in the folder _files, which read_blocks follows.
    """
    keys, place = ["lab", "bx", "by", "bz"], ["z", "x", "y", "face", "tri"]
    target = qualified(tris.sparkSession, path)
    normals, corners = np.array([o for o, _ in FACES]), np.array([[[c[i] for i in half] for half in HALVES] for _, c in FACES])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(target)

        def each() -> Iterator[tuple[str, int]]:
            for rows in grouped(batches, keys):
                name = "_".join(["", *(str(rows.column(k)[0].as_py()) for k in keys)])
                x, y, z, face, tri = (rows.column(k).to_numpy() for k in ("x", "y", "z", "face", "tri"))
                numbers = np.concatenate([normals[face][:, None], corners[face, tri] + np.stack([x, y, z], axis=1)[:, None]], axis=1).reshape(-1, 12)
                folder = posixpath.join(root, f"lab={name}")
                system.create_dir(folder)
                part = posixpath.join(folder, f".{uuid.uuid4().hex}")
                with system.open_output_stream(part) as out:
                    out.write(f"solid {name}\n".encode())
                    for lo in range(0, len(numbers), TEXT_FACETS):
                        some = numbers[lo : lo + TEXT_FACETS]
                        out.write((FACET_TEXT * len(some) % tuple(some.ravel().tolist())).encode())
                    out.write(f"endsolid {name}\n".encode())
                system.move(part, posixpath.join(folder, PART))
                yield name, len(name)

        for names in together(each()):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["part"])

    dealt = by_block(tris, size).select(*keys, *place).repartition(*keys).sortWithinPartitions(*keys, *place)
    dealt.mapInArrow(written, "part string").write.parquet(f"{path}/_files")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(part, line): the lines of the files that write_blocks wrote; tasks open them by the names that were noted."""
    target = qualified(spark, path)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(target)

        def each() -> Iterator[tuple[tuple[str, list[str]], int]]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with system.open_input_stream(posixpath.join(root, f"lab={name}", PART)) as file:
                        data = file.read()
                    yield (name, data.decode().splitlines()), len(data)

        for some in together(each()):
            names, texts = zip(*some, strict=True)
            part = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), [len(t) for t in texts])))
            yield pa.RecordBatch.from_arrays([part, pa.array(list(chain.from_iterable(texts)), pa.string())], ["part", "line"])

    return spark.read.schema("part string").parquet(f"{path}/_files").mapInArrow(lines, "part string, line string")


#: A facet of a binary STL file, and how many one of its parts holds.
FACET = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("extra", "<u2")])
FACETS = 1 << 17
HEADER = 80


def stl_parts(placed: DataFrame, facets: int = FACETS) -> DataFrame:
    """(name, content): binary STL of each object of numbered triangles, in parts of so many facets. The parts of an object,
    one after the other by name, are its file; the first begins with the header and the number of all facets."""
    normals = np.array([o for o, _ in FACES], "<f4")

    def pack(group: pa.Table) -> pa.Table:
        rows = group.sort_by("n")
        out = np.zeros(rows.num_rows, FACET)
        out["normal"] = normals[rows.column("face").to_numpy()]
        out["corners"] = np.stack([rows.column(k).to_numpy() for k in range(2, 11)], axis=1).reshape(-1, 3, 3)
        lab, part, total = (rows.column(k)[0].as_py() for k in ("lab", "part", "total"))
        head = b"" if part else bytes(HEADER) + int(total).to_bytes(4, "little")
        return pa.table({"name": [f"{lab}.combined.stl/{part:09d}"], "content": [head + out.tobytes()]})

    corners = [F.col(f"v{i}.{a}").alias(f"v{i}{a}") for i in range(3) for a in "xyz"]
    totals = placed.groupBy("lab").agg(F.count(F.lit(1)).alias("total"))
    dealt = placed.join(totals, "lab").select("face", "n", *corners, "lab", "total", F.floor(F.col("n") / facets).alias("part"))
    return dealt.groupBy("lab", "part").applyInArrow(pack, "name string, content binary")


def read_stl(spark: SparkSession, folder: str) -> DataFrame:
    """(lab, n, nx, ny, nz, corners): the facets of the binary files that stl_parts names, and their corners' nine numbers."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lab, part, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(content, FACET, offset=0 if part else HEADER + 4)
                flat = pa.array(np.ascontiguousarray(rows["corners"]).ravel())
                normal = [pa.array(np.ascontiguousarray(rows["normal"][:, k])) for k in range(3)]
                place = pa.array(part * FACETS + np.arange(len(rows)))
                corners = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 9, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), lab)), place, *normal, corners], ["lab", "n", "nx", "ny", "nz", "corners"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = lambda k: F.regexp_extract("path", "([0-9]+)[.]combined[.]stl/([0-9]+)$", k).cast("long")
    named = files.select(found(1).alias("lab"), found(2).alias("part"), "content")
    return named.mapInArrow(unpack, "lab long, n long, nx float, ny float, nz float, corners array<float>")
