"""Queries on labels and their surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmere.operators import surfaces as S
from voxmere.plans.registry import query
from voxmere.sources.paths import scratch
from voxmere.sources.views import view

OFFSETS = "of6(face, dx, dy, dz) AS (VALUES " + ", ".join(f"({k}, {o[0]}, {o[1]}, {o[2]})" for k, (o, _) in enumerate(S.FACES)) + ")"
FACES = f"{OFFSETS}, fc AS (SELECT l.lab, l.x, l.y, l.z, face FROM seg_labels l CROSS JOIN of6 ANTI JOIN seg_labels n ON n.lab = l.lab AND n.x = l.x + dx AND n.y = l.y + dy AND n.z = l.z + dz)"
CORNERS = "cr(face, tri, k, cx, cy, cz) AS (VALUES " + ", ".join(f"({f}, {t}, {k}, {c[i][0]}, {c[i][1]}, {c[i][2]})" for f, (_, c) in enumerate(S.FACES) for t, t3 in enumerate(((0, 1, 2), (0, 2, 3))) for k, i in enumerate(t3)) + ")"


def labels(spark, d):
    return view(spark, d, "seg_labels")


def tris(spark, d):
    return S.triangles(S.faces(labels(spark, d)))


@query("surface_faces", "seg_labels", sql=f"WITH {FACES} SELECT * FROM fc")
def surface_faces(spark, d):
    return S.faces(labels(spark, d)).select("lab", "x", "y", "z", "face")


@query("object_ids", "seg_labels", sql="SELECT DISTINCT lab FROM seg_labels")
def object_ids(spark, d):
    return labels(spark, d).select("lab").distinct()


COMBINED = f"SELECT lab, count(*) // 3 AS n_triangles, " + ", ".join(f"{f}({a} + c{a}) AS {f}_{a}" for a in "xyz" for f in ("min", "max")) + " FROM fc JOIN cr USING (face) GROUP BY lab"


@query("combine_surfaces", "seg_labels", sql=f"WITH {FACES}, {CORNERS} {COMBINED}")
def combine_surfaces(spark, d):
    return S.combine(tris(spark, d))


@query("surface_union", "seg_labels", sql=f"WITH {FACES}, {CORNERS} {COMBINED}")
def surface_union(spark, d):
    """Surfaces of two halves of the labels, joined as a bag; a label's parts in both halves stay apart only at the cut."""
    all_ = S.faces(labels(spark, d))
    return S.combine(S.triangles(all_.filter("z % 2 = 0")).unionByName(S.triangles(all_.filter("z % 2 = 1"))))


@query(
    "surface_export",
    "seg_labels",
    sql=f"""WITH {FACES}, {CORNERS}, tr AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY z, x, y, face, tri, k) - 1 AS place FROM fc JOIN cr USING (face)),
    ob AS (SELECT lab, 'obj' AS kind, printf('v %d %d %d', x + cx, y + cy, z + cz) AS line FROM tr
    UNION ALL SELECT lab, 'obj', printf('f %d %d %d', place + 1, place + 2, place + 3) FROM tr WHERE k = 0),
    st AS (SELECT lab, 'stl' AS kind, printf('      vertex %d %d %d', x + cx, y + cy, z + cz) AS line FROM tr
    UNION ALL SELECT lab, 'stl', unnest([printf('  facet normal %d %d %d', dx, dy, dz), '    outer loop', '    endloop', '  endfacet']) FROM tr JOIN of6 USING (face) WHERE k = 0
    UNION ALL SELECT DISTINCT lab, 'stl', unnest([printf('solid %d', lab), printf('endsolid %d', lab)]) FROM tr)
    SELECT kind, lab, line, count(*) AS n FROM (SELECT * FROM ob UNION ALL SELECT * FROM st) q GROUP BY ALL""",
)
def surface_export(spark, d):
    """Every object written as OBJ and as STL text, and the files' lines read back and counted."""
    found, path = [], scratch(spark)
    S.numbered(tris(spark, d)).write.parquet(path)  # both formats read it, and each is ranged by a sample first
    placed = spark.read.parquet(path)
    for kind, lines in (("obj", S.obj_lines), ("stl", S.stl_lines)):
        path = scratch(spark)
        S.write_lines(lines(placed), path)
        found.append(spark.read.schema("value string, lab long").text(path).select(F.lit(kind).alias("kind"), "lab", F.col("value").alias("line")))
    return found[0].unionByName(found[1]).groupBy("kind", "lab", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "surface_export_binary",
    "seg_labels",
    sql=f"""WITH {FACES}, {CORNERS}, tr AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY z, x, y, face, tri, k) - 1 AS place FROM fc JOIN cr USING (face))
    SELECT lab, place // 3 AS n, max(dx) AS nx, max(dy) AS ny, max(dz) AS nz, string_agg(concat_ws(' ', x + cx, y + cy, z + cz), ' ' ORDER BY place) AS corners FROM tr JOIN of6 USING (face) GROUP BY lab, place // 3""",
)
def surface_export_binary(spark, d):
    """Every object written as a binary STL file in parts, and the facets read back from the bytes."""
    from voxmere.sources.images import write_files

    path = scratch(spark)
    write_files(S.stl_parts(S.numbered(tris(spark, d))), path)
    whole = F.array_join(F.transform("corners", lambda c: c.cast("int").cast("string")), " ")
    return S.read_stl(spark, path).select("lab", "n", *(F.col(c).cast("int").alias(c) for c in ("nx", "ny", "nz")), whole.alias("corners"))


BLOCK = (4, 4, 16)


@query(
    "surface_export_blocks",
    "seg_labels",
    sql=f"""WITH {FACES}, {CORNERS}, tr AS (SELECT *, concat('_', lab, '_', x // {BLOCK[0]} * {BLOCK[0]}, '_', y // {BLOCK[1]} * {BLOCK[1]}, '_', z // {BLOCK[2]} * {BLOCK[2]}) AS part FROM fc JOIN cr USING (face))
    SELECT part, line, count(*) AS n FROM (SELECT part, printf('      vertex %d %d %d', x + cx, y + cy, z + cz) AS line FROM tr
    UNION ALL SELECT part, unnest([printf('  facet normal %d %d %d', dx, dy, dz), '    outer loop', '    endloop', '  endfacet']) FROM tr JOIN of6 USING (face) WHERE k = 0
    UNION ALL SELECT DISTINCT part, unnest(['solid ' || part, 'endsolid ' || part]) FROM tr) q GROUP BY ALL""",
)
def surface_export_blocks(spark, d):
    """Every object's part in each block written as an ASCII STL file of its own, and the files' lines read back and counted."""
    path = scratch(spark)
    S.write_blocks(tris(spark, d), BLOCK, path)
    return S.read_blocks(spark, path).groupBy("part", "line").agg(F.count(F.lit(1)).alias("n"))


@query("label_store_write", "seg_labels", sql="SELECT x, y, z, lab FROM seg_labels WHERE lab <> 0")
def label_store_write(spark, d):
    from voxmere.sources.blocks import open_blocks, write_blocks

    path = write_blocks(labels(spark, d).filter("lab <> 0"), value="lab")
    return open_blocks(spark, path).select("x", "y", "z", F.col("v").alias("lab"))


MESH = "fl AS (SELECT job_id, mesh_id, concat(CASE WHEN run_id % 4 = 0 THEN 255 ELSE run_id % 7 END, CASE WHEN run_id % 5 = 0 THEN '.combined.stl' ELSE '.combined.obj' END) AS name FROM meshes)"


def mesh_files(spark, d):
    r = F.col("run_id")
    return view(spark, d, "meshes").select("job_id", "mesh_id", F.concat(F.when(r % 4 == 0, "255").otherwise((r % 7).cast("string")), F.when(r % 5 == 0, ".combined.stl").otherwise(".combined.obj")).alias("name"))


@query("mesh_presence", "meshes", sql=f"WITH {MESH} SELECT mesh_id, count(*) FILTER (name LIKE '%.combined.stl') AS n_stl, count(*) FILTER (name LIKE '%.combined.obj') AS n_obj, count(*) FILTER (name LIKE '%.combined.stl') > 0 AS mesh_ready FROM fl GROUP BY mesh_id")
def mesh_presence(spark, d):
    has = lambda e: F.count_if(F.col("name").endswith(f".combined.{e}"))
    return mesh_files(spark, d).groupBy("mesh_id").agg(has("stl").alias("n_stl"), has("obj").alias("n_obj"), (has("stl") > 0).alias("mesh_ready"))


@query("export_completeness", "meshes", sql=f"WITH {MESH} SELECT job_id, CASE WHEN count(*) FILTER (name LIKE '%.combined.stl') = 0 THEN 'mesh_error' ELSE 'meshed' END AS status FROM fl GROUP BY job_id")
def export_completeness(spark, d):
    return mesh_files(spark, d).groupBy("job_id").agg(F.when(F.count_if(F.col("name").endswith(".combined.stl")) == 0, "mesh_error").otherwise("meshed").alias("status"))


@query("representative_mesh", "meshes", sql=f"WITH {MESH} SELECT mesh_id, arg_min(name, (name <> '255.combined.obj', name)) AS name FROM fl WHERE name LIKE '%.obj' GROUP BY mesh_id")
def representative_mesh(spark, d):
    objects = mesh_files(spark, d).filter(F.col("name").endswith(".obj"))
    return objects.groupBy("mesh_id").agg(F.min_by("name", F.struct(F.col("name") != "255.combined.obj", "name")).alias("name"))
