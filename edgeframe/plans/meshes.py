"""Mesh queries.  The mesh is built from the orders: every order is a triangle.

Triangles fill a strip of squares, two to a square; the corners are shifted by amounts
taken from order prices, so that no two triangles are alike.
"""

import math

from pyspark.sql import functions as F

from edgeframe.functions import V
from edgeframe.operators import mesh, scatter_combine
from edgeframe.plans.mesh_job import grid_mesh, mesh_job
from edgeframe.plans.registry import Registry, row_count, table
from edgeframe.session import written_path

queries = Registry()
DIGITS = 9


def mesh_width(spark, d) -> int:
    return math.ceil(math.sqrt(row_count(spark, d, "orders", "o_orderkey") / 2))


def order_mesh(spark, d):
    """``points, cells, faces, bfaces`` of the mesh of orders."""
    orders, w = table(spark, d, "orders"), mesh_width(spark, d)
    cells, faces, bfaces = grid_mesh(orders.select(F.col("o_orderkey").alias("cell_id")), w)
    used = cells.select(F.explode(F.array("p0", "p1", "p2")).alias("point_id")).distinct()
    cents = F.coalesce(F.rint(F.col("o_totalprice") * 100).cast("bigint"), F.lit(0))
    shifts = orders.select("o_orderkey", cents.alias("c"))
    side = F.lit(w + 1).cast("bigint")

    def placed(whole, shift):
        c = F.coalesce(shift, F.lit(0)) % 100
        return (whole + c / F.lit(400.0)) / F.lit(float(w))

    c = F.col("c")
    points = used.join(shifts, used["point_id"] == shifts["o_orderkey"], "left").select(
        "point_id",
        placed(F.col("point_id") % side, c).alias("x"),
        placed(F.call_function("div", F.col("point_id"), side),
               F.call_function("div", c, F.lit(100).cast("bigint"))).alias("y"))
    return points, cells, faces, bfaces


MESH_SQL = """
p AS (SELECT CAST(ceil(sqrt((max(o_orderkey) + 1) / 2.0)) AS BIGINT) AS w FROM orders),
q AS (SELECT o_orderkey AS c, o_orderkey // 2 AS q, (o_orderkey // 2) % w AS i,
        (o_orderkey // 2) // w AS j, o_orderkey % 2 = 1 AS up, w
        FROM (SELECT o_orderkey, (SELECT w FROM p) AS w FROM orders)),
cells AS (SELECT c, q, i, w, up, j * (w + 1) + i AS p0,
        CASE WHEN up THEN (j + 1) * (w + 1) + i + 1 ELSE j * (w + 1) + i + 1 END AS p1,
        CASE WHEN up THEN (j + 1) * (w + 1) + i ELSE (j + 1) * (w + 1) + i + 1 END AS p2 FROM q),
used AS (SELECT DISTINCT unnest([p0, p1, p2]) AS id FROM cells),
points AS (SELECT id, (id % (w + 1) + (coalesce(cents, 0) % 100) / 400.0::DOUBLE) / w::DOUBLE AS x,
        (id // (w + 1) + (coalesce(cents, 0) // 100 % 100) / 400.0::DOUBLE) / w::DOUBLE AS y
        FROM (SELECT id, (SELECT w FROM p) AS w FROM used) LEFT JOIN (SELECT o_orderkey AS k,
          CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) ON k = id),
sides AS (
  SELECT c * 3 AS id, c, p0 AS a, p1 AS b,
    CASE WHEN up THEN c - 1 ELSE 2 * (q - w) + 1 END AS t FROM cells UNION ALL
  SELECT c * 3 + 1, c, p1, p2, CASE WHEN up THEN 2 * (q + w) WHEN i < w - 1 THEN 2 * q + 3 END
    FROM cells UNION ALL
  SELECT c * 3 + 2, c, p2, p0, CASE WHEN up AND i > 0 THEN 2 * (q - 1) WHEN up THEN NULL
    ELSE c + 1 END FROM cells),
faces AS (SELECT id, c AS src, t AS dst FROM sides WHERE t IN (SELECT o_orderkey FROM orders)),
bfaces AS (SELECT id, c, a, b FROM sides WHERE t IS NULL OR t NOT IN (SELECT o_orderkey FROM orders)),
geo AS (SELECT c, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, d.x AS x2, d.y AS y2,
        (a.x + b.x + d.x) / 3 AS x, (a.y + b.y + d.y) / 3 AS y,
        0.5::DOUBLE * abs(a.x * (b.y - d.y) + b.x * (d.y - a.y) + d.x * (a.y - b.y)) AS area
        FROM cells JOIN points a ON p0 = a.id JOIN points b ON p1 = b.id JOIN points d ON p2 = d.id)"""


@queries.query(f"""
WITH {MESH_SQL}
SELECT f.id AS edge_id, src, dst, s.p0 AS src_p0, s.p1 AS src_p1, s.p2 AS src_p2,
  t.p0 AS dst_p0, t.p1 AS dst_p1, t.p2 AS dst_p2
FROM faces f JOIN cells s ON src = s.c JOIN cells t ON dst = t.c""")
def mesh_topology(spark, d):
    _, cells, faces, _ = order_mesh(spark, d)
    return mesh.edge_cell_points(faces, cells)


@queries.query(f"""
WITH {MESH_SQL}
SELECT c AS cell_id, round(x, 9) AS x, round(y, 9) AS y, round(area, 9) AS area,
  round(1 + 0.1::DOUBLE * exp(-100 * (x * x + y * y)), 9) AS h FROM geo""")
def mesh_geometry(spark, d):
    points, cells, _, _ = order_mesh(spark, d)
    geo = mesh.cell_geometry(cells, points)
    h = mesh.gaussian_field(V.of("x"), V.of("y")).column
    return geo.select("cell_id", *[F.round(c, DIGITS).alias(n) for n, c in (
        ("x", F.col("x")), ("y", F.col("y")), ("area", F.col("area")), ("h", h))])


def _normal_sql(p0: str, p1: str, p2: str) -> tuple[str, str]:
    """SQL of the normal of p1–p2 seen from p0; a point is ``x,y``."""
    (ax, ay), (bx, by), (cx, cy) = (p.split(",") for p in (p0, p1, p2))
    side = f"sign(({bx} - {cx}) * ({ay} - {cy}) - ({by} - {cy}) * ({ax} - {cx}))"
    return f"({side} * ({by} - {cy}))", f"(-{side} * ({bx} - {cx}))"


def _shared_sql() -> str:
    corners = {"0": "s.x0,s.y0", "1": "s.x1,s.y1", "2": "s.x2,s.y2"}
    parts = []
    for a, b, third in ("012", "120", "201"):
        nx, ny = _normal_sql(corners[third], corners[a], corners[b])
        fx, fy = _normal_sql("d.x,d.y", corners[a], corners[b])
        (x3, y3), (x4, y4) = corners[a].split(","), corners[b].split(",")
        bottom = f"((d.x - s.x) * ({y4} - {y3}) - (d.y - s.y) * ({x4} - {x3}))"
        top = f"(({x3} - s.x) * ({y4} - {y3}) - ({y3} - s.y) * ({x4} - {x3}))"
        parts.append((f"{nx} * {fx} + {ny} * {fy} < 0", nx, ny,
                      f"CASE WHEN {bottom} = 0 THEN 0 ELSE {top} / {bottom} END"))
    outs = []
    for k, name in ((1, "sx"), (2, "sy"), (3, "alpha")):
        whens = " ".join(f"WHEN {p[0]} THEN {p[k]}" for p in reversed(parts))
        outs.append(f"CASE {whens} ELSE 0 END AS {name}")
    return ("faces f JOIN geo s ON src = s.c JOIN geo d ON dst = d.c", ", ".join(outs))


SHARED_FROM, SHARED_COLUMNS = _shared_sql()


@queries.query(f"""
WITH {MESH_SQL}, shared AS (SELECT f.id AS edge_id, src, dst, {SHARED_COLUMNS} FROM {SHARED_FROM})
SELECT edge_id, src, dst, round(sx, 9) + 0.0 AS sx, round(sy, 9) + 0.0 AS sy,
  round(alpha, 9) AS alpha FROM shared""")
def mesh_shared_face(spark, d):
    points, cells, faces, _ = order_mesh(spark, d)
    shared = mesh.shared_face(faces, mesh.cell_geometry(cells, points))
    return shared.select("edge_id", "src", "dst",
                         *[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) for c in ("sx", "sy", "alpha")])


BOUNDARY_SQL = "SELECT f.id AS bface_id, f.c AS cell, -{0} AS bsx, -{1} AS bsy ".format(
    *_normal_sql("g.x,g.y", "a.x,a.y", "b.x,b.y")) + (
    "FROM bfaces f JOIN geo g ON f.c = g.c JOIN points a ON f.a = a.id JOIN points b ON f.b = b.id")


@queries.query(f"""
WITH {MESH_SQL}, bound AS ({BOUNDARY_SQL})
SELECT bface_id, cell, round(bsx, 9) + 0.0 AS bsx, round(bsy, 9) + 0.0 AS bsy FROM bound""")
def mesh_boundary(spark, d):
    points, cells, _, bfaces = order_mesh(spark, d)
    normals = mesh.boundary_normal(bfaces, mesh.cell_geometry(cells, points), points)
    return normals.select("bface_id", "cell", *[
        (F.round(c, DIGITS) + F.lit(0.0)).alias(c) for c in ("bsx", "bsy")])


@queries.query(f"""
WITH {MESH_SQL}, shared AS (SELECT f.id AS edge_id, src, dst, {SHARED_COLUMNS} FROM {SHARED_FROM}),
per_cell AS (SELECT dst AS c, count(*) AS n, sum(CAST(round_even(alpha * 1e6, 0) AS BIGINT)) AS a
  FROM shared GROUP BY 1)
SELECT g.c AS cell_id, round(x, 9) AS x, round(y, 9) AS y, round(area, 9) AS area,
  CAST(coalesce(n, 0) AS BIGINT) AS faces, CAST(coalesce(a, 0) AS DOUBLE) / 1e6 AS alpha
FROM geo g LEFT JOIN per_cell USING (c)""", "mesh_job")
def mesh_job_query(spark, d):
    """The whole job, file to files; the result brings its tables together by cell."""
    path = written_job(spark, d)
    shared = spark.read.parquet(f"{path}/out/faces").select("edge_id", "alpha")
    ends = spark.read.parquet(f"{path}/in/faces").select(F.col("edge_id").alias("e"), "dst")
    faces = shared.join(ends, F.col("edge_id") == F.col("e"))
    cells = spark.read.parquet(f"{path}/out/cells")
    sums = scatter_combine([
        (faces, "dst", {"faces": V([F.lit(1.0)]), "alpha": V.of("alpha")})],
        cells, id="cell_id", scale=6)
    return cells.join(sums, cells["cell_id"] == sums["id"]).select(
        "cell_id", *[F.round(c, DIGITS).alias(c) for c in ("x", "y", "area")],
        F.col("faces").cast("bigint").alias("faces"), "alpha")


def written_job(spark, d) -> str:
    """Folder with the input and the output of the mesh job."""
    path = written_path(spark, "mesh")
    for name, df in zip(("points", "cells", "faces", "bfaces"), order_mesh(spark, d)):
        df.write.parquet(f"{path}/in/{name}", compression="zstd")
    mesh_job(spark, f"{path}/in", f"{path}/out")
    return path


def rounded(*columns: str):
    return [(F.round(c, DIGITS) + F.lit(0.0)).alias(c) for c in columns]


def by_id(spark, path: str, topology: str, geometry: str, id: str):
    """A topology and a geometry table of the job side by side."""
    return spark.read.parquet(f"{path}/out/{topology}").join(
        spark.read.parquet(f"{path}/out/{geometry}"), id)


@queries.query(f"""
WITH {MESH_SQL}, shared AS (SELECT f.id AS edge_id, src, dst, {SHARED_COLUMNS} FROM {SHARED_FROM})
SELECT edge_id, s.p0 AS src_p0, s.p1 AS src_p1, s.p2 AS src_p2, t.p0 AS dst_p0, t.p1 AS dst_p1,
  t.p2 AS dst_p2, round(sx, 9) + 0.0 AS sx, round(sy, 9) + 0.0 AS sy, round(alpha, 9) + 0.0 AS alpha
FROM shared JOIN cells s ON src = s.c JOIN cells t ON dst = t.c""")
def mesh_job_faces(spark, d):
    """Tables ``face_points`` and ``faces`` of the job."""
    both = by_id(spark, written_job(spark, d), "face_points", "faces", "edge_id")
    return both.select("edge_id", *[f"{e}_p{k}" for e in ("src", "dst") for k in range(3)],
                       *rounded("sx", "sy", "alpha"))


@queries.query(f"""
WITH {MESH_SQL}, bound AS ({BOUNDARY_SQL})
SELECT bface_id, a AS bp0, b AS bp1, round(bsx, 9) + 0.0 AS bsx, round(bsy, 9) + 0.0 AS bsy
FROM bound JOIN bfaces ON id = bface_id""")
def mesh_job_boundary(spark, d):
    """Tables ``boundary_points`` and ``bfaces`` of the job."""
    both = by_id(spark, written_job(spark, d), "boundary_points", "bfaces", "bface_id")
    return both.select("bface_id", "bp0", "bp1", *rounded("bsx", "bsy"))


@queries.query(f"""
WITH {MESH_SQL}
SELECT c AS cell_id, p0 AS cells_p0, p1 AS cells_p1, p2 AS cells_p2, round(x, 9) + 0.0 AS x,
  round(y, 9) + 0.0 AS y, round(area, 9) + 0.0 AS area,
  round(1 + 0.1::DOUBLE * exp(-100 * (x * x + y * y)), 9) + 0.0 AS h FROM geo JOIN cells USING (c)""")
def mesh_job_topology(spark, d):
    """Tables ``cell_points`` and ``cells`` of the job."""
    both = by_id(spark, written_job(spark, d), "cell_points", "cells", "cell_id")
    return both.select("cell_id", *[f"cells_p{k}" for k in range(3)],
                       *rounded("x", "y", "area", "h"))
