import math

import pytest
from pyspark.sql import functions as F

from edgeframe import V, scatter_combine
from edgeframe.operators import mesh
from edgeframe.plans import grid_mesh, mesh_job

K = 5


@pytest.fixture(scope="module")
def tables(spark):
    """K × K unit squares on the unit square, two triangles each."""
    cells, faces, bfaces = grid_mesh(spark.range(2 * K * K).withColumnRenamed("id", "cell_id"), K)
    points = spark.range((K + 1) ** 2).select(
        F.col("id").alias("point_id"), ((F.col("id") % (K + 1)) / F.lit(float(K))).alias("x"),
        (F.floor(F.col("id") / (K + 1)) / F.lit(float(K))).alias("y"))
    return [df.cache() for df in (points, cells, faces, bfaces)]


def test_counts(tables):
    points, cells, faces, bfaces = tables
    assert cells.count() == 50 and faces.count() == 130 and bfaces.count() == 20
    back = faces.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    assert faces.select("src", "dst").exceptAll(back).count() == 0


def test_topology(tables):
    _, cells, faces, bfaces = tables
    out = mesh.edge_cell_points(faces, cells).collect()
    by_cell = {r["cell_id"]: (r["p0"], r["p1"], r["p2"]) for r in cells.collect()}
    for r in out:
        assert (r["src_p0"], r["src_p1"], r["src_p2"]) == by_cell[r["src"]]
        assert (r["dst_p0"], r["dst_p1"], r["dst_p2"]) == by_cell[r["dst"]]
        assert len(set(by_cell[r["src"]]) & set(by_cell[r["dst"]])) == 2
    assert mesh.cell_points(cells).columns == ["cell_id", "cells_p0", "cells_p1", "cells_p2"]
    assert mesh.boundary_points(bfaces).columns == ["bface_id", "bp0", "bp1"]


def test_areas_and_centroids(tables):
    points, cells, _, _ = tables
    total = mesh.triangle_area(cells, points).agg(F.sum("area")).first()[0]
    assert math.isclose(total, 1.0)
    c = mesh.centroid(cells, points).where("cell_id = 0").first()
    assert math.isclose(c["x"], 2 / 3 / K) and math.isclose(c["y"], 1 / 3 / K)


def test_normals_close_around_every_cell(tables):
    points, cells, faces, bfaces = tables
    geo = mesh.cell_geometry(cells, points)
    shared = mesh.shared_face(faces, geo)
    assert all(math.isclose(r["alpha"], 0.5) for r in shared.collect())
    bounds = mesh.boundary_normal(bfaces, geo, points)
    sums = scatter_combine([(shared, "dst", {"x": V.of("sx"), "y": V.of("sy")}),
                            (bounds, "cell", {"x": V.of("bsx"), "y": V.of("bsy")})], 2 * K * K)
    rows = sums.collect()
    assert len(rows) == 50
    assert all(abs(r["x"]) < 1e-12 and abs(r["y"]) < 1e-12 for r in rows)
    lengths = [round(math.hypot(r["sx"], r["sy"]), 9) for r in shared.collect()]
    assert set(lengths) == {0.2, round(0.2 * math.sqrt(2), 9)}


def test_normal_points_away_from_the_third_corner(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 1.0, 1.0)],
                               "ax double, ay double, bx double, by double, cx double, cy double")
    n = mesh.face_normal(V.of("ax", "ay"), V.of("bx", "by"), V.of("cx", "cy"))
    assert tuple(df.select(*n.columns("n")).first()) == (1.0, 0.0)


def test_alpha_of_parallel_lines_is_zero(spark):
    z, o = F.lit(0.0), F.lit(1.0)
    alpha = mesh.line_intersection_alpha(V([z, z]), V([o, z]), V([z, o]), V([o, o]))
    assert spark.range(1).select(alpha.column).first()[0] == 0.0


def test_job_writes_what_the_operators_compute(spark, tables, tmp_path):
    for name, df in zip(("points", "cells", "faces", "bfaces"), tables):
        df.write.parquet(str(tmp_path / "in" / name))
    out = mesh_job(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    read = {n: spark.read.parquet(f"{out}/{n}") for n in (
        "face_points", "cell_points", "boundary_points", "cells", "faces", "bfaces")}
    assert [read[n].count() for n in read] == [130, 50, 20, 50, 130, 20]
    assert read["cells"].columns == ["cell_id", "x", "y", "area", "h"]
    r = read["cells"].where("cell_id = 3").first()
    assert math.isclose(r["h"], 1 + 0.1 * math.exp(-100 * (r["x"] ** 2 + r["y"] ** 2)))
    assert read["faces"].columns == ["edge_id", "sx", "sy", "alpha"]
    assert read["bfaces"].columns == ["bface_id", "bsx", "bsy"]


def naive_shared(p, q):
    """Shared face of two triangles by plain arithmetic, last match wins."""
    def normal(a, b, c):
        s = (b[0] - c[0]) * (a[1] - c[1]) - (b[1] - c[1]) * (a[0] - c[0])
        s = (s > 0) - (s < 0)
        return s * (b[1] - c[1]), -s * (b[0] - c[0])

    centre = tuple(sum(c) / 3.0 for c in zip(*q))
    found = (0.0, 0.0)
    for a, b, t in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        own, far = normal(p[t], p[a], p[b]), normal(centre, p[a], p[b])
        if own[0] * far[0] + own[1] * far[1] < 0:
            found = own
    return found


def test_shared_face_on_a_crooked_mesh(spark, tables):
    points, cells, faces, _ = tables
    shaken = points.select("point_id", (F.col("x") + F.sin(F.col("point_id") * 7) * 0.03).alias("x"),
                           (F.col("y") + F.cos(F.col("point_id") * 5) * 0.03).alias("y")).cache()
    at = {r["point_id"]: (r["x"], r["y"]) for r in shaken.collect()}
    tri = {r["cell_id"]: [at[r[f"p{i}"]] for i in range(3)] for r in cells.collect()}
    for r in mesh.shared_face(faces, mesh.cell_geometry(cells, shaken)).collect():
        want = naive_shared(tri[r["src"]], tri[r["dst"]])
        assert math.isclose(r["sx"], want[0], abs_tol=1e-12)
        assert math.isclose(r["sy"], want[1], abs_tol=1e-12)


def test_the_mesh_job_moves_and_stores_little(spark, tables, tmp_path):
    """Sides move as two numbers, ``dst`` is gathered before ``src``, corners alone are stored."""
    points, cells, faces, bfaces = tables
    fresh = spark.range(12).withColumnRenamed("id", "cell_id").union(
        spark.createDataFrame([(None,), (3,), (-1,)], "cell_id long"))
    _, some, edge = grid_mesh(fresh, 2)
    for side in (some, edge):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "struct(k, 0, to" in plan and "struct(k, 0, a" not in plan
    assert sorted(tuple(r) for r in edge.where("cell = 0").collect()) == [(0, 0, 0, 1)]
    assert edge.where("cell IS NULL").count() == 3
    both = some.select("edge_id", "src").union(edge.select("bface_id", "cell"))
    assert {r[0] for r in both.where("src = -1").collect()} == {-3, -2, -1}
    geometry = mesh.cell_geometry(cells, points)
    ends = mesh.shared_face(faces, geometry)._jdf.queryExecution().analyzed().toString()
    assert ends.index("AS s_x0") < ends.index("AS d_x")       # printed from the last join on
    for name, df in zip(("points", "cells", "faces", "bfaces"), tables):
        df.write.parquet(f"{tmp_path}/in/{name}")
    mesh_job(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/corners").columns == [
        "cell_id", "x0", "y0", "x1", "y1", "x2", "y2"]
