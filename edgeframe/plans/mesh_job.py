"""The batch mesh job: mesh tables in, topology and geometry tables out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from edgeframe.functions.vec import V
from edgeframe.operators import mesh


def mesh_job(spark: SparkSession, mesh_path: str, out_path: str) -> str:
    """Read ``points, cells, faces, bfaces`` under ``mesh_path``; write six tables.

    Topology: ``face_points`` (src_p*, dst_p*), ``cell_points``, ``boundary_points``.
    Geometry: ``cells`` (x, y, area, h), ``faces`` (sx, sy, alpha), ``bfaces``
    (bsx, bsy).  Corners of cells are stored once, as ``corners``, and serve all three;
    centroids and areas are worked out of them again.
    """
    points, cells, faces, bfaces = (
        spark.read.parquet(f"{mesh_path}/{name}") for name in ("points", "cells", "faces", "bfaces"))

    def store(df, name):
        df.write.mode("overwrite").parquet(f"{out_path}/{name}", compression="zstd")

    store(mesh.edge_cell_points(faces, cells).drop("src", "dst"), "face_points")
    store(mesh.cell_points(cells), "cell_points")
    store(mesh.boundary_points(bfaces), "boundary_points")

    store(mesh.with_corners(cells.select("cell_id", *[f"p{i}" for i in mesh.CORNERS]), points)
          .drop(*[f"p{i}" for i in mesh.CORNERS]), "corners")
    geometry = mesh.shape_of(spark.read.parquet(f"{out_path}/corners"))
    field = mesh.gaussian_field(V.of("x"), V.of("y")).column
    store(geometry.select("cell_id", "x", "y", "area", field.alias("h")), "cells")
    store(mesh.shared_face(faces, geometry).select("edge_id", "sx", "sy", "alpha"), "faces")
    store(mesh.boundary_normal(bfaces, geometry, points).select("bface_id", "bsx", "bsy"),
          "bfaces")
    return out_path


def grid_mesh(cells, width: int):
    """Mesh tables of a strip of unit squares, two triangles each, from a table of cell ids.

    ``cells(cell_id)``: cell 2q is the lower and 2q+1 the upper triangle of square q;
    squares run left to right, ``width`` to a row.  Returns ``(cells, faces, bfaces)``;
    a side whose neighbour is not in the table is a boundary face.
    """
    w = F.lit(width).cast("bigint")
    q = F.call_function("div", F.col("cell_id"), F.lit(2).cast("bigint"))
    i, j = q % w, F.call_function("div", q, w)
    upper = F.col("cell_id") % 2 == 1

    def point(right: int, up: int):
        return (j + up) * (w + 1) + i + right

    def shape(rows):
        return rows.select(
            "*", q.alias("_q"), i.alias("_i"),
            point(0, 0).alias("p0"),
            F.when(upper, point(1, 1)).otherwise(point(1, 0)).alias("p1"),
            F.when(upper, point(0, 1)).otherwise(point(1, 1)).alias("p2"))

    shaped = shape(cells.select("cell_id"))
    corners = shaped.select("cell_id", "p0", "p1", "p2")

    def side(k: int, neighbour):
        return F.struct(F.lit(k).alias("k"), neighbour.cast("bigint").alias("to"))

    c, at, step = F.col("cell_id"), F.col("_q"), F.col("_i")
    none = F.lit(None).cast("bigint")
    sides = F.array(
        side(0, F.when(upper, c - 1).otherwise(2 * (at - w) + 1)),
        side(1, F.when(upper, 2 * (at + w)).when(step < w - 1, 2 * (at + 1) + 1)
             .otherwise(none)),
        side(2, F.when(upper & (step > 0), 2 * (at - 1)).when(upper, none)
             .otherwise(c + 1)))
    # Sides meet their neighbours by number; their cell and points follow from it afterwards.
    all_sides = shaped.select(c.alias("cell_id"), F.explode(sides).alias("s")).select(
        (c * 3 + F.col("s.k")).alias("side_id"), "s.to")
    known = cells.select(F.col("cell_id").alias("_known"))
    met = all_sides.join(known, all_sides["to"] == known["_known"], "left")
    k = F.pmod(F.col("side_id"), F.lit(3).cast("bigint"))
    cell = F.call_function("div", F.col("side_id") - k, F.lit(3).cast("bigint"))
    faces = met.where("_known IS NOT NULL").select(
        F.col("side_id").alias("edge_id"), cell.alias("src"), F.col("to").alias("dst"))
    bfaces = shape(met.where("_known IS NULL").select(
        "side_id", k.alias("_k"), cell.alias("cell_id"))).select(
        F.col("side_id").alias("bface_id"), F.col("cell_id").alias("cell"),
        F.when(F.col("_k") == 0, F.col("p0")).when(F.col("_k") == 1, F.col("p1"))
        .otherwise(F.col("p2")).alias("p0"),
        F.when(F.col("_k") == 0, F.col("p1")).when(F.col("_k") == 1, F.col("p2"))
        .otherwise(F.col("p0")).alias("p1"))
    return corners, faces, bfaces
