"""Geometry of triangular meshes held as tables.

``points(point_id, x, y)``, ``cells(cell_id, p0, p1, p2)``, ``faces(edge_id, src, dst)``
(directed adjacency of cells) and ``bfaces(bface_id, cell, p0, p1)``.

Coordinates are gathered onto cells first (one join and one sum by cell); faces then
take whole cells from its result (two joins), not six single points.  A cell has three
faces at most, so joins from faces to cells have no hot keys; a point may belong to any
number of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeframe.functions.vec import V, where
from edgeframe.operators.assign import expand
from edgeframe.operators.gather import Gather, gather_many

CORNERS = (0, 1, 2)
FACES = ((0, 1, 2), (1, 2, 0), (2, 0, 1))   # two corners of a face and the third corner


def edge_cell_points(faces: DataFrame, cells: DataFrame) -> DataFrame:
    """``faces`` plus the point ids of both cells: ``src_p0 … src_p2, dst_p0 … dst_p2``."""
    return gather_many(faces, [
        Gather(cells, end, {f"{end}_p{i}": f"p{i}" for i in CORNERS}, id="cell_id")
        for end in ("src", "dst")], skew="off")


def cell_points(cells: DataFrame) -> DataFrame:
    """``(cell_id, cells_p0, cells_p1, cells_p2)``."""
    return cells.select("cell_id", *[F.col(f"p{i}").alias(f"cells_p{i}") for i in CORNERS])


def boundary_points(bfaces: DataFrame) -> DataFrame:
    """``(bface_id, bp0, bp1)``."""
    return bfaces.select("bface_id", F.col("p0").alias("bp0"), F.col("p1").alias("bp1"))


def with_corners(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``cells`` plus their corners: ``x0, y0 … x2, y2``.

    One row per corner takes its point in a single join; one aggregation by cell brings
    the three back together.  Corners move to their cell before they are spread over columns,
    of which each fills two.  Cell ids are unique.
    """
    rest = [c for c in cells.columns if c != "cell_id"]
    long = cells.select("*", F.posexplode(F.array(*[f"p{i}" for i in CORNERS]))
                        .alias("_corner", "_point"))
    met = gather_many(long, [Gather(points, "_point", {"x": "x", "y": "y"}, id="point_id")])
    at = {f"{a}{i}": F.max(F.when(F.col("_corner") == i, F.col(a)))
          for i in CORNERS for a in ("x", "y")}
    return met.drop("_point").repartition("cell_id").groupBy("cell_id").agg(
        *[F.max(c).alias(c) for c in rest], *[v.alias(n) for n, v in at.items()]).select(
        *cells.columns, *at)


def corner(i: int, prefix: str = "") -> V:
    return V.of(f"{prefix}x{i}", f"{prefix}y{i}")


def mean_point(p0: V, p1: V, p2: V) -> V:
    return (p0 + p1 + p2) / 3.0


def area_of(p0: V, p1: V, p2: V) -> V:
    """Half the absolute cross sum of the corners."""
    total = p0[0] * (p1[1] - p2[1]) + p1[0] * (p2[1] - p0[1]) + p2[0] * (p0[1] - p1[1])
    return 0.5 * abs(total)


def centroid(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``(cell_id, x, y)``: the mean of the three corners."""
    c = mean_point(*[corner(i) for i in CORNERS])
    return with_corners(cells, points).select(
        "cell_id", c[0].column.alias("x"), c[1].column.alias("y"))


def triangle_area(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``(cell_id, area)``."""
    a = area_of(*[corner(i) for i in CORNERS])
    return with_corners(cells, points).select("cell_id", a.column.alias("area"))


def cell_geometry(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Corners, centroid ``x, y`` and ``area`` of every cell, in one pass."""
    return shape_of(with_corners(cells, points))


def shape_of(corners: DataFrame) -> DataFrame:
    """``cell_geometry`` of cells that have their corners."""
    p = [corner(i) for i in CORNERS]
    c = mean_point(*p)
    return corners.select(
        "cell_id", *[f"{a}{i}" for i in CORNERS for a in "xy"],
        c[0].column.alias("x"), c[1].column.alias("y"), area_of(*p).column.alias("area"))


def normal_side(p0: V, p1: V, p2: V) -> V:
    """Which way the normal of p1–p2 must turn to point away from p0: -1, 0 or 1."""
    along, off = p1 - p2, p0 - p2
    return (along[0] * off[1] - along[1] * off[0]).sign()


def turned(side: V, p1: V, p2: V) -> V:
    """The normal of p1–p2 on the given side, as long as the face."""
    along = p1 - p2
    return V([(side * along[1]).column, (-side * along[0]).column])


def face_normal(p0: V, p1: V, p2: V) -> V:
    """Normal of the face p1–p2, as long as the face, pointing away from p0."""
    return turned(normal_side(p0, p1, p2), p1, p2)


def line_intersection_alpha(a: V, b: V, p0: V, p1: V) -> V:
    """Where the line p0–p1 meets the segment a → b, as a share of it; 0 if parallel."""
    face, off, path = p1 - p0, p0 - a, b - a
    return ((off[0] * face[1] - off[1] * face[0])
            / (path[0] * face[1] - path[1] * face[0]))


def shared_face(faces: DataFrame, geometry: DataFrame) -> DataFrame:
    """``(edge_id, src, dst, sx, sy, alpha)``: the face between two adjacent cells.

    A face of ``src`` is the shared one when its normals seen from its own third
    corner and from the centroid of ``dst`` oppose each other.  Faces 01, 12 and 20 are
    tried in turn and the last match wins; without a match all are 0.  The normal
    points out of ``src``; ``alpha`` is where the line between the centroids meets it.
    """
    # The two values of ``dst`` first: they move on to ``src``, whose eight then stay.
    ends = gather_many(faces, [
        Gather(geometry, "dst", {"d_x": "x", "d_y": "y"}, id="cell_id"),
        Gather(geometry, "src", {f"s_{c}": c for c in
                                 ("x0", "y0", "x1", "y1", "x2", "y2", "x", "y")}, id="cell_id")],
        skew="off")
    p = [corner(i, "s_") for i in CORNERS]
    src, dst = V.of("s_x", "s_y"), V.of("d_x", "d_y")
    # Every value used more than once gets a column of its own: nested expressions would
    # repeat it in the generated code at each use.
    for k, (a, b, third) in enumerate(FACES):
        ends = ends.withColumns({f"_own{k}": normal_side(p[third], p[a], p[b]).column,
                                 f"_far{k}": normal_side(dst, p[a], p[b]).column})
    for k, (a, b, _) in enumerate(FACES):
        own = turned(V.of(f"_own{k}"), p[a], p[b])
        far = turned(V.of(f"_far{k}"), p[a], p[b])
        ends = ends.withColumns({**expand({f"_n{k}": own}),
                                 f"_m{k}": ((own[0] * far[0] + own[1] * far[1]) < 0).column})
    normal, alpha = V.fill(0.0, 2), V.fill(0.0)
    for k, (a, b, _) in enumerate(FACES):
        opposed = V.of(f"_m{k}")
        normal = where(opposed, V.of(f"_n{k}_0", f"_n{k}_1"), normal)
        alpha = where(opposed, line_intersection_alpha(src, dst, p[a], p[b]), alpha)
    return ends.select("edge_id", "src", "dst", normal[0].column.alias("sx"),
                       normal[1].column.alias("sy"), alpha.column.alias("alpha"))


def gaussian_field(x: V, y: V, *, base: float = 1.0, height: float = 0.1,
                   decay: float = 100.0) -> V:
    """``base + height · exp(-decay · (x² + y²))``."""
    return base + height * (-decay * (x ** 2 + y ** 2)).exp()


def boundary_normal(bfaces: DataFrame, geometry: DataFrame, points: DataFrame) -> DataFrame:
    """``(bface_id, cell, bsx, bsy)``: normals of boundary faces, pointing into the cell."""
    ends = gather_many(bfaces, [
        Gather(geometry, "cell", {"c_x": "x", "c_y": "y"}, id="cell_id"),
        Gather(points, "p0", {"x0": "x", "y0": "y"}, id="point_id"),
        Gather(points, "p1", {"x1": "x", "y1": "y"}, id="point_id")], skew="off")
    inward = -face_normal(V.of("c_x", "c_y"), corner(0), corner(1))
    return ends.select("bface_id", "cell", inward[0].column.alias("bsx"),
                       inward[1].column.alias("bsy"))
