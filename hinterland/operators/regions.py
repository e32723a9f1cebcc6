"""Polygons, neighbour sets and map tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinterland.operators.joins import attach_row, lookup
from hinterland.operators.quadtree import EDGES, build_tree, locate
from hinterland.operators.windows import first_per_key
from hinterland.sources.checkpoint import materialise


def polygon_edges(
    vertices: DataFrame,
    polygon: str,
    ring: str = "group",
    order: str = "order",
    lon: str = "long",
    lat: str = "lat",
) -> DataFrame:
    """Edges of every ring, the last vertex joined to the first.

    The window runs over one ring, never over a whole map.
    """
    w = Window.partitionBy(polygon, ring).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def following(c: str) -> Column:
        return F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).cast("double")

    return vertices.select(
        polygon,
        F.col(lon).cast("double").alias("x1"), F.col(lat).cast("double").alias("y1"),
        following(lon).alias("x2"), following(lat).alias("y2"),
    )


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    polygon: str = "polyname",
    names: DataFrame | None = None,
    lon: str = "lon",
    lat: str = "lat",
    ring: str = "group",
    order: str = "order",
    vertex_lon: str = "long",
    vertex_lat: str = "lat",
    most_edges: int = EDGES,
    point_key: Sequence[str] | None = None,
) -> DataFrame:
    """Name of the polygon around each point, NULL outside all of them.

    Polygons lie in a quadtree whose cells hold at most ``most_edges`` edges, however many a
    polygon has and however densely; a point meets its own cell and tests the edges there, none
    where the cell lies inside or outside as a whole. Points on a left or lower border count as
    inside.

    Polygons of one map do not overlap; where they may, give ``point_key`` to keep the
    first polygon by name for each point. ``names`` adds columns by polygon name and has one row
    a polygon.
    """
    edges = materialise(polygon_edges(polygons, polygon, ring, order, vertex_lon, vertex_lat))
    tree = build_tree(edges, polygon, names, most_edges)
    added = [c for c in names.columns if c != polygon] if names is not None else []
    if tree is None:
        empty = polygons.select(polygon) if names is None else names
        return points.withColumns({c: F.lit(None).cast(empty.schema[c].dataType) for c in (polygon, *added)})
    placed, around = locate(points, tree, lon, lat)
    out = placed.withColumn("_qaround", F.explode_outer(around)).select(
        *points.columns, F.col("_qaround.poly").alias(polygon), *[F.col(f"_qaround.{c}").alias(c) for c in added])
    return out if point_key is None else first_per_key(out, point_key, [polygon], nulls="last")


def neighbour_set(
    adjacency: DataFrame,
    origin: object,
    origin_col: str = "orgfips",
    neighbour_col: str = "adjfips",
) -> DataFrame:
    """Neighbours of one area together with the area itself."""
    rows = adjacency.where(F.col(origin_col) == F.lit(origin)).select(origin_col, neighbour_col)
    both = F.explode(F.array(neighbour_col, origin_col)).alias(neighbour_col)
    return rows.select(origin_col, both).distinct()


def segments(
    origin: DataFrame, centres: DataFrame, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Line segments from the one point in ``origin`` to every centre."""
    start = origin.select(F.col(lon).alias("x"), F.col(lat).alias("y"))
    return attach_row(
        centres.withColumnsRenamed({lon: "xend", lat: "yend"}), start, ["x", "y"]
    )


def vertex_join(
    vertices: DataFrame, values: DataFrame, key: str, group: str = "group", order: str = "order"
) -> DataFrame:
    """Area values on map vertices in drawing order."""
    return lookup(vertices, values, key).orderBy(group, order)
