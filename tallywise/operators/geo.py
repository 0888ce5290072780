"""Regions: enrichment by name and tagging of points by polygon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def region_enrich(regions: DataFrame, attributes: DataFrame, region_name: str, attribute_name: str,
                  columns: Sequence[str]) -> DataFrame:
    """Left join on differently named keys; the attribute side's key is kept, NULL where unmatched."""
    joined = regions.join(attributes, regions[region_name] == attributes[attribute_name], "left")
    return joined.select(regions[region_name], *[attributes[c] for c in [attribute_name, *columns]])


def polygon_edges(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygons with their edges as one array and their bounding box."""
    def ring_edges(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))

    edges = F.flatten(F.transform(rings, ring_edges))
    bound = lambda pick, f: pick(F.transform("edges", lambda e: e[f]))
    return polygons.withColumn("edges", edges).withColumns({
        "min_x": bound(F.array_min, "x1"), "max_x": bound(F.array_max, "x1"),
        "min_y": bound(F.array_min, "y1"), "max_y": bound(F.array_max, "y1"),
    }).drop(rings)


def strictly_inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd ray casting over all rings; a point on an edge is outside."""
    def crosses(e: Column) -> Column:
        # The quotient is only taken where the two ends lie on different sides, so y2 != y1.
        at = e["x1"] + F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"])
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)

    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd & ~F.exists(edges, touches)


def tag_points(points: DataFrame, polygons: DataFrame, point_id: str, x: str = "lon", y: str = "lat",
               cell: float = 5.0, name: str = "region") -> DataFrame:
    """Each point with the last polygon (by ``ord``) it lies strictly within, ``''`` for none.

    Points meet polygons by an equi-join on grid cells of ``cell`` degrees that the polygon's box
    covers: a crowded cell can be split over tasks, and no point is compared with a far polygon.
    ``ord`` is unique per polygon.
    """
    size = F.lit(cell)
    grid = lambda c: F.floor(c / size)
    boxed = polygon_edges(polygons)
    covering = boxed.select(
        "*", F.explode(F.sequence(grid(F.col("min_x")), grid(F.col("max_x")))).alias("_cx"),
    ).select("*", F.explode(F.sequence(grid(F.col("min_y")), grid(F.col("max_y")))).alias("_cy"))
    located = points.select(
        point_id, F.col(x).alias("_x"), F.col(y).alias("_y"), grid(F.col(x)).alias("_cx"), grid(F.col(y)).alias("_cy"))
    pairs = located.join(covering, ["_cx", "_cy"], "left")
    px, py = F.col("_x"), F.col("_y")
    near = px.between(F.col("min_x"), F.col("max_x")) & py.between(F.col("min_y"), F.col("max_y"))
    hit = F.when(near, F.when(strictly_inside(px, py, F.col("edges")), F.col("ord")))
    last = pairs.groupBy(point_id).agg(F.max(hit).alias("ord"))
    named = last.join(polygons.select("ord", F.col("name").alias("_name")), "ord", "left")
    return named.select(point_id, F.coalesce("_name", F.lit("")).alias(name))
