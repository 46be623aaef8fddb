"""Country lookup: points in polygons by a grid-cell equi join, and an exact ray cast where a border runs through the cell.

Cells inside a country carry its row alone; polygons are joined to the points of border cells only, by the country's key.  Both
tables are small beside the points, and AQE turns the joins into broadcasts when their measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a ring of ``struct<x,y>`` (closed or not) covers the point by the crossing number."""
    n = F.size(ring)
    step = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(False),
        lambda acc, i: acc
        != (
            ((ring[i]["y"] > lat) != (ring[(i + n - 1) % n]["y"] > lat))
            & (lon < (ring[(i + n - 1) % n]["x"] - ring[i]["x"]) * (lat - ring[i]["y"]) / F.nullif(ring[(i + n - 1) % n]["y"] - ring[i]["y"], F.lit(0.0)) + ring[i]["x"])
        ),
    )
    return F.coalesce(step, F.lit(False))


def _covered(lon: Column, lat: Column) -> Column:
    """Whether a polygon of ``polygons`` holds the point; holes do not count."""
    return F.exists("polygons", lambda rings: F.aggregate(rings, F.lit(False), lambda acc, ring: acc != inside(lon, lat, ring)))


def cover(countries: DataFrame, size: float) -> DataFrame:
    """country, cx, cy, border: the cells of ``size`` degrees that a country (country, polygons) fills, or that its border may touch."""
    edges = countries.select("country", F.explode(F.flatten("polygons")).alias("ring")).select("country", F.posexplode("ring").alias("i", "p"), "ring")
    edges = edges.select("country", "p", F.element_at("ring", (F.col("i") + 1) % F.size("ring") + 1).alias("q"))
    cells = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    border = edges.withColumn("cx", F.explode(cells(F.col("p.x"), F.col("q.x")))).withColumn("cy", F.explode(cells(F.col("p.y"), F.col("q.y")))).select("country", "cx", "cy").distinct()
    points = F.flatten(F.flatten("polygons"))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    every = countries.withColumn("cx", F.explode(cells(F.array_min(xs), F.array_max(xs)))).withColumn("cy", F.explode(cells(F.array_min(ys), F.array_max(ys))))
    filled = every.join(border, ["country", "cx", "cy"], "left_anti").where(_covered((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size))
    return border.withColumn("border", F.lit(True)).unionByName(filled.select("country", "cx", "cy", F.lit(False).alias("border")))


def lookup(points: DataFrame, countries: DataFrame, size: float = 2.0) -> DataFrame:
    """points with lon, lat joined to the countries (code, polygons) that cover them; holes do not count."""
    known = countries.withColumn("country", F.xxhash64(*countries.columns))
    grid = cover(known.select("country", "polygons").distinct(), size)
    near = points.withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)}).join(grid, ["cx", "cy"]).drop("cx", "cy")
    shapes = known.select(F.col("country").alias("shape"), "polygons").distinct()
    tried = near.join(known.drop("polygons"), "country").join(shapes, F.when(F.col("border"), F.col("country")) == F.col("shape"), "left")
    return tried.where(~F.col("border") | _covered(F.col("lon"), F.col("lat"))).drop("polygons", "shape", "border", "country")


def geocode(rows: DataFrame, key: str, countries: DataFrame, size: float = 10.0) -> DataFrame:
    """(key, countries): sorted distinct codes of all vertices of a row."""
    return lookup(rows, countries, size).groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("countries"))


def within_clip(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points (lon, lat) inside one ring: bounds first, so the scan can skip, then the exact test."""
    xs, ys = [x for x, _ in ring], [y for _, y in ring]
    shape = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    return points.where(F.col("lon").between(min(xs), max(xs)) & F.col("lat").between(min(ys), max(ys))).where(inside(F.col("lon"), F.col("lat"), shape))
