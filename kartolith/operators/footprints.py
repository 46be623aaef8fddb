"""Edit histograms and footprints: points to cells to pyramids to tile tables, created or updated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from . import tiles


def edit_histogram(points: DataFrame, facets: list[str] | None = None, grid: tiles.Grid = tiles.HISTOGRAM, zooms: list[int] | None = None) -> DataFrame:
    """points: key (day), lon, lat [, facet columns]; result: key, z, x, y, cell, value."""
    if facets:
        rows = tiles.facet_rows(points.select("key", "lon", "lat", *facets), facets)
        cells = tiles.points_to_cells(rows, grid, "key", value=F.col("value"))
    else:
        cells = tiles.points_to_cells(points, grid, "key")
    return tiles.pyramid(cells, grid, "key", zooms=zooms)


def footprints(points: DataFrame, grid: tiles.Grid = tiles.FOOTPRINT, zooms: list[int] | None = None) -> DataFrame:
    """points: key (user or hashtag), lon, lat; result: key, z, x, y, cell, value (density)."""
    return tiles.pyramid(tiles.points_to_cells(points, grid, "key"), grid, "key", zooms=zooms)


def update(stored: DataFrame, committed: DataFrame, points: DataFrame, grid: tiles.Grid, zooms: list[int] | None = None, keep: int = tiles.KEEP_SEQUENCES, value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, committed) after adding points with a ``sequence`` (``value``: a positive column to add up instead of rows); a sequence a tile holds already adds nothing.

    Of the sequences of a tile the newest ``keep`` stay in ``committed``.  The cells of the points and the tiles that don't hold their sequences yet
    are found once and kept in the shared folder; if there are none, both tables are returned as they are.
    """
    zooms = list(range(grid.base_zoom + 1)) if zooms is None else zooms
    base = session.stored(tiles.rasterize(tiles.points_to_cells(points, grid, "key", "sequence", value=F.col(value) if value else None), "key", "sequence"), "cells")
    at_tile = base.select("sequence", F.shiftright("gx", grid.bits).alias("bx"), F.shiftright("gy", grid.bits).alias("by")).distinct()
    up = lambda c: F.expr(f"shiftright({c}, {grid.base_zoom} - z)")
    touched = at_tile.withColumn("z", F.explode(F.array(*map(F.lit, zooms)))).select(F.col("z").cast("int"), up("bx").alias("x"), up("by").alias("y"), "sequence").distinct()
    held = committed.join(base.select("sequence").distinct(), "sequence", "left_semi")
    again = not held.isEmpty()
    fresh = session.stored(tiles.uncommitted(touched, held) if again else touched, "fresh")
    if fresh.isEmpty():
        return stored, committed
    known = committed.select("z", "x", "y", "sequence").union(fresh.select("z", "x", "y", "sequence"))
    if known.select("sequence").distinct().limit(keep + 1).count() > keep:  # else no tile holds more
        known = tiles.newest_sequences(known, keep)
    cells = tiles.fan_out(base, grid, zooms, "key", "sequence")
    if again:
        cells = cells.join(fresh, ["z", "x", "y", "sequence"], "left_semi")
    return tiles.merge_cells(stored, cells, "key"), known


def target_points(nodes: DataFrame, changeset_hashtags: DataFrame, users: DataFrame | None = None, hashtags: DataFrame | None = None, by: str = "user") -> DataFrame:
    """Node rows to draw, keyed by user or by hashtag, restricted to the users who used a listed hashtag, or to listed hashtags."""
    if by == "user":
        if hashtags is not None:
            used = changeset_hashtags.join(hashtags, "hashtag", "left_semi").select("changeset")
            users = nodes.join(used, "changeset", "left_semi").select("uid").distinct()
        rows = nodes if users is None else nodes.join(users, "uid", "left_semi")
        return rows.withColumn("key", F.col("uid").cast("string"))
    tags = changeset_hashtags if hashtags is None else changeset_hashtags.join(hashtags, "hashtag", "left_semi")
    return nodes.join(tags, "changeset").withColumn("key", F.col("hashtag"))


def changeset_bounds(nodes: DataFrame) -> DataFrame:
    """Centre, extent and node count per user and changeset."""
    return nodes.groupBy("uid", "changeset").agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), (F.max("lon") - F.min("lon")).alias("width"), (F.max("lat") - F.min("lat")).alias("height"), F.count("*").alias("nodes")
    )
