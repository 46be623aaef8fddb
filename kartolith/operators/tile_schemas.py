"""Element tables behind vector tiles: snapshot, history with validity, and authorship."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def snapshot(versions: DataFrame) -> DataFrame:
    """The latest version of every element, if it is visible."""
    last = versions.groupBy("id").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "id"]), F.struct("updated", "version", "minor_version")).alias("r"))
    return last.select("id", "r.*").where("visible")


def history(versions: DataFrame) -> DataFrame:
    """Every version with valid_until, null while open; an older event closes nothing and is kept."""
    order = Window.partitionBy("id").orderBy("updated", "version", "minor_version")
    return versions.withColumn("valid_until", F.lead("updated").over(order))


def authorship(versions: DataFrame) -> DataFrame:
    """Per element: creation time, authors, last author, versions, latest minor version."""
    latest = F.struct("updated", "version", "minor_version")
    return versions.groupBy("id").agg(
        F.min("updated").alias("created"),
        F.array_join(F.array_sort(F.collect_set("author")), ",").alias("authors"),
        F.max_by("author", F.struct("updated", "version", "minor_version", "author")).alias("last_author"),
        F.count("*").alias("versions"),
        F.max(latest)["minor_version"].alias("minor_version"),
    )


def merge_features(old: DataFrame, diffs: DataFrame, key: str = "id") -> DataFrame:
    """Three-way: untouched features stay, newer ones replace, new ones are added, deletions remove."""
    values = [c for c in old.columns if c != key]
    a, b = old.alias("a"), diffs.alias("b")
    newer = F.col("b.updated").isNotNull() & (F.col("a.updated").isNull() | (F.col("b.updated") >= F.col("a.updated")))
    merged = a.join(b, key, "full_outer").select(key, *[F.when(newer, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in values])
    return merged.where("visible") if "visible" in values else merged


def next_minor_version(stored: DataFrame, new: DataFrame) -> DataFrame:
    """new (id, version, ...) with the minor version after the stored one of the same version, else 0."""
    before = stored.select("id", F.col("version").alias("old_version"), F.col("minor_version").alias("old_minor"))
    return new.join(before, "id", "left").withColumn("minor_version", F.when(F.col("old_version") == F.col("version"), F.col("old_minor") + 1).otherwise(0).cast("int")).drop("old_version", "old_minor")


def place(features: DataFrame, zooms: range) -> DataFrame:
    """Features (id, lon, lat, ...) once for every zoom, with the tile z, x, y that holds them."""
    each = features.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    by_zoom = lambda f: F.coalesce(*[F.when(F.col("z") == z, f(z)) for z in zooms])
    x, y = by_zoom(lambda z: geo.tile_x(F.col("lon"), z)), by_zoom(lambda z: geo.tile_y(F.col("lat"), z))
    return each.withColumns({"x": x, "y": y}).where((F.col("y") >= 0) & (F.col("y") < F.expr("shiftleft(1, z)")))


def update_tiles(stored: DataFrame, diff: DataFrame, zooms: range, dry: bool = False) -> DataFrame:
    """The tile table (id, z, x, y, lon, lat, updated, visible, ...) after a diff at every zoom; ``dry``: the tiles it would touch.

    An element that moves leaves its old tile: (id, z) is the key, not the tile.
    """
    fresh = place(diff, zooms)
    if dry:
        return fresh.select("z", "x", "y").union(stored.join(diff.select("id"), "id", "left_semi").select("z", "x", "y")).distinct()
    both = stored.withColumn("key", F.struct("id", "z")).drop("id", "z"), fresh.withColumn("key", F.struct("id", "z")).drop("id", "z")
    return merge_features(both[0], both[1].select(*both[0].columns), "key").select("key.id", "key.z", *[c for c in both[0].columns if c != "key"])
