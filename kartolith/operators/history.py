"""Versioned elements: validity, minor versions, interval joins, tag roll-ups, way reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags

OPEN = "9999-12-31 00:00:00"


def with_validity(history: DataFrame, key: str = "id", at: str = "timestamp", *ties: str) -> DataFrame:
    """valid_until: when the next version of the same element begins; null while open."""
    return history.withColumn("valid_until", F.lead(at).over(Window.partitionBy(key).orderBy(at, *ties)))


def with_minor_version(history: DataFrame, *ties: str) -> DataFrame:
    order = Window.partitionBy("id", "version").orderBy("updated", *ties)
    return history.withColumn("minor_version", (F.row_number().over(order) - 1).cast("int"))


def carry_forward(nodes: DataFrame, *cols: str) -> DataFrame:
    """Deleted nodes take the last known values of cols; geometry_changed tells whether coordinates moved."""
    order = Window.partitionBy("id").orderBy("timestamp", "version")
    filled = nodes.withColumns({c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in cols})
    same = F.col("lon").eqNullSafe(F.lag("lon").over(order)) & F.col("lat").eqNullSafe(F.lag("lat").over(order))
    return filled.withColumn("geometry_changed", ~same)


def within(at: Column, since: Column, until: Column) -> Column:
    return (since <= at) & (at < F.coalesce(until, F.lit(OPEN).cast("timestamp_ntz")))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, since: str, until: str, how: str = "inner") -> DataFrame:
    """Rows of both whose key agrees and whose ``at`` lies in [since, until); the key drives the join."""
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & within(F.col(f"a.{at}"), F.col(f"b.{since}"), F.col(f"b.{until}")), how)


def right_outer_validity(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with the ways that held them at the time; nodes of no way stay, nodes outside every interval go."""
    w, n = ways.alias("w"), nodes.alias("n")
    joined = w.join(n, F.col("w.ref") == F.col("n.ref"), "right_outer")
    return joined.where(F.col("w.since").isNull() | within(F.col("n.updated"), F.col("w.since"), F.col("w.valid_until")))


def latest_versions(ways: DataFrame) -> DataFrame:
    return ways.groupBy("changeset", "id").agg(F.max("version").alias("version"), F.max("updated").alias("updated"))


def reduce_tags(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, tags: every tag with its distinct values joined by ``;`` in sorted order; null without any tag."""
    exploded = rows.select(*keys, F.explode_outer("tags").alias("k", "v"))
    values = exploded.select(*keys, "k", F.explode_outer(F.when(F.col("v").isNotNull(), tags.split_values(F.col("v")))).alias("v")).distinct()
    joined = values.groupBy(*keys, "k").agg(F.array_join(F.array_sort(F.collect_set("v")), ";").alias("v"))
    entries = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))
    return joined.groupBy(*keys).agg(F.array_sort(entries).alias("e")).select(*keys, F.when(F.size("e") > 0, F.map_from_entries("e")).alias("tags"))


def reconstruct_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per way version and per later move of one of its nodes: id, version, minor_version, updated, geom.

    ways: id, version, timestamp, valid_until, nds array<long>; nodes: id, timestamp, valid_until, lon, lat.
    Vertices are the node versions valid at ``updated``, in way order.
    """
    refs = ways.select(F.col("id").alias("way"), "version", "timestamp", "valid_until", F.posexplode("nds").alias("place", "ref"))
    n = nodes.select(F.col("id").alias("ref"), F.col("timestamp").alias("since"), F.col("valid_until").alias("until"), "lon", "lat")
    moves = refs.join(n, "ref").where(within(F.col("since"), F.col("timestamp"), F.col("valid_until"))).select("way", "version", F.col("since").alias("updated"))
    times = refs.select("way", "version", F.col("timestamp").alias("updated")).union(moves).distinct()
    vertices = times.join(refs.select("way", "version", "place", "ref"), ["way", "version"]).join(n, "ref").where(within(F.col("updated"), F.col("since"), F.col("until")))
    lines = vertices.groupBy("way", "version", "updated").agg(F.array_sort(F.collect_list(F.struct("place", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("v"))
    geom = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return with_minor_version(lines.select(F.col("way").alias("id"), "version", "updated", geom.alias("geom")))
