"""Whole jobs from a history or a diff feed: changeset statistics and faceted edit histograms.

A history has id, type, tags, lat, lon, nds (array of node identifiers), changeset, timestamp, uid, version, visible.  Statistics union
way and point rows and aggregate once; tag classes of ways reach nodes as booleans, so no tag maps are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import maps, tags, time
from . import countries as lookup
from . import footprints, history, stats, tiles

#: Facets that ways give to their nodes; those of MERGED hold for the node's own tags, too.
WAY_CLASSES = {"building": tags.is_building, "road": tags.is_road, "waterway": tags.is_waterway, "poi": tags.is_poi, "coastline": tags.is_coastline}
MERGED = ("building", "poi")
FACETS = [*WAY_CLASSES, "created", "modified", "deleted", "metadata_only"]


def prepare_nodes(rows: DataFrame) -> DataFrame:
    """Node versions with validity, coordinates of deletions carried forward, and geometry_changed."""
    nodes = rows.where("type = 'node'").select("id", "tags", "lon", "lat", "changeset", "timestamp", "uid", "version", "visible")
    return history.with_validity(history.carry_forward(nodes, "lon", "lat"), "id", "timestamp", "version")


def prepare_ways(rows: DataFrame) -> DataFrame:
    ways = rows.where("type = 'way'").select("id", "tags", "nds", "changeset", "timestamp", "uid", "version", "visible")
    return history.with_validity(ways, "id", "timestamp", "version")


def way_versions(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """changeset, id, version, updated: one row per changeset that changed a way or moved one of its nodes while it held them."""
    refs = ways.select(F.col("id").alias("way"), "version", "timestamp", "valid_until", F.explode("nds").alias("ref")).distinct()
    moved = nodes.select(F.col("id").alias("ref"), F.col("changeset"), F.col("timestamp").alias("updated")).join(refs, "ref").where(history.within(F.col("updated"), F.col("timestamp"), F.col("valid_until")))
    own = ways.select("changeset", "id", "version", F.col("timestamp").alias("updated"))
    return history.latest_versions(moved.select("changeset", F.col("way").alias("id"), "version", "updated").unionByName(own))


def way_geometries(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The way versions with tags, visible, minor_version and geom: the vertices valid at ``updated``, in way order."""
    every = way_versions(ways, nodes).join(ways.select("id", "version", "nds", "tags", "visible"), ["id", "version"])
    refs = every.select("changeset", "id", "version", "updated", F.posexplode("nds").alias("place", "ref"))
    n = nodes.select(F.col("id").alias("ref"), F.col("timestamp").alias("since"), F.col("valid_until").alias("until"), "lon", "lat").where("lon is not null and lat is not null")
    held = refs.join(n, "ref").where(history.within(F.col("updated"), F.col("since"), F.col("until")))
    lines = held.groupBy("changeset", "id", "version", "updated").agg(F.array_sort(F.collect_list(F.struct("place", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("v"))
    geom = F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    placed = every.drop("nds").join(lines.select("changeset", "id", "version", "updated", geom.alias("geom")), ["changeset", "id", "version", "updated"], "left")
    return history.with_minor_version(placed, "changeset")


def edits_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, vertices) of a history: tagged way versions with length and area deltas, and tagged points; and where each edit lies."""
    nodes, ways = prepare_nodes(rows), prepare_ways(rows)
    shaped = way_geometries(ways.where(tags.is_tagged(F.col("tags"))), nodes)
    changed = stats.with_area_delta(stats.with_linear_delta(stats.with_previous_geometry(shaped)))
    points = nodes.where(tags.is_tagged(F.col("tags"))).withColumns({"minor_version": F.lit(0), "linear_m": F.lit(0.0), "area_m2": F.lit(0.0), "updated": F.col("timestamp"), "kind": F.lit("node")})
    cols = ["kind", "id", "changeset", "tags", "version", "minor_version", "visible", "linear_m", "area_m2", "updated"]
    edits = changed.withColumn("kind", F.lit("way")).select(cols).unionByName(points.select(cols))
    key = ["kind", "id", "changeset", "updated"]
    vertices = shaped.select(F.lit("way").alias("kind"), "id", "changeset", "updated", F.explode("geom").alias("p")).select(*key, F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    return edits, vertices.unionByName(points.where("lon is not null and lat is not null").select(*key, "lon", "lat"))


def changeset_stats_from_history(rows: DataFrame, polygons: DataFrame | None = None) -> DataFrame:
    """changeset, measurements, counts, total_edits, edits and, with country polygons (code, polygons), countries (edits by code)."""
    edits, vertices = edits_of(rows)
    out = stats.changeset_stats(edits)
    if polygons is None:
        return out
    touched = lookup.lookup(vertices, polygons).select("kind", "id", "changeset", "updated", "code").distinct()
    by_code = touched.groupBy("changeset", "code").agg(F.count("*").alias("n"))
    codes = by_code.groupBy("changeset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("countries"))
    return out.join(codes, "changeset", "left")


def checkpointed(make, path: str, use: bool, spark) -> DataFrame:
    """Statistics from ``make()``, stored as ORC under ``path``; or those stored before (``use``), an error without a path."""
    if use and not path:
        raise ValueError("no checkpoint was named")
    if not use:
        out = make()
        if not path:
            return out
        out.write.mode("overwrite").option("compression", "snappy").orc(path)
    return spark.read.orc(path)


def faceted_nodes(rows: DataFrame) -> DataFrame:
    """Node versions (key, lon, lat and 0/1 facets) with the classes of the ways that held them at the time."""
    nodes, ways = (p(rows.where("uid > 1")) for p in (prepare_nodes, prepare_ways))
    every = way_versions(ways, nodes).join(ways.select("id", "version", "nds", "tags"), ["id", "version"])
    held = every.select("updated", F.explode("nds").alias("ref"), *[p(F.col("tags")).alias(f"of_{n}") for n, p in WAY_CLASSES.items()]).alias("w")
    n = nodes.alias("n")
    joined = held.join(n, F.col("w.ref") == F.col("n.id"), "right_outer")
    joined = joined.where(F.col("w.updated").isNull() | history.within(F.col("w.updated"), F.col("n.timestamp"), F.col("n.valid_until")))
    keys = ["id", "version", "timestamp"]
    once = joined.groupBy(*[F.col(f"n.{k}").alias(k) for k in keys]).agg(
        *[F.any_value(f"n.{c}").alias(c) for c in ("tags", "lon", "lat", "visible", "geometry_changed")], *[F.coalesce(F.bool_or(f"of_{c}"), F.lit(False)).alias(f"of_{c}") for c in WAY_CLASSES]
    )
    minor = history.with_minor_version(once.withColumn("updated", F.col("timestamp")))
    return _facets(minor, tags.is_new(F.col("version"), F.col("minor_version")), F.col("visible") & ~tags.is_new(F.col("version"), F.col("minor_version")), (F.col("minor_version") > 0) | ~F.col("geometry_changed"))


def _facets(nodes: DataFrame, created, modified, metadata_only) -> DataFrame:
    own = F.col("tags")
    flags = {n: (F.col(f"of_{n}") | p(own)) if n in MERGED else F.col(f"of_{n}") for n, p in WAY_CLASSES.items()}
    flags |= {"created": created, "modified": modified, "deleted": ~F.col("visible"), "metadata_only": metadata_only}
    rest = [c for c in ("sequence",) if c in nodes.columns]
    ok = nodes.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    return ok.select("id", "version", time.day_key(F.col("updated")).alias("key"), "lon", "lat", *rest, *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in flags.items()])


def faceted_histogram_from_history(rows: DataFrame, grid: tiles.Grid = tiles.HISTOGRAM, zooms: list[int] | None = None) -> DataFrame:
    return footprints.edit_histogram(faceted_nodes(rows).drop("id", "version"), FACETS, grid, zooms)


def known_tags(visible, now, before):
    """The tags of a visible element, the previous ones of a deleted one."""
    return F.when(visible, now).otherwise(before)


def faceted_diffs(diffs: DataFrame) -> DataFrame:
    """Node rows (key, lon, lat, sequence, facets) of augmented diffs: sequence, type, id, version, minor_version, updated, lon, lat, nds,
    tags, prev_tags, visible.

    Nodes that changed take the classes of their ways of the same sequence (major versions); nodes of changed ways appear again with the
    way's classes alone (minor versions).  A frame of whole sequences gives whole groups, so a stream runs it in foreachBatch.
    """
    current = diffs.withColumn("tags", known_tags(F.col("visible"), F.col("tags"), F.col("prev_tags")))
    nodes = current.where("type = 'node'").select("sequence", F.col("id").alias("ref"), "version", "updated", "tags", "lon", "lat", "visible")
    of = lambda ways: ways.select("sequence", "updated", F.explode("nds").alias("ref"), *[p(F.col("tags")).alias(f"of_{n}") for n, p in WAY_CLASSES.items()])
    ways = current.where("type = 'way'")
    classes = [f"of_{n}" for n in WAY_CLASSES]
    major = nodes.join(of(ways).drop("updated"), ["sequence", "ref"], "left_outer")
    minor = of(ways.where("minor_version = 0")).join(nodes.select("sequence", "ref", "version", "lon", "lat", "visible"), ["sequence", "ref"]).withColumn("tags", F.lit(None).cast("map<string,string>"))
    cols = ["sequence", F.col("ref").alias("id"), "version", "updated", "tags", "lon", "lat", "visible", *classes]
    both = major.select(cols).unionByName(minor.select(cols)).withColumn("own", F.struct(*[p(F.col("tags")).alias(n) for n, p in WAY_CLASSES.items()]))
    once = both.groupBy("sequence", "id", "version", "updated").agg(
        F.min(F.struct("lon", "lat", "visible")).alias("at"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in classes], *[F.coalesce(F.bool_or(f"own.{c}"), F.lit(False)).alias(f"own_{c}") for c in MERGED]
    )
    merged = once.select("*", "at.*").withColumns({f"of_{c}": F.col(f"of_{c}") | F.col(f"own_{c}") for c in MERGED}).withColumn("tags", F.lit(None).cast("map<string,string>"))
    new = F.col("version") == 1
    return _facets(merged, new & F.col("visible"), ~new & F.col("visible"), F.lit(False))


def counts_rows(diffs: DataFrame) -> DataFrame:
    """(sequence, changeset, uid, name, value): the 48 measures of prepared diffs, long, zero entries left out."""
    return stats.long_measures(diffs, ("sequence", "changeset", "uid"))


def wide_stats(rows: DataFrame, key: str = "changeset") -> DataFrame:
    """key, measurements, counts and total_edits of long (key, name, value) rows."""
    is_count = F.col("name").isin(stats.COUNTS)
    entry = F.struct("name", "value")
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.when(~is_count, entry))).alias("m"), F.array_sort(F.collect_list(F.when(is_count, entry))).alias("c"))
    counts = F.transform_values(F.map_from_entries("c"), lambda k, v: v.cast("long"))
    return lists.select(key, F.map_from_entries("m").alias("measurements"), counts.alias("counts")).withColumn("total_edits", maps.total(F.col("counts")))

