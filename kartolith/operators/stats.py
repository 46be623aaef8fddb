"""Per-changeset statistics: counts by feature class and action, lengths, areas, countries.

One wide conditional aggregation: sums combine on the map side, and maps are built once a changeset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, maps, tags

ACTIONS = ("added", "modified", "deleted")
LINES = {"road": tags.is_road, "waterway": tags.is_waterway, "coastline": tags.is_coastline, "railline": tags.is_rail_line}
AREAS = {"landuse": tags.is_landuse, "natural": tags.is_natural}
CLASSES = {
    "roads": tags.is_road, "waterways": tags.is_waterway, "coastlines": tags.is_coastline, "buildings": tags.is_building, "railway_features": tags.is_rail_feature,
    "raillines": tags.is_rail_line, "pois": tags.is_poi, "landuse": tags.is_landuse, "natural": tags.is_natural, "other": tags.is_other,
}
MEASURES = [f"{n}_km_{a}" for n in LINES for a in ACTIONS] + [f"{n}_km2_{a}" for n in AREAS for a in ACTIONS]
COUNTS = [f"{n}_{a}" for n in CLASSES for a in ACTIONS]


def action(name: str) -> Column:
    """Actions may overlap: an invisible first version is added and deleted."""
    new = tags.is_new(F.col("version"), F.col("minor_version"))
    return {"added": new, "modified": ~new & F.col("visible"), "deleted": ~F.col("visible")}[name]


def with_previous_geometry(history: DataFrame) -> DataFrame:
    order = Window.partitionBy("id").orderBy("updated", "version", "minor_version")
    return history.withColumn("prev_geom", F.lag("geom", 1).over(order))


def with_linear_delta(history: DataFrame) -> DataFrame:
    """Metres by which the length changed; 0 where the tags are not linear."""
    change = F.abs(geo.line_length(F.col("geom")) - geo.line_length(F.col("prev_geom")))
    return history.withColumn("linear_m", F.when(tags.is_linear(F.col("tags")), change).otherwise(0.0))


def with_area_delta(history: DataFrame) -> DataFrame:
    change = F.abs(geo.utm_area("geom") - geo.utm_area("prev_geom"))
    return history.withColumn("area_m2", change)


def _flagged(edits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, one boolean a class and an action, metres and square metres: every predicate is evaluated once a row."""
    t = F.col("tags")
    flags = {**{f"is_{n}": p(t) for n, p in CLASSES.items()}, **{f"is_{n}": p(t) for n, p in {**LINES, **AREAS}.items()}, **{f"was_{a}": action(a) for a in ACTIONS}}
    return edits.select(*keys, "linear_m", "area_m2", *[c.alias(n) for n, c in flags.items()])


def _sums() -> list[Column]:
    on = lambda n, a: F.col(f"is_{n}") & F.col(f"was_{a}")
    out = [F.sum(F.when(on(n, a), F.col("linear_m") / 1000.0).otherwise(0.0)).alias(f"m_{n}_km_{a}") for n in LINES for a in ACTIONS]
    out += [F.sum(F.when(on(n, a), F.col("area_m2") / 1000000.0).otherwise(0.0)).alias(f"m_{n}_km2_{a}") for n in AREAS for a in ACTIONS]
    return out + [F.count_if(on(n, a)).alias(f"c_{n}_{a}") for n in CLASSES for a in ACTIONS]


def changeset_stats(edits: DataFrame, keys: tuple[str, ...] = ("changeset",)) -> DataFrame:
    """keys, measurements map, counts map, total_edits, edits (rows)."""
    wide = _flagged(edits, keys).groupBy(*keys).agg(*_sums(), F.count("*").alias("edits"))
    total = reduce(lambda a, b: a + b, (F.col(f"c_{n}") for n in COUNTS))
    return wide.select(*keys, maps.from_columns(MEASURES, "m_").alias("measurements"), maps.from_columns(COUNTS, "c_").alias("counts"), total.alias("total_edits"), "edits")


def long_counts(edits: DataFrame, keys: tuple[str, ...] = ("changeset",), measures: bool = False) -> DataFrame:
    """keys, key, value: the entries of the counts (or measurements) without building maps."""
    names, prefix = (MEASURES, "m_") if measures else (COUNTS, "c_")
    wide = _flagged(edits, keys).groupBy(*keys).agg(*_sums())
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"{prefix}{n}").alias("value")) for n in names])
    return wide.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.key", "e.value").where("value <> 0")


def long_measures(edits: DataFrame, keys: tuple[str, ...] = ("changeset",)) -> DataFrame:
    """keys, name, value: counts and measurements together, without building maps."""
    wide = _flagged(edits, keys).groupBy(*keys).agg(*_sums())
    entry = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"))
    entries = F.array(*[entry(n, f"c_{n}") for n in COUNTS], *[entry(n, f"m_{n}") for n in MEASURES])
    return wide.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.name", "e.value").where("value <> 0")


def long_form(stats: DataFrame, column: str, keys: tuple[str, ...] = ("changeset",)) -> DataFrame:
    return stats.select(*keys, F.explode(column).alias("key", "value"))


def merge_stats(left: DataFrame, right: DataFrame, key: str = "changeset") -> DataFrame:
    """Full outer union of two statistics tables; clashing entries are added."""
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, key, "full_outer").select(
        key,
        maps.simplify(maps.merge(F.col("a.measurements"), F.col("b.measurements"))).alias("measurements"),
        maps.simplify(maps.merge(F.col("a.counts"), F.col("b.counts"), "bigint")).alias("counts"),
        (F.coalesce("a.total_edits", F.lit(0)) + F.coalesce("b.total_edits", F.lit(0))).alias("total_edits"),
    )


def facet_flags(edits: DataFrame, streaming: bool = False) -> DataFrame:
    """edits with nine 0/1 facets. A creation is a new element in batch, a first version with geometry in a stream.

    Columns: tags, version, minor_version, visible, geometry_changed.
    """
    t = F.col("tags")
    created = (F.col("version") == 1) & F.col("geometry_changed") if streaming else tags.is_new(F.col("version"), F.col("minor_version"))
    flags = {
        "building": tags.is_building(t), "road": tags.is_road(t), "waterway": tags.is_waterway(t), "poi": tags.is_poi(t), "coastline": tags.is_coastline(t),
        "created": created & F.col("visible"), "modified": ~created & F.col("visible"), "deleted": ~F.col("visible"), "metadata_only": ~F.col("geometry_changed"),
    }
    return edits.withColumns({n: F.coalesce(c, F.lit(False)).cast("int") for n, c in flags.items()})


def country_counts(edits: DataFrame, keys: tuple[str, ...] = ("changeset",)) -> DataFrame:
    """keys, country, edit_count: one row per country an edit touches."""
    return edits.groupBy(*keys, "country").agg(F.count("*").alias("edit_count"))


def any_of(classes: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, classes)
