"""Predicates over a ``map<string,string>`` of tags.

Missing tags are false, never null: list tests are wrapped so that negation is two-valued.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WATERWAYS = ("river", "riverbank", "canal", "stream", "stream_end", "brook", "drain", "ditch", "dam", "weir", "waterfall", "pressurised")
POI_KEYS = ("amenity", "shop", "craft", "office", "leisure", "aeroway")


def split_values(value: Column) -> Column:
    """Values of a ``;``-delimited list, trimmed; empty for null."""
    return F.coalesce(F.transform(F.split(value, ";"), lambda v: F.trim(v)), F.array().cast("array<string>"))


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def has(tags: Column, key: str) -> Column:
    return F.coalesce(tag(tags, key).isNotNull(), F.lit(False))


def lists(tags: Column, key: str, *values: str) -> Column:
    """Whether the ``;``-delimited value holds one of the values: one pattern, so code generation goes on around it."""
    return F.coalesce(tag(tags, key).rlike(f"(^|;) *({'|'.join(map(re.escape, values))}) *(;|$)"), F.lit(False))


def is_tagged(tags: Column) -> Column:
    return F.coalesce(F.size(tags) > 0, F.lit(False))


def is_road(tags: Column) -> Column:
    return has(tags, "highway")


def is_building(tags: Column) -> Column:
    return has(tags, "building")


def is_waterway(tags: Column) -> Column:
    return lists(tags, "waterway", *WATERWAYS)


def is_coastline(tags: Column) -> Column:
    return lists(tags, "natural", "coastline")


def is_poi(tags: Column) -> Column:
    return reduce(lambda a, b: a | b, (has(tags, k) for k in POI_KEYS))


def is_landuse(tags: Column) -> Column:
    return has(tags, "landuse")


def is_natural(tags: Column) -> Column:
    return has(tags, "natural")


def is_rail_feature(tags: Column) -> Column:
    return lists(tags, "railway", "station", "yard") | lists(tags, "landuse", "railway")


def is_rail_line(tags: Column) -> Column:
    return ~is_rail_feature(tags) & has(tags, "railway")


def is_railway(tags: Column) -> Column:
    return has(tags, "railway") | lists(tags, "landuse", "railway")


def is_linear(tags: Column) -> Column:
    return is_road(tags) | is_waterway(tags) | is_coastline(tags) | is_rail_line(tags)


def is_other(tags: Column) -> Column:
    known = (is_road, is_waterway, is_building, is_railway, is_natural, is_landuse, is_poi)
    return is_tagged(tags) & ~reduce(lambda a, b: a | b, (p(tags) for p in known))


def is_interesting_node(tags: Column) -> Column:
    return is_poi(tags)


def is_interesting_way(tags: Column) -> Column:
    return is_building(tags) | is_road(tags) | is_waterway(tags) | is_coastline(tags) | is_poi(tags)


def is_interesting(tags: Column) -> Column:
    return is_interesting_node(tags) | is_interesting_way(tags)


def is_new(version: Column, minor: Column) -> Column:
    return (version == 1) & (minor == 0)


def merge_tags(a: Column, b: Column) -> Column:
    """Both maps; where values differ, the distinct ones joined by ``;`` in order of appearance."""
    both = F.map_zip_with(
        F.coalesce(a, F.create_map().cast("map<string,string>")),
        F.coalesce(b, F.create_map().cast("map<string,string>")),
        lambda k, x, y: F.array_join(F.array_distinct(F.concat(split_values(x), split_values(y))), ";"),
    )
    return F.when(a.isNotNull() | b.isNotNull(), both)


PREDICATES = {
    "tagged": is_tagged, "road": is_road, "building": is_building, "waterway": is_waterway, "coastline": is_coastline, "poi": is_poi, "landuse": is_landuse,
    "natural": is_natural, "rail_feature": is_rail_feature, "rail_line": is_rail_line, "railway": is_railway, "linear": is_linear, "other": is_other,
    "interesting_node": is_interesting_node, "interesting_way": is_interesting_way, "interesting": is_interesting,
}
