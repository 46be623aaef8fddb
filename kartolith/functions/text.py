"""Hashtags, keys, paths and author lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashtags(text: Column) -> Column:
    """Distinct lower-case hashtags without the sign, in order of appearance; empty for null."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"#([\w-]+)"), F.lit(1)))
    return F.coalesce(found, F.array().cast("array<string>"))


def merge_sets(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, none), F.coalesce(b, none))


def facet_key(key: Column, facet: Column) -> Column:
    return F.concat_ws(":", key, facet)


def facet_of(key: Column) -> Column:
    """The part after the last colon, null without one."""
    return F.when(F.contains(key, F.lit(":")), F.element_at(F.split(key, ":"), -1))


def base_key(key: Column) -> Column:
    return F.element_at(F.split(key, ":"), 1)


def is_hidden(key: Column) -> Column:
    return F.startswith(key, F.lit("__"))


def element_key(kind: Column, id_: Column) -> Column:
    """n, w or r and the identifier."""
    return F.concat(F.when(kind == "node", "n").when(kind == "way", "w").when(kind == "relation", "r"), id_.cast("string"))


def add_author(authors: Column, author: Column) -> Column:
    """Comma-separated set with one more member."""
    old = F.filter(F.split(F.coalesce(authors, F.lit("")), ","), lambda x: x != "")
    return F.array_join(F.array_distinct(F.concat(old, F.when(author.isNotNull(), F.array(author)).otherwise(F.array().cast("array<string>")))), ",")


def tile_path(z: Column, x: Column, y: Column, key: Column | None = None) -> Column:
    path = F.format_string("%d/%d/%d.mvt", z, x, y)
    return path if key is None else F.concat(F.url_encode(key), F.lit("/"), path)


def strip_separator(line: Column) -> Column:
    return F.regexp_replace(line, "\u001e", "")
