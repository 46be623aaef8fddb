"""Roll-ups of changeset statistics per user, hashtag, country and hashtag with user.

Counts and measurements stay long (key, value) up to the last step, so partial sums combine; ranks are
taken over the aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(changesets: DataFrame, *keys: str) -> DataFrame:
    """changesets, edits and last edit by keys."""
    return changesets.groupBy(*keys).agg(
        F.count("*").alias("changeset_count"), F.sum(F.coalesce("total_edits", F.lit(0))).cast("long").alias("edit_count"), F.max(F.coalesce("closed_at", "created_at")).alias("last_edit")
    )


def map_sums(changesets: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, key, value): entries of a map column added up; exploded before the shuffle, summed on both sides."""
    return changesets.select(*keys, F.explode(column).alias("key", "value")).groupBy(*keys, "key").agg(F.sum("value").alias("value"))


def as_map(long: DataFrame, name: str, *keys: str) -> DataFrame:
    return long.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name))


def top(sums: DataFrame, group: str | list[str], by: str, k: int) -> DataFrame:
    """Rows whose rank in the group is at most k; ties may exceed k."""
    group = [group] if isinstance(group, str) else group
    return sums.withColumn("rank", F.rank().over(Window.partitionBy(*group).orderBy(F.desc(by))).cast("long")).where(F.col("rank") <= k)


def breakdown(changesets: DataFrame, bridge: DataFrame | None, group: str, by: str, k: int = 10) -> DataFrame:
    """Edits and changesets of each (group, by), ranked by edits within the group."""
    rows = changesets if bridge is None else changesets.join(bridge, "changeset")
    sums = rows.groupBy(group, by).agg(F.count("*").alias("changeset_count"), F.sum(F.coalesce("total_edits", F.lit(0))).cast("long").alias("edit_count"))
    return top(sums, group, "edit_count", k)


def statistics(changesets: DataFrame, *keys: str, measure_maps: tuple[str, ...] = ("counts", "measurements")) -> DataFrame:
    """One row per keys: totals and one merged map per map column."""
    out = totals(changesets, *keys)
    for m in measure_maps:
        out = out.join(as_map(map_sums(changesets, m, *keys), m, *keys), list(keys), "left")
    return out


def listing(rows: DataFrame, keys: list[str], by: str, name: str, most: int | None = None) -> DataFrame:
    """keys and ``name``: an array of (name, n) by name, or the ``most`` frequent ones, most frequent first."""
    counts = rows.groupBy(*keys, by).agg(F.count("*").alias("n"))
    if most is None:
        return counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("name"), "n"))).alias(name))
    top_rows = counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), by))).where(F.col("place") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("place", F.col(by).alias("name"), "n")))
    return top_rows.groupBy(*keys).agg(F.transform(ordered, lambda e: F.struct(e["name"].alias("name"), e["n"].alias("n"))).alias(name))


def profile(changesets: DataFrame, *keys: str, countries: DataFrame | None = None, hashtags: DataFrame | None = None, top_hashtags: int = 50) -> DataFrame:
    """The whole view of the keys: totals, edit_times (changesets by day), editors, countries and the most used hashtags."""
    by = list(keys)
    parts = [listing(changesets.withColumn("day", F.to_date("created_at")), by, "day", "edit_times"), listing(changesets, by, "editor", "editors")]
    if countries is not None:
        parts.append(listing(changesets.join(countries, "changeset"), by, "country", "countries"))
    if hashtags is not None:
        parts.append(listing(changesets.join(hashtags, "changeset"), by, "hashtag", "hashtags", top_hashtags))
    out = totals(changesets, *keys)
    for p in parts:
        out = out.join(p, by, "left")
    return out
