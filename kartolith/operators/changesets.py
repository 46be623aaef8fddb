"""Changeset tables: assembly from dumps, merging with a stream, metadata, hashtags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

COORDINATE_SCALE = 1e7


def collect_tags(rows: DataFrame, key: str = "changeset_id") -> DataFrame:
    """(key, tags): pairs travel together, so a null on one side cannot shift the other; the last value by order wins."""
    once = rows.groupBy(key, "k").agg(F.max("v").alias("v"))
    entries = F.array_sort(F.collect_list(F.struct("k", "v")))
    return once.where("k is not null").groupBy(key).agg(F.map_from_entries(entries).alias("tags"))


def collect_comments(comments: DataFrame, users: DataFrame, key: str = "changeset_id") -> DataFrame:
    """(key, comments, comments_count): an unknown author leaves a null name."""
    named = comments.join(users.select(F.col("id").alias("author_id"), F.col("display_name").alias("user")), "author_id", "left")
    one = F.struct(F.col("created_at").alias("date"), "user", F.col("author_id").alias("uid"), "body")
    return named.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("comments")).withColumn("comments_count", F.size("comments").cast("long"))


def assemble(changesets: DataFrame, tag_rows: DataFrame, comments: DataFrame, users: DataFrame) -> DataFrame:
    """The changeset table of the four dump tables; bounds are fixed-point integers."""
    bounds = {c: (F.col(c) / COORDINATE_SCALE) for c in ("min_lat", "max_lat", "min_lon", "max_lon") if c in changesets.columns}
    return (
        changesets.withColumns(bounds)
        .join(users.select(F.col("id").alias("user_id"), F.col("display_name").alias("user")), "user_id", "left")
        .join(collect_tags(tag_rows).withColumnRenamed("changeset_id", "id"), "id", "left")
        .join(collect_comments(comments, users).withColumnRenamed("changeset_id", "id"), "id", "left")
        .withColumns({"comments_count": F.coalesce("comments_count", F.lit(0)), "open": F.col("closed_at").isNull(), "sequence": F.lit(-1)})
        .withColumnRenamed("user_id", "uid")
    )


def merge_changesets(old: DataFrame, new: DataFrame, until=None) -> DataFrame:
    """Both tables by column name; of an identifier's rows the newest (by closing, then creation time) stays."""
    both = old.unionByName(new, allowMissingColumns=True)
    if until is not None:
        both = both.where(F.coalesce("closed_at", "created_at") <= until)
    newest = F.max_by(F.struct(*both.columns), F.struct(F.coalesce("closed_at", "created_at"), "sequence"))
    return both.groupBy("id").agg(newest.alias("r")).select("r.*")


def end_time(changesets: DataFrame) -> DataFrame:
    return changesets.agg(F.max(F.coalesce("closed_at", "created_at")).alias("end_time"))


def metadata(changesets: DataFrame) -> DataFrame:
    """One row per changeset with the latest closing time and all hashtags of its comment and hashtags tag."""
    found = text.merge_sets(text.hashtags(F.col("comment")), text.hashtags(F.col("hashtags_tag")))
    return changesets.select("id", "uid", "user", "editor", "created_at", "closed_at", found.alias("hashtags")).groupBy("id", "uid", "user", "editor", "created_at", "hashtags").agg(F.max("closed_at").alias("closed_at"))


def explode_hashtags(meta: DataFrame) -> DataFrame:
    return meta.select(F.col("id").alias("changeset"), F.explode("hashtags").alias("hashtag"))
