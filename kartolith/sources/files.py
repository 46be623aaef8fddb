"""Histories, changesets, dump CSVs, feature lines, lists and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

HISTORY = (
    "id long, type string, tags map<string,string>, lat decimal(9,7), lon decimal(10,7), nds array<struct<ref:long>>, "
    "members array<struct<type:string,ref:long,role:string>>, changeset long, timestamp timestamp, uid long, user string, version long, visible boolean"
)
CHANGESETS = (
    "id long, tags map<string,string>, created_at timestamp, open boolean, closed_at timestamp, comments_count long, min_lat double, max_lat double, min_lon double, max_lon double, num_changes long, uid long, user string"
)
DUMPS = {
    "changesets": "id long, user_id long, created_at timestamp, min_lat int, max_lat int, min_lon int, max_lon int, closed_at timestamp, num_changes int",
    "changeset_tags": "changeset_id long, k string, v string",
    "changeset_comments": "id long, changeset_id long, author_id long, body string, created_at timestamp, visible boolean",
    "users": "id long, display_name string",
}
_FEATURE = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"


def read_history(spark: SparkSession, path: str, fmt: str = "orc") -> DataFrame:
    rows = spark.read.format(fmt).schema(HISTORY).load(path)
    return rows.withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double"), "nds": F.transform("nds", lambda n: n["ref"])})


def read_changesets(spark: SparkSession, path: str, fmt: str = "orc") -> DataFrame:
    return spark.read.format(fmt).schema(CHANGESETS).load(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Dump CSV: header, quoted line breaks, doubled quotes; the schema is given, never inferred."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"', nullValue="").schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', nullValue="", emptyValue='""').csv(path)


def write_orc(df: DataFrame, path: str, files: int | None = None) -> None:
    """Snappy ORC; ``files`` bounds the number of output files (coalescing, not shuffling)."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("compression", "snappy").orc(path)


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """Augmented diffs: one GeoJSON collection a line, members ``old`` (may be missing) and ``new``; record separators go."""
    raw = spark.read.text(path).select(text.strip_separator(F.col("value")).alias("line")).where(F.trim("line") != "")
    feature = "struct<id:string,type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
    parsed = raw.select(F.from_json("line", f"struct<features:array<{feature}>>").alias("c"))
    by = lambda which: F.try_element_at(F.filter("c.features", lambda f: f["id"] == which), F.lit(1))
    return parsed.select(by("old").alias("old"), by("new").alias("new"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One entry a line, trimmed and lower-cased; blanks and repeats go."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("hashtag")).where("hashtag <> ''").distinct()


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """name, code, polygons (array of polygons of rings of struct<x,y>) of GeoJSON features, one a line; polygons become multipolygons."""
    rows = spark.read.text(path).select(F.from_json("value", _FEATURE).alias("f"))
    multi = F.when(F.col("f.geometry.type") == "Polygon", F.concat(F.lit("["), F.col("f.geometry.coordinates"), F.lit("]"))).otherwise(F.col("f.geometry.coordinates"))
    rings = F.from_json(multi, "array<array<array<array<double>>>>")
    points = F.transform(rings, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))))
    return rows.select(F.col("f.properties")["name"].alias("name"), F.col("f.properties")["code"].alias("code"), points.alias("polygons"))
