"""Command line: python -m kartolith.cli <command> ...; every command reads and writes tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.time import day_key
from .operators import changesets, footprints, matching, pipelines, stats, stores, tile_schemas, tiles, vector_tiles
from .session import session
from .sources import feeds, files
from .streaming import jobs


def changeset_stats(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Statistics of prepared edits (tags, version, minor_version, visible, linear_m, area_m2)."""
    return stats.changeset_stats(spark.read.parquet(a.input))


def edit_histogram(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    nodes = files.read_history(spark, a.input).where("type = 'node' and uid > 1")
    return footprints.edit_histogram(nodes.withColumn("key", day_key(F.col("timestamp"))))


def footprint(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    nodes = files.read_history(spark, a.input).where("type = 'node' and uid > 1")
    listed = files.read_list(spark, a.hashtags) if a.hashtags else None
    bridge = None
    if a.changesets:
        tags = F.coalesce(F.try_element_at("tags", F.lit("comment")), F.lit(""))
        bridge = changesets.explode_hashtags(files.read_changesets(spark, a.changesets).select("id", F.regexp_extract_all(F.lower(tags), F.lit(r"#([\w-]+)"), F.lit(1)).alias("hashtags")))
    return footprints.footprints(footprints.target_points(nodes, bridge, hashtags=listed, by=a.by))


def merge_changesets(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return changesets.merge_changesets(files.read_changesets(spark, a.input).withColumn("sequence", F.lit(-1)), spark.read.parquet(a.new))


def snapshot(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return {"snapshot": tile_schemas.snapshot, "history": tile_schemas.history, "authorship": tile_schemas.authorship}[a.schema](spark.read.parquet(a.input))


def export_tiles(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    encoded = vector_tiles.encode_tiles(tiles.vectorize(spark.read.parquet(a.input)), a.layer, a.bits)
    return vector_tiles.export(encoded, a.folder)


def history_stats(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Statistics of a whole history, geocoded with --countries; --checkpoint stores them, --use-checkpoint reads them again."""
    polygons = files.read_countries(spark, a.countries).select("code", "polygons") if a.countries else None
    make = lambda: pipelines.changeset_stats_from_history(files.read_history(spark, a.input), polygons)
    return pipelines.checkpointed(make, a.checkpoint or "", a.use_checkpoint, spark)


def changeset_metadata(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return changesets.metadata(files.read_changesets(spark, a.input).withColumns({"editor": tag("created_by"), "comment": tag("comment"), "hashtags_tag": tag("hashtags")}))


def faceted_histogram(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return pipelines.faceted_histogram_from_history(files.read_history(spark, a.input))


def match_buildings(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Counterparts of the buildings (id, tags, ring) of two tables with their probabilities."""
    left, right = (matching.buildings(spark.read.parquet(p)) for p in (a.input, a.other))
    return matching.building_probabilities(left, right).where(F.col("p") > a.least)


def update_tiles(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A tile table of features after a diff; --dry-run lists the tiles it touches."""
    return tile_schemas.update_tiles(spark.read.parquet(a.input), spark.read.parquet(a.diff), range(a.min_zoom, a.max_zoom + 1), a.dry_run)


def _feed(spark: SparkSession, a: argparse.Namespace, process: str, columns: str) -> tuple[DataFrame, stores.SnapshotTable]:
    """The feed in --input from --start, or after what the process saved in --store, up to --end (a stream: no end)."""
    feeds.register(spark)
    saved = stores.SnapshotTable(spark, f"{a.store}/checkpoints", "proc_name string, sequence long")
    first, end = feeds.bounds(a.input, a.start, a.end, stores.saved_sequence(saved.read(), process))
    options = {"path": a.input, "start_sequence": first, "columns": columns, **({} if a.stream else {"end_sequence": end})}
    return spark.readStream.format("sequence_feed").options(**options).load(), saved


def _run(spark: SparkSession, a: argparse.Namespace, process: str, rows: DataFrame, saved: stores.SnapshotTable, run) -> None:
    query = jobs.start(rows, jobs.with_checkpoint(run, saved, process), f"{a.store}/_{process}-{saved.version()}", process, once=not a.stream)
    query.awaitTermination()


def feed_rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Rows of a feed (changes, diffs or changesets) as a table."""
    feeds.register(spark)
    first, end = feeds.bounds(a.input, a.start, a.end)
    return spark.read.format("sequence_feed").options(path=a.input, start_sequence=first, end_sequence=end, columns=a.columns or feeds.COLUMNS).load()


_EDITS = "sequence long, changeset long, uid long, tags map<string,string>, version long, minor_version long, visible boolean, linear_m double, area_m2 double"
_POINTS = "sequence long, uid long, key string, lon double, lat double"
_CELLS = "key string, z int, x long, y long, cell long, value long"


def update_stats(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """All measures of a feed of prepared edits, added to the table in --store once a sequence."""
    rows, saved = _feed(spark, a, "stats", _EDITS)
    table, applied = stores.SnapshotTable(spark, f"{a.store}/stats", "changeset long, name string, value double"), stores.SnapshotTable(spark, f"{a.store}/applied", "changeset long, sequence long")
    _run(spark, a, "stats", rows, saved, jobs.merge_into(table, applied, "changeset", pipelines.counts_rows))
    return pipelines.wide_stats(table.read())


def update_histogram(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Points of a feed (key: day, user or hashtag) added to the cells in --store once a sequence and tile."""
    rows, saved = _feed(spark, a, "histogram", _POINTS)
    table, known = stores.SnapshotTable(spark, f"{a.store}/cells", _CELLS), stores.SnapshotTable(spark, f"{a.store}/sequences", "z int, x long, y long, sequence long")
    _run(spark, a, "histogram", rows, saved, jobs.update_tiles(table, known, lambda b: b.drop("uid"), tiles.Grid(a.zoom, a.cells)))
    return table.read()


COMMANDS = {
    "changeset-stats": changeset_stats, "edit-histogram": edit_histogram, "footprint": footprint, "merge-changesets": merge_changesets, "elements": snapshot, "export-tiles": export_tiles,
    "history-stats": history_stats, "changeset-metadata": changeset_metadata, "faceted-histogram": faceted_histogram, "match-buildings": match_buildings, "update-tiles": update_tiles,
    "feed-rows": feed_rows, "update-stats": update_stats, "update-histogram": update_histogram,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kartolith")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--output", required=True)
        if name == "footprint":
            c.add_argument("--changesets")
            c.add_argument("--hashtags")
            c.add_argument("--by", choices=("user", "hashtag"), default="user")
        if name == "merge-changesets":
            c.add_argument("--new", required=True)
        if name == "elements":
            c.add_argument("--schema", choices=("snapshot", "history", "authorship"), default="snapshot")
        if name == "history-stats":
            c.add_argument("--countries")
            c.add_argument("--checkpoint")
            c.add_argument("--use-checkpoint", action="store_true")
        if name == "match-buildings":
            c.add_argument("--other", required=True)
            c.add_argument("--least", type=float, default=0.5)
        if name == "update-tiles":
            c.add_argument("--diff", required=True)
            c.add_argument("--min-zoom", type=int, default=0)
            c.add_argument("--max-zoom", type=int, default=15)
            c.add_argument("--dry-run", action="store_true")
        if name in ("feed-rows", "update-stats", "update-histogram"):
            c.add_argument("--start", type=int)
            c.add_argument("--end", type=int)
            c.add_argument("--columns")
        if name in ("update-stats", "update-histogram"):
            c.add_argument("--store", required=True)
            c.add_argument("--stream", action="store_true")
        if name == "update-histogram":
            c.add_argument("--zoom", type=int, default=tiles.HISTOGRAM.base_zoom)
            c.add_argument("--cells", type=int, default=tiles.HISTOGRAM.cells)
        if name == "export-tiles":
            c.add_argument("--folder", required=True)
            c.add_argument("--layer", default="edits")
            c.add_argument("--bits", type=int, default=tiles.HISTOGRAM.bits)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or session(f"kartolith {a.command}")
    COMMANDS[a.command](spark, a).write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
