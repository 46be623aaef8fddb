"""Streams over sequence-stamped rows; each also runs bounded on a batch DataFrame.

Event time derives from the sequence, so a group is final once the next sequence has arrived.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.time import time_of
from ..operators import footprints, stores, tiles
from ..session import stored

OPEN_HOURS = 25


def stats_by_sequence(rows: DataFrame, value: str, category: str, delay: str = "0 seconds") -> DataFrame:
    """(timestamp, sequence, category): count and sum; append mode on a stream."""
    timed = rows.withColumn("timestamp", time_of(F.col("sequence")))
    if rows.isStreaming:
        timed = timed.withWatermark("timestamp", delay)
    return timed.groupBy("timestamp", "sequence", category).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def join_open_changesets(diffs: DataFrame, changesets: DataFrame, hours: int = OPEN_HOURS) -> DataFrame:
    """Diffs (changeset, timestamp) with their changeset (id, created_at); the time range bounds the state."""
    d, c = diffs, changesets
    if d.isStreaming:
        d, c = d.withWatermark("timestamp", "0 seconds"), c.withWatermark("created_at", f"{hours} hours")
    window = (F.col("timestamp") >= F.col("created_at")) & (F.col("timestamp") <= F.col("created_at") + F.expr(f"interval {hours} hours"))
    return d.join(c, (F.col("changeset") == F.col("id")) & window)


def merge_into(table: stores.SnapshotTable, applied: stores.SnapshotTable, key: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: long (key, name, value, sequence) rows, that ``prepare`` makes of a batch, added once per sequence.

    Table and applied sequences move under one pointer, so a batch that is replayed after a crash finds both or neither.
    ``prepare`` keeps groups of key and sequence apart: where a batch has both columns, it gets those alone that were not applied.
    A batch that adds nothing leaves both tables as they are.
    """
    applied.follow(table)

    def run(batch: DataFrame, _: int) -> None:
        done, batch = applied.read(), batch.persist()
        if prepare and {key, "sequence"} <= set(batch.columns):
            new = stored(stores.fresh_rows(batch.select(key, "sequence").distinct(), done, key), "fresh")
            again = done.join(batch.select("sequence").distinct(), "sequence", "left_semi")
            rows = None if new.isEmpty() else prepare(batch if again.isEmpty() else batch.join(new, [key, "sequence"], "left_semi"))
        else:
            rows = stores.fresh_rows(prepare(batch) if prepare else batch, done, key)
        if rows is not None:
            rows = stored(rows.select(key, "sequence", "name", "value"), "rows")
            if not rows.isEmpty():
                table.replace(*_both(stores.upsert_fresh(table.read(), rows, done, key), applied))
        batch.unpersist()

    return run


def _both(results: tuple[DataFrame, DataFrame], follower: stores.SnapshotTable) -> tuple[DataFrame, stores.SnapshotTable, DataFrame]:
    return results[0], follower, results[1]


def merge_countries(table: stores.SnapshotTable, applied: stores.SnapshotTable, countries: DataFrame) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: (changeset, sequence, code, edit_count) rows added once per sequence under the countries' identifiers."""
    applied.follow(table)

    def run(batch: DataFrame, _: int) -> None:
        table.replace(*_both(stores.upsert_countries(table.read(), batch.persist(), applied.read(), countries), applied))
        batch.unpersist()

    return run


def update_tiles(table: stores.SnapshotTable, committed: stores.SnapshotTable, prepare: Callable[[DataFrame], DataFrame], grid: tiles.Grid, facets: list[str] | None = None, keep: int = tiles.KEEP_SEQUENCES) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: points that ``prepare`` makes of a batch (key, lon, lat, sequence [, facets]) added to a tile table.

    A sequence that a tile holds adds nothing, and a batch that adds nothing leaves both tables as they are; of a tile's sequences the newest
    ``keep`` are remembered.
    """
    committed.follow(table)

    def run(batch: DataFrame, _: int) -> None:
        points = prepare(batch.persist())
        before = table.read()
        cells, known = footprints.update(before, committed.read(), tiles.facet_rows(points, facets) if facets else points, grid, keep=keep, value="value" if facets else None)
        if cells is not before:
            table.replace(cells, committed, known)
        batch.unpersist()

    return run


def with_checkpoint(run: Callable[[DataFrame, int], None], saved: stores.SnapshotTable, process: str) -> Callable[[DataFrame, int], None]:
    """``run``, and then the batch's last sequence saved under the name of the process."""

    def both(batch: DataFrame, number: int) -> None:
        run(batch.persist(), number)
        last = batch.agg({"sequence": "max"}).first()[0]
        if last is not None:
            saved.replace(stores.save_checkpoint(saved.read(), process, last))
        batch.unpersist()

    return both


def start(df: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, name: str, once: bool = True) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 seconds")).start()


def printer(df: DataFrame, name: str) -> StreamingQuery:
    return df.writeStream.format("console").queryName(name).start()
