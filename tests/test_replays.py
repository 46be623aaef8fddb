"""Replayed batches leave tables as they are; batches that are new in part add that part."""

from pyspark.sql import functions as F

from kartolith.operators import stores, tiles
from kartolith.streaming import jobs

GRID = tiles.Grid(3, 8)


def tables(spark, path, first, second):
    return [stores.SnapshotTable(spark, f"file://{path}/{n}", s) for n, s in (("t", first), ("a", second))]


def test_tiles_are_not_written_again(spark, tmp_path):
    table, known = tables(spark, tmp_path, "key string, z int, x long, y long, cell long, value long", "z int, x long, y long, sequence long")
    points = spark.range(400).select((F.col("id") % 3).cast("string").alias("key"), (F.col("id") * 37 % 360 - 180.0).alias("lon"), (F.col("id") * 11 % 160 - 80.0).alias("lat"), (F.col("id") % 5).alias("sequence"))
    run = jobs.update_tiles(table, known, lambda b: b, GRID)
    run(points.where("sequence < 3"), 0)
    run(points.where("sequence < 3"), 0)
    assert (table.version(), known.version()) == (1, 1)
    run(points, 1)  # three sequences again, two new
    assert table.version() == 2
    want = tiles.pyramid(tiles.points_to_cells(points, GRID, "key"), GRID, "key")
    got = table.read().select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    run(points.where("sequence = 3 or lon > 0").withColumn("sequence", F.when(F.col("sequence") == 4, 9).otherwise(F.col("sequence"))), 2)
    late = points.where("sequence = 4 and lon > 0")
    assert table.read().where("z = 0").agg(F.sum("value")).first()[0] == 400 + late.count()
    assert known.read().count() == known.read().distinct().count()


def test_the_newest_sequences_are_kept(spark, tmp_path):
    table, known = tables(spark, tmp_path, "key string, z int, x long, y long, cell long, value long", "z int, x long, y long, sequence long")
    points = spark.range(30).select(F.lit("k").alias("key"), F.lit(1.0).alias("lon"), F.lit(1.0).alias("lat"), F.col("id").alias("sequence"))
    jobs.update_tiles(table, known, lambda b: b, GRID, keep=4)(points, 0)
    assert {r.sequence for r in known.read().collect()} == {26, 27, 28, 29} and known.read().count() == 4 * 4


def test_counts_are_prepared_for_new_sequences_only(spark, tmp_path):
    table, applied = tables(spark, tmp_path, "changeset long, name string, value double", "changeset long, sequence long")
    seen = []

    def prepare(batch):
        seen.append(batch.count())
        return batch.groupBy("sequence", "changeset").agg(F.count("*").cast("double").alias("value")).withColumn("name", F.lit("n"))

    run = jobs.merge_into(table, applied, "changeset", prepare)
    batch = spark.range(60).select((F.col("id") % 4).alias("changeset"), (F.col("id") % 3).alias("sequence"))
    run(batch.where("sequence < 2"), 0)
    run(batch.where("sequence < 2"), 0)
    assert table.version() == 1 and seen == [40]
    run(batch, 1)
    assert seen == [40, 20] and {r.changeset: r.value for r in table.read().collect()} == {k: 15.0 for k in range(4)}
    assert applied.read().count() == 12 and table.version() == 2
