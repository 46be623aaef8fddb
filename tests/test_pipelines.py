"""Whole jobs on small cases, crashes between writes, and lookups against brute force."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kartolith.functions import geo
from kartolith.operators import countries, matching, pipelines, rollups, stores, tile_schemas, tiles
from kartolith.sources import feeds
from kartolith.streaming import jobs

T = datetime(2020, 1, 1)
HISTORY = "id long, type string, tags map<string,string>, lat double, lon double, nds array<long>, changeset long, timestamp timestamp_ntz, uid long, version long, visible boolean"


def at(day):
    return T + timedelta(days=day)


@pytest.fixture(scope="module")
def history(spark):
    rows = [
        (1, "node", {}, 0.0, 0.0, None, 100, at(0), 5, 1, True), (2, "node", {"amenity": "cafe"}, 0.0, 1.0, None, 100, at(0), 5, 1, True), (2, "node", {"amenity": "cafe"}, 0.0, 2.0, None, 102, at(5), 5, 2, True),
        (2, "node", {"amenity": "cafe"}, None, None, None, 103, at(9), 5, 3, False), (10, "way", {"highway": "x"}, None, None, [1, 2], 101, at(1), 5, 1, True), (11, "way", {}, None, None, [1, 2], 101, at(1), 5, 1, True),
    ]
    return spark.createDataFrame(rows, HISTORY)


def test_changeset_stats(spark, history):
    box = lambda x: [[[(x, -1.0), (x + 1.6, -1.0), (x + 1.6, 1.0), (x, 1.0)]]]
    shapes = spark.createDataFrame([("A", box(-0.5)), ("B", box(1.2))], "code string, polygons array<array<array<struct<x:double,y:double>>>>")
    got = {r.changeset: r for r in pipelines.changeset_stats_from_history(history, shapes).collect()}
    degree = math.radians(1) * geo.EARTH / 1000
    assert got[100].counts == {"pois_added": 1} and got[100].countries == {"A": 1} and got[100].measurements == {}
    assert got[101].counts == {"roads_added": 1} and got[101].measurements["road_km_added"] == pytest.approx(degree) and got[101].countries == {"A": 1}
    assert got[102].counts == {"roads_modified": 1, "pois_modified": 1} and got[102].measurements["road_km_modified"] == pytest.approx(degree) and got[102].countries == {"A": 1, "B": 2}
    assert got[103].counts == {"roads_modified": 1, "pois_deleted": 1} and got[103].total_edits == 2
    assert pipelines.changeset_stats_from_history(history.where("false")).count() == 0


def test_faceted_nodes(history):
    got = {(r.id, r.version): r for r in pipelines.faceted_nodes(history).collect()}
    assert {k for k, r in got.items() if r.road} == {(1, 1), (2, 1), (2, 2), (2, 3)} and {k for k, r in got.items() if r.poi} == {(2, 1), (2, 2), (2, 3)}
    assert got[2, 3].deleted and got[2, 3].lon == 2.0 and got[2, 3].metadata_only and got[2, 1].created and got[2, 2].modified and not got[2, 2].metadata_only


def test_faceted_diffs(spark):
    schema = "sequence long, type string, id long, version long, minor_version long, updated timestamp_ntz, lon double, lat double, nds array<long>, tags map<string,string>, prev_tags map<string,string>, visible boolean"
    rows = [(7, "node", 1, 1, 0, at(0), 1.0, 2.0, None, {"shop": "x"}, None, True), (7, "node", 2, 2, 0, at(0), 3.0, 2.0, None, {}, {"amenity": "y"}, False), (7, "way", 9, 1, 0, at(1), None, None, [1], {}, {"building": "yes"}, False), (8, "way", 9, 2, 0, at(2), None, None, [1], {"highway": "x"}, None, True)]
    got = sorted(((r.sequence, r.id, r.building, r.poi, r.created, r.deleted, r.key) for r in pipelines.faceted_diffs(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(7, 1, 1, 0, 1, 0, 2020002), (7, 1, 1, 1, 1, 0, 2020001), (7, 2, 0, 1, 0, 1, 2020001)]


def test_a_crash_between_writes_adds_nothing_twice(spark, tmp_path, monkeypatch):
    table = stores.SnapshotTable(spark, f"file://{tmp_path}/t", "changeset long, name string, value double")
    applied = stores.SnapshotTable(spark, f"file://{tmp_path}/a", "changeset long, sequence long")
    run = jobs.merge_into(table, applied, "changeset")
    batch = spark.createDataFrame([(1, "x", 5.0, 3), (2, "x", 1.0, 3)], "changeset long, name string, value double, sequence long")
    swap = stores.SnapshotTable._swap
    monkeypatch.setattr(stores.SnapshotTable, "_swap", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run(batch, 0)
    assert table.read().count() == 0 and applied.read().count() == 0
    monkeypatch.setattr(stores.SnapshotTable, "_swap", swap)
    for _ in range(3):  # the batch again, and replays
        run(batch, 0)
    assert {r.changeset: r.value for r in table.read().collect()} == {1: 5.0, 2: 1.0} and applied.read().count() == 2
    again = stores.SnapshotTable(spark, f"file://{tmp_path}/a", "changeset long, sequence long")
    again.follow(stores.SnapshotTable(spark, f"file://{tmp_path}/t", "changeset long, name string, value double"))
    assert again.read().count() == 2


def test_tile_sequences_are_pruned(spark):
    rows = spark.range(30).select(F.lit(1).alias("z"), F.lit(0).alias("x"), (F.col("id") % 2).alias("y"), F.col("id").alias("sequence"))
    got = {(r.y, r.sequence) for r in tiles.newest_sequences(rows, 4).collect()}
    assert got == {(s % 2, s) for s in range(22, 30)}


def test_country_lookup_over_random_points(spark):
    """Concave polygons, holes and multipolygons against a ray cast in Python."""
    rng = random.Random(5)

    def star(cx, cy, r, n=14):
        return [(cx + (r if k % 2 else r * 0.4) * math.cos(2 * math.pi * k / n), cy + (r if k % 2 else r * 0.4) * math.sin(2 * math.pi * k / n)) for k in range(n)]

    shapes = [("A", [[star(3, 4, 9), star(3, 4, 2)]]), ("B", [[star(-20, 10, 15)], [star(30, -20, 12)]]), ("C", [[star(8, 6, 11)]])]
    points = [(i, rng.uniform(-40, 45), rng.uniform(-35, 30)) for i in range(3000)]

    def inside(x, y, ring):
        hit = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                hit = not hit
        return hit

    want = {(i, c) for i, x, y in points for c, polygons in shapes if any(sum(inside(x, y, r) for r in rings) % 2 for rings in polygons)}
    table = spark.createDataFrame(shapes, "code string, polygons array<array<array<struct<x:double,y:double>>>>")
    got = countries.lookup(spark.createDataFrame(points, "id long, lon double, lat double"), table)
    assert {(r.id, r.code) for r in got.collect()} == want and len(want) > 300
    assert {(r.id, r.code) for r in countries.lookup(spark.createDataFrame(points, "id long, lon double, lat double"), table, size=3.0).collect()} == want


def test_feed_with_missing_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/feed"
    lines = spark.createDataFrame([(3, '{"id": 1}'), (7, '{"id": 2}'), (7, '{"id": 3}')], "sequence long, line string")
    feeds.write_feed(lines, path)
    feeds.register(spark)
    got = spark.read.format("sequence_feed").options(path=path, start_sequence=2, end_sequence=20, partitions=3).load().select("sequence", "id").collect()
    assert sorted((r.sequence, r.id) for r in got) == [(3, 1), (7, 2), (7, 3)] and feeds.bounds(path) == (7, 8)


def test_areas_of_a_batch(spark):
    square = "array(named_struct('x', 9.0D, 'y', 45.0D), named_struct('x', 9.01D, 'y', 45.0D), named_struct('x', 9.01D, 'y', 45.01D), named_struct('x', 9.0D, 'y', 45.01D))"
    none = "cast(null as array<struct<x:double,y:double>>)"
    df = spark.sql(f"select 1 k, {square} r union all select 2, {none} union all select 3, slice({square}, 1, 2) union all select 4, transform({square}, v -> named_struct('x', v.x - 100, 'y', -v.y)) union all select 5, array_append({square}, named_struct('x', cast(null as double), 'y', 1.0D)) union all select 6, array_append({square}, {square}[0])")
    got = {r.k: r.a for r in df.coalesce(1).select("k", geo.utm_area("r").alias("a")).collect()}
    assert got[1] == pytest.approx(788.6 * 1111.4, rel=0.01) and got[6] == pytest.approx(got[1]) and got[4] == pytest.approx(got[1], rel=1e-3) and [got[k] for k in (2, 3, 5)] == [0.0, 0.0, 0.0]


def test_moving_features_leave_their_tile(spark):
    schema = "id long, lon double, lat double, updated long, visible boolean"
    stored = tile_schemas.place(spark.createDataFrame([(1, -90.0, 45.0, 1, True), (2, 90.0, 45.0, 1, True), (3, 90.0, -45.0, 1, True)], schema), range(1, 3))
    diff = spark.createDataFrame([(1, 90.0, -45.0, 2, True), (2, 90.0, 45.0, 2, False)], schema)
    got = sorted((r.id, r.z, r.x, r.y) for r in tile_schemas.update_tiles(stored, diff, range(1, 3)).collect())
    assert got == [(1, 1, 1, 1), (1, 2, 3, 2), (3, 1, 1, 1), (3, 2, 3, 2)]
    touched = {(r.z, r.x, r.y) for r in tile_schemas.update_tiles(stored, diff, range(1, 2), dry=True).collect()}
    assert touched >= {(1, 0, 0), (1, 1, 1), (1, 1, 0)}


def test_profile_without_bridges(spark):
    c = spark.createDataFrame([(1, 5, "e", T, None, 3), (2, 5, "f", at(1), at(2), None)], "changeset long, uid long, editor string, created_at timestamp_ntz, closed_at timestamp_ntz, total_edits long")
    r = rollups.profile(c, "uid").first()
    assert (r.changeset_count, r.edit_count, r.last_edit) == (2, 3, at(2)) and [(e["name"], e.n) for e in r.editors] == [("e", 1), ("f", 1)] and len(r.edit_times) == 2


def test_writer_checkpoint_and_errors(spark, tmp_path):
    df = spark.range(10)
    stores.write_partitions(df, f"file://{tmp_path}/w", 3)
    assert spark.read.parquet(f"file://{tmp_path}/w").count() == 10
    stores.log_errors(df.where("id > 7"), f"file://{tmp_path}/e", "why")
    assert {r.reason for r in spark.read.parquet(f"file://{tmp_path}/e").collect()} == {"why"}
    with pytest.raises(ValueError):
        pipelines.checkpointed(lambda: df, "", True, spark)
    assert pipelines.checkpointed(lambda: df, "", False, spark).count() == 10
    saved = stores.save_checkpoint(spark.createDataFrame([("a", 1)], "proc_name string, sequence long"), "b", 4)
    assert stores.saved_sequence(saved, "b") == 4 and stores.saved_sequence(saved, "c") is None


def test_building_probabilities(spark):
    """A shifted building without overlap is found by its anchors; equal ones do not take part."""
    ring = lambda x, y, w=0.001: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    anchors = [(i, ring(0.01 + 0.003 * i, 0.01 + 0.002 * (i % 3))) for i in range(5)]
    left = [*anchors, (50, ring(0.02, 0.03)), (51, ring(0.03, 0.04))]
    right = [*((100 + i, r) for i, r in anchors), (150, ring(0.0205, 0.0301)), (151, ring(0.0321, 0.0402)), (152, ring(0.4, 0.4))]
    frame = lambda rows: matching.buildings(spark.createDataFrame([(i, r, {"building": "yes"}) for i, r in rows], "id long, ring array<struct<x:double,y:double>>, tags map<string,string>"))
    got = {(r.a_id, r.b_id): r.p for r in matching.building_probabilities(frame(left), frame(right), 0.01, 0.05).collect()}
    assert set(got) == {(50, 150), (51, 150), (51, 151)} and got[51, 151] > 0.5
    assert got[50, 150] == max(p for (a, _), p in got.items() if a == 50) and got[51, 151] == max(p for (a, _), p in got.items() if a == 51)
    alone = {(r.a_id, r.b_id): r.p for r in matching.building_probabilities(frame(left[5:]), frame(right[5:]), 0.01, 0.05).collect()}
    assert 0.44 < alone[50, 150] <= 1.0


def test_commands(spark, history, tmp_path):
    from kartolith import cli
    from kartolith.sources import files

    at_ = lambda n: f"file://{tmp_path}/{n}"
    ready = history.withColumns({"nds": F.transform("nds", lambda n: F.struct(n.alias("ref"))), "lat": F.col("lat").cast("decimal(9,7)"), "lon": F.col("lon").cast("decimal(10,7)"), "user": F.lit("u"), "timestamp": F.col("timestamp").cast("timestamp")})
    files.write_orc(ready.withColumn("members", F.lit(None).cast("array<struct<type:string,ref:long,role:string>>")), at_("h"))
    cli.main(["history-stats", "--input", at_("h"), "--output", at_("s"), "--checkpoint", at_("k")], spark)
    cli.main(["history-stats", "--input", at_("missing"), "--output", at_("s2"), "--checkpoint", at_("k"), "--use-checkpoint"], spark)
    assert spark.read.parquet(at_("s")).count() == spark.read.parquet(at_("s2")).count() == 4
    cli.main(["faceted-histogram", "--input", at_("h"), "--output", at_("f")], spark)
    assert spark.read.parquet(at_("f")).where("z = 0 and key like '%:road'").count() > 0
    lines = spark.createDataFrame([(k, f'{{"uid": 1, "key": "2020001", "lon": {k}.5, "lat": 1.0}}') for k in range(6)], "sequence long, line string")
    feeds.write_feed(lines, at_("feed"))
    for last in ("3", "5", "5"):
        cli.main(["update-histogram", "--input", at_("feed"), "--output", at_("u"), "--store", at_("store"), "--end", last, "--zoom", "2", "--cells", "4", *(["--start", "0"] if last == "3" else [])], spark)
    assert spark.read.parquet(at_("u")).groupBy("z").agg(F.sum("value")).distinct().count() == 3 and {r[0] for r in spark.read.parquet(at_("u")).groupBy("z").agg(F.sum("value").alias("n")).select("n").collect()} == {6}
    cli.main(["feed-rows", "--input", at_("feed"), "--output", at_("r"), "--start", "2", "--end", "4", "--columns", "sequence long, lon double"], spark)
    assert spark.read.parquet(at_("r")).count() == 3
