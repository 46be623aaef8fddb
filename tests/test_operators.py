"""Operators on small cases and by invariants."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartolith.operators import changesets, countries, footprints, history, matching, rollups, stats, stores, tile_schemas, tiles

T = datetime(2020, 1, 1)


def test_actions_overlap(spark):
    rows = [(1, 1, 0, True), (1, 1, 0, False), (1, 2, 0, True), (1, 1, 1, True), (1, 3, 0, False)]
    e = spark.createDataFrame(rows, "changeset long, version int, minor_version int, visible boolean").withColumns({"tags": F.create_map(F.lit("highway"), F.lit("x"), F.lit("building"), F.lit("y")), "linear_m": F.lit(1000.0), "area_m2": F.lit(0.0)})
    r = stats.changeset_stats(e).first()
    assert r.counts == {f"{c}_{a}": 2 for c in ("roads", "buildings") for a in ("added", "modified", "deleted")} and r.total_edits == 12 and r.edits == 5
    assert r.measurements == {"road_km_added": 2.0, "road_km_modified": 2.0, "road_km_deleted": 2.0}
    a, b = stats.changeset_stats(e.limit(2)), stats.changeset_stats(e.withColumn("changeset", F.lit(2)))
    merged = {r.changeset: r.total_edits for r in stats.merge_stats(a, b).collect()}
    assert merged[2] == 12 and set(merged) == {1, 2}


def test_area_and_previous_geometry(spark):
    ring = lambda s: [(9.0, 45.0), (9.0 + s, 45.0), (9.0 + s, 45.0 + s), (9.0, 45.0 + s)]
    rows = [(1, v, 0, T + timedelta(days=v), ring(s), {"landuse": "x"}) for v, s in ((1, 0.001), (2, 0.002))]
    h = spark.createDataFrame(rows, "id long, version int, minor_version int, updated timestamp, geom array<struct<x:double,y:double>>, tags map<string,string>")
    a = [r.area_m2 for r in stats.with_area_delta(stats.with_previous_geometry(h)).orderBy("version").collect()]
    assert a[0] == pytest.approx(8780, rel=0.02) and a[1] == pytest.approx(3 * a[0], rel=1e-3)


def test_way_reconstruction(spark):
    at = lambda d: T + timedelta(days=d)
    nodes = spark.createDataFrame([(1, at(0), 0.0, 0.0, 1), (2, at(0), 1.0, 0.0, 1), (2, at(5), 2.0, 0.0, 2), (3, at(9), 5.0, 5.0, 1)], "id long, timestamp timestamp_ntz, lon double, lat double, version long")
    nodes = history.with_validity(nodes, "id", "timestamp", "version")
    ways = spark.createDataFrame([(10, 1, at(1), [1, 2, 1]), (10, 2, at(8), [2, 1]), (11, 1, at(6), [2, 3])], "id long, version long, timestamp timestamp_ntz, nds array<long>")
    got = history.reconstruct_ways(history.with_validity(ways, "id", "timestamp", "version"), nodes).orderBy("id", "version", "minor_version").collect()
    assert [(r.id, r.version, r.minor_version, r.updated, [(p.x, p.y) for p in r.geom]) for r in got] == [
        (10, 1, 0, at(1), [(0, 0), (1, 0), (0, 0)]), (10, 1, 1, at(5), [(0, 0), (2, 0), (0, 0)]), (10, 2, 0, at(8), [(2, 0), (0, 0)]), (11, 1, 0, at(6), [(2, 0)]), (11, 1, 1, at(9), [(2, 0), (5, 5)])
    ]


def test_deleted_nodes_keep_coordinates(spark):
    rows = [(1, 1, T, 1.0, 2.0), (1, 2, T + timedelta(1), None, None), (1, 3, T + timedelta(2), 3.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, version int, timestamp timestamp_ntz, lon double, lat double")
    got = history.carry_forward(df, "lon", "lat").orderBy("version").collect()
    assert [(r.lon, r.lat) for r in got] == [(1, 2), (1, 2), (3, 2)]


def test_reduce_tags(spark):
    df = spark.createDataFrame([(1, {"a": "x;y", "b": "1"}), (1, {"a": "w"}), (2, None), (3, {"c": None})], "g int, tags map<string,string>")
    assert {r.g: r.tags for r in history.reduce_tags(df, "g").collect()} == {1: {"a": "w;x;y", "b": "1"}, 2: None, 3: {"c": ""}}


def test_assembly_aligns_pairs(spark):
    c = spark.createDataFrame([(1, 5, T, None, 10_000_000), (2, 6, T, T, None)], "id long, user_id long, created_at timestamp, closed_at timestamp, min_lat int")
    t = spark.createDataFrame([(1, "k", None), (1, "j", "v"), (1, None, "z")], "changeset_id long, k string, v string")
    m = spark.createDataFrame([(1, 9, "hey", T), (1, 5, None, T)], "changeset_id long, author_id long, body string, created_at timestamp")
    u = spark.createDataFrame([(5, "five"), (6, "six")], "id long, display_name string")
    one, two = changesets.assemble(c, t, m, u).orderBy("id").collect()
    assert one.tags == {"k": None, "j": "v"} and {(x.uid, x.user, x.body) for x in one.comments} == {(9, None, "hey"), (5, "five", None)} and one.comments_count == 2 and one.open and one.min_lat == 1.0
    assert two.tags is None and two.comments_count == 0 and not two.open
    assert changesets.end_time(c).first()[0] == T


def test_ranks_keep_ties(spark):
    df = spark.createDataFrame([("g", i, 5 if i < 3 else 1) for i in range(5)], "g string, k int, n int")
    assert rollups.top(df, "g", "n", 2).count() == 3
    m = spark.createDataFrame([(1, {"a": 1.0}, 3), (1, {"a": 2.0, "b": 1.0}, None), (2, None, 1)], "u int, m map<string,double>, total_edits int").withColumns({"closed_at": F.lit(T), "created_at": F.lit(T)})
    got = {r.u: (r.changeset_count, r.edit_count, r.m) for r in rollups.statistics(m, "u", measure_maps=("m",)).collect()}
    assert got == {1: (2, 3, {"a": 3.0, "b": 1.0}), 2: (1, 1, None)}


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = [(rng.choice([2020001, 2020002]), rng.uniform(-180, 180), rng.uniform(-80, 80), rng.randrange(6)) for _ in range(500)]
    rows += [(2020001, None, 1.0, 0), (2020001, float("nan"), 1.0, 0), (2020001, 0.0, 89.0, 0), (2020001, 181.0, 0.0, 0)]
    return spark.createDataFrame(rows, "key int, lon double, lat double, sequence long")


def test_pyramid_conserves_sums(points):
    got = footprints.edit_histogram(points)
    assert {r.z: r.s for r in got.groupBy("z").agg(F.sum("value").alias("s")).collect()} == {z: 500 for z in range(11)}
    assert got.where("cell < 0 or cell >= 16384").count() == 0
    up = got.where("z = 10").select("key", (F.col("x") / 2).cast("long").alias("x"), (F.col("y") / 2).cast("long").alias("y"), "value").groupBy("key", "x", "y").agg(F.sum("value").alias("value"))
    at9 = got.where("z = 9").groupBy("key", "x", "y").agg(F.sum("value").alias("value"))
    assert up.exceptAll(at9).count() == 0 == at9.exceptAll(up).count()


def test_replay_changes_nothing(spark, points):
    grid = tiles.Grid(4, 16)
    whole = footprints.edit_histogram(points.drop("sequence"), grid=grid)
    empty, none = whole.where("false"), spark.createDataFrame([], "z int, x long, y long, sequence long")
    cells, known = footprints.update(empty, none, points.where("sequence < 4"), grid)
    cells, known = footprints.update(cells, known, points, grid)
    cells, known = footprints.update(cells, known, points, grid)
    same = [c.select("key", "z", "x", "y", "cell", "value") for c in (cells, whole)]
    assert same[0].exceptAll(same[1]).count() == 0 == same[1].exceptAll(same[0]).count()
    features = tiles.vectorize(whole)
    assert features.select(F.sum(F.aggregate(F.map_values("values"), F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] == 500 * 5
    assert spark.range(1).select(tiles.remember_sequences(F.array(*[F.lit(i).cast("long") for i in range(5)]), F.array(F.lit(9).cast("long")), 3)).first()[0] == [3, 4, 9]


def test_footprint_selections(spark):
    n = spark.createDataFrame([(1, 10, 0.0, 0.0), (2, 11, 1.0, 1.0), (1, 12, 2.0, 2.0)], "uid long, changeset long, lon double, lat double")
    h = spark.createDataFrame([(10, "a"), (11, "b"), (10, "b")], "changeset long, hashtag string")
    listed = spark.createDataFrame([("a",)], "hashtag string")
    keys = lambda **k: sorted(r.key for r in footprints.target_points(n, h, **k).collect())
    assert keys() == ["1", "1", "2"] and keys(hashtags=listed) == ["1", "1"] and keys(by="hashtag") == ["a", "b", "b"] and keys(by="hashtag", hashtags=listed) == ["a"]


def test_schemas(spark):
    v = spark.createDataFrame([(1, 1, 0, T, "a", True), (1, 2, 0, T + timedelta(1), "b", True), (2, 1, 0, T, "a", True), (2, 2, 0, T + timedelta(2), "a", False)], "id long, version int, minor_version int, updated timestamp, author string, visible boolean")
    assert [(r.id, r.version) for r in tile_schemas.snapshot(v).collect()] == [(1, 2)]
    assert sum(r.valid_until is None for r in tile_schemas.history(v).collect()) == 2
    assert {r.id: (r.authors, r.last_author, r.versions) for r in tile_schemas.authorship(v).collect()} == {1: ("a,b", "b", 2), 2: ("a", "a", 2)}
    old, new = v.where("version = 1"), v.where("version = 2")
    assert {r.id: r.version for r in tile_schemas.merge_features(old, new).collect()} == {1: 2}
    late = v.where("id = 1 and version = 1")
    assert {r.id: r.version for r in tile_schemas.merge_features(v.where("id = 1 and version = 2"), late).collect()} == {1: 2}


def test_stores(spark, tmp_path):
    table = stores.SnapshotTable(spark, f"file://{tmp_path}/t", "id long, name string")
    assert table.read().count() == 0 and table.version() == 0
    table.replace(spark.createDataFrame([(1, "a")], "id long, name string"))
    table.replace(stores.rename_users(table.read(), spark.createDataFrame([(1, "b"), (2, "c")], "id long, name string")))
    assert table.version() == 2 and sorted(map(tuple, table.read().collect())) == [(1, "b"), (2, "c")]
    assert sorted(map(tuple, stores.insert_absent(table.read(), spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "id long, name string"), "id").collect())) == [(1, "b"), (2, "c"), (3, "y")]
    latest = stores.upsert_latest(spark.createDataFrame([(1, 5, "old")], "id long, at int, v string"), spark.createDataFrame([(1, 5, "new"), (1, 4, "older"), (2, 1, "x")], "id long, at int, v string"), "id", "at")
    assert sorted(map(tuple, latest.collect())) == [(1, 5, "new"), (2, 1, "x")]
    saved = stores.save_checkpoint(spark.createDataFrame([("p", 1), ("q", 2)], "proc_name string, sequence long"), "p", 7)
    assert {tuple(r) for r in stores.checkpoint_lag(saved, 12).collect()} == {("p", 7, 5, False), ("q", 2, 10, True)}
    good, bad = stores.split_errors(table.read(), F.when(F.col("id") == 1, None).otherwise(F.col("id") == 2))
    assert (good.count(), bad.count()) == (1, 1)
    stamped = stores.refresh(table.read(), stores.SnapshotTable(spark, f"file://{tmp_path}/v", "id long, name string"), "users", spark.createDataFrame([("users", T)], "mat_view string, updated_at timestamp"))
    assert [r.mat_view for r in stamped.collect()] == ["users"] and stamped.first().updated_at > T


def test_country_lookup_equals_brute_force(spark):
    """Random points in each country's bounds: grid lookup and a plain ray cast agree."""
    rng = random.Random(5)
    shapes = {c: [[[(x, y)] for x, y in ()]] for c in ()}
    for c in "abc":
        cx, cy = rng.uniform(-60, 60), rng.uniform(-40, 40)
        angles = sorted(rng.uniform(0, 6.28) for _ in range(9))
        outer = [(cx + rng.uniform(8, 25) * np.cos(a), cy + rng.uniform(8, 25) * np.sin(a)) for a in angles]
        hole = [(cx - 2, cy - 2), (cx + 2, cy - 2), (cx + 2, cy + 2), (cx - 2, cy + 2)]
        shapes[c] = [[[(float(x), float(y)) for x, y in outer], hole]]
    df = spark.createDataFrame([(c, p) for c, p in shapes.items()], "code string, polygons array<array<array<struct<x:double,y:double>>>>")
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-70, 70)) for i in range(600)]

    def inside(x, y, ring):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[-1:] + ring[:-1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    want = {(i, c) for i, x, y in pts for c, polygons in shapes.items() if any(sum(inside(x, y, r) for r in rings) % 2 for rings in polygons)}
    frame = spark.createDataFrame(pts, "id long, lon double, lat double")
    assert {(r.id, r.code) for r in countries.lookup(frame, df).collect()} == want and len(want) > 20
    coded = {r.id: r.countries for r in countries.geocode(frame, "id", df).collect()}
    assert all(coded[i] == sorted(c for j, c in want if j == i) for i in coded)


def test_matching():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert len(matching.clip(square, square + 5)) == 0
    both = matching.clip(square, square + 1)
    from kartolith.functions.geo import ring_area

    assert ring_area(both[:, 0], both[:, 1]) == pytest.approx(1) and matching.vertex_difference(square, square) == pytest.approx(0, abs=1e-9)
    assert matching.vertex_difference(square, square + 0.3) == pytest.approx(0, abs=1e-9) and matching.vertex_difference(square, square * 1.5) > 0.3
    h = matching.homography(square, square * 2 + 1)
    assert np.allclose(h @ np.array([1, 1, 1]), [3, 3, 1]) and matching.vertex_difference(square[:3], square) == float("inf")
    assert np.allclose(matching.project(np.array([(1.0, -1.0), (3.0, 3.0)]), square), [(1, 0), (2, 2)])


def test_pairs_and_scores(spark):
    rng = random.Random(9)
    rows = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(200)]
    a, b = (spark.createDataFrame(r, "id long, x double, y double") for r in (rows[:100], rows[100:]))
    got = {(r.a_id, r.b_id) for r in matching.candidate_pairs(a, b, 0.1, 0.1).collect()}
    assert got == {(i, j) for i, x, y in rows[:100] for j, u, v in rows[100:] if np.hypot(x - u, y - v) <= 0.1}
    df = spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (1, 9, 0.1)], "k long, m long, p double")
    assert tuple(matching.best_matches(df, "k", "m", "p").first()) == (1, 4, 0.5, 3)
    one = spark.range(1).select(matching.relative_similarity(F.lit(0.0), F.lit(0.0), F.lit(0.0)), matching.relative_similarity(F.lit(1.0), F.lit(2.0), F.lit(0.0)), matching.display_number(F.lit("right"), F.lit(0.25)))
    assert tuple(one.first()) == (0.0, 0.5, 1.75)


def test_building_pipeline(spark):
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    schema = "id long, tags map<string,string>, ring array<struct<x:double,y:double>>"
    left = matching.buildings(spark.createDataFrame([(1, {"building": "yes"}, ring(0.0, 0.0, 0.01)), (2, {"building": "yes"}, ring(1.0, 1.0, 0.01)), (3, {"a": "b"}, ring(0.0, 0.0, 0.01)), (4, None, ring(0.0, 0.0, 0.01))], schema))
    right = matching.buildings(spark.createDataFrame([(11, {"building": "x"}, ring(0.0, 0.0, 0.01)), (12, {"building": "x"}, ring(0.001, 0.0, 0.01)), (13, {"building": "x"}, ring(5.0, 5.0, 0.01))], schema))
    got = {r.id: (r.side, r.best, round(r.probability, 6), r.matches) for r in matching.match_buildings(left, right).collect()}
    assert got == {1: (0, 11, 1.0, 2), 2: (0, None, 0.0, 0), 11: (1, 1, 1.0, 1), 12: (1, 1, 0.9, 1), 13: (1, None, 0.0, 0)}
    shares = matching.normalise_support(spark.createDataFrame([("c", 2.0), ("c", 4.0), ("d", 0.0)], "cell string, n double"), "cell", "n")
    assert sorted(map(tuple, shares.collect())) == [("c", 0.5), ("c", 1.0), ("d", 0.0)]
    boxes = spark.createDataFrame([(0.1, 0.1, 0.2, 0.2)], "x0 double, y0 double, x1 double, y1 double")
    assert matching.quad_partition(boxes, 4, 2).first().quad == "00"
