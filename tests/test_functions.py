"""Tag logic, maps, text, time and geometry on hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kartolith.functions import geo, maps, tags, text
from kartolith.functions import time as times


def truths(spark, tag_map):
    df = spark.createDataFrame([(tag_map,)], "tags map<string,string>")
    return {n for n, v in df.select(*[p(F.col("tags")).alias(n) for n, p in tags.PREDICATES.items()]).first().asDict().items() if v or v is None and 1 / 0}


@pytest.mark.parametrize(
    "tag_map,want",
    [
        (None, set()),
        ({}, set()),
        ({"railway": "rail"}, {"tagged", "rail_line", "railway", "linear"}),
        ({"railway": "station"}, {"tagged", "rail_feature", "railway"}),
        ({"railway": "abandoned; yard"}, {"tagged", "rail_feature", "railway"}),
        ({"landuse": "railway;grass"}, {"tagged", "rail_feature", "railway", "landuse"}),
        ({"highway": "path", "building": "yes"}, {"tagged", "road", "building", "linear", "interesting_way", "interesting"}),
        ({"natural": "coastline"}, {"tagged", "natural", "coastline", "linear", "interesting_way", "interesting"}),
        ({"natural": "wood"}, {"tagged", "natural"}),
        ({"waterway": "ditch"}, {"tagged", "waterway", "linear", "interesting_way", "interesting"}),
        ({"waterway": "unknown"}, {"tagged", "other"}),
        ({"shop": "bakery"}, {"tagged", "poi", "interesting_node", "interesting_way", "interesting"}),
        ({"name": "x"}, {"tagged", "other"}),
    ],
)
def test_predicates(spark, tag_map, want):
    assert truths(spark, tag_map) == want


def test_merge_tags_and_splitting(spark):
    df = spark.createDataFrame([({"a": "1;2", "b": "x"}, {"a": "2; 3"}), (None, {"a": "1"}), (None, None)], "l map<string,string>, r map<string,string>")
    got = [r[0] for r in df.select(tags.merge_tags(F.col("l"), F.col("r"))).collect()]
    assert got == [{"a": "1;2;3", "b": "x"}, {"a": "1"}, None]


def test_maps(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": -2.0}, {"b": 2.0}), (None, {"a": 1.0}), (None, None)], "l map<string,double>, r map<string,double>")
    merged = maps.merge(F.col("l"), F.col("r"))
    got = df.select(maps.simplify(merged), maps.null_if_empty(maps.simplify(merged)), maps.total(merged)).collect()
    assert [tuple(r) for r in got] == [({"a": 1.0}, {"a": 1.0}, 1), ({"a": 1.0}, {"a": 1.0}, 1), ({}, None, 0)]
    counted = maps.count_values(spark.createDataFrame([(1, ["x", "y", "x"]), (1, []), (2, None)], "g int, v array<string>"), ["g"], "v")
    assert sorted(tuple(r) for r in counted.collect()) == [(1, "x", 2), (1, "y", 1)]


def test_text(spark):
    df = spark.createDataFrame([("Fix #HOT-map #b_1;#b_1 #é",), (None,), ("none",)], "t string")
    assert [r[0] for r in df.select(text.hashtags(F.col("t"))).collect()][0][:2] == ["hot-map", "b_1"]
    assert [r[0] for r in df.select(text.hashtags(F.col("t"))).collect()][1:] == [[], []]
    one = spark.range(1)
    assert one.select(text.add_author(F.lit("a,b"), F.lit("a")), text.add_author(F.lit(None).cast("string"), F.lit("c")), text.facet_of(F.lit("2020001:poi")), text.facet_of(F.lit("x")), text.base_key(F.lit("k:f")), text.is_hidden(F.lit("__id")), text.element_key(F.lit("way"), F.lit(7)), text.tile_path(F.lit(3), F.lit(1), F.lit(2), F.lit("a b")), text.strip_separator(F.lit("\u001e{}"))).first()[:] == ("a,b", "c", "poi", None, "k", True, "w7", "a+b/3/1/2.mvt", "{}")


def test_time(spark):
    df = spark.sql("select timestamp'2020-02-29 00:01:00' t")
    s, back, day = df.select(times.sequence_of(F.col("t")), times.time_of(times.sequence_of(F.col("t"))) == F.col("t"), times.day_key(F.col("t"))).first()
    assert (s, back, day) == ((1582934460 - times.EPOCH) // 60, True, 2020060)


def line(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_lengths(spark):
    null = F.lit(None).cast("array<struct<x:double,y:double>>")
    got = spark.range(1).select(geo.line_length(line((0, 0), (1, 0))), geo.line_length(line((0, 0), (1, 0), (1, 1))), geo.line_length(line((5, 5))), geo.line_length(null), geo.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()
    degree = math.pi / 180 * geo.EARTH
    assert got[0] == pytest.approx(degree) and got[1] == pytest.approx(2 * degree, rel=1e-6) and got[2] == got[3] == 0 and got[4] is None


def test_utm_area(spark):
    dx, dy = 100 / (math.pi / 180 * geo.EARTH * math.cos(math.radians(45.0))), 100 / 111_132.95
    square = [(9.0, 45.0), (9.0 + dx, 45.0), (9.0 + dx, 45.0 + dy), (9.0, 45.0 + dy)]
    null = F.lit(None).cast("array<struct<x:double,y:double>>")
    a, b, c = spark.range(1).select(geo.utm_area(line(*square)), geo.utm_area(line(*square[:2])), geo.utm_area(null)).first()
    assert a == pytest.approx(10_000, rel=5e-3) and b == c == 0
    x, y = geo.utm_xy(np.array([9.0]), np.array([0.0]), 32)
    assert abs(x[0] - 500_000) < 1e-6 and abs(y[0]) < 1e-6


def test_tiles(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-180.0, 85.0), (179.999, -85.0), (180.0, 0.0), (0.0, 85.06)], "lon double, lat double")
    x, y = geo.tile_x(F.col("lon"), 1), geo.tile_y(F.col("lat"), 1)
    assert [tuple(r) for r in df.select(x, y, geo.in_grid(x, y, 1)).collect()] == [(1, 1, True), (0, 0, True), (1, 1, True), (2, 1, False), (1, -1, False)]
    assert [r[0] for r in spark.range(4).select(geo.zorder(F.col("id"), F.lit(3) - F.col("id"), 2)).collect()] == [10, 9, 6, 5]
    lon, lat = geo.cell_centre(F.lit(1), F.lit(1), 1)
    assert spark.range(1).select(lon, F.round(lat, 4)).first()[:] == (90.0, -66.5133)


@pytest.mark.parametrize("box,address", [((0.1, 0.1, 0.2, 0.2), "00"), ((0.1, 0.1, 0.9, 0.2), ""), ((0.8, 0.8, 0.81, 0.81), "333333"), ((0.0, 0.6, 0.0, 0.6), "200220")])
def test_quad_address(spark, box, address):
    got = spark.range(1).select(geo.quad_address(*[F.lit(v) for v in box], 6)).first()[0]
    brute, (x0, y0, x1, y1), half = "", box, 1.0
    ox = oy = 0.0
    while len(brute) < 6:
        half /= 2
        qx, qy = {v >= ox + half for v in (x0, x1)}, {v >= oy + half for v in (y0, y1)}
        if len(qx) > 1 or len(qy) > 1:
            break
        a, b = qx.pop(), qy.pop()
        brute, ox, oy = brute + str(a + 2 * b), ox + half * a, oy + half * b
    assert got == brute and got.startswith(address[:2])
