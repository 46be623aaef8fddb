"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, maps, tags, text
from ..functions import time as times
from ..operators import changesets as cs
from ..operators import countries, footprints, history, matching, rollups, stats, stores, tile_schemas, tiles
from ..session import fresh_path
from ..sources import files
from ..streaming import jobs
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GRID = tiles.Grid(10, 128)
DEEP = GRID.base_zoom + GRID.bits


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _x(zoom: int, lon: str = "lon") -> str:
    return f"CAST(floor(({lon} + 180.0::DOUBLE) / 360.0::DOUBLE * {float(1 << zoom)}::DOUBLE) AS BIGINT)"


def _y(zoom: int, lat: str = "lat") -> str:
    return f"CAST(floor((1.0::DOUBLE - ln(tan(radians({lat})) + 1.0::DOUBLE / cos(radians({lat}))) / {math.pi!r}::DOUBLE) / 2.0::DOUBLE * {float(1 << zoom)}::DOUBLE) AS BIGINT)"


def _zorder(col: str, row: str, bits: int) -> str:
    return " + ".join(f"((({col} >> {i}) & 1) << {2 * i}) + ((({row} >> {i}) & 1) << {2 * i + 1})" for i in range(bits))


_CLASS_SQL = {
    "roads": "p_type = 'ECONOMY'", "waterways": "p_type = 'STANDARD'", "coastlines": "p_type = 'MEDIUM'", "buildings": "p_type = 'PROMO'", "railway_features": "false", "raillines": "p_type = 'SMALL'",
    "pois": "false", "landuse": "p_type = 'LARGE'", "natural": "p_type = 'MEDIUM'", "other": "false",
}
_ACTION_SQL = {"added": "version = 1 AND minor_version = 0", "modified": "NOT (version = 1 AND minor_version = 0) AND visible", "deleted": "NOT visible"}
_COUNT_ROWS = " UNION ALL ".join(f"SELECT changeset, '{c}_{a}' AS key FROM e WHERE {p} AND {w}" for c, p in _CLASS_SQL.items() if p != "false" for a, w in _ACTION_SQL.items())
_MEASURE_ROWS = " UNION ALL ".join(
    f"SELECT changeset, '{n}_{u}_{a}' AS key, {v} AS v FROM e WHERE p_type = '{p}' AND {w}"
    for n, p, u, v in (("road", "ECONOMY", "km", "linear_m / 1000"), ("waterway", "STANDARD", "km", "linear_m / 1000"), ("coastline", "MEDIUM", "km", "linear_m / 1000"), ("railline", "SMALL", "km", "linear_m / 1000"), ("landuse", "LARGE", "km2", "area_m2 / 1000000"), ("natural", "MEDIUM", "km2", "area_m2 / 1000000"))
    for a, w in _ACTION_SQL.items()
)


# Scans, projections, predicates


@query(f"WITH {fx.POINTS} SELECT event_id, lon, lat, key FROM p WHERE lon IS NOT NULL AND lat IS NOT NULL AND uid > 1")
def scan_filter_nodes(spark, sf):
    return fx.points(spark, sf).where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lat") & (F.col("uid") > 1)).select("event_id", "lon", "lat", "key")


@query("SELECT p_partkey AS id, 'say \"' || p_name || '\"' || chr(10) || p_brand AS body, p_retailprice AS price FROM part")
def csv_ingest_roundtrip(spark, sf):
    path = fresh_path(spark, "csv")
    rows = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit('say "'), "p_name", F.lit('"\n'), "p_brand").alias("body"), F.col("p_retailprice").alias("price"))
    files.write_csv(rows, path)
    return files.read_csv(spark, path, "id long, body string, price double")


@query("SELECT o_orderkey AS id, o_custkey AS uid, o_orderdate AS created_at FROM orders WHERE o_totalprice > 100000")
def orc_roundtrip(spark, sf):
    path = fresh_path(spark, "orc")
    files.write_orc(fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uid"), F.col("o_orderdate").alias("created_at"), "o_totalprice"), path, 1)
    return spark.read.orc(path).where("o_totalprice > 100000").select("id", "uid", "created_at")


_PREDICATE_SQL = {
    "tagged": "true", "road": "p_type = 'ECONOMY'", "building": "p_type = 'PROMO'", "waterway": "p_type = 'STANDARD'", "coastline": "p_type = 'MEDIUM'", "poi": "false", "landuse": "p_type = 'LARGE'",
    "natural": "p_type = 'MEDIUM'", "rail_feature": "false", "rail_line": "p_type = 'SMALL'", "railway": "p_type = 'SMALL'", "linear": "p_type IN ('ECONOMY', 'STANDARD', 'MEDIUM', 'SMALL')", "other": "false",
    "interesting_node": "false", "interesting_way": "p_type IN ('PROMO', 'ECONOMY', 'STANDARD', 'MEDIUM')", "interesting": "p_type IN ('PROMO', 'ECONOMY', 'STANDARD', 'MEDIUM')",
}


@query(f"WITH {fx.EDITS} " + " UNION ALL ".join(f"SELECT '{n}' AS predicate, count(*) FILTER ({p}) AS n FROM e" for n, p in _PREDICATE_SQL.items()))
def tag_predicates(spark, sf):
    counts = fx.edits(spark, sf).agg(*[F.count_if(p(F.col("tags"))).alias(n) for n, p in tags.PREDICATES.items()])
    return counts.unpivot([], list(tags.PREDICATES), "predicate", "n")


# Statistics


@query(f"WITH {fx.EDITS} SELECT changeset, key, count(*) AS value FROM ({_COUNT_ROWS}) GROUP BY ALL")
def changeset_counts(spark, sf):
    return stats.long_counts(fx.edits(spark, sf))


@query(f"WITH {fx.EDITS} SELECT changeset, key, round(sum(v), 3) AS value FROM ({_MEASURE_ROWS}) GROUP BY ALL HAVING sum(v) <> 0")
def changeset_measurements(spark, sf):
    return stats.long_counts(fx.edits(spark, sf), measures=True).withColumn("value", F.round("value", 3))


@query(f"WITH {fx.EDITS}, n AS (SELECT changeset, count(*) AS n FROM ({_COUNT_ROWS}) GROUP BY ALL) SELECT changeset, coalesce(any_value(n), 0) AS total_edits, count(*) AS edits FROM e LEFT JOIN n USING (changeset) GROUP BY changeset")
def changeset_total_edits(spark, sf):
    return stats.changeset_stats(fx.edits(spark, sf)).select("changeset", "total_edits", "edits")


@query(f"WITH {fx.EDITS} SELECT changeset, country, count(*) AS edit_count FROM e GROUP BY ALL")
def changeset_countries(spark, sf):
    return stats.country_counts(fx.edits(spark, sf))


@query(f"WITH {fx.EDITS} SELECT changeset, key, count(*) AS value FROM ({_COUNT_ROWS}) GROUP BY ALL")
def full_outer_stats(spark, sf):
    """Ways and points apart, then merged: the same counts as together."""
    e = fx.edits(spark, sf)
    ways, nodes = (stats.changeset_stats(e.where(F.col("l_linenumber") % 3 == 0)), stats.changeset_stats(e.where(F.col("l_linenumber") % 3 != 0)))
    return stats.long_form(stats.merge_stats(ways, nodes), "counts")


@query("SELECT k AS key, sum(n) AS value FROM (SELECT l_returnflag || l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT o_orderstatus || 'x' AS k, count(*) FROM orders GROUP BY ALL) GROUP BY ALL".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def merge_count_maps(spark, sf):
    """Two maps of counts added key by key."""
    one = lambda df, k: df.groupBy(k.alias("k")).count().agg(F.map_from_entries(F.collect_list(F.struct("k", "count"))).alias("m"), F.lit(1).alias("g"))
    a = one(fx.table(spark, sf, "lineitem"), F.concat("l_returnflag", "l_linestatus"))
    b = one(fx.table(spark, sf, "orders"), F.concat("o_orderstatus", F.lit("x")))
    return a.alias("a").join(b.alias("b"), "g").select(F.explode(maps.merge(F.col("a.m"), F.col("b.m"), "bigint")).alias("key", "value"))


# Hashtags and metadata

_COMMENT = "'fix ' || p_name || ' #' || replace(p_brand, 'Brand#', 'tag-') || ' #HOT-' || p_type || ' #' || replace(p_brand, 'Brand#', 'TAG-')"


def _comments(spark, sf):
    brand = lambda s: F.regexp_replace("p_brand", "Brand#", s)
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("fix "), "p_name", F.lit(" #"), brand("tag-"), F.lit(" #HOT-"), "p_type", F.lit(" #"), brand("TAG-")).alias("comment"))


@query(f"SELECT p_partkey AS id, array_to_string([lower(replace(p_brand, 'Brand#', 'tag-')), lower('hot-' || p_type)], ',') AS hashtags FROM part")
def hashtag_extract(spark, sf):
    return _comments(spark, sf).select("id", F.array_join(text.hashtags(F.col("comment")), ",").alias("hashtags"))


@query(f"SELECT hashtag, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(lower({_COMMENT}), '#([\\w-]+)', 1))) AS hashtag FROM part) GROUP BY ALL")
def hashtag_frequency(spark, sf):
    return _comments(spark, sf).select(F.explode(text.hashtags(F.col("comment"))).alias("hashtag")).groupBy("hashtag").agg(F.count("*").alias("n"))


@query(f"""WITH {fx.CHANGESETS} SELECT id, uid, "user", editor, created_at, max(closed_at) AS closed_at, 'a,' || lower(editor[1:1]) AS hashtags FROM c GROUP BY ALL""")
def changeset_metadata(spark, sf):
    c = fx.changesets(spark, sf).withColumns({"comment": F.lit("work #a"), "hashtags_tag": F.concat(F.lit("#A;#"), F.substring("editor", 1, 1))})
    twice = c.unionByName(c.withColumn("closed_at", F.lit(None).cast("timestamp_ntz")))
    return cs.metadata(twice).withColumn("hashtags", F.array_join("hashtags", ","))


@query("""
WITH t AS (SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS n_tags FROM lineitem GROUP BY ALL),
k AS (SELECT l_orderkey AS id, count(*) AS n_comments, count(*) FILTER (s_name IS NULL) AS unknown FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 2 = 0 GROUP BY ALL)
SELECT o_orderkey AS id, o_custkey AS uid, c_name AS "user", coalesce(n_tags, 0) AS n_tags, coalesce(n_comments, 0) AS comments_count, coalesce(unknown, 0) AS unknown, o_orderstatus = 'P' AS open
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN t ON t.id = o_orderkey LEFT JOIN k ON k.id = o_orderkey
""")
def changeset_assembly(spark, sf):
    c = fx.changesets(spark, sf).select("id", F.col("uid").alias("user_id"), "created_at", "closed_at")
    line = fx.table(spark, sf, "lineitem")
    tag_rows = line.select(F.col("l_orderkey").alias("changeset_id"), F.col("l_linenumber").cast("string").alias("k"), "l_returnflag").withColumnRenamed("l_returnflag", "v")
    people = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"))
    authors = fx.table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_name").alias("display_name"))
    comments = line.select(F.col("l_orderkey").alias("changeset_id"), (-F.col("l_suppkey") - 1).alias("author_id"), F.col("l_returnflag").alias("body"), F.col("l_shipdate").alias("created_at"))
    out = cs.assemble(c, tag_rows, comments, people.unionByName(authors))
    unknown = F.coalesce(F.size(F.filter("comments", lambda x: x["user"].isNull())), F.lit(0)).cast("long")
    return out.select("id", "uid", "user", F.coalesce(F.size("tags"), F.lit(0)).cast("long").alias("n_tags"), "comments_count", unknown.alias("unknown"), "open")


@query(f"""WITH {fx.CHANGESETS}, b AS (SELECT id, uid, editor, created_at, closed_at, -1 AS sequence FROM c UNION ALL SELECT id, uid, 'new', created_at, closed_at + INTERVAL 1 HOUR, 7 FROM c WHERE id % 3 = 0)
SELECT id, uid, editor, sequence FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(closed_at, created_at) DESC, sequence DESC) = 1""")
def merge_changesets(spark, sf):
    old = fx.changesets(spark, sf).select("id", "uid", "editor", "created_at", "closed_at").withColumn("sequence", F.lit(-1))
    new = old.where("id % 3 = 0").select(F.lit(7).alias("sequence"), F.lit("new").alias("editor"), (F.col("closed_at") + F.expr("interval 1 hour")).alias("closed_at"), "created_at", "uid", "id")
    return cs.merge_changesets(old, new).select("id", "uid", "editor", "sequence")


# History


@query("SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def prev_value_lag(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return fx.table(spark, sf, "events").select("event_id", "user_id", (F.col("value") - F.lag("value").over(order)).alias("delta"))


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INT) AS minor_version FROM events")
def minor_version(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", F.col("user_id").alias("id"), F.col("event_type").alias("version"), F.col("ts").alias("updated"))
    return history.with_minor_version(rows, "event_id").select("event_id", F.col("id").alias("user_id"), "minor_version")


_VALID = "v AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_until FROM events)"


@query(f"WITH {_VALID} SELECT * FROM v")
def validity_interval(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return history.with_validity(rows, "user_id", "ts", "event_id")


@query(f"WITH {_VALID} SELECT l.event_id, r.event_id AS held_by FROM events l JOIN v r ON l.user_id = r.user_id AND r.ts <= l.ts AND (r.valid_until IS NULL OR l.ts < r.valid_until)")
def asof_way_node_join(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", "user_id", "ts")
    valid = history.with_validity(rows, "user_id", "ts", "event_id")
    return history.asof_join(rows, valid, "user_id", "ts", "ts", "valid_until").select(F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("held_by"))


@query(f"WITH {_VALID} SELECT coalesce(w.event_id, -1) AS way, n.event_id AS node FROM (SELECT * FROM v WHERE user_id % 2 = 0) w RIGHT JOIN events n ON w.user_id = n.user_id WHERE w.ts IS NULL OR (w.ts <= n.ts AND (w.valid_until IS NULL OR n.ts < w.valid_until))")
def right_outer_validity(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", "user_id", "ts")
    ways = history.with_validity(rows, "user_id", "ts", "event_id").where("user_id % 2 = 0").select(F.col("event_id").alias("way"), F.col("user_id").alias("ref"), F.col("ts").alias("since"), "valid_until")
    nodes = rows.select(F.col("event_id").alias("node"), F.col("user_id").alias("ref"), F.col("ts").alias("updated"))
    return history.right_outer_validity(ways, nodes).select(F.coalesce("way", F.lit(-1)).alias("way"), "node")


@query(f"WITH {fx.EDITS} SELECT changeset, id, max(version) AS version, max(updated) AS updated FROM e GROUP BY ALL")
def latest_version(spark, sf):
    return history.latest_versions(fx.edits(spark, sf))


@query(f"WITH {fx.EDITS}, k AS (SELECT DISTINCT changeset, p_type FROM e) SELECT changeset, string_agg(p_type, ';' ORDER BY p_type) AS kinds FROM k GROUP BY ALL")
def reduce_tags(spark, sf):
    rows = fx.edits(spark, sf).select("changeset", F.create_map(F.lit("kind"), F.col("p_type")).alias("tags"))
    return history.reduce_tags(rows, "changeset").select("changeset", F.col("tags")["kind"].alias("kinds"))


@query(f"WITH {fx.EDITS} SELECT o_orderkey AS changeset, coalesce(bool_or(NOT visible), false) AS any_deleted, count(id) AS edits FROM orders LEFT JOIN e ON changeset = o_orderkey GROUP BY ALL")
def left_outer_any(spark, sf):
    c = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("changeset"))
    return c.join(fx.edits(spark, sf), "changeset", "left_outer").groupBy("changeset").agg(F.coalesce(F.bool_or(~F.col("visible")), F.lit(False)).alias("any_deleted"), F.count("id").alias("edits"))


# Roll-ups

_CS = f"""{fx.CHANGESETS}, n AS (SELECT changeset, count(*) AS total_edits FROM e GROUP BY ALL), t AS (SELECT c.*, id AS changeset, total_edits FROM c LEFT JOIN n ON id = changeset)"""


def _totals(spark, sf):
    n = fx.edits(spark, sf).groupBy("changeset").agg(F.count("*").alias("total_edits"))
    return fx.changesets(spark, sf).withColumn("changeset", F.col("id")).join(n, "changeset", "left")


_SUM = "count(*) AS changeset_count, CAST(sum(coalesce(total_edits, 0)) AS BIGINT) AS edit_count, max(coalesce(closed_at, created_at)) AS last_edit"


@query(f'WITH {fx.EDITS}, {_CS} SELECT uid, "user", {_SUM} FROM t GROUP BY ALL')
def user_statistics(spark, sf):
    return rollups.totals(_totals(spark, sf), "uid", "user")


@query(f"WITH {fx.EDITS}, {_CS}, {fx.BRIDGE} SELECT hashtag, {_SUM} FROM t JOIN b USING (changeset) GROUP BY ALL")
def hashtag_statistics(spark, sf):
    return rollups.totals(_totals(spark, sf).join(fx.bridge(spark, sf), "changeset"), "hashtag")


@query(f"WITH {fx.EDITS}, {_CS}, k AS (SELECT DISTINCT changeset, country FROM e) SELECT country, {_SUM} FROM t JOIN k USING (changeset) GROUP BY ALL")
def country_statistics(spark, sf):
    return rollups.totals(_totals(spark, sf).join(fx.edits(spark, sf).select("changeset", "country").distinct(), "changeset"), "country")


@query(f"WITH {fx.EDITS}, {_CS}, {fx.BRIDGE} SELECT hashtag, uid, {_SUM} FROM t JOIN b USING (changeset) GROUP BY ALL")
def hashtag_user_statistics(spark, sf):
    return rollups.totals(_totals(spark, sf).join(fx.bridge(spark, sf), "changeset"), "hashtag", "uid")


@query(f"WITH {fx.EDITS}, k AS (SELECT c_custkey AS uid, o_orderkey AS changeset FROM orders JOIN customer ON o_custkey = c_custkey) SELECT uid, key, count(*) AS value FROM ({_COUNT_ROWS}) JOIN k USING (changeset) GROUP BY ALL")
def user_count_maps(spark, sf):
    per = stats.changeset_stats(fx.edits(spark, sf)).join(fx.changesets(spark, sf).select(F.col("id").alias("changeset"), "uid"), "changeset")
    merged = rollups.as_map(rollups.map_sums(per, "counts", "uid"), "counts", "uid")
    return stats.long_form(merged, "counts", ("uid",))


@query(f"WITH {fx.EDITS}, {_CS}, {fx.BRIDGE}, k AS (SELECT DISTINCT changeset, country FROM e), s AS (SELECT country, hashtag, count(*) AS changeset_count, CAST(sum(coalesce(total_edits, 0)) AS BIGINT) AS edit_count FROM t JOIN k USING (changeset) JOIN b USING (changeset) GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY country ORDER BY edit_count DESC) AS rank FROM s QUALIFY rank <= 10")
def top_hashtags_per_country(spark, sf):
    c = _totals(spark, sf).join(fx.edits(spark, sf).select("changeset", "country").distinct(), "changeset")
    return rollups.breakdown(c, fx.bridge(spark, sf), "country", "hashtag", 10)


@query(f"WITH {fx.EDITS}, {_CS}, s AS (SELECT uid, editor, count(*) AS changeset_count, CAST(sum(coalesce(total_edits, 0)) AS BIGINT) AS edit_count FROM t GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY uid ORDER BY edit_count DESC) AS rank FROM s QUALIFY rank <= 2")
def top_editors_per_user(spark, sf):
    return rollups.breakdown(_totals(spark, sf), None, "uid", "editor", 2)


# Tiles


@query(f"WITH {fx.POINTS}, t AS (SELECT event_id, {_x(10)} AS x, {_y(10)} AS y FROM p) SELECT * FROM t WHERE x BETWEEN 0 AND 1023 AND y BETWEEN 0 AND 1023")
def point_tile(spark, sf):
    x, y = geo.tile_x(F.col("lon"), 10), geo.tile_y(F.col("lat"), 10)
    return fx.points(spark, sf).select("event_id", x.alias("x"), y.alias("y")).where(geo.in_grid(F.col("x"), F.col("y"), 10))


_FACETS = ("click", "purchase")


def _facets(spark, sf):
    p = fx.points(spark, sf)
    return p.withColumns({f: (F.col("event_type") == f).cast("int") for f in _FACETS})


_FACET_ROWS = " UNION ALL ".join([f"SELECT event_id, CAST(key AS VARCHAR) AS key, lon, lat FROM p", *(f"SELECT event_id, key || ':{f}', lon, lat FROM p WHERE event_type = '{f}'" for f in _FACETS)])


@query(f"WITH {fx.POINTS} SELECT event_id, key FROM ({_FACET_ROWS})")
def facet_tiles(spark, sf):
    return tiles.facet_rows(_facets(spark, sf).select("event_id", "key", *_FACETS), list(_FACETS)).select("event_id", "key")


_CELLS = f"g AS (SELECT key, {_x(DEEP)} AS gx, {_y(DEEP)} AS gy FROM p), k AS (SELECT * FROM g WHERE gx BETWEEN 0 AND {(1 << DEEP) - 1} AND gy BETWEEN 0 AND {(1 << DEEP) - 1})"


@query(f"WITH {fx.POINTS}, {_CELLS} SELECT key, gx, gy, count(*) AS value FROM k GROUP BY ALL")
def rasterize(spark, sf):
    return tiles.rasterize(tiles.points_to_cells(fx.points(spark, sf), GRID, "key"), "key")


def _pyramid_sql(key: str, source: str, grid: tiles.Grid, extra: str = "", zooms: str | None = None) -> str:
    deep = grid.base_zoom + grid.bits
    last = (1 << deep) - 1
    return f"""g AS (SELECT {key} AS key{extra}, {_x(deep)} AS gx, {_y(deep)} AS gy FROM ({source}) s),
k AS (SELECT key{extra}, z, gx >> ({grid.base_zoom} - z) AS cx, gy >> ({grid.base_zoom} - z) AS cy FROM g, (SELECT unnest({zooms or f"range(0, {grid.base_zoom + 1})"}) AS z) WHERE gx BETWEEN 0 AND {last} AND gy BETWEEN 0 AND {last}),
pyramid AS (SELECT key{extra}, CAST(z AS INT) AS z, cx >> {grid.bits} AS x, cy >> {grid.bits} AS y, {_zorder("cx", "cy", grid.bits)} AS cell, count(*) AS value FROM k GROUP BY ALL)"""


@query(f"WITH {fx.POINTS}, {_pyramid_sql('key', 'SELECT * FROM p', GRID)} SELECT * FROM pyramid")
def edit_histogram(spark, sf):
    return footprints.edit_histogram(fx.points(spark, sf))


@query(f"WITH {fx.POINTS}, {_pyramid_sql('key', 'SELECT * FROM p', GRID)} SELECT z, count(*) AS cells, CAST(sum(value) AS BIGINT) AS total FROM pyramid GROUP BY ALL")
def tile_pyramid(spark, sf):
    return footprints.edit_histogram(fx.points(spark, sf)).groupBy("z").agg(F.count("*").alias("cells"), F.sum("value").alias("total"))


@query(f"WITH {fx.POINTS}, {_pyramid_sql('key', _FACET_ROWS, GRID)} SELECT * FROM pyramid")
def faceted_histogram(spark, sf):
    return footprints.edit_histogram(_facets(spark, sf), list(_FACETS))


@query(f"WITH {fx.POINTS}, {_pyramid_sql('key', _FACET_ROWS, GRID)} SELECT z, x, y, CASE WHEN contains(key, ':') THEN split_part(key, ':', 2) END AS facet, CAST(sum(value) AS BIGINT) AS total, max(CAST(split_part(key, ':', 1) AS INT)) AS last_day FROM pyramid GROUP BY ALL")
def tile_totals(spark, sf):
    return tiles.totals_by_facet(footprints.edit_histogram(_facets(spark, sf), list(_FACETS)))


@query(f"WITH {fx.POINTS}, {_pyramid_sql('CAST(uid AS VARCHAR)', 'SELECT * FROM p', tiles.FOOTPRINT)} SELECT * FROM pyramid")
def user_footprint(spark, sf):
    return footprints.footprints(footprints.target_points(fx.points(spark, sf).withColumn("changeset", F.col("event_id")), None))


@query(f"WITH {fx.POINTS}, {_pyramid_sql('event_type', 'SELECT * FROM p', tiles.FOOTPRINT)} SELECT key, z, x, y, count(*) AS count, CAST(sum(value) AS BIGINT) AS total FROM pyramid GROUP BY ALL")
def hashtag_footprint(spark, sf):
    p = fx.points(spark, sf).withColumn("changeset", F.col("event_id"))
    rows = footprints.target_points(p, p.select("changeset", F.col("event_type").alias("hashtag")), by="hashtag")
    return tiles.tile_counts(footprints.footprints(rows), "key")


@query(f"WITH {fx.POINTS} SELECT event_id, {_zorder(_x(7), _y(7), 7)} AS code FROM p WHERE {_y(7)} BETWEEN 0 AND 127")
def zorder_index(spark, sf):
    x, y = geo.tile_x(F.col("lon"), 7), geo.tile_y(F.col("lat"), 7)
    return fx.points(spark, sf).select("event_id", geo.zorder(x, y, 7).alias("code"), y.alias("y")).where(F.col("y").between(0, 127)).drop("y")


@query(f"WITH {fx.POINTS} SELECT event_id, sequence FROM p WHERE sequence % 5 <> 0")
def uncommitted_sequences(spark, sf):
    p = fx.points(spark, sf).withColumns({"z": F.lit(0), "x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})
    return tiles.uncommitted(p, p.where("sequence % 5 = 0").select("z", "x", "y", "sequence").distinct()).select("event_id", "sequence")


@query(f"WITH {fx.POINTS}, {_pyramid_sql('key', 'SELECT * FROM p', GRID, zooms='[10, 9]')} SELECT * FROM pyramid")
def tile_update_merge(spark, sf):
    """Half of the points created, then all applied as an update with the first half's sequences committed: the whole."""
    p, zooms = fx.points(spark, sf), [10, 9]
    first = p.where("sequence % 2 = 0")
    stored = footprints.edit_histogram(first, zooms=zooms)
    committed = tiles.pyramid(tiles.points_to_cells(first, GRID, "sequence"), GRID, "sequence", zooms=zooms).select("z", "x", "y", "sequence").distinct()
    return footprints.update(stored, committed, p, GRID, zooms)[0]


_VERSIONS = "v AS (SELECT user_id AS id, event_id, ts AS updated, event_type AS author, event_type <> 'error' AS visible FROM events)"


def _versions(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.lit(0).alias("minor_version"), F.col("ts").alias("updated"), F.col("event_type").alias("author"), (F.col("event_type") != "error").alias("visible"))


@query(f"WITH {_VERSIONS} SELECT id, event_id AS version FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated DESC, event_id DESC) = 1) WHERE visible")
def tile_snapshot(spark, sf):
    return tile_schemas.snapshot(_versions(spark, sf)).select("id", "version")


@query(f"WITH {_VERSIONS} SELECT id, event_id AS version, updated, lead(updated) OVER (PARTITION BY id ORDER BY updated, event_id) AS valid_until FROM v")
def tile_history_scd2(spark, sf):
    return tile_schemas.history(_versions(spark, sf)).select("id", "version", "updated", "valid_until")


@query(f"WITH {_VERSIONS} SELECT id, min(updated) AS created, string_agg(DISTINCT author, ',' ORDER BY author) AS authors, arg_max(author, (updated, event_id)) AS last_author, count(*) AS versions FROM v GROUP BY ALL")
def tile_authors(spark, sf):
    return tile_schemas.authorship(_versions(spark, sf)).drop("minor_version")


# Stores


@query("SELECT user_id AS changeset, event_type AS name, round(sum(value), 3) AS value FROM events GROUP BY ALL")
def upsert_stats(spark, sf):
    """Two overlapping deliveries, the second replayed: every sequence counts once."""
    rows = fx.points(spark, sf).groupBy(F.col("uid").alias("changeset"), F.col("event_type").alias("name"), "sequence").agg(F.sum("value").alias("value"))
    empty, applied = rows.where("false").drop("sequence"), rows.where("false").select("changeset", "sequence")
    first = rows.where("sequence % 2 = 0")
    table, applied = stores.upsert_counts(empty, first, applied)
    table, applied = stores.upsert_counts(table, rows, applied)
    table, applied = stores.upsert_counts(table, rows, applied)
    return table.select("changeset", "name", F.round("value", 3).alias("value"))


@query("SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_name) AS ids, CAST(min(1) AS BIGINT) AS first, count(DISTINCT p_name) AS last FROM part")
def get_or_create_hashtags(spark, sf):
    names = fx.table(spark, sf, "part").select(F.col("p_name").alias("hashtag"))
    some = stores.assign_ids(spark.createDataFrame([], "id long, hashtag string"), names.where("length(hashtag) % 2 = 0"))
    out = stores.assign_ids(some, names)
    return out.agg(F.countDistinct("hashtag").alias("names"), F.countDistinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(f"WITH {fx.POINTS}, s AS (SELECT event_type AS proc_name, max(sequence) AS sequence FROM p GROUP BY ALL) SELECT proc_name, sequence, (SELECT max(sequence) FROM p) - sequence AS behind, (SELECT max(sequence) FROM p) - sequence >= 10 AS alert FROM s")
def checkpoint_lag(spark, sf):
    p = fx.points(spark, sf)
    saved = p.groupBy(F.col("event_type").alias("proc_name")).agg(F.max("sequence").alias("sequence"))
    return stores.checkpoint_lag(saved, p.agg(F.max("sequence")).first()[0])


# Geometry

_HAVERSINE = "2 * 6378137.0::DOUBLE * asin(sqrt(least(power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2), 1)))"
_LEGS = "l AS (SELECT uid, event_id, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM p WINDOW w AS (PARTITION BY uid ORDER BY event_id))"


@query(f"WITH {fx.POINTS}, {_LEGS} SELECT uid, round(coalesce(sum({_HAVERSINE}) FILTER (lon2 IS NOT NULL), 0) / 1000, 3) AS km FROM l GROUP BY ALL")
def haversine_length(spark, sf):
    lines = fx.points(spark, sf).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("line"))
    return lines.select("uid", F.round(geo.line_length(F.transform("line", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))) / 1000, 3).alias("km"))


@query(f"WITH {fx.POINTS}, g AS (SELECT event_id, uid, {_HAVERSINE.replace('lat2', '(lat + 0.5)').replace('lon2', '(lon + 0.5)')} AS len FROM p) SELECT event_id, round(coalesce(abs(len - coalesce(lag(len) OVER (PARTITION BY uid ORDER BY event_id), 0)), 0), 2) AS delta FROM g")
def linear_delta(spark, sf):
    pt = lambda d: F.struct((F.col("lon") + d).alias("x"), (F.col("lat") + d).alias("y"))
    rows = fx.points(spark, sf).select(
        "event_id", F.col("uid").alias("id"), F.col("event_id").alias("updated"), F.lit(1).alias("version"), F.lit(0).alias("minor_version"), F.array(pt(F.lit(0.0)), pt(F.lit(0.5))).alias("geom"), F.create_map(F.lit("highway"), F.lit("path")).alias("tags")
    )
    return stats.with_linear_delta(stats.with_previous_geometry(rows)).select("event_id", F.round("linear_m", 2).alias("delta"))


@query(f"WITH {fx.POINTS} SELECT uid, key AS changeset, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, round(max(lon) - min(lon), 6) AS width, round(max(lat) - min(lat), 6) AS height, count(*) AS nodes FROM p GROUP BY ALL")
def changeset_footprint_bbox(spark, sf):
    out = footprints.changeset_bounds(fx.points(spark, sf).withColumn("changeset", F.col("key")))
    return out.select("uid", "changeset", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "width", "height")], "nodes")


def _boxes_of_countries(spark, sf):
    n = fx.table(spark, sf, "nation").select(F.col("n_name").alias("code"), (F.col("n_nationkey") * 14.0 - 179.995).alias("x0"))
    corner = lambda dx, y: F.struct((F.col("x0") + dx).alias("x"), F.lit(y).alias("y"))
    box = lambda a, b, c, d: F.array(corner(a, c), corner(b, c), corner(b, d), corner(a, d))
    return n.select("code", F.array(F.array(box(0.0, 12.0, -50.005, 60.005), box(4.0, 8.0, -10.005, 10.005))).alias("polygons"))


@query(f"WITH {fx.POINTS}, n AS (SELECT n_name AS code, n_nationkey * 14.0::DOUBLE - 179.995::DOUBLE AS x0 FROM nation) SELECT event_id, code FROM p JOIN n ON lon BETWEEN x0 AND x0 + 12 AND lat BETWEEN -50.005 AND 60.005 WHERE NOT (lon BETWEEN x0 + 4 AND x0 + 8 AND lat BETWEEN -10.005 AND 10.005)")
def country_lookup(spark, sf):
    return countries.lookup(fx.points(spark, sf).select("event_id", "lon", "lat"), _boxes_of_countries(spark, sf)).select("event_id", "code")


@query("SELECT event_id, user_id AS uid FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def semi_join_target_users(spark, sf):
    p = fx.points(spark, sf)
    return p.join(p.where("event_type = 'purchase'").select("uid"), "uid", "left_semi").select("event_id", "uid")


@query(f"WITH {fx.EDITS}, {fx.BRIDGE} SELECT hashtag, count(*) AS edits FROM e JOIN b USING (changeset) GROUP BY ALL")
def changeset_hashtag_join(spark, sf):
    return fx.edits(spark, sf).join(fx.bridge(spark, sf), "changeset").groupBy("hashtag").agg(F.count("*").alias("edits"))


# Buildings


@query(f"WITH {fx.BOXES}, k AS (SELECT side, round(x, 1) AS k FROM r) SELECT k, CASE WHEN count(DISTINCT side) = 2 THEN 'both' WHEN min(side) = 0 THEN 'left' ELSE 'right' END AS side FROM k GROUP BY k")
def building_venn(spark, sf):
    r = fx.boxes(spark, sf).withColumn("k", F.round("x", 1) + F.lit(0.0))
    return matching.venn(r.where("side = 0"), r.where("side = 1"), "k")


_NEAR = "n AS (SELECT a.id AS a_id, b.id AS b_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM r a JOIN r b ON a.side = 0 AND b.side = 1 WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 0.05)"


def _near(spark, sf):
    r = fx.boxes(spark, sf)
    return matching.candidate_pairs(r.where("side = 0"), r.where("side = 1"), 0.05, 0.05)


@query(f"WITH {fx.BOXES}, {_NEAR} SELECT a_id, b_id, round(d, 6) AS distance FROM n")
def candidate_pairs(spark, sf):
    return _near(spark, sf).select("a_id", "b_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {fx.BOXES}, {_NEAR}, o AS (SELECT a_id, b_id, a.w * a.h AS aa, b.w * b.h AS ba, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i FROM n JOIN r a ON a.id = a_id JOIN r b ON b.id = b_id) SELECT a_id, b_id, round(CASE WHEN aa > 0 THEN i / aa ELSE 0 END, 6) AS a_share, round(CASE WHEN ba > 0 THEN i / ba ELSE 0 END, 6) AS b_share FROM o")
def rectangle_overlap(spark, sf):
    r = fx.boxes(spark, sf)
    side = lambda p: r.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}{c}") for c in "xywh"])
    pairs = _near(spark, sf).select("a_id", "b_id").join(side("a"), "a_id").join(side("b"), "b_id")
    a, b = matching.box_overlap("a", "b")
    return pairs.select("a_id", "b_id", F.round(a, 6).alias("a_share"), F.round(b, 6).alias("b_share"))


@query(f"WITH {fx.BOXES}, {_NEAR} SELECT a_id, arg_max(b_id, (1 - d, -b_id)) AS best, round(max(1 - d), 6) AS probability, count(*) AS matches FROM n GROUP BY ALL")
def best_match(spark, sf):
    r = fx.boxes(spark, sf)
    return matching.nearest(r.where("side = 0"), r.where("side = 1"), 0.05, 0.05).withColumn("probability", F.round("probability", 6))


_UNIT = [f"least(greatest(CAST(floor(({v} + 1) / 2 * 16) AS BIGINT), 0), 15)" for v in ("x", "y", "(x + w)", "(y + h)")]


@query(f"""WITH {fx.BOXES}, q AS (SELECT id, {_zorder(_UNIT[0], _UNIT[1], 4)} AS a, {_zorder(_UNIT[2], _UNIT[3], 4)} AS b FROM r),
d AS (SELECT id, array_to_string([CAST((a >> s) & 3 AS VARCHAR) for s in [6, 4, 2, 0]], '') AS t, CASE WHEN a >> 6 <> b >> 6 THEN 0 WHEN a >> 4 <> b >> 4 THEN 1 WHEN a >> 2 <> b >> 2 THEN 2 WHEN a <> b THEN 3 ELSE 4 END AS n FROM q)
SELECT id, t[1:n] AS address FROM d""")
def quadtree_address(spark, sf):
    u = lambda c: (c + 1) / 2
    r = fx.boxes(spark, sf)
    return r.select("id", geo.quad_address(u(F.col("x")), u(F.col("y")), u(F.col("x") + F.col("w")), u(F.col("y") + F.col("h")), 4).alias("address"))


@query(f"WITH {fx.POINTS}, t AS (SELECT {_x(8)} AS bx, {_y(8)} AS bw FROM p), u AS (SELECT z, bx >> (8 - z) AS x, bw >> (8 - z) AS y FROM t, (SELECT unnest(range(0, 9)) AS z) WHERE bx BETWEEN 0 AND 255 AND bw BETWEEN 0 AND 255) SELECT CAST(z AS INT) AS z, x, y, count(*) AS weight FROM u GROUP BY ALL")
def heatmap_downsample(spark, sf):
    return matching.heat_map(fx.points(spark, sf).withColumn("weight", F.lit(1).cast("long")), list(range(9)))


def _similar(spark, sf, vertices: bool) -> DataFrame:
    r = fx.boxes(spark, sf)
    ring = F.array(*[F.struct((F.col("x") + dx * F.col("w")).alias("x"), (F.col("y") + dy * F.col("h")).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])
    boxes = r.withColumn("ring", ring)
    return matching.similar_pairs(boxes.where("side = 0"), boxes.where("side = 1"), 0.05, 0.05, vertices)


@query()
def building_similarity(spark, sf):
    return _similar(spark, sf, True)


@query(f"WITH {fx.EDITS} SELECT CAST(sum(CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END) AS BIGINT) AS road, CAST(sum(CASE WHEN p_type = 'MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS coastline, count(*) FILTER (version = 1 AND minor_version = 0 AND visible) AS created, count(*) FILTER (NOT (version = 1 AND minor_version = 0) AND visible) AS modified, count(*) FILTER (NOT visible) AS deleted, count(*) FILTER (l_linenumber % 2 = 0) AS metadata_only FROM e")
def facet_flags(spark, sf):
    flagged = stats.facet_flags(fx.edits(spark, sf).withColumn("geometry_changed", F.col("l_linenumber") % 2 != 0))
    return flagged.agg(*[F.sum(c).cast("long").alias(c) for c in ("road", "coastline", "created", "modified", "deleted", "metadata_only")])


@query(f"WITH {fx.POINTS} SELECT event_id FROM p WHERE lon BETWEEN -30.005 AND 44.995 AND lat BETWEEN -20.005 AND 50.005")
def spatial_clip(spark, sf):
    return countries.within_clip(fx.points(spark, sf), [(-30.005, -20.005), (44.995, -20.005), (44.995, 50.005), (-30.005, 50.005)]).select("event_id")


@query(f"WITH {fx.POINTS}, b AS (SELECT event_id, {_x(4)} AS x0, least({_x(4, '(lon + 30)')}, 15) AS x1, {_y(4)} AS y FROM p) SELECT event_id, unnest(range(x0, x1 + 1)) AS x, y FROM b WHERE y BETWEEN 0 AND 15")
def tile_cover(spark, sf):
    p = fx.points(spark, sf).where(geo.tile_y(F.col("lat"), 4).between(0, 15))
    boxes = p.select("event_id", F.col("lon").alias("west"), (F.col("lon") + 30).alias("east"), F.col("lat").alias("south"), F.col("lat").alias("north"))
    return matching.tile_cover(boxes, 4).select("event_id", "x", "y")


@query(f"WITH {fx.POINTS}, {_pyramid_sql('key', 'SELECT * FROM p', GRID, zooms='[3]')} SELECT z, x, y, cell, count(*) AS keys, CAST(sum(value) AS BIGINT) AS total FROM pyramid GROUP BY ALL")
def vectorize(spark, sf):
    features = tiles.vectorize(footprints.edit_histogram(fx.points(spark, sf), zooms=[3]))
    return features.select("z", "x", "y", "cell", F.size("values").cast("long").alias("keys"), maps.total(F.col("values")).alias("total"))


@query(
    f"""WITH {fx.BOXES}, m AS (SELECT *, x + 0.4 * w AS cx, y + 0.4 * h AS cy FROM r),
o AS (SELECT a.id AS a_id, b.id AS b_id, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) / greatest(a.w * a.h, b.w * b.h) AS p
  FROM m a JOIN m b ON a.side = 0 AND b.side = 1 AND sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) <= 0.05),
g AS (SELECT id, side, arg_max(other, (p, -other)) AS best, max(p) AS probability, count(*) AS matches
  FROM (SELECT a_id AS id, 0 AS side, b_id AS other, p FROM o WHERE p > 0.3 UNION ALL SELECT b_id, 1, a_id, p FROM o WHERE p > 0.3) GROUP BY ALL)
SELECT m.id, CAST(m.side AS INT) AS side, best, round(coalesce(probability, 0.0), 5) AS probability, coalesce(matches, 0) AS matches FROM m LEFT JOIN g ON g.id = m.id AND g.side = m.side"""
)
def building_matching(spark, sf):
    r = fx.boxes(spark, sf)
    at = lambda dx, dy: F.struct((F.col("x") + dx * F.col("w")).alias("x"), (F.col("y") + dy * F.col("h")).alias("y"))
    rings = r.select("id", "side", F.array(*[at(*d) for d in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]).alias("ring"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"))
    out = matching.match_buildings(matching.buildings(rings.where("side = 0")), matching.buildings(rings.where("side = 1")), 0.05, 0.3)
    return out.withColumn("probability", F.round("probability", 5))


# Streams


def _stream(spark, df: DataFrame, parts: str, name: str) -> DataFrame:
    """The rows as a file stream, one value of ``parts`` after the other."""
    path = fresh_path(spark, name)
    df.repartitionByRange(4, parts).sortWithinPartitions(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query(f"WITH {fx.POINTS} SELECT sequence, event_type, count(*) AS n, round(sum(value), 3) AS total FROM p GROUP BY ALL")
def stream_stats_by_sequence(spark, sf):
    rows = _stream(spark, fx.points(spark, sf).select("sequence", "event_type", "value"), "sequence", "stream")
    out, ck = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-ck")
    q = jobs.stats_by_sequence(rows, "value", "event_type").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("sequence", "event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT user_id AS changeset, event_type AS name, round(sum(value), 3) AS value FROM events GROUP BY ALL")
def stream_upsert(spark, sf):
    """A stream delivered twice into a snapshot table: replays add nothing."""
    rows = fx.points(spark, sf).groupBy(F.col("uid").alias("changeset"), F.col("event_type").alias("name"), "sequence").agg(F.sum("value").alias("value"))
    stream = _stream(spark, rows, "sequence", "upsert")
    table = stores.SnapshotTable(spark, fresh_path(spark, "table"), "changeset long, name string, value double")
    applied = stores.SnapshotTable(spark, fresh_path(spark, "applied"), "changeset long, sequence long")
    for k in range(2):
        jobs.start(stream, jobs.merge_into(table, applied, "changeset"), fresh_path(spark, "ck"), f"upsert{k}").awaitTermination()
    return table.read().select("changeset", "name", F.round("value", 3).alias("value"))


@query("SELECT e.event_id, c.event_id AS id FROM events e JOIN events c ON e.user_id = c.event_id AND c.event_type <> 'none' WHERE e.ts >= c.ts AND e.ts <= c.ts + INTERVAL 25 HOUR")
def stream_join_watermark(spark, sf):
    ev = fx.table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    diffs = _stream(spark, ev.select("event_id", F.col("user_id").alias("changeset"), F.col("t").alias("timestamp")), "timestamp", "diffs")
    opened = _stream(spark, ev.select(F.col("event_id").alias("id"), F.col("t").alias("created_at")), "created_at", "opened")
    out = fresh_path(spark, "join-out")
    joined = jobs.join_open_changesets(diffs, opened).select("event_id", "id")
    joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "join-ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, id long").parquet(out)


@query("SELECT event_id, CAST(floor((epoch(ts) - 1347432900) / 60) AS BIGINT) AS sequence, CAST(floor((epoch(ts) - 1347432900) / 60) AS BIGINT) * 60 + 1347432900 AS at FROM events")
def sequence_time_mapping(spark, sf):
    s = times.sequence_of(F.col("ts"))
    return fx.table(spark, sf, "events").select("event_id", s.alias("sequence"), F.unix_timestamp(times.time_of(s)).alias("at"))


def entry(spark: SparkSession) -> DataFrame:
    return top_hashtags_per_country(spark, "/root/testdata/sf0.001")


from . import elements  # noqa: E402, F401  registers the queries over histories, diffs, files, feeds and stores
