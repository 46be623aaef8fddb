"""Registered queries over element histories, diffs, files, feeds and stores, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import geo, maps, tags, text
from ..operators import changesets as cs
from ..operators import countries, footprints, history, matching, pipelines, rollups, stats, stores, tile_schemas, tiles
from ..session import fresh_path
from ..sources import feeds, files
from ..streaming import jobs
from . import fixtures as fx
from .registry import _COUNT_ROWS, _CS, _HAVERSINE, _MEASURE_ROWS, _facets, _NEAR, _pyramid_sql, _similar, _totals, _x, _y, _zorder, GRID, query

_WAYS = f"""{fx.HISTORY},
refs AS (SELECT id AS way, version, tm, until, unnest(nds) AS ref, unnest([1, 2, 3]) AS place FROM w),
trig AS (
  SELECT n.changeset, r.way AS id, r.version, n.tm AS updated FROM n JOIN refs r ON n.id = r.ref AND r.tm <= n.tm AND (r.until IS NULL OR n.tm < r.until)
  UNION ALL SELECT changeset, id, version, tm FROM w),
every AS (SELECT changeset, id, max(version) AS version, max(updated) AS updated FROM trig GROUP BY ALL),
verts AS (
  SELECT a.changeset, a.id, a.version, a.updated, r.place, n.lon, n.lat
  FROM every a JOIN refs r ON r.way = a.id AND r.version = a.version JOIN n ON n.id = r.ref AND n.lon IS NOT NULL AND n.tm <= a.updated AND (n.until IS NULL OR a.updated < n.until)),
legs AS (SELECT *, lead(lon) OVER l AS lon2, lead(lat) OVER l AS lat2 FROM verts WINDOW l AS (PARTITION BY changeset, id, version, updated ORDER BY place)),
len AS (SELECT changeset, id, version, updated, count(*) AS n_vertices, coalesce(sum({_HAVERSINE}) FILTER (lon2 IS NOT NULL), 0) AS len FROM legs GROUP BY ALL),
shaped AS (
  SELECT e.*, coalesce(len, 0) AS len, coalesce(n_vertices, 0) AS n_vertices, w.kind, w.visible, row_number() OVER (PARTITION BY e.id, e.version ORDER BY e.updated, e.changeset) - 1 AS minor
  FROM every e LEFT JOIN len USING (changeset, id, version, updated) JOIN w ON w.id = e.id AND w.version = e.version),
changed AS (SELECT *, CASE WHEN kind = 2 THEN 0 ELSE abs(len - coalesce(lag(len) OVER (PARTITION BY id ORDER BY updated, version, minor), 0)) END AS m FROM shaped)"""


@query(f"WITH {_WAYS} SELECT changeset, id, version, updated FROM every")
def way_versions(spark, sf):
    h = fx.history(spark, sf)
    return pipelines.way_versions(pipelines.prepare_ways(h), pipelines.prepare_nodes(h))


@query(f"WITH {_WAYS} SELECT changeset, id, version, CAST(minor AS INT) AS minor_version, n_vertices, round(len, 2) AS metres FROM shaped")
def reconstruct_ways(spark, sf):
    h = fx.history(spark, sf)
    shaped = pipelines.way_geometries(pipelines.prepare_ways(h), pipelines.prepare_nodes(h))
    return shaped.select("changeset", "id", "version", "minor_version", F.coalesce(F.size("geom"), F.lit(0)).cast("long").alias("n_vertices"), F.round(geo.line_length(F.col("geom")), 2).alias("metres"))


_ACTS = {"added": "version = 1 AND minor = 0", "modified": "NOT (version = 1 AND minor = 0) AND visible", "deleted": "NOT visible"}
_WAY_CLASS = (("roads", 0), ("waterways", 1), ("buildings", 2), ("raillines", 3))
_POINT_CLASS = (("pois", "click"), ("railway_features", "view"), ("other", "error"))
_NODE_ROWS = "SELECT id, version, 0 AS minor, visible, changeset, kind, lon, lat, tm FROM n WHERE kind IN ('click', 'view', 'error')"
_STATS_ROWS = " UNION ALL ".join(
    [f"SELECT changeset, '{c}_{a}' AS key, 1.0::DOUBLE AS v FROM changed WHERE kind = {k} AND {p}" for c, k in _WAY_CLASS for a, p in _ACTS.items()]
    + [f"SELECT changeset, '{c}_{a}', 1.0::DOUBLE FROM ({_NODE_ROWS}) WHERE kind = '{k}' AND {p}" for c, k in _POINT_CLASS for a, p in _ACTS.items()]
    + [f"SELECT changeset, '{c}_km_{a}', m / 1000 FROM changed WHERE kind = {k} AND {p}" for c, k in (("road", 0), ("waterway", 1), ("railline", 3)) for a, p in _ACTS.items()]
)
_BOX = "b AS (SELECT n_name AS code, n_nationkey * 14.0::DOUBLE - 179.995::DOUBLE AS x0 FROM nation)"
_IN_BOX = "lon BETWEEN x0 AND x0 + 12 AND lat BETWEEN -50.005 AND 60.005 AND NOT (lon BETWEEN x0 + 4 AND x0 + 8 AND lat BETWEEN -10.005 AND 10.005)"


@query(
    f"""WITH {_WAYS}, {_BOX}, c AS (
  SELECT DISTINCT 'way' AS t, changeset, id, updated AS tm, code FROM verts JOIN b ON {_IN_BOX}
  UNION ALL SELECT DISTINCT 'node', changeset, id, tm, code FROM ({_NODE_ROWS}) JOIN b ON {_IN_BOX})
SELECT changeset, key, round(sum(v), 2) AS value FROM ({_STATS_ROWS}) GROUP BY ALL HAVING sum(v) <> 0
UNION ALL SELECT changeset, 'country ' || code, CAST(count(*) AS DOUBLE) FROM c GROUP BY ALL"""
)
def changeset_stats_from_history(spark, sf):
    """Node and way preparation, geometries, deltas, geocoding, ways and points together: one row a changeset, shown long."""
    from .registry import _boxes_of_countries

    out = pipelines.changeset_stats_from_history(fx.history(spark, sf), _boxes_of_countries(spark, sf))
    double = lambda c: F.map_entries(F.transform_values(c, lambda k, v: v.cast("double")))
    named = F.map_entries(F.transform_keys(F.transform_values("countries", lambda k, v: v.cast("double")), lambda k, v: F.concat(F.lit("country "), k)))
    entries = F.concat(double("counts"), F.map_entries("measurements"), F.coalesce(named, F.array().cast("array<struct<key:string,value:double>>")))
    return out.select("changeset", F.explode(entries).alias("e")).select("changeset", "e.key", F.round("e.value", 2).alias("value"))


@query(f"WITH {fx.HISTORY} SELECT id, version, lon, lat, NOT same AS geometry_changed FROM n")
def carry_forward(spark, sf):
    return pipelines.prepare_nodes(fx.history(spark, sf)).select("id", "version", "lon", "lat", "geometry_changed")


_FACETED = f"""{_WAYS.replace("FROM nv WINDOW", "FROM nv WHERE uid > 1 WINDOW").replace("FROM w0)", "FROM w0 WHERE uid > 1)")},
held AS (SELECT e.updated, w.kind, unnest(w.nds) AS ref FROM every e JOIN w ON w.id = e.id AND w.version = e.version),
f AS (
  SELECT n.id, n.version, n.tm, any_value(n.kind) AS kind, any_value(n.lon) AS lon, any_value(n.lat) AS lat, any_value(n.visible) AS visible, any_value(n.same) AS same,
    coalesce(bool_or(h.kind = 2), false) AS building, coalesce(bool_or(h.kind = 0), false) AS road, coalesce(bool_or(h.kind = 1), false) AS waterway
  FROM held h RIGHT JOIN n ON h.ref = n.id WHERE h.updated IS NULL OR (n.tm <= h.updated AND (n.until IS NULL OR h.updated < n.until)) GROUP BY n.id, n.version, n.tm),
rows AS (
  SELECT id, version, CAST(year(tm) * 1000 + dayofyear(tm) AS INT) AS key, lon, lat, building, road, waterway, kind = 'click' AS poi, false AS coastline, version = 1 AS created, visible AND version > 1 AS modified,
    NOT visible AS deleted, same AS metadata_only
  FROM f WHERE lon IS NOT NULL)"""


@query(f"WITH {_FACETED} SELECT id, version, key, " + ", ".join(f"CAST({c} AS INT) AS {c}" for c in pipelines.FACETS) + " FROM rows")
def faceted_nodes(spark, sf):
    return pipelines.faceted_nodes(fx.history(spark, sf)).drop("lon", "lat")


_FACET_UNION = " UNION ALL ".join(["SELECT CAST(key AS VARCHAR) AS key, lon, lat FROM rows", *(f"SELECT key || ':{c}', lon, lat FROM rows WHERE {c}" for c in pipelines.FACETS)])


@query(f"WITH {_FACETED}, {_pyramid_sql('key', _FACET_UNION, GRID)} SELECT * FROM pyramid")
def faceted_histogram_from_history(spark, sf):
    """All eleven zooms."""
    return pipelines.faceted_histogram_from_history(fx.history(spark, sf))


_DIFF = """d AS (
  SELECT CAST(floor((epoch(ts) - 1347432900) / 60) AS BIGINT) // 360 AS sequence, event_type = 'purchase' AS is_way, user_id AS id, event_id % 4 + 1 AS version, event_id % 3 AS minor, ts, event_id % 11 <> 0 AS visible,
    event_type = 'click' AS poi, user_id % 4 AS kind, ((event_id * 7919) % 36000) / 100 - 180 AS lon, ((event_id * 104729) % 17000) / 100 - 85 AS lat
  FROM events),
dn AS (SELECT * FROM d WHERE NOT is_way),
dw AS (SELECT sequence, ts, minor, kind, unnest([id, id + 1, id + 2]) AS ref FROM d WHERE is_way),
both_ AS (
  SELECT n.sequence, n.id, n.version, n.ts, n.lon, n.lat, n.visible, n.poi, w.kind FROM dn n LEFT JOIN dw w ON w.sequence = n.sequence AND w.ref = n.id
  UNION ALL SELECT n.sequence, n.id, n.version, w.ts, n.lon, n.lat, n.visible, false, w.kind FROM dw w JOIN dn n ON w.sequence = n.sequence AND w.ref = n.id WHERE w.minor = 0),
rows AS (
  SELECT sequence, id, version, ts, CAST(year(ts) * 1000 + dayofyear(ts) AS INT) AS key, min(lon) AS lon, arg_min(lat, (lon, lat, visible)) AS lat, coalesce(bool_or(kind = 2), false) AS building, coalesce(bool_or(kind = 0), false) AS road,
    coalesce(bool_or(kind = 1), false) AS waterway, bool_or(poi) AS poi, false AS coastline, version = 1 AND arg_min(visible, (lon, lat, visible)) AS created, version > 1 AND arg_min(visible, (lon, lat, visible)) AS modified,
    NOT arg_min(visible, (lon, lat, visible)) AS deleted, false AS metadata_only
  FROM both_ GROUP BY sequence, id, version, ts)"""


def _diffs(spark, sf):
    one = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    none, kind, way = F.create_map().cast("map<string,string>"), F.col("user_id") % 4, F.col("event_type") == "purchase"
    of = F.when(way & (kind == 0), one("highway", "x")).when(way & (kind == 1), one("waterway", "river")).when(way & (kind == 2), one("building", "yes")).when(~way & (F.col("event_type") == "click"), one("shop", "x")).otherwise(none)
    alive = F.col("event_id") % 11 != 0
    p = fx.points(spark, sf)
    return p.withColumn("user_id", F.col("uid")).select(
        F.expr("sequence div 360").alias("sequence"), F.when(way, "way").otherwise("node").alias("type"), F.col("uid").alias("id"), (F.col("event_id") % 4 + 1).alias("version"), (F.col("event_id") % 3).alias("minor_version"),
        F.col("ts").alias("updated"), "lon", "lat", F.when(way, F.array(F.col("uid"), F.col("uid") + 1, F.col("uid") + 2)).alias("nds"), F.when(alive, of).otherwise(none).alias("tags"), F.when(~alive, of).alias("prev_tags"), alive.alias("visible"),
    )


@query(f"WITH {_DIFF} SELECT sequence, id, version, key, " + ", ".join(f"CAST({c} AS INT) AS {c}" for c in pipelines.FACETS) + " FROM rows")
def faceted_diffs(spark, sf):
    """Major versions with their ways' tags and minor versions of changed ways, by sequence."""
    return pipelines.faceted_diffs(_diffs(spark, sf)).drop("lon", "lat")


@query(f"WITH {_DIFF}, {_pyramid_sql('key', _FACET_UNION, GRID)} SELECT * FROM pyramid")
def stream_faceted_tiles(spark, sf):
    """Diffs as a stream into the tile table of all eleven zooms; the whole stream is then delivered again and adds nothing."""
    d = _diffs(spark, sf)
    path = fresh_path(spark, "diffs")
    d.repartitionByRange(2, "sequence").write.parquet(path)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = stores.SnapshotTable(spark, fresh_path(spark, "tiles"), "key string, z int, x long, y long, cell long, value long")
    known = stores.SnapshotTable(spark, fresh_path(spark, "sequences"), "z int, x long, y long, sequence long")
    for k in range(2):
        jobs.start(stream, jobs.update_tiles(table, known, lambda b: pipelines.faceted_diffs(b).drop("id", "version"), GRID, pipelines.FACETS), fresh_path(spark, "ck"), f"tiles{k}").awaitTermination()
    return table.read()


@query(f"WITH {fx.EDITS}, m AS (SELECT changeset, changeset % 17 AS sequence, country, count(*) AS n FROM e GROUP BY ALL) SELECT changeset, n_nationkey AS country_id, CAST(sum(n) AS BIGINT) AS edit_count FROM m JOIN nation ON n_nationkey = country AND n_nationkey % 2 = 0 GROUP BY ALL")
def upsert_countries(spark, sf):
    """Edits by country code, resolved to known countries' identifiers and added once a sequence, in two overlapping deliveries."""
    names = fx.table(spark, sf, "nation")
    known = names.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("code"))
    rows = fx.edits(spark, sf).withColumn("sequence", F.col("changeset") % 17).groupBy("changeset", "sequence", "country").count().join(names.select(F.col("n_nationkey").alias("country"), F.col("n_name").alias("code")), "country")
    rows = rows.select("changeset", "sequence", "code", F.col("count").alias("edit_count"))
    table, applied = stores.upsert_countries(None, rows.where("sequence < 9"), None, known)
    return stores.upsert_countries(table, rows, applied, known)[0]


_WIDE = f"""WITH {fx.EDITS}, {_CS}, k AS (SELECT DISTINCT changeset, country FROM e), {fx.BRIDGE},
tot AS (SELECT uid, "user", count(*) AS changeset_count, CAST(sum(coalesce(total_edits, 0)) AS BIGINT) AS edit_count, max(coalesce(closed_at, created_at)) AS last_edit FROM t GROUP BY ALL),
days AS (SELECT uid, string_agg(d || '=' || n, ',' ORDER BY d) AS edit_times FROM (SELECT uid, strftime(created_at, '%Y-%m-%d') AS d, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
eds AS (SELECT uid, string_agg(editor || '=' || n, ',' ORDER BY editor) AS editors FROM (SELECT uid, editor, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
cos AS (SELECT uid, string_agg(country || '=' || n, ',' ORDER BY country) AS countries FROM (SELECT uid, CAST(country AS VARCHAR) AS country, count(*) AS n FROM t JOIN k USING (changeset) GROUP BY ALL) GROUP BY ALL),
hs AS (SELECT uid, string_agg(hashtag || '=' || n, ',' ORDER BY n DESC, hashtag) AS hashtags FROM (SELECT uid, hashtag, count(*) AS n FROM t JOIN b USING (changeset) GROUP BY uid, hashtag QUALIFY row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, hashtag) <= 50) GROUP BY ALL)
SELECT * FROM tot LEFT JOIN days USING (uid) LEFT JOIN eds USING (uid) LEFT JOIN cos USING (uid) LEFT JOIN hs USING (uid)"""


@query(_WIDE)
def user_profile(spark, sf):
    """The whole view of a user: totals, edits by day, editors, countries and the 50 most used hashtags."""
    c = _totals(spark, sf)
    places = fx.edits(spark, sf).select("changeset", F.col("country").cast("string").alias("country")).distinct()
    out = rollups.profile(c, "uid", "user", countries=places, hashtags=fx.bridge(spark, sf), top_hashtags=50)
    show = lambda name: F.array_join(F.transform(name, lambda e: F.concat(e["name"].cast("string"), F.lit("="), e["n"].cast("string"))), ",").alias(name)
    return out.select("uid", "user", "changeset_count", "edit_count", "last_edit", show("edit_times"), show("editors"), show("countries"), show("hashtags"))


# Sources and sinks


@query(f"WITH {fx.HISTORY} SELECT id, 'node' AS type, version, lon, lat, visible FROM (SELECT id, version, raw_lon AS lon, raw_lat AS lat, visible FROM nv) UNION ALL SELECT id, 'way', version, NULL, NULL, visible FROM w")
def history_scan(spark, sf):
    """Written as an ORC history with decimal coordinates and read back."""
    path = fresh_path(spark, "history")
    h = fx.history(spark, sf).withColumns({"lat": F.col("lat").cast("decimal(9,7)"), "lon": F.col("lon").cast("decimal(10,7)"), "nds": F.transform("nds", lambda n: F.struct(n.alias("ref"))), "user": F.lit("u"), "timestamp": F.col("timestamp").cast("timestamp")})
    files.write_orc(h.withColumn("members", F.lit(None).cast("array<struct<type:string,ref:long,role:string>>")), path)
    return files.read_history(spark, path).select("id", "type", "version", "lon", "lat", "visible")


@query(f"WITH {fx.CHANGESETS} SELECT id, uid, editor, closed_at IS NULL AS open FROM c")
def changeset_scan(spark, sf):
    path = fresh_path(spark, "changesets")
    c = fx.changesets(spark, sf).select("id", "uid", "user", F.create_map(F.lit("created_by"), F.col("editor")).alias("tags"), F.col("created_at").cast("timestamp"), F.col("closed_at").cast("timestamp"), F.col("closed_at").isNull().alias("open"))
    files.write_orc(c, path)
    return files.read_changesets(spark, path).select("id", "uid", F.col("tags")["created_by"].alias("editor"), "open")


@query(f"WITH {fx.EDITS} SELECT changeset, count(*) AS edits FROM e GROUP BY ALL")
def checkpointed_stats(spark, sf):
    path = fresh_path(spark, "stats")
    pipelines.checkpointed(lambda: stats.changeset_stats(fx.edits(spark, sf)), path, False, spark)
    return pipelines.checkpointed(lambda: None, path, True, spark).select("changeset", "edits")


def _feed(spark, sf):
    """A feed of 40 sequences of JSON rows."""
    path = fresh_path(spark, "feed")
    rows = fx.points(spark, sf).where("event_id % 3 = 0").select((F.col("event_id") % 40).alias("sequence"), F.struct(F.lit("node").alias("type"), F.col("uid").alias("id"), "lon", "lat", F.col("event_id").alias("changeset")).alias("r"))
    feeds.write_feed(rows.select("sequence", F.to_json("r").alias("line")), path)
    feeds.register(spark)
    return path


@query("SELECT event_id % 40 AS sequence, user_id AS id, event_id AS changeset FROM events WHERE event_id % 3 = 0 AND event_id % 40 BETWEEN 0 AND 29")
def feed_bounded(spark, sf):
    """A bounded read of the sequences 0 to 29."""
    path = _feed(spark, sf)
    first, end = feeds.bounds(path, 0, 29)
    return spark.read.format("sequence_feed").options(path=path, start_sequence=first, end_sequence=end).load().select("sequence", "id", "changeset")


@query("SELECT event_id % 40 AS sequence, user_id AS id, event_id AS changeset FROM events WHERE event_id % 3 = 0")
def feed_stream(spark, sf):
    """The same feed as a stream, ten sequences a run, every run resumed after the sequence saved for the process."""
    path, out = _feed(spark, sf), fresh_path(spark, "feed-out")
    saved = stores.SnapshotTable(spark, fresh_path(spark, "checkpoints"), "proc_name string, sequence long")
    for _ in range(4):
        before = stores.saved_sequence(saved.read(), "feed")
        first, end = feeds.bounds(path, 0 if before is None else None, None, before)
        stream = spark.readStream.format("sequence_feed").options(path=path, start_sequence=first, end_sequence=end, batch_size=10).load()
        sink = lambda b, i, k=first: b.select("sequence", "id", "changeset").write.mode("overwrite").parquet(f"{out}/batch={k + i}")
        jobs.start(stream, jobs.with_checkpoint(sink, saved, "feed"), fresh_path(spark, "ck"), f"feed{first}").awaitTermination()
    return spark.read.parquet(out).select("sequence", "id", "changeset")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN event_type END AS old_name, CAST(user_id AS VARCHAR) AS new_name, event_id % 3 = 0 AS has_old FROM events WHERE event_id % 50 = 0")
def augmented_diff_files(spark, sf):
    """GeoJSON diff lines with record separators, members old and new."""
    path = fresh_path(spark, "adiff")
    e = fx.table(spark, sf, "events").where("event_id % 50 = 0")
    feature = lambda which, name: F.struct(F.lit(which).alias("id"), F.lit("Feature").alias("type"), F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("name"), name).alias("properties"))
    new, old = feature("new", F.col("user_id").cast("string")), feature("old", F.col("event_type"))
    lines = e.select(F.concat(F.lit("\u001e"), F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.array(old, new)).otherwise(F.array(new)).alias("features")))).alias("value"))
    lines.write.text(path)
    return files.read_diffs(spark, path).select(F.col("new.properties")["id"].alias("id"), F.col("old.properties")["name"].alias("old_name"), F.col("new.properties")["name"].alias("new_name"), F.col("old").isNotNull().alias("has_old"))


@query("SELECT DISTINCT lower(p_brand) AS hashtag FROM part")
def list_scan(spark, sf):
    path = fresh_path(spark, "list")
    fx.table(spark, sf, "part").select(F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("value")).union(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(path)
    return files.read_list(spark, path)


@query(f"WITH {fx.POINTS}, {_BOX} SELECT event_id, code FROM p JOIN b ON {_IN_BOX}")
def country_polygons(spark, sf):
    """Countries read from GeoJSON features, polygons and multipolygons, used for a lookup."""
    path = fresh_path(spark, "countries")
    names = {r.n_nationkey: r.n_name for r in fx.table(spark, sf, "nation").collect()}
    box = lambda a, b, c, d: [[a, c], [b, c], [b, d], [a, d], [a, c]]
    lines = []
    for k, name in sorted(names.items()):
        x = k * 14.0 - 179.995
        rings = [box(x, x + 12, -50.005, 60.005), box(x + 4, x + 8, -10.005, 10.005)]
        lines.append((json.dumps({"type": "Feature", "properties": {"name": name, "code": name}, "geometry": {"type": "Polygon" if k % 2 else "MultiPolygon", "coordinates": rings if k % 2 else [rings]}}),))
    spark.createDataFrame(lines, "value string").write.text(path)
    return countries.lookup(fx.points(spark, sf).select("event_id", "lon", "lat"), files.read_countries(spark, path).select("code", "polygons")).select("event_id", "code")


@query(f"WITH {fx.POINTS}, {_BOX}, g AS (SELECT uid, code FROM p JOIN b ON {_IN_BOX} GROUP BY ALL) SELECT uid, string_agg(code, ',' ORDER BY code) AS countries FROM g GROUP BY ALL")
def geocode(spark, sf):
    from .registry import _boxes_of_countries

    return countries.geocode(fx.points(spark, sf).select("uid", "lon", "lat"), "uid", _boxes_of_countries(spark, sf)).select("uid", F.array_join("countries", ",").alias("countries"))


# Stores


@query(f"WITH {fx.CHANGESETS}, b AS (SELECT id, editor, created_at, 0 AS new FROM c UNION ALL SELECT id, 'new', created_at + INTERVAL 1 HOUR * (id % 3 - 1), 1 FROM c WHERE id % 2 = 0) SELECT id, editor FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, new DESC) = 1")
def upsert_latest(spark, sf):
    c = fx.changesets(spark, sf).select("id", "editor", "created_at")
    new = c.where("id % 2 = 0").select("id", F.lit("new").alias("editor"), (F.col("created_at") + F.expr("make_dt_interval(0, 1)") * (F.col("id") % 3 - 1)).alias("created_at"))
    return stores.upsert_latest(c, new, "id", "created_at").select("id", "editor")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS name FROM customer")
def rename_users(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    seen = c.where("id % 3 = 0").withColumn("name", F.concat(F.lit("new "), "name")).union(c.where("id % 5 = 1 and id % 3 <> 0"))
    return stores.rename_users(c.where("id % 5 <> 1"), seen)


@query("SELECT p_name AS hashtag FROM part GROUP BY ALL")
def insert_absent(spark, sf):
    names = fx.table(spark, sf, "part").select(F.col("p_name").alias("hashtag"))
    return stores.insert_absent(names.where("length(hashtag) % 2 = 0").distinct(), names, "hashtag")


@query(f"WITH {fx.EDITS}, {fx.BRIDGE}, h AS (SELECT hashtag, row_number() OVER (ORDER BY md5(hashtag)[1:2], hashtag) AS id FROM (SELECT DISTINCT hashtag FROM b)) SELECT changeset, id AS hashtag_id FROM b JOIN h USING (hashtag)")
def hashtag_bridge(spark, sf):
    """Identifiers of new hashtags and the pairs of changeset and hashtag, delivered twice."""
    b = fx.bridge(spark, sf)
    named = stores.assign_ids(spark.createDataFrame([], "id long, hashtag string"), b.select("hashtag"))
    return stores.bridge_rows(b.union(b), named)


@query(f"WITH {fx.POINTS} SELECT event_type AS proc_name, max(sequence) AS sequence FROM p GROUP BY ALL")
def save_checkpoints(spark, sf):
    now = spark.createDataFrame([("view", 1)], "proc_name string, sequence long")
    for name, s in fx.points(spark, sf).groupBy("event_type").agg(F.max("sequence")).collect():  # five processes
        now = stores.save_checkpoint(now, name, s)
    return now


@query("SELECT event_id, value < 0 OR event_type = 'error' AS failed FROM events")
def split_errors(spark, sf):
    good, bad = stores.split_errors(fx.table(spark, sf, "events"), (F.col("value") >= 0) & (F.col("event_type") != "error"))
    path = fresh_path(spark, "errors")
    stores.log_errors(bad.select("event_id"), path, "value below 0 or an error")
    return good.select("event_id", F.lit(False).alias("failed")).union(spark.read.parquet(path).select("event_id", F.lit(True)))


@query("SELECT event_type AS name, count(*) AS n, 'events' AS mat_view FROM events GROUP BY ALL")
def refresh_views(spark, sf):
    """A view recomputed into its table, unless one is refreshing already, and stamped."""
    table = stores.SnapshotTable(spark, fresh_path(spark, "view"), "name string, n long")
    stamps = spark.createDataFrame([], "mat_view string, updated_at timestamp")
    view = fx.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    stamps = stores.refresh(view, table, "events", stores.refresh(view, table, "events", stamps))
    return table.read().crossJoin(stamps.select("mat_view"))


@query("SELECT count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events")
def partition_writer(spark, sf):
    """Rows written by a bounded number of writers, one file each."""
    path = fresh_path(spark, "writers")
    stores.write_partitions(fx.table(spark, sf, "events").select("user_id"), path, 5)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("user_id").alias("total"))


# Tiles


@query(f"WITH {fx.POINTS}, g AS (SELECT sequence % 7 AS sequence, key, {_x(10)} >> 10 AS x FROM p WHERE {_y(10)} BETWEEN 0 AND 1023), s AS (SELECT DISTINCT sequence FROM g) SELECT array_to_string((SELECT list(sequence ORDER BY sequence) FROM (SELECT sequence FROM s ORDER BY sequence DESC LIMIT 4)), ',') AS kept")
def remember_sequences(spark, sf):
    """The newest four of the sequences of two deliveries."""
    p = fx.points(spark, sf).where(geo.in_grid(geo.tile_x(F.col("lon"), 10), geo.tile_y(F.col("lat"), 10), 10)).select((F.col("sequence") % 7).alias("s"))
    half = lambda k: p.where(f"s % 2 = {k}").agg(F.collect_set("s").alias(f"s{k}"))
    return half(0).crossJoin(half(1)).select(F.array_join(tiles.remember_sequences(F.col("s0"), F.col("s1"), 4), ",").alias("kept"))


@query(f"WITH {fx.POINTS} , f AS (SELECT event_id, CAST(key AS VARCHAR) AS key, sequence, lon, lat FROM p UNION ALL SELECT event_id, key || ':' || event_type, sequence, lon, lat FROM p WHERE event_type IN ('click', 'purchase')) SELECT key, sequence, {_x(17)} AS gx, {_y(17)} AS gy, count(*) AS value FROM f WHERE {_x(17)} BETWEEN 0 AND 131071 AND {_y(17)} BETWEEN 0 AND 131071 GROUP BY ALL")
def tile_facets_sequence(spark, sf):
    """Cells by facet key and sequence."""
    rows = tiles.facet_rows(_facets(spark, sf).select("key", "sequence", "lon", "lat", "click", "purchase"), ["click", "purchase"])
    return tiles.rasterize(tiles.points_to_cells(rows, GRID, "key", "sequence", value=F.col("value")), "key", "sequence")


@query(f"WITH {fx.POINTS}, {_pyramid_sql('CAST(uid AS VARCHAR)', 'SELECT * FROM p', tiles.Grid(6, 128))} SELECT * FROM pyramid")
def footprint_update(spark, sf):
    """Half of the sequences created, all of them applied afterwards."""
    grid = tiles.Grid(6, 128)
    p = fx.points(spark, sf).withColumn("key", F.col("uid").cast("string"))
    first = p.where("sequence % 2 = 0")
    done = tiles.pyramid(tiles.points_to_cells(first, grid, "sequence"), grid, "sequence").select("z", "x", "y", "sequence").distinct()
    return footprints.update(footprints.footprints(first, grid), done, p, grid)[0]


@query(f"WITH {fx.POINTS}, {_pyramid_sql('event_type', 'SELECT * FROM p', tiles.Grid(6, 128))} SELECT * FROM pyramid")
def stream_hashtag_footprints(spark, sf):
    """Changed nodes joined with open changesets that carry a hashtag, as streams, into the footprint table."""
    grid = tiles.Grid(6, 128)
    p = fx.points(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    store = lambda df, name: (path := fresh_path(spark, name), df.write.parquet(path), spark.readStream.schema(df.schema).parquet(path))[2]
    nodes = store(p.select(F.col("event_id").alias("changeset"), "lon", "lat", "sequence", (F.col("at") + F.expr("interval 1 hour")).alias("timestamp")), "nodes")
    opened = store(p.select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.col("at").alias("created_at")), "opened")
    table = stores.SnapshotTable(spark, fresh_path(spark, "footprints"), "key string, z int, x long, y long, cell long, value long")
    known = stores.SnapshotTable(spark, fresh_path(spark, "sequences"), "z int, x long, y long, sequence long")
    joined = jobs.join_open_changesets(nodes, opened).select("key", "lon", "lat", "sequence")
    jobs.start(joined, jobs.update_tiles(table, known, lambda b: b, grid), fresh_path(spark, "ck"), "footprints").awaitTermination()
    return table.read()


@query(f"WITH {fx.POINTS}, t AS (SELECT event_id, {_x(4)} AS x, {_y(4)} AS y FROM p WHERE {_y(4)} BETWEEN 0 AND 15), k AS (SELECT * FROM t WHERE event_id % 2 = 0) SELECT x, y, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM k WHERE x % 2 = 0 GROUP BY ALL")
def tile_load(spark, sf):
    """Tiles of a key list loaded from the tile table; keys without a tile give nothing."""
    p = fx.points(spark, sf).where("event_id % 2 = 0").select("event_id", F.lit(4).alias("z"), geo.tile_x(F.col("lon"), 4).alias("x"), geo.tile_y(F.col("lat"), 4).alias("y")).where("y between 0 and 15")
    contents = tiles.contents(p, "event_id")
    asked = spark.range(16).select(F.lit(4).alias("z"), F.col("id").alias("x")).where("x % 2 = 0").crossJoin(spark.range(20).select(F.col("id").alias("y")))
    return tiles.load(contents, asked).where("features is not null").select("x", "y", F.array_join("features", ",").alias("ids"))


@query(f"WITH {fx.BOXES}, t AS (SELECT id, w * h AS area, least(greatest(CAST(floor((x + 1) / 2 * 16) AS BIGINT), 0), 15) AS tx, least(greatest(CAST(floor((y + 1) / 2 * 16) AS BIGINT), 0), 15) AS ty FROM r) SELECT ({_zorder('tx', 'ty', 4)}) // 16 AS bundle, string_agg(tx || '/' || ty || ':' || n, ',' ORDER BY {_zorder('tx', 'ty', 4)}) AS tiles FROM (SELECT tx, ty, string_agg(id, ' ' ORDER BY area DESC, id) AS n FROM t GROUP BY ALL) GROUP BY ALL")
def tile_bundles(spark, sf):
    """Tile contents by area, largest first, bundled in Z order."""
    cell = lambda c: F.least(F.greatest(F.floor((F.col(c) + 1) / 2 * 16), F.lit(0)), F.lit(15)).cast("long")
    r = fx.boxes(spark, sf).select("id", (F.col("w") * F.col("h")).alias("area"), F.lit(4).alias("z"), cell("x").alias("x"), cell("y").alias("y"))
    out = tiles.bundles(tiles.contents(r, "id", largest="area"), 4, 2)
    show = lambda t: F.concat(t["x"].cast("string"), F.lit("/"), t["y"].cast("string"), F.lit(":"), F.array_join(t["features"], " "))
    return out.select("bundle", F.array_join(F.transform("tiles", show), ",").alias("tiles"))


@query("WITH v AS (SELECT user_id AS id, event_id, ts, event_id % 3 AS version FROM events), o AS (SELECT id, max(version) AS version, max(event_id) AS n FROM v WHERE event_id % 2 = 0 GROUP BY ALL), d AS (SELECT id, arg_max(version, event_id) AS version FROM v WHERE event_id % 2 = 1 GROUP BY ALL) SELECT d.id, d.version, CAST(CASE WHEN o.version = d.version THEN n % 5 + 1 ELSE 0 END AS INT) AS minor_version FROM d LEFT JOIN o USING (id)")
def tile_minor_version(spark, sf):
    """The minor version of an update: the stored one and one more on the same version, else 0."""
    v = fx.table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", (F.col("event_id") % 3).alias("version"))
    old = v.where("event_id % 2 = 0").groupBy("id").agg(F.max("version").alias("version"), (F.max("event_id") % 5).cast("int").alias("minor_version"))
    new = v.where("event_id % 2 = 1").groupBy("id").agg(F.max_by("version", "event_id").alias("version"))
    return tile_schemas.next_minor_version(old, new).select("id", "version", "minor_version")


@query("WITH v AS (SELECT user_id AS id, event_id, event_type <> 'error' AS visible FROM events), o AS (SELECT * FROM v WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id) = 1), d AS (SELECT * FROM v WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id) = 2) SELECT coalesce(d.id, o.id) AS id, CASE WHEN d.event_id >= coalesce(o.event_id, -1) THEN d.event_id ELSE o.event_id END AS updated FROM o FULL JOIN d ON o.id = d.id WHERE CASE WHEN d.event_id >= coalesce(o.event_id, -1) THEN d.visible ELSE o.visible END")
def merge_features(spark, sf):
    """Untouched, replaced, new and deleted features of a tile table."""
    from pyspark.sql import Window

    v = fx.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("updated"), (F.col("event_type") != "error").alias("visible"))
    nth = lambda k, n: v.where(f"updated % {k} = 0").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("updated"))).where(f"k = {n}").drop("k")
    return tile_schemas.merge_features(nth(2, 1), nth(3, 2)).select("id", "updated")


@query(f"WITH {fx.POINTS}, {_pyramid_sql('key', 'SELECT * FROM p', GRID, zooms='[3]')} SELECT x, y, cell, max(key) AS last_day, row_number() OVER (PARTITION BY x, y ORDER BY max(key) DESC, cell) AS place FROM pyramid GROUP BY x, y, cell")
def newest_first(spark, sf):
    """Features of a tile, those edited last first."""
    cells = footprints.edit_histogram(fx.points(spark, sf), zooms=[3])
    ordered = tiles.newest_first(tiles.vectorize(cells))
    return ordered.select("x", "y", F.posexplode("features").alias("place", "f")).select("x", "y", F.col("f.cell").alias("cell"), F.col("f.last_day").alias("last_day"), (F.col("place") + 1).cast("long").alias("place"))


@query(f"WITH {fx.POINTS}, q AS (SELECT event_type, {_x(6)} AS x, {_y(6)} AS y FROM p) SELECT 6 AS z, x, y, count(*) AS features FROM q WHERE event_type <> 'error' AND y BETWEEN 0 AND 63 GROUP BY ALL")
def tile_updater(spark, sf):
    """Stored features of every zoom, a diff applied to the tiles it touches; here shown at one zoom."""
    p = fx.points(spark, sf).select(F.col("event_id").alias("id"), "lon", "lat", F.col("event_id").alias("updated"), (F.col("event_type") != "error").alias("visible"))
    stored = tile_schemas.place(p.where("id % 2 = 0").withColumn("visible", F.lit(True)), range(5, 8))
    out = tile_schemas.update_tiles(stored, p, range(5, 8))
    return out.where("z = 6").groupBy("z", "x", "y").agg(F.count("*").alias("features"))


# Functions


@query("SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_brand || '; ' || p_name || ' ;x', ';'), lambda v: trim(v, ' ')), '|') AS vals, 'w' || p_partkey AS element, replace('sep' || p_name, 'sep', '') AS bare, p_brand || '%' AS raw, '3/4/' || p_partkey || '.mvt' AS path, '{\"a\":' || p_partkey || '}' AS js FROM part")
def text_functions(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.array_join(tags.split_values(F.concat("p_brand", F.lit("; "), "p_name", F.lit(" ;x"))), "|").alias("vals"), text.element_key(F.lit("way"), F.col("p_partkey")).alias("element"),
        text.strip_separator(F.concat(F.lit("\u001e"), "p_name")).alias("bare"), F.url_decode(F.element_at(F.split(text.tile_path(F.lit(3), F.lit(4).cast("long"), F.col("p_partkey"), F.concat("p_brand", F.lit("%"))), "/"), 1)).alias("raw"),
        text.tile_path(F.lit(3), F.lit(4).cast("long"), F.col("p_partkey")).alias("path"), F.to_json(F.create_map(F.lit("a"), "p_partkey")).alias("js"),
    )


@query("SELECT user_id AS id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS authors FROM events GROUP BY ALL")
def author_lists(spark, sf):
    """Comma-separated author sets grown one author at a time."""
    sets = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set("event_type")).alias("a"))
    grown = F.aggregate("a", F.lit(""), lambda acc, x: text.add_author(text.add_author(acc, x), x))
    return sets.select("id", grown.alias("authors"))


@query("SELECT event_id, date_trunc('day', ts)::DATE AS day, epoch_us(ts) // 1000 AS millis, epoch_us(ts) // 1000000 AS back FROM events")
def time_functions(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return fx.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), F.unix_millis(ts).alias("millis"), F.unix_timestamp(F.timestamp_millis(F.unix_millis(ts))).alias("back"))


@query(f"WITH {fx.POINTS}, t AS (SELECT event_id, {_x(9)} AS x, {_y(9)} AS y FROM p WHERE {_y(9)} BETWEEN 0 AND 511) SELECT event_id, round((x + 0.5) / 512 * 360 - 180, 6) AS lon, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 0.5) / 512)))), 6) AS lat FROM t")
def cell_centres(spark, sf):
    t = fx.points(spark, sf).select("event_id", geo.tile_x(F.col("lon"), 9).alias("x"), geo.tile_y(F.col("lat"), 9).alias("y")).where("y between 0 and 511")
    lon, lat = geo.cell_centre(F.col("x"), F.col("y"), 9)
    return t.select("event_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("WITH m AS (SELECT o_custkey AS g, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY ALL) SELECT g, k AS key, n, CAST(sum(n) OVER (PARTITION BY g) AS BIGINT) AS total FROM m")
def map_functions(spark, sf):
    """Occurrences in arrays as rows, and the sum of a map's values."""
    arrays = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.collect_list("o_orderpriority").alias("a"))
    rows = maps.count_values(arrays, ["g"], "a")
    total = rollups.as_map(rows.withColumnRenamed("n", "value"), "m", "g").select("g", maps.total(maps.null_if_empty(F.col("m"))).alias("total"))
    return rows.join(total, "g")


@query(f"WITH {fx.POINTS}, s AS (SELECT event_id, uid, abs(value) + 1 AS v FROM p) SELECT event_id, round(v / max(v) OVER (PARTITION BY uid), 9) AS support FROM s")
def normalise_support(spark, sf):
    s = fx.points(spark, sf).select("event_id", "uid", (F.abs("value") + 1).alias("v"))
    return matching.normalise_support(s, "uid", "v").select("event_id", F.round("v", 9).alias("support"))


@query(f"WITH {fx.BOXES}, s AS (SELECT id, abs(x) AS d1, w AS d2, y AS a FROM r) SELECT id, round(CASE WHEN greatest(d1, d2) > 0 THEN greatest(cos(a), 0) * least(d1, d2) / greatest(d1, d2) ELSE 0 END, 6) AS s, round(CASE id % 3 WHEN 0 THEN w WHEN 1 THEN 1.0 ELSE 2.0 - w END, 6) AS shown FROM r JOIN s USING (id)")
def similarity_functions(spark, sf):
    r = fx.boxes(spark, sf)
    side = F.when(F.col("id") % 3 == 0, "left").when(F.col("id") % 3 == 1, "both").otherwise("right")
    return r.select("id", F.round(matching.relative_similarity(F.abs("x"), F.col("w"), F.col("y")), 6).alias("s"), F.round(matching.display_number(side, F.col("w")), 6).alias("shown"))


@query("SELECT CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS shown, count(*) FILTER (event_type = 'error') AS gone FROM events")
def visible_or_previous(spark, sf):
    """Tags of visible elements, previous ones of deleted ones, and the filter of deletions."""
    e = fx.table(spark, sf, "events").select((F.col("event_type") != "error").alias("visible"))
    known = pipelines.known_tags(F.col("visible"), F.create_map(F.lit("now"), F.lit("1")), F.create_map(F.lit("before"), F.lit("1")))
    return e.agg(F.count_if(known["now"].isNotNull()).alias("shown"), F.count_if(~F.col("visible") & known["before"].isNotNull()).alias("gone"))


@query(f"WITH {fx.CHANGESETS} SELECT max(coalesce(closed_at, created_at)) AS end_time FROM c")
def end_time(spark, sf):
    return cs.end_time(fx.changesets(spark, sf))


@query(f"WITH {fx.POINTS}, s AS (SELECT DISTINCT uid FROM p WHERE event_type = 'purchase') SELECT uid AS key, count(*) AS n FROM p JOIN s USING (uid) GROUP BY ALL")
def footprint_selection(spark, sf):
    """Users who used a listed hashtag."""
    p = fx.points(spark, sf).withColumn("changeset", F.col("event_id"))
    listed = spark.createDataFrame([("purchase",)], "hashtag string")
    rows = footprints.target_points(p, p.select("changeset", F.col("event_type").alias("hashtag")), hashtags=listed)
    return rows.groupBy(F.col("key").cast("long").alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {fx.EDITS}, r AS (SELECT changeset, key, 1.0::DOUBLE AS v FROM ({_COUNT_ROWS}) UNION ALL SELECT changeset, key, v FROM ({_MEASURE_ROWS})) SELECT changeset, key AS name, round(sum(v), 3) AS value FROM r GROUP BY ALL HAVING sum(v) <> 0")
def stream_changeset_stats(spark, sf):
    """All 48 measures of a stream of prepared diffs by sequence, added to the stored ones; delivered twice, counted once."""
    rows = fx.edits(spark, sf).select("changeset", (F.col("changeset") % 8).alias("sequence"), F.lit(1).alias("uid"), "tags", "version", "minor_version", "visible", "linear_m", "area_m2")
    path = fresh_path(spark, "edits")
    rows.repartitionByRange(2, "sequence").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = stores.SnapshotTable(spark, fresh_path(spark, "table"), "changeset long, name string, value double")
    applied = stores.SnapshotTable(spark, fresh_path(spark, "applied"), "changeset long, sequence long")
    for k in range(2):
        jobs.start(stream, jobs.merge_into(table, applied, "changeset", pipelines.counts_rows), fresh_path(spark, "ck"), f"stats{k}").awaitTermination()
    return table.read().select("changeset", "name", F.round("value", 3).alias("value"))


@query(f"WITH {fx.BOXES}, {_NEAR}, o AS (SELECT a_id, b_id, a.w * a.h AS aa, b.w * b.h AS ba, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i FROM n JOIN r a ON a.id = a_id JOIN r b ON b.id = b_id) SELECT a_id, b_id, round(least(i / aa, i / ba), 5) AS min_share, round(greatest(i / aa, i / ba), 5) AS max_share FROM o WHERE aa > 0 AND ba > 0")
def building_shares(spark, sf):
    """Overlap shares of rings; the closed form of rectangles is the oracle."""
    return _similar(spark, sf, False).select("a_id", "b_id", F.round("min_share", 5).alias("min_share"), F.round("max_share", 5).alias("max_share"))


@query(
    f"""WITH {fx.BOXES}, {_NEAR}, q AS (SELECT a_id, b_id, a.x AS ax, a.y AS ay, b.x AS px, b.y AS py, floor(a.x / 0.5) AS i, floor(a.y / 0.5) AS j FROM n JOIN r a ON a.id = a_id JOIN r b ON b.id = b_id),
k AS (SELECT x AS cx, y AS cy, floor(x / 0.5) AS i, floor(y / 0.5) AS j FROM r WHERE id % 10 = 0),
d AS (SELECT *, sqrt(power(ax - cx, 2) + power(ay - cy, 2)) AS d1, sqrt(power(px - cx, 2) + power(py - cy, 2)) AS d2 FROM q JOIN k USING (i, j)),
s AS (SELECT i, j, a_id, b_id, sum(coalesce((((ax - cx) * (px - cx) + (ay - cy) * (py - cy)) / nullif(d1 * d2, 0) + 1) / 2 * least(d1, d2) / nullif(greatest(d1, d2), 0), 0)) AS t FROM d GROUP BY ALL)
SELECT a_id, b_id, round(t / max(t) OVER (PARTITION BY i, j), 6) AS support FROM s"""
)
def building_support(spark, sf):
    """Relative similarities of near buildings over shared anchors, as shares of the greatest in a cell."""
    r = fx.boxes(spark, sf)
    pairs = matching.candidate_pairs(r.where("side = 0"), r.where("side = 1"), 0.05, 0.05)
    return matching.anchor_support(pairs, r.where("id % 10 = 0"), 0.5).where("support is not null").select("a_id", "b_id", F.round("support", 6).alias("support"))


@query(f"WITH {fx.BOXES} SELECT a.id AS a_id, b.id AS b_id FROM r a JOIN r b ON a.side = 0 AND b.side = 1 AND a.x - 0.01 <= b.x + b.w AND b.x <= a.x + a.w + 0.01 AND a.y - 0.01 <= b.y + b.h AND b.y <= a.y + a.h + 0.01")
def near_buildings(spark, sf):
    """Pairs of buildings whose envelopes are at most 0.01 apart, however large they are."""
    left, right = _rings(spark, sf)
    return matching.near_boxes(left, right, 0.01, 0.1)


def _rings(spark, sf):
    r = fx.boxes(spark, sf)
    at = lambda dx, dy: F.struct((F.col("x") + dx * F.col("w")).alias("x"), (F.col("y") + dy * F.col("h")).alias("y"))
    rings = r.select("id", "side", F.array(*[at(*d) for d in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]).alias("ring"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"))
    return tuple(matching.buildings(rings.where(f"side = {k}")) for k in (0, 1))


@query()
def building_probabilities(spark, sf):
    """Shape scores and anchor support of all near pairs."""
    left, right = _rings(spark, sf)
    return matching.building_probabilities(left, right.unionByName(left.where("id % 10 = 0").withColumn("id", F.col("id") + 1_000_000)), 0.01, 0.1)
