"""Views shaped like map edits over the driver's tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: part type -> tag
TAGS = {"ECONOMY": ("highway", "residential"), "STANDARD": ("waterway", "river"), "PROMO": ("building", "yes"), "SMALL": ("railway", "rail"), "LARGE": ("landuse", "forest"), "MEDIUM": ("natural", "coastline")}

EDITS = """e AS (
  SELECT l_orderkey AS changeset, l_partkey AS id, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS version, l_linenumber % 2 AS minor_version,
    l_returnflag <> 'R' AS visible, l_shipdate AS updated, l_linenumber, l_quantity * 10 AS linear_m, l_extendedprice AS area_m2, s_nationkey AS country, p_type, p_brand
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

POINTS = """p AS (
  SELECT event_id, user_id AS uid, ts, event_type, value,
    ((event_id * 7919) % 36000) / 100 - 180 AS lon, ((event_id * 104729) % 17000) / 100 - 85 AS lat,
    CAST(year(ts) * 1000 + dayofyear(ts) AS INT) AS key, CAST(floor((epoch(ts) - 1347432900) / 60) AS BIGINT) AS sequence
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element edits with tags; small dimensions are left to the planner."""
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    kinds = F.create_map(*[x for k, (a, b) in TAGS.items() for x in (F.lit(k), F.create_map(F.lit(a), F.lit(b)))])
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("changeset"), F.col("l_partkey").alias("id"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("version"),
        (F.col("l_linenumber") % 2).alias("minor_version"), (F.col("l_returnflag") != "R").alias("visible"), F.col("l_shipdate").alias("updated"), "l_linenumber",
        (F.col("l_quantity") * 10).alias("linear_m"), F.col("l_extendedprice").alias("area_m2"), F.col("s_nationkey").alias("country"), "p_type", "p_brand",
        F.try_element_at(kinds, F.col("p_type")).alias("tags"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.time import day_key, sequence_of

    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("uid"), "ts", "event_type", "value",
        ((F.col("event_id") * 7919) % 36000 / 100 - 180).alias("lon"), ((F.col("event_id") * 104729) % 17000 / 100 - 85).alias("lat"),
        day_key(F.col("ts")).alias("key"), sequence_of(F.col("ts")).alias("sequence"),
    )


def changesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as changesets: pending ones are open."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uid"), F.col("c_name").alias("user"), F.col("o_orderpriority").alias("editor"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("interval 1 day")).alias("closed_at"),
    )


CHANGESETS = """c AS (
  SELECT o_orderkey AS id, o_custkey AS uid, c_name AS "user", o_orderpriority AS editor, o_orderdate AS created_at,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 DAY END AS closed_at
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """changeset, hashtag pairs."""
    return edits(spark, sf_dir).select("changeset", F.lower(F.regexp_replace("p_brand", "Brand#", "tag-")).alias("hashtag")).distinct()


BRIDGE = """b AS (SELECT DISTINCT changeset, lower(replace(p_brand, 'Brand#', 'tag-')) AS hashtag FROM e)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of embeddings: x, y, w, h and the dataset (even or odd)."""
    v = table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    return v.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 2).alias("side"), at(0).alias("x"), at(1).alias("y"), F.abs(at(2)).alias("w"), F.abs(at(3)).alias("h"))


BOXES = """r AS (SELECT vec_id AS id, vec_id % 2 AS side, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, abs(CAST(embedding[3] AS DOUBLE)) AS w, abs(CAST(embedding[4] AS DOUBLE)) AS h FROM embeddings)"""


WAY_BASE = 10_000_000

HISTORY = f"""nv AS (
  SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, ts AS tm, event_id % 499 AS changeset, event_id % 7 AS uid, event_type AS kind, event_type <> 'error' AS visible,
    CASE WHEN event_type <> 'error' THEN ((event_id * 7919) % 36000) / 100 - 180 END AS raw_lon, CASE WHEN event_type <> 'error' THEN ((event_id * 104729) % 17000) / 100 - 85 END AS raw_lat
  FROM events WHERE event_type <> 'purchase'),
nc AS (SELECT *, last_value(raw_lon IGNORE NULLS) OVER w AS lon, last_value(raw_lat IGNORE NULLS) OVER w AS lat, lead(tm) OVER (PARTITION BY id ORDER BY tm, version) AS until
  FROM nv WINDOW w AS (PARTITION BY id ORDER BY tm, version ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT *, lon IS NOT DISTINCT FROM lag(lon) OVER o AND lat IS NOT DISTINCT FROM lag(lat) OVER o AS same FROM nc WINDOW o AS (PARTITION BY id ORDER BY tm, version)),
w0 AS (SELECT {WAY_BASE} + user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, ts AS tm, event_id % 499 AS changeset, event_id % 7 AS uid, event_id % 50 <> 0 AS visible,
    [user_id, user_id + 1, user_id + 2] AS nds, user_id % 4 AS kind
  FROM events WHERE event_type = 'purchase' AND event_id % 10 < 3),
w AS (SELECT *, lead(tm) OVER (PARTITION BY id ORDER BY tm, version) AS until FROM w0)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as element versions: a purchase (three in ten) makes a way version over three nodes, anything else a node version."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    one = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    alive = F.col("event_type") != "error"
    common = [(F.col("event_id") % 499).alias("changeset"), F.col("ts").alias("timestamp"), (F.col("event_id") % 7).alias("uid")]
    version = F.row_number().over(order).cast("long").alias("version")
    nodes = e.where("event_type <> 'purchase'").select(
        F.col("user_id").alias("id"), F.lit("node").alias("type"),
        F.when(F.col("event_type") == "click", one("amenity", "cafe")).when(F.col("event_type") == "view", one("railway", "station")).when(F.col("event_type") == "error", one("man_made", "pier")).otherwise(F.create_map().cast("map<string,string>")).alias("tags"),
        F.when(alive, (F.col("event_id") * 104729) % 17000 / 100 - 85).alias("lat"), F.when(alive, (F.col("event_id") * 7919) % 36000 / 100 - 180).alias("lon"),
        F.lit(None).cast("array<long>").alias("nds"), *common, version, alive.alias("visible"),
    )
    kind = F.col("user_id") % 4
    ways = e.where("event_type = 'purchase' AND event_id % 10 < 3").select(
        (F.col("user_id") + WAY_BASE).alias("id"), F.lit("way").alias("type"),
        F.when(kind == 0, one("highway", "residential")).when(kind == 1, one("waterway", "river")).when(kind == 2, one("building", "yes")).otherwise(one("railway", "rail")).alias("tags"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array(F.col("user_id"), F.col("user_id") + 1, F.col("user_id") + 2).alias("nds"), *common, version, (F.col("event_id") % 50 != 0).alias("visible"),
    )
    return nodes.unionByName(ways)
