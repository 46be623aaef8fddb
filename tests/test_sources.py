"""Readers, feeds and streams."""

import json

import pytest
from pyspark.sql import functions as F

from kartolith.operators import stores
from kartolith.sources import feeds, files
from kartolith.streaming import jobs


def test_csv(spark, tmp_path):
    text = 'id,changeset_id,author_id,body,created_at,visible\n1,2,3,"two\nlines, ""quoted""",2020-01-01T00:00:00Z,true\n4,5,,,,\n'
    (tmp_path / "c.csv").write_text(text)
    one, two = files.read_csv(spark, str(tmp_path / "c.csv"), files.DUMPS["changeset_comments"]).orderBy("id").collect()
    assert one.body == 'two\nlines, "quoted"' and one.visible and one.author_id == 3
    assert two.body is None and two.author_id is None and two.created_at is None


def test_history(spark, tmp_path):
    row = spark.sql("select 1L id, 'node' type, map('a', 'b') tags, cast(1.5 as decimal(9,7)) lat, cast(2.5 as decimal(10,7)) lon, array(named_struct('ref', 7L)) nds, cast(null as array<struct<type:string,ref:long,role:string>>) members, 3L changeset, timestamp'2020-01-01' timestamp, 4L uid, 'u' user, 1L version, true visible")
    files.write_orc(row, str(tmp_path / "h"), 1)
    got = files.read_history(spark, str(tmp_path / "h")).first()
    assert (got.lat, got.lon, got.nds, got.tags) == (1.5, 2.5, [7], {"a": "b"})


def test_lists_diffs_countries(spark, tmp_path):
    (tmp_path / "l").write_text("  Foo\n\nbar\nfoo\n")
    assert sorted(r.hashtag for r in files.read_list(spark, str(tmp_path / "l")).collect()) == ["bar", "foo"]
    point = lambda i, x: {"id": i, "type": "Feature", "geometry": {"type": "Point", "coordinates": [x, 1]}, "properties": {"id": "5"}}
    lines = ["\u001e" + json.dumps({"type": "FeatureCollection", "features": [point("old", 1), point("new", 2)]}), "", json.dumps({"features": [point("new", 3)]})]
    (tmp_path / "d").write_text("\n".join(lines))
    got = files.read_diffs(spark, str(tmp_path / "d")).orderBy(F.col("old").isNull()).collect()
    assert got[0].old.geometry.coordinates == "[1,1]" and got[0].new.properties == {"id": "5"} and got[1].old is None and got[1].new.id == "new"
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = [{"type": "Feature", "geometry": {"type": t, "coordinates": c}, "properties": {"name": n, "code": n[0]}} for t, c, n in (("Polygon", [ring], "Aa"), ("MultiPolygon", [[ring], [ring]], "Bb"))]
    (tmp_path / "c").write_text("\n".join(map(json.dumps, shapes)))
    a, b = files.read_countries(spark, str(tmp_path / "c")).orderBy("code").collect()
    assert (a.name, a.code, len(a.polygons), len(b.polygons)) == ("Aa", "A", 1, 2) and a.polygons[0][0][1].x == 1.0


@pytest.fixture
def feed(tmp_path):
    for s in range(10, 16):
        (tmp_path / f"{s}.json").write_text("".join(json.dumps({"id": s * 10 + k, "type": "node", "changeset": k, "lon": 1.5}) + "\n" for k in range(3)))
    return str(tmp_path)


def test_bounded_feed(spark, feed):
    feeds.register(spark)
    read = lambda **o: spark.read.format("sequence_feed").options(path=feed, **o).load()
    assert read().count() == 18 and sorted({r.sequence for r in read(start_sequence=12, end_sequence=14).collect()}) == [12, 13]
    assert read(start_sequence=40).count() == 0 and read().select("lon").distinct().first().lon == 1.5


def test_streamed_feed_equals_bounded(spark, feed, tmp_path):
    feeds.register(spark)
    stream = spark.readStream.format("sequence_feed").options(path=feed, start_sequence=11, batch_size=2).load()
    table = stores.SnapshotTable(spark, f"file://{tmp_path}/t", "changeset long, name string, value double")
    applied = stores.SnapshotTable(spark, f"file://{tmp_path}/a", "changeset long, sequence long")
    rows = stream.select("changeset", F.col("type").alias("name"), F.lit(1.0).alias("value"), "sequence")
    q = jobs.start(rows, jobs.merge_into(table, applied, "changeset"), f"{tmp_path}/ck", "feed", once=False)
    q.processAllAvailable()
    q.stop()
    assert {(r.changeset, r.value) for r in table.read().collect()} == {(k, 5.0) for k in range(3)}


def test_late_rows(spark, tmp_path):
    """Sequences in order, one file a batch: stream and batch agree, the last group included."""
    df = spark.createDataFrame([(s, "c", 1.0) for s in (1, 2, 2, 3, 4) for _ in range(2)], "sequence long, category string, value double")
    for s in range(1, 5):
        df.where(F.col("sequence") == s).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.stats_by_sequence(stream, "value", "category").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {(r.sequence, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.sequence, r.n, r.total) for r in jobs.stats_by_sequence(df, "value", "category").collect()}
