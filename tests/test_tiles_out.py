"""Tile bytes round trip; commands run end to end."""

from kartolith import cli
from kartolith.operators import footprints, tiles, vector_tiles


def test_layer_round_trip():
    rows = [(7, 3, -4, {"a": 1, "b": "é", "c": 2.5, "d": True, "e": -9}), (None, 4095, 0, {"a": 1}), (0, 0, 0, {})]
    raw = vector_tiles.tile({"x": vector_tiles.layer("x", rows), "y": vector_tiles.layer("y", [])})
    assert vector_tiles.decode(raw) == {"x": rows, "y": []}


def test_commands(spark, tmp_path):
    points = spark.createDataFrame([(2020001, 1.0, 2.0), (2020001, 1.0, 2.0), (2020002, -50.0, 20.0)], "key int, lon double, lat double")
    footprints.edit_histogram(points).write.parquet(f"{tmp_path}/cells")
    cli.main(["export-tiles", "--input", f"{tmp_path}/cells", "--output", f"{tmp_path}/sizes", "--folder", f"{tmp_path}/tiles"], spark)
    assert spark.read.parquet(f"{tmp_path}/sizes").count() == len(list((tmp_path / "tiles").rglob("*.mvt")))
    top = vector_tiles.decode((tmp_path / "tiles/0/0/0.mvt").read_bytes())["edits"]
    assert sorted(sum(v for k, v in f[3].items() if k != "__id") for f in top) == [1, 2] and all(0 <= f[1] < 4096 for f in top)
    v = spark.sql("select 1L id, 1 version, 0 minor_version, timestamp'2020-01-01' updated, 'a' author, true visible")
    v.write.parquet(f"{tmp_path}/v")
    cli.main(["elements", "--input", f"{tmp_path}/v", "--output", f"{tmp_path}/s", "--schema", "history"], spark)
    assert spark.read.parquet(f"{tmp_path}/s").first().valid_until is None
    assert tiles.Grid(3, 8).bits == 3


def test_read_back(spark, tmp_path):
    points = spark.createDataFrame([(2020001, 1.0, 2.0), (2020002, -50.0, 20.0)], "key int, lon double, lat double")
    cells = footprints.edit_histogram(points, zooms=[0, 5])
    vector_tiles.export(vector_tiles.encode_tiles(tiles.vectorize(cells), "edits", 7), str(tmp_path / "t")).collect()
    got = vector_tiles.read_tiles(spark, str(tmp_path / "t")).collect()
    assert sorted((r.z, r.x, r.y, r.id) for r in got) == sorted((r.z, r.x, r.y, r.cell) for r in cells.collect())
    assert vector_tiles.read_tiles(spark, str(tmp_path / "none")).count() == 0
